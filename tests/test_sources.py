import json

import pytest
from pyspark.sql import functions as F

from textmill.operators import folds
from textmill.sources import html, readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_answers(spark, tmp_path):
    p = write(tmp_path / "qa.jsonl", "\n".join(json.dumps({"question": "q", "human_answers": h, "chatgpt_answers": a}) for h, a in ((["h one", "h two"], ["a one"]), ([], ["a two"]))))
    items = readers.read_jsonl(spark, p, readers.QA)
    items = items.withColumn("line", F.when(F.size("human_answers") > 0, 0).otherwise(1))
    rows = readers.make_rows(readers.parse_answers(items, "finance"), "hc3", {"finance": "web"}, {"chatgpt": "gpt-3.5"}).orderBy("id").collect()
    assert [(r.id, r.label, r.generator, r.grp) for r in rows] == [
        ("hc3:finance:0:a0", 1, "gpt-3.5", "hc3:finance:0"), ("hc3:finance:0:h0", 0, "human", "hc3:finance:0"), ("hc3:finance:0:h1", 0, "human", "hc3:finance:0"), ("hc3:finance:1:a0", 1, "gpt-3.5", "hc3:finance:1"),
    ]


def test_jsonl_strict_and_lenient(spark, tmp_path):
    p = write(tmp_path / "x.jsonl", '{"id": "1"}\nnot json\n')
    assert readers.read_jsonl(spark, p, "id string", lenient=True).count() == 1
    assert readers.read_jsonl(spark, p + ".missing", "id string", lenient=True).count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl(spark, p, "id string").collect()


def test_coded(spark, tmp_path):
    head = "﻿text,label,src\n"
    body = '"one two, ""quoted""\nline",1,cmv_human\nx y z,0,cmv_machine_continuation_flan_t5_base\n'
    items = readers.read_csv(spark, write(tmp_path / "t.csv", head + body), ["text", "label", "src"]).withColumn("line", F.when(F.col("label") == "1", 0).otherwise(1))
    rows = readers.parse_coded(items, "train").orderBy("id").collect()
    assert rows[0].text == 'one two, "quoted"\nline' and rows[0].label == 0 and rows[0].generator == "human"
    assert (rows[1].sub_source, rows[1].generator, rows[1].label, rows[1].meta["prompt_type"]) == ("cmv", "flan_t5_base", 1, "continuation")
    ood = spark.createDataFrame([("a", "1", "cnn_human", 0), ("b", "0", "cnn_gpt4", 1), ("c", "0", "cnn_human_para", 2)], "text string, label string, src string, line int")
    got = readers.parse_coded(ood, "test_ood_para", True, ("cnn",), repeats_humans=True).orderBy("id").collect()
    assert [(r.generator, r.grp) for r in got] == [("gpt4", "ood:cnn"), ("gpt-3.5-trubo", "ood:cnn")]
    for bad in (("a", "0", "cmv_human", 0), ("a", "0", "what_ever", 0)):
        with pytest.raises(Exception):
            readers.parse_coded(spark.createDataFrame([bad], "text string, label string, src string, line int"), "train").collect()


def test_attacked(spark):
    s = "id string, source_id string, domain string, model string, attack string, decoding string, repetition_penalty string, generation string"
    rows = [("1", "s", "news", "human", "none", "", "", "t"), ("2", "s", "news", "gpt4", "none", "greedy", "no", "u"), ("3", "s", "news", "gpt4", "zero_width", "greedy", "no", "v")]
    got = readers.parse_attacked(spark.createDataFrame(rows, s), ["news"]).orderBy("id").collect()
    assert [(r.id, r.label, r.grp) for r in got] == [("1", 0, "s"), ("2", 1, "s")] and got[0].meta == {"attack": "none"} and got[1].meta["decoding"] == "greedy"
    with pytest.raises(Exception):
        readers.parse_attacked(spark.createDataFrame([("1", "s", "blog", "human", "zero_width", "", "", "t")], s), ["news"]).collect()
    with pytest.raises(Exception):
        readers.make_rows(readers.parse_attacked(spark.createDataFrame(rows, s), ["news"]), "raid", {"other": "x"}).collect()


def test_tsv_and_digests(spark, tmp_path):
    p = write(tmp_path / "u.tsv", "# comment\nhttps://a.b\tnews\n\nhttps://c.d\n")
    assert [tuple(r) for r in readers.read_tsv(spark, p, ["url", "kind"]).collect()] == [("https://a.b", "news"), ("https://c.d", None)]
    assert len(readers.file_digests(spark, p).first().sha256) == 64


def test_html():
    page = '<p>One<br>two</p><table><tr><td><p>no</p></td></tr></table><p>Three <sup class="reference">[1]</sup>four</p><blockquote><p>no</p><div><p>no</p></div></blockquote><p>Five'
    got, skipped = html.paragraphs_of(page)
    assert got == ["One two", "Three four", "Five"] and skipped == {"table": 1, "sup": 1, "blockquote": 1}


def long(name):
    return f"{name} " + "some words of a paragraph that is long enough to be read on its own " * 4


#: Which texts of a page count; the name stands in the text.
CASES = [
    ("plain", True, "<p>{}</p>"),
    ("in-article", True, "<article><p>{}</p><p>short</p></article>"),
    ("item", True, "<ul><li>{}</li></ul>"),
    ("footnote", True, '<p>{} <a href="#">link</a><sup>[1]</sup></p>'),
    ("with-script", True, "<p>{}<script>var never = 1;</script><style>.never{{}}</style></p>"),
    ("icon", True, '<p>{} <span aria-hidden="true" class="icons">never</span></p>'),
    ("hidden-from-readers", True, '<div aria-hidden="true"><p>{}</p></div>'),
    ("form", True, "<form><p>{}</p><input></form>"),
    ("inline-code", True, "<p>{} <code>kept</code></p>"),
    ("open-details", True, "<details open><summary>More</summary><p>{}</p></details>"),
    ("nav", False, "<nav><ul><li>{}</li></ul></nav>"),
    ("role-navigation", False, '<div role="navigation"><ul><li>{}</li></ul></div>'),
    ("header", False, "<header><p>{}</p></header>"),
    ("footer", False, "<footer><p>{}</p></footer>"),
    ("contentinfo", False, '<div role="contentinfo"><p>{}</p></div>'),
    ("banner", False, '<div role="banner"><p>{}</p></div>'),
    ("search", False, '<div role="search"><p>{}</p></div>'),
    ("cookies", False, '<div role="dialog" aria-label="x"><p>{}</p></div>'),
    ("alert", False, '<div role="alertdialog"><p>{}</p></div>'),
    ("dialog", False, "<dialog open><p>{}</p></dialog>"),
    ("display-none", False, '<p style="display: none">{}</p>'),
    ("hidden", False, "<p hidden>{}</p>"),
    ("details", False, "<details><summary>More</summary><p>{}</p></details>"),
    ("editable", False, '<div contenteditable="true"><p>{}</p></div>'),
    ("textbox", False, '<div role="textbox"><p>{}</p></div>'),
    ("textarea", False, "<textarea>{}</textarea>"),
    ("code", False, "<ul><li><pre><code>{}</code></pre></li></ul>"),
    ("template", False, "<template><p>{}</p></template>"),
]


@pytest.mark.parametrize("name, counts, page", CASES)
def test_candidates(name, counts, page):
    for around in ("{}", "<html><body><main><section>{}</section></main></body></html>"):
        got = [c["text"] for c in html.candidates_of(around.format(page.format(long(name)))).candidates]
        assert len(got) == counts and all(t.startswith(f"{name} some") and "never" not in t for t in got)
        assert name != "inline-code" or got[0].endswith("kept")


def test_short_and_nested_candidates():
    texts = lambda page, least=1: [c["text"] for c in html.candidates_of(page, least).candidates]
    assert texts("<article>Direct text</article>") == ["Direct text"] and texts("<article>Direct text</article>", 15) == []
    assert texts("<article><p>Inner</p></article>") == ["Inner"] and texts("<li>a <p>inner</p></li>") == ["inner"]
    assert texts(f"<article>{long('own')}<p>short</p></article>", 15) == [" ".join(long("own").split()) + " short"]
    assert texts("<p>one<p>two<ul><li>a<li>b<ul><li>c</ul></ul>") == ["one", "two", "a", "c"]
    assert texts("") == texts(None) == texts("<p></p></div><p>") == [] and texts("<p>a</b></i>b</p>") == ["ab"]
    assert texts("<div>" * 3000 + "<p>deep</p>") == ["deep"]


def test_language_of_candidates():
    got = html.candidates_of('<html lang="de-AT"><p>eins</p><div lang="EN"><p>two</p></div></html>', 1).candidates
    assert [c["lang"] for c in got] == ["de", "en"]


def test_sensitive():
    asks = lambda page: html.candidates_of(page).sensitive
    assert asks('<input type="password">') and asks('<input autocomplete="cc-number">') and asks('<form><input autocomplete="one-time-code"></form>')
    assert not asks('<dialog><input type="password"></dialog>') and not asks('<div aria-modal="true"><input type="password"></div>')
    assert not asks('<div hidden><input type="password"></div>') and not asks('<input autocomplete="name">')


def test_candidate_breaks():
    c = html.candidates_of("<div><p>a</p><p>b</p><h2>t</h2><p>c</p><hr><p>d</p></div>", 1).candidates
    assert c[0]["break_key"] == c[1]["break_key"] and len({x["break_key"] for x in c}) == 3 and len({x["container"] for x in c}) == 1
    c = html.candidates_of(f"<ul><li>{long('a')}<ul><li>b</ul><li>{long('c')}</ul>", 15).candidates
    assert len(c) == 2 and c[0]["break_key"] == c[1]["break_key"]  # the list lies in the first one


def test_groups_are_made_while_reading(spark):
    page = "<div>" + "".join(f"<p>{long(f'p{i}')}</p>" for i in range(8)) + "</div>"
    got = html.candidates(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), limits=(600, 2000)).collect()
    sizes = [(r.text_length, r.words, r.lang, r.break_key) for r in sorted(got, key=lambda r: r.pos)]
    for k, limit in enumerate((600, 2000)):
        assert [r.groups[k] for r in sorted(got, key=lambda r: r.pos)] == folds.fold_runs(sizes, limit, 120, None)
    assert len(got) == 8 and len({r.groups[0] for r in got}) > len({r.groups[1] for r in got}) >= 2


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    one = sinks.write_rows(rows, path)
    assert one == sinks.write_rows(rows.repartition(2), path) and spark.read.json(path).count() == 2
    sinks.check_pinned(one, {"n": 2})
    with pytest.raises(sinks.DataError):
        sinks.check_pinned(one, {"n": 3})
    with pytest.raises(sinks.DataError):
        sinks.write_rows(rows.union(rows), path)
    assert spark.read.json(path).count() == 2
    s = rows.withColumn("split", F.when(F.col("id") == "a", "train").otherwise("test"))
    sinks.write_splits(s, path + "-splits")
    assert spark.read.parquet(path + "-splits/split=test").count() == 1
    assert sinks.write_splits(s, path + "-splits", by=["v"]) == {"train": 1, "test": 1} and spark.read.parquet(path + "-splits-report").count() == 2
    assert [r.id for r in spark.read.parquet(path + "-splits-ids").orderBy("split").collect()] == ["b", "a"]
    texts = spark.createDataFrame([("a", "x", "web"), ("b", " ", "web"), ("c", None, "web"), ("d", "", "chat"), ("e", "y", "chat")], "id string, text string, sub string")
    got = sinks.write_rows(texts, path + "-counted", text="text", excluded=F.col("sub") == "chat")
    assert (got["n"], got["excluded"], got["empty"]) == (1, 2, 2)
    sinks.export_feedback(spark.createDataFrame([("b", 9), ("a", 3)], "id string, at long"), path + "-feedback")
    assert [r.id for r in spark.read.json(path + "-feedback").collect()] == ["a", "b"]
    sinks.check_frozen(spark.createDataFrame([("b",)], "id string"), s)
    with pytest.raises(sinks.DataError):
        sinks.check_frozen(spark.createDataFrame([("a",)], "id string"), s)
