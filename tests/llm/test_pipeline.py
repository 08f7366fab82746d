import corpus_pipeline as cp
from textmill.llm.common import Scratch, read_table

from .conftest import ODD


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    scratch = Scratch(spark, "test")
    docs = read_table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        assert docs.columns == cp.COLUMNS and 0 < docs.count() <= before
        before = docs.count()
    last = scratch.table(cp.STAGES[-1][1](spark, docs, sf_dir), "last")
    assert last.select("doc_id").distinct().count() == before
    assert last.filter("start = 0").count() == before


NAMES = ("row", "o", "h", "g", "all", "id", "th", "runs", "lines", "kept", "own", "n_lines", "n_removed", "score", "class_id", "n_links", "key", "part", "start")


def test_odd_documents(spark, make_docs, sf_dir):
    """Every stage takes nulls, empty and very long texts, repeated rows, rows without an id and columns of any name."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i * 7919 % 300_007}" for i in range(150_000))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, "no id"), (None, None), (500, long), (501, "y" * 2_000_000), (502, long.replace("word", "other"))]
    docs, none = make_docs(rows), make_docs([])
    for name in NAMES:
        docs, none = docs.withColumn(name, F.lit("mine")), none.withColumn(name, F.lit("mine"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == cp.COLUMNS
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert {500, 501, 502, None, 8} <= ids, name
        assert stage(spark, none, sf_dir).count() == 0, name


def test_rows_without_an_id_are_decontaminated(spark, make_docs, sf_dir):
    item = read_table(spark, sf_dir, "benchmark").filter("length(text) > 60").first().text
    rows = [(None, f"before {item} after"), (1, item), (1, "clean text of its own"), (None, "clean text of its own, too"), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in cp.decontamination(spark, make_docs(rows), sf_dir).collect()), key=str)
    assert got == sorted([rows[2], rows[3], rows[4]], key=str)


def test_one_of_each_group_stays(spark, make_docs, sf_dir):
    text = " ".join(f"w{i}" for i in range(200))
    docs = make_docs([(5, text), (2, text), (9, text + " more"), (4, "other words here that stand alone")])
    assert {r.doc_id for r in cp.near_dup(spark, docs, sf_dir).collect()} == {2, 4}


def test_whole_repeats_go_with_their_lines(spark, make_docs, sf_dir):
    line = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(1, line), (2, line), (3, line + "\nown line"), (4, ""), (5, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, docs, sf_dir).collect()}
    assert got == {1: (line, len(line)), 3: ("own line", 8), 4: ("", 0), 5: ("", 0)}


def test_near_duplicates_row_by_row(spark, make_docs, sf_dir):
    text = lambda name: " ".join(f"{name}{i}" for i in range(200))
    a, b, c, d, e = (text(x) for x in "abcde")
    rows = [(1, a), (1, a), (1, a)]  # a repeated row: one stays
    rows += [(2, b), (3, c), (3, b + " more")]  # shares its id with another text and is a near copy of the second document
    rows += [(None, d), (None, e), (None, e + " more"), (None, a)]  # without an id: alone, near copies, a copy of a document with one
    rows += [(4, ""), (4, ""), (4, None), (5, "…"), (None, ""), (None, "")]  # without words
    got = sorted(((r.doc_id, r.text) for r in cp.near_dup(spark, make_docs(rows), sf_dir).collect()), key=str)
    several = [x for x in got if x[0] is None and x[1] and x[1].startswith("e0 ")]
    assert len(several) == 1
    got.remove(several[0])
    got = sorted((i, t or "") if i == 4 else (i, t) for i, t in got if i is not None), sorted(t for i, t in got if i is None)
    assert got == ([(1, a), (2, b), (3, c), (4, ""), (5, "…")], ["", "", d])
