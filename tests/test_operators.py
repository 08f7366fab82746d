import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textmill.functions import scores as fs
from textmill.operators import counts, dedup, folds, grading, hosts, layout, metrics, split, store


def brute_auroc(rows):
    ai, human = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not ai or not human:
        return None
    return sum((a > h) + 0.5 * (a == h) for a in ai for h in human) / len(ai) / len(human)


def test_auroc_and_thresholds(spark):
    rnd = random.Random(1)
    groups = {g: [(rnd.randint(0, 1), rnd.randint(0, 30) / 10) for _ in range(n)] for g, n in (("a", 200), ("b", 7), ("c", 900))}
    groups["one"] = [(1, 0.5)] * 4
    rows = [(g, y, s) for g, x in groups.items() for y, s in x]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    for r in metrics.auroc(df, ["g"]).collect():
        want = brute_auroc(groups[r.g])
        assert r.auroc == want if want is None else abs(r.auroc - want) < 1e-12
    for target in (0.01, 0.1, 0.5):
        got = metrics.thresholds(df, ["g"], target=target).collect()
        for r in got:
            v = sorted(s for _, s in groups[r.g])
            allowed = int(target * len(v))
            if not allowed:
                assert r.threshold is None
                continue
            flagged = [s for s in v if (s > r.threshold if r.strict else s >= r.threshold)]
            assert len(flagged) <= allowed and r.threshold == v[len(v) - allowed]
            lower = [s for s in set(v) if s < r.threshold or r.strict and s == r.threshold]
            assert not lower or len(flagged) + v.count(max(lower)) > allowed
    h = spark.range(1000).select(F.col("id").cast("double").alias("score"))
    r = metrics.thresholds(h, []).first()
    assert (r.threshold, r.strict) == (990.0, False)


def test_measures(spark):
    rows = [(1, 0.9, True)] * 6 + [(1, 0.2, False)] * 2 + [(0, 0.8, True)] + [(0, 0.1, False)] * 3
    df = spark.createDataFrame([("x", *r) for r in rows] + [("only_ai", 1, 0.9, True)], "g string, label int, score double, flag boolean")
    got = {r.g: r for r in metrics.measures(df, ["g"], df.filter("g = 'x'")).collect()}
    assert (got["x"].detected, got["x"].fa, got["x"].f1) == (0.75, 0.25, 0.8)
    assert got["only_ai"].fa is None and got["only_ai"].human == 0 and got["only_ai"].auroc == 1.0 and got["only_ai"].f1 == pytest.approx(2 / 3, abs=1e-6)
    alone = {r.g: r for r in metrics.measures(df, ["g"]).collect()}
    assert alone["only_ai"].auroc is None and alone["only_ai"].detected == 1.0


def test_best_threshold_and_accuracy(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 100) / 100) for _ in range(80)]
    df = spark.createDataFrame(rows, "label int, score double")
    acc = lambda t: sum((s >= t) == (y == 1) for y, s in rows) / len(rows)
    best, at = acc(0.5), 0.5
    for k in range(1, 100):
        if acc(k / 100) > best:
            best, at = acc(k / 100), k / 100
    assert tuple(metrics.best_threshold(df).first()) == (at, best)
    assert metrics.best_accuracy(df).first()[0] == pytest.approx(max(acc(s) for _, s in rows))


def test_temperature(spark):
    df = spark.createDataFrame([(x * 3.0, int(random.Random(10_000 + i).random() < 1 / (1 + math.exp(-x)))) for i, x in enumerate([random.Random(k).uniform(-3, 3) for k in range(800)])], "logit double, label int")
    assert 2 < metrics.temperature(df) < 4.5
    assert metrics.temperature(df.limit(5)) == 1.0


def test_levels_and_suggestions(spark):
    g = fs.Grading(0.75, 0.94, 120, 0.97)
    rows = [(0.75, 200, "yellow"), (0.94, 120, "red"), (0.749, 10, "green"), (0.95, 119, "uncertain"), (0.97, 20, "red"), (0.95, None, "red"), (None, 5, None)]
    df = spark.createDataFrame(rows, "p double, words int, want string")
    assert all(r.got == r.want for r in df.select("want", fs.level(F.col("p"), F.col("words"), g).alias("got")).collect())
    human = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.12, 0.14, 0.18, 0.22, 0.25, 0.3, 0.4, 0.5, 0.58]
    t = grading.suggest_thresholds(spark.createDataFrame([(0, h) for h in human] + [(1, 0.9)], "label int, score double")).first()
    assert (t.yellow_from, t.red_from) == (0.22, 0.59)
    t = grading.suggest_thresholds(spark.createDataFrame([(0, 0.99)] * 3, "label int, score double")).first()
    assert (t.yellow_from, t.red_from) == (0.98, 0.99)
    t = grading.suggest_thresholds(spark.createDataFrame([(0, 0.0)] * 3, "label int, score double")).first()
    assert (t.yellow_from, t.red_from) == (0.05, 0.06)
    bad = spark.createDataFrame([(0, 0.9), (1, 0.1)], "label int, score double")
    assert grading.verdict(bad).first().status == "fail" and grading.verdict(grading.oriented(bad)).first().status == "ok"


def test_hosts(spark):
    h = spark.createDataFrame([("a.b.example.com",), ("notexample.com",), ("example.com",), ("x.org",)], "host string")
    s = spark.createDataFrame([("example.com",), ("b.example.com",)], "site string")
    assert {tuple(r) for r in hosts.suffix_match(h, s).collect()} == {("a.b.example.com", "b.example.com"), ("example.com", "example.com")}
    d = spark.createDataFrame([(x,) for x in ("com", "a.com", "b.a.com", "c.b.a.com", "x.y", "a.com")], "domain string")
    assert {r[0] for r in hosts.compact(d).collect()} == {"com", "a.com", "x.y"}
    n = spark.createDataFrame([(x,) for x in ("https://WWW.Bank.de/login?x", " *.shop.co.uk ", "bad host", "nodots", "a.b:80")], "t string")
    assert [r[0] for r in n.select(hosts.normal_host(F.col("t"))).collect()] == ["bank.de", "shop.co.uk", None, None, "a.b"]
    c = spark.createDataFrame([("s1", "a.b.c"), ("s1", "d.e"), ("s2", "b.c"), ("s2", "d.e"), ("s3", "q.b.c")], "source string, domain string")
    assert {r.source: (r.n, r.added) for r in hosts.contributions(c, ["s1", "s2", "s3"]).collect()} == {"s1": (2, 2), "s2": (2, 0), "s3": (1, 0)}
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "site string")
    p = hosts.policies(h, one("x.org"), one("example.com"), one("b.example.com"), one("notexample.com"), "sites")
    assert {r.host: (r.reason, r.policy) for r in p.collect()} == {"a.b.example.com": (None, "manual"), "notexample.com": (None, "auto"), "example.com": ("builtin", "blocked"), "x.org": ("user", "blocked")}


def test_folds():
    en = lambda n, words, key=1, lang="en": (n, words, lang, key)
    assert folds.fold_runs([en(100, 20)] * 4, 2000, 120, ["en"]) == [1, 1, 1, 1]
    assert folds.fold_runs([en(100, 20), en(100, 20, 2), en(100, 20, 2)], 2000, 120, ["en"]) == [1, 2, 2]
    assert folds.fold_runs([en(100, 20), en(900, 150), en(100, 20), en(100, 20, lang="de"), en(100, 20)], 2000, 120, ["en"]) == [1, 2, 3, 4, 5]
    assert folds.fold_runs([en(999, 20), en(999, 20), en(1000, 20)], 2000, 120, None) == [1, 1, 2]
    assert folds.fold_batches([100] * 12) == [0] * 5 + [1] * 5 + [2] * 2
    assert folds.fold_batches([2400, 200, 3000, 10]) == [0, 1, 2, 3]
    assert folds.fold_batches([100] * 12, None) == [0] * 12
    assert folds.fold_lengths([5, 6, 20, 500, 600, 642]) == [0, 0, 0, 1, 1, 2]


def test_fold_dataframes(spark):
    rows = [(p, i, n, 10, "en", "k") for p in (1, 2) for i, n in enumerate([900, 900, 900, 100])]
    df = spark.createDataFrame(rows, "page_id long, pos int, text_length int, words int, lang string, break_key string")
    got = defaultdict(list)
    for r in folds.group_short(df, known=["en"]).orderBy("page_id", "pos").collect():
        got[r.page_id].append(r.grp)
    assert got == {1: [1, 1, 2, 2], 2: [1, 1, 2, 2]}
    kept = folds.drop_small_groups(folds.group_short(df), "page_id", "grp")
    assert kept.count() == 0
    assert {r.pos for r in folds.take_until(df.withColumn("words", F.lit(900)), "page_id").filter("page_id = 1").collect()} == {0, 1}


def item(text, x, y, h=10, w=None, eol=True):
    return {"str": text, "x": float(x), "y": float(y), "w": float(w if w is not None else 5 * len(text)), "h": float(h), "eol": eol}


def column(lines, top=700, x=72, leading=13):
    return [item(t, x, top - leading * i) for i, t in enumerate(lines)]


LINE = "some words of a running line that fill the whole column to the right"


def layout_pages(spark, docs):
    """docs: doc_id -> list of item lists, one for each page of 800 units."""
    rows = [(d, n + 1, 800.0, items) for d, pages in docs.items() for n, items in enumerate(pages)]
    return spark.createDataFrame(rows, f"doc_id long, number int, height double, items {layout.ITEMS}")


def test_layout(spark):
    first = column([LINE, LINE + " exam-", "ple goes on to the end."]) + column([LINE, "A second paragraph ends without"], top=600)
    second = column(["a full stop, so it goes on here.", "REFERENCES"], leading=40) + column(["[1] Some Author. A title."], top=600) + column(["APPENDIX"], top=500) + column([LINE + " again."], top=400)
    around = lambda n, items: [item("My running title", 72, 780), *items, item(f"{n}", 300, 20)]
    titled = [item("A larger title", 72, 700, h=16), *column([LINE, LINE + " ends."], top=670), item("12 34.5 = 99 / 7", 72, 600), item("Figure 3 shows it", 72, 560)]
    snippets = [item("two", 72, 700, w=15, eol=False), item("words", 95, 700.5, w=25, eol=False), item("", 120, 700, eol=False), item("joined", 120, 700, w=30, eol=False), item("next line.", 72, 687)]
    bullets = column([LINE + ".", "• one thing", "• other thing"]) + [item("Indented " + LINE, 90, 640), item(LINE, 72, 627)]
    df = layout_pages(spark, {1: [around(1, first), around(2, second)], 2: [titled], 3: [snippets], 4: [[]], 5: [bullets], 6: [[dict(item("x", 0, 0), str=None)]]})
    got = {}
    for r in sorted(layout.paragraphs(df).collect(), key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append(r)
    one = got[1]
    assert [r.kind for r in one] == ["text", "text", "heading", "references", "heading", "text"] and "example goes" in one[0].text
    assert (one[1].page, one[1].end_page) == (1, 2) and one[1].text.endswith("it goes on here.") and [b.page for b in one[1].boxes] == [1, 2]
    assert not any("running title" in r.text for r in one) and [r.pos for r in one] == list(range(6))
    assert [r.kind for r in got[2]] == ["heading", "text", "table", "caption"]
    assert [r.text for r in got[3]] == ["two wordsjoined next line."] and got[3][0].words == 4
    assert [r.text.split()[0] for r in got[5]] == ["some", "•", "•", "Indented"] and set(got) == {1, 2, 3, 5}
    made = layout.lines(df)
    assert sorted((r.doc_id, r.page) for r in layout.pages_without_text(df, made).collect()) == [(4, 1), (6, 1)]
    assert {r.doc_id: (r.key, r.pages) for r in layout.furniture(made, df).filter("key like 'my%'").collect()} == {1: ("my running title", 2)}
    assert {r.doc_id: r.body for r in layout.body_sizes(made).collect()} == {1: 10.0, 2: 10.0, 3: 10.0, 5: 10.0}
    assert {r.doc_id: r.leading for r in layout.leadings(layout.without_furniture(made, df)).collect()}[1] == 13.0
    assert layout.merge_rects([(0, 10, 5, 12), (6, 10.5, 9, 12), (0, 30, 5, 32)]) == [(0, 30, 5, 32), (0, 10, 9, 12)]


def test_layout_texts(spark):
    got = spark.sql("SELECT array('AI-', 'Detector') AS a, array('exam-', 'ple') AS b, array('x') AS c").select(*[layout.joined(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(got) == ("AI- Detector", "example", "x")
    texts = {"2.1 Method": True, "It ends here.": False, "METHODS AND DATA": True, "12": False, "1 a b c d e f g h": False}
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", layout.heading_like(F.col("t")).alias("h")).collect()}
    assert got == texts


def test_components(spark):
    rnd = random.Random(3)
    n, edges = 300, [(a, b) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(180)) if a != b] + [(i, i + 1) for i in range(200, 260)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.root for r in dedup.components(spark.range(n), df).collect()}
    assert got == {i: find(i) for i in range(n)}


def text_of(*numbers):
    out = []
    for k in numbers:
        rnd = random.Random(k)
        out += [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(9, 14))).capitalize() + "." for _ in range(6)]
    return " ".join(out)


def decide(spark, rows, suite=()):
    """rows (id, grp, label, text) -> {id: (reason, group_root)}"""
    from textmill.functions.text import ascii_words, exact_key

    all_rows = [(i, g, y, t, i, False) for i, g, y, t in rows] + [(1000 + k, "", 0, t, 1000 + k, True) for k, t in enumerate(suite)]
    u = spark.createDataFrame(all_rows, "id long, grp string, label int, text string, ord long, suite boolean")
    keyed = u.withColumn("w", ascii_words(F.col("text"))).withColumn("key", exact_key(F.col("w"))).drop("w")
    got = dedup.cluster_decisions(keyed, dedup.shared_pairs(dedup.doc_shingles(u, "id")))
    return {r.id: (r.reason, r.group_root) for r in got.collect()}


def test_cluster_decisions(spark):
    a, b, c = text_of(1), text_of(2), text_of(3)
    got = decide(spark, [(1, "g1", 0, a), (2, "g2", 0, a), (3, "g3", 0, b), (4, "g4", 1, b), (5, "g5", 0, c), (6, "g6", 0, text_of(4, 5, 6)), (7, "g7", 0, text_of(4))], [c, text_of(9)])
    assert got[1] == (None, "g1") and got[2] == ("duplicate", "g1")
    assert got[3][0] == got[4][0] == "label_conflict" and got[3][1] == got[4][1] == "g3"
    assert got[5][0] == "in_suite"
    assert got[6] == (None, "g6") and got[7] == ("duplicate", "g6")  # an excerpt is a duplicate


def test_related_in_order_against_a_plain_loop(spark):
    rnd = random.Random(12)
    side = {i: rnd.choice(["train", "validation", "test"]) for i in range(60)}
    rank = {"train": 0, "validation": 1, "test": 2}
    pairs = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(120)} | {(i, i + 1) for i in range(40)})
    gone = set()
    for a, b in pairs:
        if side[a] != side[b] and a not in gone and b not in gone:
            gone.add(a if rank[side[a]] < rank[side[b]] else b)
    split = spark.createDataFrame([(i, s, rank[s]) for i, s in side.items()], "id long, side string, rank int")
    got = [r.id for r in dedup.separate_related(spark.createDataFrame(pairs, "a long, b long"), split).collect()]
    assert sorted(got) == sorted(gone)


def test_percentiles_by_place(spark):
    import numpy as np

    rnd = random.Random(3)
    rows = [(g, rnd.choice([rnd.random(), 0.5, None])) for g in "ab" for _ in range(400)] + [("c", 1.0), ("d", None)]
    got = {r.g: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p": 0.05, "m": 0.5, "q": 0.95}).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].m == 1.0
    for g in "ab":
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose([got[g].p, got[g].m, got[g].q], np.percentile(own, [5, 50, 95]))


def test_related_are_separated(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a long, b long")
    sides = spark.createDataFrame([(1, "train", 0), (2, "test", 2), (3, "train", 0), (4, "test", 2), (7, "train", 0), (8, "train", 0)], "id long, side string, rank int")
    assert {r.id for r in dedup.separate_related(pairs, sides).collect()} == {1, 3}


def test_split_properties(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("grp"), (F.col("id") % 350).cast("string").alias("merged"))
    got = split.split_groups(rows, "50", "merged", "grp")
    assert split.disjoint(got, "merged", "split").count() == 0
    shares = {r.split: r["count"] / 3000 for r in rows.withColumn("split", split.side_of(F.col("grp"), "50")).groupBy("split").count().collect()}
    assert 0.05 < shares["test"] < 0.16 and 0.02 < shares["validation"] < 0.09
    # more data doesn't move a group, and merging only moves towards test
    order = {"train": 0, "validation": 1, "test": 2}
    own = {r.grp: r.s for r in rows.select("grp", split.side_of(F.col("grp"), "50").alias("s")).distinct().collect()}
    assert all(order[r.split] >= order[own[r.grp]] for r in got.select("grp", "split").distinct().collect())


def test_generations(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", f"m{i % 4}") for i in range(60)] + [(100 + i, "g0", "keep") for i in range(5)], "id long, grp string, kind string")
    got = split.select_generations(rows, "grp", "kind", "id", 4, "50", ["keep"]).collect()
    per = defaultdict(list)
    for r in got:
        per[r.grp].append(r.kind)
    assert sum(k == "keep" for k in per["g0"]) == 5
    for g, kinds in per.items():
        own = [k for k in kinds if k != "keep"]
        assert len(own) == 4 and len(set(own)) == 4


def test_store(spark):
    day = store.DAY_MS
    s = spark.createDataFrame([("a", 0.1, "m", 100 * day), ("b", 0.2, "m", 69 * day), ("c", 0.3, "n", 100 * day), ("d", 0.4, "m", 70 * day)], "k string, p double, m string, at long")
    keys = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    assert {r.k: r.p for r in store.lookup(keys, s, "m", 100 * day).collect()} == {"a": 0.1, "b": None, "c": None, "d": 0.4, "e": None}
    assert {r.k for r in store.prune(s, 100 * day).collect()} == {"a", "c", "d"}
    assert {r.k for r in store.prune(s, 100 * day, cap=2).collect()} == {"a", "c"}
    assert {r.k for r in store.prune(s, 100 * day, cap=1).collect()} == {"a"}
    new = spark.createDataFrame([("a", 0.9, "m", 101 * day)], "k string, p double, m string, at long")
    assert {r.k: r.p for r in store.upsert(s, new).collect()}["a"] == 0.9
    n = spark.createDataFrame([("x", 5, 0, "first"), ("x", 5, 1, "second"), ("x", 4, 2, "old")], "k string, at long, ord long, v string")
    assert store.newest(n, ["k"], "at", "ord").first().v == "first"
    fb = spark.createDataFrame([("  t ", "ai", "own", 1.5, "m" * 300, None, None), ("t", "robot", "own", 0.5, "m", "en", "pdf"), ("", "ai", "own", 0.5, "m", "en", "pdf")], "text string, label string, basis string, p double, model string, lang string, source string")
    got = store.sanitise_feedback(fb).collect()
    assert [r.valid for r in got] == [True, False, False] and got[0].p is None and len(got[0].model) == 200 and got[0].source == "page"


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(fs.sigmoid(F.lit(-800.0))) == 0 and one(fs.sigmoid(F.lit(0.0))) == 0.5
    assert one(fs.softmax(arr(1.0, 1.0))) == [0.5, 0.5]
    assert one(fs.log_odds(arr(2.0), 0)) == 2.0 and one(fs.log_odds(arr(2.0, 0.5), 0)) == pytest.approx(1.5)
    assert one(fs.normalised(arr(0.0, 0.0))) == [0.5, 0.5] and one(fs.arg_max(arr(1.0, 3.0, 3.0))) == 1
    labels = lambda *p: F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("score")) for a, b in p])
    assert one(fs.probability_from_labels(labels(("Human", 0.75), ("AI", 0.25)))) == 0.25
    assert one(fs.probability_from_labels(labels(("human", 0.75)))) == 0.25 and one(fs.probability_from_labels(labels(("x", 0.5)))) is None
    assert one(fs.quantise(arr(1.0, -2.0, 0.5)))["values"] == [64, -127, 32]
    assert one(fs.pool_pairs(arr(1.0, 3.0, 5.0))) == [2.0, 5.0]


def test_counts(spark):
    u = counts.until_exit(spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (1, "b", 5.0)], "c int, stage string, ms double"), ["c"], "stage", "ms")
    got = counts.expected_time(u, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "stage string, share double"), ["c"], "stage").first()
    assert (got.expected, got.whole) == (5.5, 8.0)
    old, new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, h string"), spark.createDataFrame([(1, "x"), (2, "q"), (4, "n")], "id int, h string")
    assert {r.id: r.state for r in counts.changes(old, new, "id", "h").collect()} == {1: "same", 2: "changed", 3: "gone", 4: "new"}
    assert "–" in counts.markdown(spark.createDataFrame([(1, None)], "a int, b double"))
    a = counts.checksum(old, ["id", "h"]).first()
    assert a == counts.checksum(old.repartition(3), ["id", "h"]).first() and a != counts.checksum(new, ["id", "h"]).first()
