import random
import re

from pyspark.sql import functions as F

from textmill.llm import decontaminate as dc

from .conftest import ODD


def shingle_set(t, n=5):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = {}
    for j in {j for j, _ in items}:
        q = set().union(*(shingle_set(t) for k, t in items if k == j))
        for i, t in docs:
            if q and len(q & shingle_set(t)) / len(q) >= 0.8:
                out[i, j] = max(out.get((i, j), 0), len(q & shingle_set(t)))
    return out


def test_against_brute_force(spark, make_docs):
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randrange(800)}" for _ in range(n))
    items = [(j, text(rnd.choice([3, 5, 6, 20, 60, 200, 700]))) for j in range(40)] + [(3, text(20)), (90, None), (91, "")]
    docs = []
    for i in range(150):
        t = text(rnd.randint(0, 200))
        if i % 3 == 0:
            w = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randint(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = "changed"
            t += " " + " ".join(w).upper() + "; " + text(30)
        docs.append((i, t))
    docs += [(1000 + k, t) for k, t in enumerate(ODD)] + [(0, items[5][1]), (None, items[6][1])]
    got = {(r.doc_id, r.item_id): r.n_shared for r in dc.contaminated(make_docs(docs, more=True), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute([d for d in docs if d[0] is not None], items)
    assert got == want and len(want) > 20


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(make_docs(ODD), none).count() == 0
    assert dc.contaminated(make_docs([]), spark.createDataFrame([(1, "a b c d e f")], none.schema)).count() == 0


def test_joins_by_shuffle_too(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert [r.doc_id for r in dc.contaminated(make_docs(["x", "zero one two three four five six seven"]), items).collect()] == [1]


def test_bands_by_size(spark):
    got = {r.n: r.b for r in spark.range(1, 3000).selectExpr("cast(id as int) n").select("n", dc.bands(F.col("n"), 0.8, dc.RECALL).alias("b")).collect()}
    assert got[4] == 1 and got[5] == 2 and got[32] == 7 and got[59] == 12 and max(got.values()) == 13
    for n in range(1, 60):  # one more than may be lacking: no such document is missed
        assert got[n] > n - -(-n * 8 // 10)
    for n in range(60, 3000):  # all bands lacking, drawn without putting back
        lacking, miss = n - -(-n * 8 // 10), 1.0
        for k in range(got[n]):
            miss *= (lacking - k) / (n - k)
        assert miss <= 1e-9


def test_ties_and_long_texts(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(40))
    part = " ".join(f"q{i}" for i in range(33))  # 29 of 36 shingles: over 0.8; one word less is under
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    docs = [(1, f"{long} {item} {long}"), (2, part), (3, " ".join(f"q{i}" for i in range(32))), (4, f"{item} {item}"), (4, item), (5, "x" * 2_000_000)]
    items = spark.createDataFrame([(1, item), (2, item), (3, item.upper())], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in dc.contaminated(make_docs(docs, more=True), items).collect())
    assert got == sorted((d, i, n) for d, n in ((1, 36), (2, 29), (4, 36)) for i in (1, 2, 3))
