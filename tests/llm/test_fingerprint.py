import re
from hashlib import sha256

from pyspark.sql import functions as F

from textmill.llm import fingerprint as fp

from .conftest import ODD


def chains(text):
    w = re.findall(r"\w+", text.lower())
    out = set()
    for i, x in enumerate(w):
        if x in fp.ANTECEDENTS:
            c = [y for y in w[i + 1 :] if y not in fp.ANTECEDENTS][: fp.CHAIN]
            if len(c) == fp.CHAIN:
                out.add((x, *c))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_likeness_is_that_of_the_chains():
    a = "The quick brown fox jumps over the lazy dog and the old cat of a small town in the north sleeps on it"
    b = a.replace("small", "large")
    assert len(fp.signatures(a)) == len(chains(a))
    assert abs(fp.likeness(fp.signatures(a), fp.signatures(b)) - jaccard(chains(a), chains(b))) < 1e-9
    assert fp.load(fp.dump(fp.signatures(a))).tolist() == fp.signatures(a).tolist()
    assert fp.likeness(fp.signatures(a), fp.signatures(a)[:2], 0.8) == 0


def test_length_partitions_meet(spark):
    got = {r.id: set(r.k) for r in spark.range(1, 501).select("id", fp.length_partitions(F.col("id"), 0.8).alias("k")).collect()}
    for n in range(1, 400):
        for m in range(n, int(n / 0.8) + 1):
            if n / m >= 0.8:
                assert got[n] & got[m]


def test_search_against_brute_force(make_docs):
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "of", "and", "in"]) if rnd.random() < 0.4 else f"w{rnd.randrange(500)}"
    bases = [[word() for _ in range(rnd.randint(5, 200))] for _ in range(10)]
    rows = [*ODD]
    for _ in range(80):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    sets = {i: frozenset(fp.signatures(t or "").tolist()) for i, t in enumerate(rows)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    want = {(q, i): jaccard(sets[q], s) for q in sets if q % 20 == 0 for s, i in first.items() if jaccard(sets[q], s) >= 0.8}
    docs = make_docs(rows, more=True)
    got = {(r.query_id, r.doc_id): r.likeness for r in fp.search(docs.filter("doc_id % 20 = 0"), docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_query_against_brute_force(spark, make_docs, tmp_path):
    rows = [(3 * i, t) for i, t in enumerate([*ODD, *(f"the house of {i} red stones is on a hill and in the valley number {i % 3} lives an old man of wood" for i in range(20))])]
    rows += [(3, "again"), (3, "again")]
    make_docs(rows, more=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.op3_document_fingerprints(spark, str(tmp_path)).collect())
    docs = sorted((i, t or "") for i, t in rows)
    want = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        s, se, sn = fp.signatures(t), fp.signatures(e), fp.signatures(nxt)
        want.append((i, len(t), sha256(e.encode()).hexdigest(), fp.dump(s), fp.dump(se), fp.likeness(s, se), fp.likeness(s, sn)))
    assert got == sorted(want)
    by_text = {}
    for (i, t), r in zip(docs, got):
        assert by_text.setdefault(t, r[3]) == r[3] or rows.count((i, t)) > 1
    make_docs([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert fp.op3_document_fingerprints(spark, f"{tmp_path}/e").count() == 0
    make_docs(["only one"]).write.parquet(f"{tmp_path}/o/documents.parquet")
    assert fp.op3_document_fingerprints(spark, f"{tmp_path}/o").first().near_next == 1
