import random
import re

import numpy as np

from textmill.llm import near_dup as nd

from .conftest import ODD


def shingle_set(t, n=5):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, least=0.8):
    s = [shingle_set(t) for _, t in docs]
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if s[a] and s[b] and len(s[a] & s[b]) >= least * len(s[a] | s[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    best = {}
    for k, (i, _) in enumerate(docs):
        best[find(k)] = min(i, best.get(find(k), i))
    return sorted((i, best[find(k)], links[k]) for k, (i, _) in enumerate(docs))


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(2000)}"
    bases = [[word() for _ in range(rnd.choice([3, 8, 40, 120, 300]))] for _ in range(12)]
    docs = []
    for _ in range(160):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = word()
        docs.append(" ".join(w))
    return docs


def test_against_brute_force(make_docs, monkeypatch):
    for seed, block in ((0, 2048), (1, 7)):
        monkeypatch.setattr(nd, "BLOCK_SETS", block)
        rows = [(11 * i + 3, t) for i, t in enumerate(corpus(seed))] + [(5000 + i, t) for i, t in enumerate(ODD)] + [(3, "a text under an id that is used twice"), (9999, "a text under an id that is used twice")]
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in nd.near_duplicates(make_docs(rows, more=True)).collect())
        assert got == brute(rows)


def test_empty(make_docs):
    assert nd.near_duplicates(make_docs([])).count() == 0


def test_depths_and_signature():
    assert nd.depths(0.8) == [4, 3] and nd.depths(0.99) == [4] and nd.depths(0.1) == [4, 3, 2, 1]
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**63, 400, np.uint64))
    b = np.unique(np.concatenate((a[:360], rnd.integers(0, 2**63, 40, np.uint64))))
    same = (nd.signature(a) == nd.signature(b)).mean()
    assert abs(same - 360 / 440) < 0.15
    assert (nd.signature(a)[:1] == nd.signature(a[::-1])[:1]).all()


def test_labels_sort_as_a_trie():
    rnd = np.random.default_rng(2)
    sigs = rnd.integers(0, 3, (50, nd.TREES * nd.DEPTH)).astype(np.uint64) << np.uint64(20)
    raw = [nd.labels(s) for s in sigs]
    trees = sigs.reshape(50, nd.TREES, nd.DEPTH)
    for t in range(nd.TREES):
        by_bytes = sorted(range(50), key=lambda i: raw[i][16 * t : 16 * t + 16])
        assert [tuple(trees[i, t]) for i in by_bytes] == sorted(tuple(x) for x in trees[:, t])
    for d in range(1, nd.DEPTH + 1):
        ids = nd.node_ids(trees, d)
        for i in range(0, 50, 7):
            assert ((ids == ids[i]) == (trees[:, :, :d] == trees[i, :, :d]).all(2)).all()


def test_sets_that_have_met_are_not_met_again(spark):
    """At the shorter prefix only nodes over two labels or more count."""
    from textmill.llm.common import Scratch

    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**31, nd.TREES * nd.DEPTH).astype(np.uint64)
    near, far = base.copy(), rnd.integers(0, 2**31, nd.TREES * nd.DEPTH).astype(np.uint64)
    near[3 :: nd.DEPTH] += np.uint64(1)  # agrees with the others in prefixes of three minima only
    rows = [(bytes([i]) * 16, bytearray(nd.labels(s)), bytearray(nd.labels(s)[3::4])) for i, s in enumerate([base, base, base, near, far])]
    reps = spark.createDataFrame(rows, "k binary, labels binary, sig binary")
    scratch = Scratch(spark, "forest-test")
    deep = nd._linked(reps, None, 4, 0.56, scratch, 2)
    assert {(r.a[0], r.b[0]) for r in deep.collect()} == {(1, 0), (2, 0)}
    label = deep.toDF("v", "label")
    wide = nd._linked(reps, label, 3, 0.56, scratch, 2)
    assert {(r.a[0], r.b[0]) for r in wide.collect()} == {(3, 0)}
    together = reps.filter("k < X'03030303030303030303030303030303'")
    assert nd._linked(together, label, 3, 0.56, Scratch(spark, "forest-test"), 2).count() == 0


def test_links_across_clusters():
    sigs = np.array([[0, 0, 0, 0], [0, 0, 0, 9], [5, 5, 5, 5], [5, 5, 5, 6], [7, 7, 7, 7]], np.uint8)
    assert nd.link_alike(sigs, np.array([1, 2, 3, 4, 5]), 0.7) == [0, 0, 2, 2, 4]
    assert nd.link_alike(sigs, np.array([1, 2, 2, 4, 5]), 0.7) == [0, 0, 0, 0, 4]


def test_chained_clusters_compare_only_what_met(make_docs):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[25 * i : 25 * i + 120])) for i in range(12)]  # each overlaps the next, none reaches 0.8
    rows += [(100 + i, " ".join(words[:150 + i])) for i in range(30)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in nd.near_duplicates(make_docs(rows)).collect())
    assert got == brute(rows)


def test_texts_of_some_megabytes(make_docs):
    long = " ".join(f"w{i * 7919 % 300_007}" for i in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 3_000_000), (4, "x" * 3_000_000), (5, "short text")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in nd.near_duplicates(make_docs(rows)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0)]
