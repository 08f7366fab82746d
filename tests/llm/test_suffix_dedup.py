import random
from hashlib import sha256

import numpy as np

from textmill.llm import suffix_dedup as sd

from .conftest import ODD


def brute(docs, length=sd.LENGTH):
    """[(id, text)] in order -> per document (bytes, removed, spans, kept)"""
    seen, out = {}, []
    raws = [(t or "").encode() for _, t in docs]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], (d, i))
    for d, raw in enumerate(raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((docs[d][0], len(raw), sum(gone), spans, sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (8, 20, 25, 30, 60, 200)]
    docs = []
    for _ in range(n):
        kind = rnd.randint(0, 6)
        if kind == 0 or not docs:
            t = text(rnd.randint(0, 150))
        elif kind == 1:
            t = rnd.choice(docs)
        elif kind == 2:
            w = rnd.choice(docs).split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = rnd.choice(["ab", "a", "abc ", shared[0] + " "]) * rnd.randint(1, 300)
        else:
            t = text(rnd.randint(0, 30)) + rnd.choice(shared) + text(rnd.randint(0, 30)) + rnd.choice(shared) + rnd.choice(["", text(20)])
        docs.append(t)
    return docs


def run(spark, make_docs, tmp_path, rows, name):
    make_docs(rows, more=True).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return [tuple(r) for r in sd.op8_suffix_array_dedup(spark, f"{tmp_path}/{name}").collect()]


def test_query_against_brute_force(spark, make_docs, tmp_path):
    for seed in range(3):
        rows = [(7 * i + 1, t) for i, t in enumerate(corpus(seed))] + [(1000 + i, t) for i, t in enumerate(ODD)]
        assert sorted(run(spark, make_docs, tmp_path, rows, f"s{seed}")) == sorted(brute(rows))


def test_ids_that_repeat_and_empty_table(spark, make_docs, tmp_path):
    t = corpus(9, 12)
    rows = [(None, t[0]), (5, t[0]), (5, t[1]), (5, t[1]), (4, t[1]), (None, None)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(run(spark, make_docs, tmp_path, rows, "r"), key=str) == sorted(brute(order), key=str)
    assert run(spark, make_docs, tmp_path, [], "e") == []


def test_anchors_with_many_surroundings(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "PLACES", 2)  # nearly every shared anchor goes by single windows
    rows = [(7 * i + 1, t) for i, t in enumerate(corpus(5))] + [(1000 + i, t) for i, t in enumerate(ODD)]
    assert sorted(run(spark, make_docs, tmp_path, rows, "hot")) == sorted(brute(rows))


def test_polynomial_hashes_may_collide(spark, make_docs, tmp_path):
    """Thue-Morse strings and their complements collide modulo 2^64 for any base; they are other bytes all the same."""
    a, b = "ab", "ba"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, a[:3000]), (2, b[:3000]), (3, a[1000:3000]), (4, "x" + b[5:2500])]
    assert sorted(run(spark, make_docs, tmp_path, rows, "tm")) == sorted(brute(rows))


def test_texts_of_some_megabytes(spark, make_docs, tmp_path):
    long = " ".join(f"word{i * 7919 % 1_000_003}" for i in range(150_000))
    rows = [(1, long), (2, "own " + long[:500_000]), (3, long[700_000:700_099])]
    got = {r[0]: r for r in run(spark, make_docs, tmp_path, rows, "long")}
    assert got[1][2] == 0 and got[2][2:4] == (500_000, 1) and got[3][2] == 0


def test_small_chunks_and_batches_agree():
    import pyarrow as pa

    docs = [(i, t) for i, t in enumerate(corpus(4, 40))]
    want = brute(docs)

    def stages(chunk, rows):
        old = sd.CHUNK, sd.FLUSH
        sd.CHUNK = sd.FLUSH = chunk
        try:
            batch = pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]})
            t = pa.Table.from_batches(list(sd.find_anchors(iter([batch])))).sort_by([(k, "ascending") for k in ("key", "c", "c2", "doc", "pos")])
            m = pa.Table.from_batches(list(sd.match_anchors(iter(t.to_batches(rows))))).to_pylist()
            at = {}
            for r in m:
                if r["spans"] is None:
                    at.setdefault(r["doc"], []).append({"pos": r["pos"], "key": r["key"]})
            b = pa.RecordBatch.from_pydict({"doc": pa.array(list(at), pa.int64()), "text": [dict(docs)[d] for d in at], "at": list(at.values())})
            a = pa.Table.from_batches(list(sd.surroundings(iter([b])))).sort_by([(k, "ascending") for k in ("half", "key", "near", "doc", "pos")])
            w = [r for x in sd.match_windows(iter(a.to_batches(rows))) for r in x.to_pylist()]
        finally:
            sd.CHUNK, sd.FLUSH = old
        out = []
        for d, t in docs:
            raw = t.encode()
            spans = b"".join(r["spans"] for r in [*m, *w] if r["doc"] == d and r["spans"] is not None)
            removed, n, kept = sd.cut_out(raw, spans)
            out.append((d, len(raw), removed, n, sha256(kept).hexdigest()))
        return out

    for chunk, rows in ((500, 7), (3000, 50), (10**7, 10**6)):
        assert stages(chunk, rows) == want


def test_mergesort_and_collisions(monkeypatch):
    rnd = random.Random(2)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))).encode() for _ in range(400)]
    group = np.sort(np.array([rnd.randint(0, 9) for _ in parts]))
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size

    def holds():
        order, ext = sd.sort_suffixes(buf, start, size, group)
        for g in range(10):
            own = [int(i) for i in np.flatnonzero(group == g)]
            at = np.searchsorted(group, g)
            got = order[at : at + len(own)].tolist()
            assert sorted(got) == own and [parts[i] for i in got] == sorted(parts[i] for i in own)
            for k in range(1, len(own)):
                x, y = parts[got[k - 1]], parts[got[k]]
                n = next((m for m, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
                assert ext[at + k] == n

    holds()
    monkeypatch.setattr(sd, "_SIGNS", np.ones(256, np.uint64))  # all strings of a length collide
    holds()
