import random
import zlib

import numpy as np

from textmill.llm import toxicity as tx

from .conftest import ODD

BAD = ["vilex", "grobnar", "snarfel", "mudwick"]


def sample(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"{rnd.choice('bdfglmprst')}{rnd.choice('aeiou')}{rnd.choice('bdfglmprst')}{rnd.choice('aeiou')}{rnd.randrange(30)}" for _ in range(rnd.randint(1, 300))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(rnd.randint(1, 3)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(BAD) + rnd.choice(["", "", "ish", "s"]))
        out.append((" ".join(w), y))
    return out


def test_windows_cover():
    for n in (0, 1, 64, 65, 112, 113, 500):
        got = tx.window_starts(n)
        covered = set().union(*(range(s, s + tx.SPAN) for s in got))
        assert set(range(n)) <= covered and all(s >= 0 for s in got) and (n <= tx.SPAN or max(got) + tx.SPAN == n)


def test_gradients():
    rnd = np.random.default_rng(0)
    net = tx.Network({"a": 1}, 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) + (0.1 * rnd.standard_normal(net.p[k].shape) if k not in ("E", "C") else 0)
    words = rnd.standard_normal((6, 3, 2 * tx.WIDTH))
    mask = np.array([[True] * 3] * 4 + [[True, False, True]] * 2)
    old, tx._f4 = tx._f4, np.float64
    try:
        def loss(w):
            return float(net.run(net.projected(w.reshape(-1, w.shape[-1])).reshape(6, 3, -1), mask) @ np.array([0.5, -1.0, 2.0]))

        out, kept = net.run(net.projected(words.reshape(-1, words.shape[-1])).reshape(6, 3, -1), mask, keep=True)
        g, dw = net.back(words, mask, kept, np.array([0.5, -1.0, 2.0]))
        for k in g:
            flat, gf = net.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
            for i in rnd.choice(len(flat), min(6, len(flat)), replace=False):
                was = flat[i]
                flat[i] = was + 1e-6
                up = loss(words)
                flat[i] = was - 1e-6
                down = loss(words)
                flat[i] = was
                assert abs((up - down) / 2e-6 - gf[i]) < 1e-4 * max(1, abs(gf[i])), k
        for i in ((0, 0, 1), (3, 2, 5), (5, 0, 9)):
            up, down = words.copy(), words.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - dw[i]) < 1e-4
    finally:
        tx._f4 = old


def plain_score(net, text):
    """The score by plain loops over words, units and windows."""
    import math
    import re

    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    words = re.findall(r"\w+", text.lower())

    def vector(w):
        b = f"^{w}$".encode()
        grams = [p["C"][zlib.crc32(b[i : i + n]) % tx.BUCKETS] for n in (3, 4) for i in range(len(b) - n + 1)]
        return p["E"][net.vocabulary.get(w, 0)] + [sum(c) / len(grams) for c in zip(*grams)]

    def layer(d, xs):
        h, out, n = [0.0] * tx.UNITS, [], tx.UNITS
        for x in xs:
            inp = [sum(x[i] * p["W"][d][i][j] for i in range(len(x))) + p["b"][d][j] for j in range(3 * n)]
            rec = [sum(h[i] * p["U"][d][i][j] for i in range(n)) for j in range(3 * n)]
            z = [sig(inp[j] + rec[j]) for j in range(n)]
            r = [sig(inp[n + j] + rec[n + j]) for j in range(n)]
            c = [math.tanh(inp[2 * n + j] + r[j] * rec[2 * n + j]) for j in range(n)]
            h = [(1 - z[j]) * c[j] + z[j] * h[j] for j in range(n)]
            out.append(h)
        return out

    best = -math.inf
    for s in tx.window_starts(len(words)):
        xs = [vector(w) for w in words[s : s + tx.SPAN]]
        states = [a + b for a, b in zip(layer(0, xs), layer(1, xs[::-1])[::-1])]
        e = [math.exp(sum(x * y for x, y in zip(h, p["a"]))) for h in states]
        pooled = [sum(w * h[j] for w, h in zip(e, states)) / sum(e) for j in range(2 * tx.UNITS)] if states else [0.0] * 2 * tx.UNITS
        best = max(best, sum(x * y for x, y in zip(pooled, p["o"])) + p["c"][0])
    return sig(best)


def test_scores_against_plain_loops():
    net = tx.train(sample(120), passes=2)
    texts = [t for t, _ in sample(8, seed=3)] + [t for t in ODD if t] + ["", "Ωmega unseen vilex words", "vilex " * 130]
    got = tx.Scorer(net, windows=3).scores(texts)
    for t, s in zip(texts, got):
        assert abs(plain_score(net, t) - s) < 1e-4, t[:50]


def test_long_texts_are_not_drawn(spark, make_docs):
    docs = make_docs([(i, "x " * (30_000 if i % 3 == 0 else 5)) for i in range(60)] + [(100, "y " * 2_000_000)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(100, 1, 1)], "doc_id long, quality int, toxic int")
    got = tx.training_sample(docs, labels, 50, 50)
    assert got and max(len(t) for t, _ in got) == 10
    assert tx.score(docs, labels).filter("doc_id = 100").count() == 1


def test_held_out_accuracy():
    net = tx.train(sample(600))
    test = sample(300, seed=5)
    s = tx.Scorer(net).scores([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((s >= 0.5) == y).mean() > 0.95
    alone = np.array([tx.Scorer(net).scores([t])[0] for t, _ in test[:20]])
    assert np.allclose(alone, s[:20], atol=1e-5)  # a score doesn't depend on its neighbours


def test_score_defined_results(spark, make_docs):
    data = sample(200)
    rows = [(i, t) for i, (t, _) in enumerate(data)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "text"), (1, data[1][0])]
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tx.score(make_docs(rows, more=True), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    none = tx.score(make_docs(rows), labels.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert tx.score(make_docs([]), labels).count() == 0
    kept = tx.filtered(make_docs(rows, more=True), labels)
    assert kept.columns == make_docs([], more=True).columns and kept.count() == sum(r.score < 0.5 for r in got)


def test_held_out_labels_are_not_learned(spark, make_docs):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = make_docs([(i, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    got = tx.training_sample(docs, labels, 50, 60)
    assert len(got) == 110 and not {int(t.split()[1]) for t, _ in got} & set(held)
