import random

from pyspark.sql import functions as F

from textmill.llm import line_dedup as ld

from .conftest import ODD


def brute(docs, least=ld.MIN_WORDS):
    """[(id, text)], ids unique -> {id: (text left, lines, removed)}: lines go that lie in a run of `least` words which also
    starts earlier. Any two documents, and each with itself, are read side by side."""
    docs = sorted(docs, key=lambda d: d[0])
    raw = [(t or "").split("\n") for _, t in docs]
    own = [[(k, x.strip()) for k, x in enumerate(r) if x.strip()] for r in raw]
    gone = [set() for _ in docs]
    for j, later in enumerate(own):
        before = [0]
        for _, x in later:
            before.append(before[-1] + len(x.split()))
        for i in range(j + 1):
            starts = {}  # place in the earlier one -> first line of the run that ends here
            for b in range(len(later)):
                new = {}
                for a in range(len(own[i]) if i < j else b):
                    if own[i][a][1] == later[b][1]:
                        new[a] = starts.get(a - 1, b)
                        if before[b + 1] - before[new[a]] >= least:
                            gone[j].update(range(new[a], b + 1))
                starts = new
    out = {}
    for (i, _), r, o, g in zip(docs, raw, own, gone):
        lost = set().union(*(range(o[k][0], o[k + 1][0] if k + 1 < len(o) else len(r)) for k in g))
        out[i] = "\n".join(x for k, x in enumerate(r) if k not in lost), len(r), len(lost)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    line = lambda: " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(1, 30)))
    shared = [[line() for _ in range(rnd.randint(1, 9))] for _ in range(8)] + [[" ".join(["long"] * 60)], ["short", "lines"] * 40]
    docs = []
    for _ in range(50):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            lines += rnd.choice(shared) if rnd.random() < 0.5 else [line() for _ in range(rnd.randint(0, 4))]
            lines += [""] * rnd.randint(0, 2)
        docs.append("\n".join("  " + x if rnd.random() < 0.1 else x for x in lines))
    return docs


def test_against_brute_force(make_docs):
    for seed in range(3):
        rows = [(5 * i, t) for i, t in enumerate(corpus(seed))] + [(1000 + i, t) for i, t in enumerate(ODD)]
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(make_docs(rows, more=True)).collect()}
        assert got == brute(rows)


def test_guarantees(make_docs):
    a, b = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(1, f"{a}\n{b}\nend"), (2, f"own\n{a}\n{b}\nother"), (3, a), (4, f"{a}\nbetween\n{b}"), (5, None), (5, None), (None, f"{a}\n{b}")]
    got = ld.dedup_lines(make_docs(rows)).collect()
    texts = {(r.doc_id, r.text) for r in got}
    assert len(got) == len(rows) and (2, "own\nother") in texts and (3, a) in texts and (4, f"{a}\nbetween\n{b}") in texts and (5, "") in texts
    assert ld.dedup_lines(make_docs([])).count() == 0


def test_runs_that_begin_as_another_passage(make_docs):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = words("a", 40), words("b", 20), words("c", 20)
    rows = [(1, f"{a}\n{b}\nd"), (2, f"{a}\n{b}\n{c}\ne"), (3, f"{a}\n{b}\n{c}\nf")]
    rows += [(4, f"g\n{words('x', 20)}\n{words('y', 50)}"), (5, f"{c}\n{words('x', 20)}\n{words('y', 50)}"), (6, f"{c}\n{words('x', 20)}\n{words('y', 50)}")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(make_docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: f"{c}\ne", 3: "f", 4: rows[3][1], 5: c, 6: ""}


def test_against_every_earlier_place(make_docs):
    rnd = random.Random(5)
    lines = [" ".join(f"{name}{i}" for i in range(n)) for name, n in zip("abcdefgh", [40, 20, 20, 12, 55, 7, 30, 25])]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(2, 9)))) for i in range(150)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_repeated_rows_are_one_document(make_docs):
    part = lambda name: "\n".join(" ".join(f"{name}{j}x{i}" for i in range(10)) for j in range(6))
    once = [(1, part("a") + "\nend"), (2, "own\n" + part("a")), (3, "own too\n" + "\n".join(part("b").split("\n")[:3])), (4, "\n".join(part("b").split("\n")[:3]) + "\nlast")]
    want = {1: once[0][1], 2: "own", 3: once[2][1], 4: once[3][1]}
    for rows in (once + once[1:2], once + once[:1] * 2, once * 2):
        got = ld.dedup_lines(make_docs(rows)).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.text) for r in got} == set(want.items())


def test_short_lines_behind_very_long_ones(make_docs):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, f"{words('a', 170)}\n{words('b', 10)}\n{words('c', 7)}\nend"), (2, f"own\n{words('a', 170)}\n{words('b', 10)}\n{words('c', 7)}\nlast"), (3, f"{words('z', 9)}\n{words('a', 170)}"), (4, f"{words('z', 9)}\n{words('a', 170)}")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(make_docs(rows)).collect()}
    assert got == brute(rows) and got[2][0] == "own\nlast" and got[4][0] == ""


def test_clashing_columns_and_long_texts(make_docs):
    a = " ".join(f"x{i}" for i in range(60))
    long = "\n".join(f"line {i} of a text of some megabytes that holds {i * 7} and {i * 13}" for i in range(40_000))
    rows = [(1, f"{a}\n{long}"), (2, f"own\n{a}"), (3, "y" * 3_000_000), (4, long)]
    df = make_docs(rows)
    for name in ("n_removed", "n_lines", "__runs", "__t", "runs", "id", "th", "of", "lines", "n", "kept", "own", "lo", "a.b"):
        df = df.withColumn(name, F.lit("mine"))
    out = ld.dedup_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(out.columns) == sorted(df.columns) and len(got) == 4
    assert all(r["kept"] == r["a.b"] == r["__runs"] == r["of"] == "mine" for r in got.values())
    assert got[2].text == "own" and got[2].n_removed == 1 and got[4].text == "" and got[4].n_removed == 40_000 and got[3].n_removed == 0 == got[1].n_removed
