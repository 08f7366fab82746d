import unicodedata

from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.functions import udfs
from textmill.plans.text_queries import cleaned, normalised

CASES = [
    ("a b\r\nc  d", "a b c d", ["whitespace"]),
    ("one<br />two &amp; <b>three</b>", "one two & three", ["html", "whitespace"]),
    ("## Title\n- **bold** word\n> quote", "Title bold word quote", ["markdown", "whitespace"]),
    ("﻿He said “yes”​ and ‘no’", "He said \"yes\" and 'no'", ["invisible", "quotes"]),
    ("I do n't know , she 's here ( really ) .", "I don't know, she's here (really).", ["detokenise"]),
    ("``hm'' -LRB- x -RRB-", '"hm" (x)', ["detokenise"]),
    ("a<b and c>d with __init__", "a<b and c>d with __init__", []),
    ("été", "été", ["unicode_nfc"]),
    ("", "", []),
    (None, None, []),
]


def test_normalise(spark):
    df = normalised(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string"))
    got = {r.i: r for r in df.collect()}
    for i, (_, want, changes) in enumerate(CASES):
        assert (got[i].text, got[i].changes) == (want, changes)
    again = normalised(df.select("i", "text")).filter(F.size("changes") > 0)
    assert again.count() == 0  # idempotent


LONG = "This is a sentence of quite a few words that goes on and on here. " * 2


def test_clean(spark):
    rows = [
        (0, "x", "s", "", "g", "She do n't see . He ca n't , too . They wo n't ( go ) ."),
        (1, "x", "s", "", "g", LONG + "And this one is cut in the mid"),
        (2, "wikimedia", "wikinews", "", "g", "Friday, June 5, 2009 " + LONG),
        (3, "x", "s", "", "g", "Friday, June 5, 2009 " + LONG),
        (4, "x", "s", "", "g", LONG + "Hello, users of CMV! This is a footnote from your moderators. Blah. Happy CMVing!"),
        (5, "x", "s", "", "g", "too short"),
        (6, "mage", "s", "continuation", "h", "A b c d e f g h i j k l m own part starts. " + LONG),
        (7, "x", "s", "", "g", LONG + "The following is the full text of the abstract for a paper titled X from arxiv.org: again"),
    ]
    df = spark.createDataFrame(rows, "id int, source string, sub_source string, prompt_type string, grp string, text string")
    openings = spark.createDataFrame([("h", "A b c d e f g h i j k l m human goes on")], "grp string, opening string")
    got = {r.id: r for r in cleaned(df, openings).collect()}
    assert got[0].reason == "tokenised" and got[0].text is None and got[0].changes == []
    assert got[2].changes == ["dateline", "whitespace"] and "moderator_footnote" in got[4].changes and "shared_opening" in got[6].changes and "prompt_echo" in got[7].changes
    assert got[1].reason is None and got[1].text == LONG.strip() and got[1].changes[-1] == "incomplete_end"
    assert got[2].text.startswith("This is") and got[3].text.startswith("Friday")
    assert got[4].text == LONG.strip()
    assert got[5].reason == "short"
    assert got[6].text == LONG.strip()  # opening cut, then the rest of the broken sentence
    assert got[7].text == LONG.strip()


def test_clip_chunks_shared(spark):
    text = "First sentence here. Second one is longer than that! Third"
    one = lambda c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first().x
    assert one(tx.clip(F.col("t"), 100)) == text
    assert one(tx.clip(F.col("t"), 55)) == "First sentence here. Second one is longer than that!"
    assert one(tx.clip(F.col("t"), 40)) == "First sentence here. Second one is"
    assert one(tx.clip(F.lit("x" * 50), 20)) == "x" * 20
    assert one(tx.chunks(F.lit("a" * 950))) == ["a" * 500, "a" * 500]
    assert one(tx.chunks(F.lit("abc"))) == ["abc"]
    assert one(tx.shared_words(F.lit("a b c d"), F.lit("a b x d"))) == 2
    assert one(tx.cut_words(F.lit(" a  b c d"), F.lit(2))) == " c d"


def test_language(spark):
    rows = [
        ("en", "The cat is on the table and it was not from this house but they have a dog with them"),
        ("de", "Der Hund ist nicht auf dem Tisch und die Katze ist mit einem Ball in den Garten von mir zu sehen"),
        ("fr", "Le chat est sur la table et il ne veut pas des fruits dans le jardin avec les enfants qui sont"),
        ("ru", "Это предложение написано на русском языке и достаточно длинное"),
        ("ja", "これは日本語の文章です。漢字もカタカナもあります。もっと長くします"),
        ("", "x1 = foo(bar); while (yy) { return zz; } call(qq, bb, cc, dd, ff, gg, hh, kk, mm)"),
        ("", "short text"),
    ]
    df = spark.createDataFrame(rows, "want string, text string").withColumn("w", tx.language_words(F.col("text")))
    for r in df.select("want", tx.detect_language(F.col("text"), F.col("w")).alias("got")).collect():
        assert r.got == r.want


def test_excerpt_and_halves(spark):
    text = " ".join(f"Sentence number {i} has some more words in it here." for i in range(60))
    df = spark.createDataFrame([(str(i), text) for i in range(200)] + [("s", "Only this.")], "k string, t string")
    got = df.select("k", udfs.excerpt()(F.col("k"), F.col("t")).alias("e")).collect()
    counts = []
    for r in got[:-1]:
        piece = text[r.e.start : r.e.end]
        assert piece.startswith("Sentence") and piece.endswith(".") and 15 <= len(piece.split()) <= 330 and len(piece) <= 2000
        counts.append(len(piece.split()))
    assert 20 < sum(c < 40 for c in counts) < 100 and (got[-1].e.start, got[-1].e.end) == (0, 10)
    h = spark.createDataFrame([(text,)], "t string").select(udfs.split_half("t").alias("h")).first().h
    assert h.first.endswith(".") and h.second.startswith("Sentence")
    assert unicodedata.is_normalized("NFC", h.first)


def test_excerpts_by_plain_scan():
    """Every excerpt is one that a scan over all starts and lengths allows."""
    import random
    import re

    from textmill.functions import udfs

    lengths, rnd = ((0.3, 15, 39), (0.4, 40, 119), (0.3, 120, 330)), random.Random(4)
    sentence = lambda: " ".join(f"W{rnd.randrange(99)}" if i == 0 else f"w{rnd.randrange(99)}" for i in range(rnd.choice([3, 8, 20, 60]))) + rnd.choice([". ", "! ", '." '])
    texts = [" " + "".join(sentence() for _ in range(rnd.randint(0, 30))) for _ in range(150)] + ["", " ", "x" * 5000, "word " * 3000, "One. " * 900]
    count = lambda t: len(t.split())
    for k, text in enumerate(texts):
        draw, again = random.Random(k), random.Random(k)
        a, b = udfs.choose_excerpt(text, draw, lengths, 2000)
        lo, hi = again.choices([(15, 39), (40, 119), (120, 330)], [0.3, 0.4, 0.3])[0]
        target, spans = again.randint(lo, hi), udfs.sentence_spans(text)
        assert 0 <= a <= b <= len(text) and b - a <= 2000 and count(text[a:b]) <= 330
        if count(text) <= target:
            assert (a, b) == (0, len(text)) or b - a > 1900 or not text.strip()
            continue
        assert a in [s for s, _ in spans]
        rest = [e for s, e in spans if s >= a]
        words = [count(text[a:e]) for e in rest]
        if b in rest and count(text[a:b]) >= lo:
            n = count(text[a:b])
            assert n >= target or n + count(text[b:rest[rest.index(b) + 1]]) > hi or any(x > 330 or e - a > 2000 for x, e in zip(words, rest) if x >= target)
    assert udfs.sentence_spans(" One two.  Three! Four") == [(0, 9), (11, 17), (18, 22)] and udfs.sentence_spans("") == []
    assert all(re.match(r"\S|$", text[b:].lstrip()[:1]) for text, b in [("a. B", 2)])


def test_skipped_titles(spark):
    from textmill.operators import filters

    titles = {"List of lakes": False, "Lists of rivers": False, "Wikinews Shorts: June": False, "News briefs": False, "Crosswords/2009": False, "Mercury (disambiguation)": False, "Mercury (disambiguation) page": False, "Glossary of chess": True, "A List of lakes": True}
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", filters.qualified_page(F.col("t"), F.lit(9), F.lit(9), 5).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == titles
