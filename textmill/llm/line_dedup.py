"""Line dedup: winnowing over line hashes.

What goes: every line of a run of whole lines with at least `MIN_WORDS` words that also starts at an earlier place.

A window is the shortest run of consecutive lines, from some line on, that has at least `MIN_WORDS` words. In each window
the line with the smallest hash is selected; as a window's content alone decides that, a run that repeats and has
`MIN_WORDS` words is sure to share a selected line (fingerprint) with its earlier copy. Fingerprints that occur at one
place only are done with. Windows around the others that stand at two places or more are extended line by line both ways, as far
as the extended run stands at an earlier place too, whichever that is for each length, and the lines of the later place go.
One extension reaches as far as lines can start that hold no further window; a longer match has one, which is extended for
itself. Words of a line count up to `MIN_WORDS` for that, so a very long line reaches no less far than a short one.

Extended runs meet as hashes of the window and of the lines added to it. Groups of equal fingerprints, windows or extended
runs, however large, are only ever reduced to their first and last place before a shuffle, and the join back is against one
row for each key, read from a written table, so that Spark can split a hot key.
Joins are sort-merge joins at every size: what small inputs could broadcast would grow with the corpus.

Lines are compared without surrounding white space. The order is (doc_id, hash of the text, line); rows that agree in both
are one document and are treated alike. Blank lines are never compared; one goes with the line before it.

Defined results: null texts are empty; an empty text keeps its one empty line; a document may lose all its lines; a row
comes back for each row; other columns are kept as they are by `dedup_lines`, whatever their names (but for n_lines and
n_removed, which it replaces), and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read_table, release

MIN_WORDS = 50


def _extended(context: Column, side: int, lo: Callable[[Column], Column], hi: Callable[[Column], Column]) -> Column:
    """For each number of leading lines of a context: two hashes of them, and the lines they reach to, lo and hi."""

    def one(x: Column, i: Column) -> Column:
        lines = F.transform(F.slice(context, F.lit(1), i + 1), lambda y: F.struct(y["h"], y["g"]))
        return F.struct(F.xxhash64(F.lit(side), lines).alias("a"), F.xxhash64(F.lit(-side), lines).alias("b"), lo(x).alias("lo"), hi(x).alias("hi"))

    return F.transform(context, one)


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, lo, hi: line numbers, ends included, that repeat an earlier run; th is the hash of the document's text."""
    rows = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("raw", "line"))
    lines = rows.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).filter("line <> ''").select(
        "doc_id", "th", "raw", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.least(F.size(F.split("line", r"\s+")), F.lit(min_words)).cast("long").alias("nw")
    )
    by_place = Window.partitionBy("doc_id", "th").orderBy("raw")
    # rows that agree in id and text are one document: their lines come once
    lines = lines.withColumn("again", F.coalesce(F.lag("raw").over(by_place) == F.col("raw"), F.lit(False))).filter("NOT again").drop("again")
    lines = lines.withColumn("s", F.coalesce(F.sum("nw").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("end", F.coalesce(F.lead("raw").over(by_place) - 1, F.lit(2**31 - 1)))
    lines = lines.withColumn("one", F.struct("h", "g", "raw", "end"))
    # s, the words before a line, grows with each line: ranges of it are runs of lines
    by_words = Window.partitionBy("doc_id", "th").orderBy("s")
    here, before, after = by_words.rangeBetween(0, min_words - 1), by_words.rangeBetween(-min_words, -1), by_words.rangeBetween(min_words, 3 * min_words - 1)
    windows = lines.select(
        "doc_id", "th", "raw", F.sum("nw").over(here).alias("total"), F.collect_list("one").over(here).alias("run"),
        F.min(F.struct("h", "raw")).over(here).alias("pick"), F.reverse(F.collect_list("one").over(before)).alias("left"), F.collect_list("one").over(after).alias("right"),
    ).filter(F.col("total") >= min_words)
    hashes = F.transform("run", lambda x: F.struct(x["h"], x["g"]))
    windows = windows.select(
        "doc_id", "th", "raw", F.col("pick.h").alias("fp"), F.col("pick.raw").alias("fp_at"), F.struct(F.xxhash64(hashes).alias("a"), F.xxhash64(F.lit(1), hashes).alias("b")).alias("key"),
        F.element_at("run", -1)["end"].alias("hi"), "left", "right",
    )
    windows = scratch.table(windows, "windows")

    place = F.struct("doc_id", "th", "fp_at")
    twice = windows.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("fp")
    twice = scratch.table(twice, "fingerprints")
    around = scratch.table(windows.join(twice.hint("merge"), "fp"), "around")
    at = F.struct("doc_id", "th", "raw")
    shared = around.groupBy("key").agg(F.min(at).alias("f"), F.max(at).alias("last")).filter("f <> last").select("key")
    shared = scratch.table(shared, "shared")
    zero, raw, hi = F.lit(0).cast("long"), F.col("raw"), F.col("hi")
    itself = F.array(F.struct(zero.alias("a"), zero.alias("b"), raw.alias("lo"), hi.alias("hi")))
    reach = F.concat(itself, _extended(F.col("left"), 1, lambda x: x["raw"], lambda x: hi), _extended(F.col("right"), 2, lambda x: raw, lambda x: x["end"]))
    reached = around.join(shared.hint("merge"), "key").select("key", "doc_id", "th", "raw", F.explode(reach).alias("r")).select("key", "doc_id", "th", "raw", "r.*")
    reached = scratch.table(reached, "reached")
    first = reached.groupBy("key", "a", "b").agg(F.min(at).alias("f"), F.max(at).alias("last")).filter("f <> last").select("key", "a", "b", "f")
    first = scratch.table(first, "first")
    met = reached.join(first.hint("merge"), ["key", "a", "b"]).filter(at != F.col("f"))
    return met.groupBy("doc_id", "th", "raw").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("doc_id", "th", "lo", "hi")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with the text that is left, and n_lines, n_removed; all other columns stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    names = [c for c in docs.columns if c != "text"]
    own = F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")  # columns of the input can't clash with those made here
    whole = docs.select(own, F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    runs = repeated_runs(whole.select(F.col("id").alias("doc_id"), "th", "text"), scratch, min_words)
    of_doc = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    of_doc = scratch.table(of_doc.select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "runs"), "runs")
    for name in ("windows", "fingerprints", "around", "shared", "reached", "first"):
        scratch.drop(name)
    release(spark)
    whole = whole.join(of_doc.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left")
    whole = whole.withColumn("lines", F.split("text", "\n", -1)).withColumn("n", F.size("lines"))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], F.least(r["hi"], F.col("n") - 1))))
    kept = F.when(F.col("runs").isNull(), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array_except(F.sequence(F.lit(0), F.col("n") - 1), gone))
    whole = whole.withColumn("kept", kept)
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"))
    whole = whole.select("own", text.alias("left"), F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.size("kept")).cast("long").alias("n_removed"))
    back = [F.col("own").getField(c).alias(c) for c in names if c not in ("n_lines", "n_removed")]
    return whole.select(*back, F.col("left").alias("text"), "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the lines that are left) for each row of documents; odd rows as defined above."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Stated without windows or fingerprints: pairs of equal lines, earlier and later, that follow each other are runs; those of
#: 50 words or more go.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(range(len(ls))) AS raw, unnest(ls) AS line, len(ls) AS n FROM d),
l1 AS (SELECT doc_id, raw, n, regexp_replace(line, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS line FROM l0),
l2 AS (SELECT *, len(regexp_split_to_array(line, '[\s\x0b]+')) AS nw FROM l1 WHERE line <> ''),
l3 AS (SELECT doc_id, raw, line, nw, row_number() OVER w AS i, coalesce(lead(raw) OVER w - 1, n - 1) AS e FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY raw)),
p AS (SELECT b.doc_id, b.i, b.raw, b.e, b.nw, a.doc_id AS other, b.i - a.i AS shift
  FROM l3 a JOIN l3 b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS island FROM p),
m AS (SELECT doc_id, min(raw) AS lo, max(e) AS hi FROM g GROUP BY doc_id, other, shift, island HAVING sum(nw) >= 50),
r AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS raw FROM m),
k AS (SELECT l0.doc_id, string_agg(line, chr(10) ORDER BY raw) AS kept, count(*) AS n FROM l0 ANTI JOIN r USING (doc_id, raw) GROUP BY l0.doc_id)
SELECT doc_id, len(ls) AS n_lines, len(ls) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
