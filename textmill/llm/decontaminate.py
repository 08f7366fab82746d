"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is short and a document may be long, so their Jaccard is tiny and says nothing; containment does. Items are
partitioned by the number of their distinct word shingles. An item's signature is its bottom sketch: the smallest hashes of
one permutation of its shingles, each of which is a band of its own, as a document that holds the item holds nearly all of
them whatever else it holds. A partition's number of bands is tuned to the containment: a document that contains the
threshold of an item lacks at most a share of 1 - threshold of its shingles, so the partition up to `PIGEONHOLE` shingles
takes one band more than that many and can't miss, and larger items take as many as keep the odds of a miss under
1 - `RECALL`: 13 of any number of shingles. An item of a thousand shingles is 13 rows of the index, not a thousand.

A document meets an item if one of its shingle hashes is a band of the item's and it has at least the threshold's share of
the item's number of shingles. A document hash beyond the largest band of all items meets nothing and goes before the join.
Pairs that meet are verified on the words themselves.

Only DataFrame functions are used. The index is broadcast if its counted rows are at most `BROADCAST_ROWS`, and the items'
words for the verification if their counted bytes are at most `BROADCAST_BYTES`; larger ones are joined by shuffle. No pair
is dropped for being frequent.

Defined results: null and empty texts, and texts or items of fewer words than a shingle, have no shingles and match
nothing; an item id that repeats stands for the shingles of all its rows; rows that share a doc_id give one row, with the
largest containment; rows without a doc_id aren't reported; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, release, texts, words

SHINGLE, THRESHOLD, RECALL, PIGEONHOLE = 5, 0.8, 1 - 1e-9, 32
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def _places(w: Column, n: int) -> Column:
    """0 .. size - n, or nothing."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, n: int) -> Column:
    return F.transform(_places(w, n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)]))


def shingle_texts(w: Column, n: int) -> Column:
    # element by element: slice() copies the whole array each time
    return F.array_distinct(F.transform(_places(w, n), lambda i: F.concat_ws(" ", *[w[i + k] for k in range(n)])))


def bands(size: Column, threshold: float, recall: float) -> Column:
    """How many of an item's smallest hashes its partition takes: enough to meet any document with the containment.

    `size` shingles with a containment of `threshold` leave floor((1 - threshold) * size) that may be lacking. Of a bottom
    sketch drawn without putting back, s bands are all lacking with a probability under (1 - threshold)^s.
    """
    lacking = F.floor(size * (1 - threshold) + 1e-9)
    most = math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if 0 < threshold < 1 else 1
    return F.when(size <= PIGEONHOLE, lacking + 1).otherwise(F.least(lacking + 1, F.lit(most))).cast("int")


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every pair with containment >= threshold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    sized = items.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).select("item_id", F.explode(shingle_texts(F.col("w"), n)).alias("s")).distinct()
    sized = scratch.table(sized.groupBy("item_id").agg(F.collect_list("s").alias("shingles")), "items")
    hashed = F.transform("shingles", lambda s: F.xxhash64(*[F.split(s, " ")[i] for i in range(n)]))
    least = F.ceil(F.size("shingles") * threshold - 1e-9)
    index = sized.select("item_id", least.alias("least"), F.explode(F.slice(F.array_sort(F.array_distinct(hashed)), F.lit(1), bands(F.size("shingles"), threshold, recall))).alias("h"))
    index = scratch.table(index, "index")
    count, top = index.agg(F.count("*"), F.max("h")).first()
    words_bytes = sized.agg(F.sum(F.length(F.array_join("shingles", " ")).cast("long"))).first()[0] or 0

    docs = texts(docs)
    hashes = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", (F.size("w") - n + 1).alias("size"))  # before the rows multiply
    hashes = hashes.select("doc_id", "size", F.explode(F.filter(shingle_hashes(F.col("w"), n), lambda h: h <= F.lit(top))).alias("h"))
    met = hashes.join(F.broadcast(index) if count <= BROADCAST_ROWS else index, "h").filter(F.col("size") >= F.col("least")).select("doc_id", "item_id").distinct()
    met = scratch.table(met, "met")

    # verification reads only documents that met an item
    pairs = met.join(F.broadcast(sized) if words_bytes <= BROADCAST_BYTES else sized.hint("merge"), "item_id")
    near = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingle_texts(F.col("w"), n).alias("own"))
    shared = F.size(F.array_intersect("own", "shingles")).cast("long")
    got = near.join(pairs, "doc_id").select("doc_id", "item_id", shared.alias("n_shared"), F.size("shingles").cast("long").alias("n_shingles"))
    got = got.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    release(spark)
    return got.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold).select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment for documents and items; odd rows as defined above."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8"""
