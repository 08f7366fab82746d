"""A corpus pipeline of five stages; each keeps the columns of documents, but for the last, which returns sequence pieces.

Stage functions take (spark, docs, sf_dir); `run` writes each stage's rows as Parquet into the shared folder and hands the
reread table to the next one.

Each stage works on any rows of its predecessor: null and empty texts pass through (but a document all of whose lines repeat
earlier ones goes), and an empty table stays empty. Every stage decides on each row by its own text, so rows that share a doc_id,
or have none, don't share decisions. Columns beyond those of documents are left aside, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import Scratch, read_table
from textmill.llm.decontaminate import contaminated
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.near_dup import near_duplicates
from textmill.llm.packing import pack
from textmill.llm.toxicity import filtered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rejected from this score on.
TOXIC = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores under TOXIC; the network learns from the labelled ones among docs."""
    return _documents(filtered(_documents(docs), read_table(spark, sf_dir, "labels"), TOXIC))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that repeat an earlier run go, and with them documents of which nothing else is left; n_chars follows the text."""
    left = dedup_lines(_documents(docs)).filter(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    return _documents(left.withColumn("n_chars", F.length("text").cast("long")))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, that with the smallest id (rows without an id come last).

    Each row has a key of its own, so rows that share an id, or have none, are decided one by one. Texts without words are never
    near duplicates; of those that agree in id and text one row stays, without an id all.
    """
    scratch = Scratch(spark, "near-dup-rows")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    order = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(text), F.xxhash64(F.lit(1), text), F.xxhash64(*COLUMNS), "row").alias("o"))
    classes = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    stay = order.join(classes.select(F.col("doc_id").alias("row"), "class_id"), "row").groupBy("class_id").agg(F.min("o").alias("o")).select("o.*")
    stay = stay.toDF("no_id", "doc_id", "h", "g", "all", "row")
    stay = stay.groupBy("doc_id", "h", "g", F.when(F.col("no_id"), F.col("row"))).agg(F.min(F.struct("all", "row")).alias("o")).select("o.row")
    return _documents(rows.join(scratch.table(stay, "stay"), "row", "left_semi"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Texts are told apart by 64-bit hashes, so rows without an id are searched too, and
    nothing is written for it; that a clean text shares the hash of one that goes has odds of their numbers over 2^64."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    leaks = contaminated(docs.select(key.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return _documents(docs.select(*COLUMNS, key).join(leaks, "key", "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_dup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return scratch.table(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


#: SQL can't express the toxicity network and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
