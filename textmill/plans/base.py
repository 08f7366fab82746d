"""Tables that several queries start from, for Spark and as SQL common table expressions.

There is no model here: scores are a fixed function of a row's label and id, so that every measure has something to measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import unit
from ..functions.text import EXCERPT_LENGTHS, SPACE, length_group, word_count
from .catalogue import table

WORDS_SQL = f"len(regexp_extract_all(text, '[^{SPACE}]+'))"


def unit_sql(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0)"


def group_sql(words: str, groups=EXCERPT_LENGTHS) -> str:
    return "CASE " + " ".join(f"WHEN {words} <= {hi} THEN '{n}'" for n, _, hi in groups[:-1]) + f" ELSE '{groups[-1][0]}' END"


def stand_in(label: Column, key: Column, strength: float = 0.8, salt: str = "score") -> Column:
    return F.round(1 / (1 + F.exp(-(2 * label - 1) * strength - (unit(F.concat(F.lit(salt + ":"), key.cast("string"))) - 0.5) * 4)), 6)


def stand_in_sql(label: str, key: str, strength: float = 0.8, salt: str = "score") -> str:
    return f"round(1 / (1 + exp(-(2 * {label} - 1) * {strength} - ({unit_sql(f"'{salt}:' || {key}")} - 0.5) * 4)), 6)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, lang, source, text, label, toxic, words, length, score, other, view, generator."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")
    words = word_count(F.col("text"))
    generator = F.when(F.col("label") == 0, "human").otherwise(F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")))
    view = F.when(F.col("lang") == "es", "held_out_domain").when(F.col("source").isin("src18", "src19"), "testbed").when(generator == "g3", "held_out_generator").otherwise("main")
    j = j.withColumn("words", words).withColumn("generator", generator).withColumn("view", view)
    return j.withColumn("length", length_group(F.col("words"), EXCERPT_LENGTHS)).withColumn("score", stand_in(F.col("label"), F.col("doc_id"))).withColumn("other", stand_in(F.col("label"), F.col("doc_id"), 0.5, "other"))


SCORED = f"""s0 AS (SELECT d.doc_id, d.lang, d.source, d.text, l.quality AS label, l.toxic, {WORDS_SQL} AS words,
  CASE WHEN l.quality = 0 THEN 'human' ELSE 'g' || (d.doc_id % 7) END AS generator,
  {stand_in_sql('l.quality', 'd.doc_id')} AS score, {stand_in_sql('l.quality', 'd.doc_id', 0.5, 'other')} AS other
  FROM documents d JOIN labels l USING (doc_id)),
sc AS (SELECT *, {group_sql('words')} AS length, CASE WHEN lang = 'es' THEN 'held_out_domain' WHEN source IN ('src18', 'src19') THEN 'testbed'
  WHEN generator = 'g3' THEN 'held_out_generator' ELSE 'main' END AS "view" FROM s0)"""


def area_sql(rows: str, by: str = "") -> str:
    """AUROC by averaged ranks of rows(by, label, score)."""
    part = f"PARTITION BY {by}" if by else ""
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0,
  CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 THEN
    (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) END AS auroc
  FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}score) - 1) / 2 AS r FROM {rows}) {tail}"""
