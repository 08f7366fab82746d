"""Queries on filters, guards, lookups and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import filters, scorers
from .base import SCORED, WORDS_SQL, scored, unit_sql
from .catalogue import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


RULES = [{"source": "src3", "lang": "en", "reason": "as an example"}, {"source": "src7", "reason": "as a whole"}]


@query("SELECT doc_id, CASE WHEN source = 'src3' AND lang = 'en' OR source = 'src7' THEN 'configured' WHEN quality = 1 AND doc_id % 2 = 1 THEN 'surplus' END AS reason FROM documents JOIN labels USING (doc_id)")
def drop_reasons(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return filters.drop_reasons(d, RULES, d.filter("doc_id % 2 = 0"), "doc_id").select("doc_id", "reason")


@query(f"WITH {SCORED} SELECT doc_id FROM sc JOIN (SELECT source, label FROM sc GROUP BY ALL HAVING count(*) >= 5) USING (source, label)")
def large_cells(spark, sf_dir):
    return filters.large_cells(scored(spark, sf_dir).select("doc_id", "source", "label"), ["source", "label"], 5).select("doc_id")


@query(f"""WITH f AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user')
SELECT conv_id::VARCHAR AS grp, array_to_string(regexp_extract_all(text, '[^{tx.SPACE}]+')[1:60], ' ') AS opening FROM f WHERE r = 1""")
def first_openings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return filters.first_openings(c.select(F.col("conv_id").cast("string").alias("grp"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label"), "text", F.col("turn").alias("ord")))


@query(f"""WITH c AS (SELECT conv_id, turn, role, {WORDS_SQL} AS words FROM conversations)
SELECT conv_id, min(turn) FILTER (role = 'user') AS human, min(turn) FILTER (role = 'assistant') AS ai FROM c WHERE words BETWEEN 15 AND 60 GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0""")
def paired_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    c = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label"), tx.word_count(F.col("text")).alias("words"))
    return filters.paired_answers(c, 15, 60).withColumnRenamed("grp", "conv_id")


@query("""SELECT doc_id, 'missing' AS state FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unused' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def referential_integrity(spark, sf_dir):
    return filters.references(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey > 0), c AS (SELECT 1::BIGINT AS node UNION SELECT child FROM e JOIN c ON parent = node) SELECT node FROM c""")
def subclass_closure(spark, sf_dir):
    """Everything under a node of a tree of numbers."""
    e = table(spark, sf_dir, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 3").alias("parent"))
    return filters.closure(e, spark.createDataFrame([(1,)], "node long"))


@query(f"""WITH {SCORED}, f AS (SELECT source, doc_id FROM sc WHERE score >= 0.8) SELECT source, doc_id AS pos, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number,
  coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), min(doc_id) OVER (PARTITION BY source)) AS next_pos FROM f""")
def next_flagged(spark, sf_dir):
    f = scored(spark, sf_dir).filter("score >= 0.8").select("source", F.col("doc_id").alias("pos"))
    return filters.next_flagged(f, "source")


@query("SELECT conv_id, turn AS pos, CASE WHEN role = 'user' THEN (count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT - 1 ELSE -1 END AS span FROM conversations")
def text_index(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "user", F.lit("x")).otherwise("").alias("text"))
    return filters.text_index(c, "conv_id").select("conv_id", "pos", "span")


@query("SELECT conv_id, turn AS pos, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2) AS grp FROM conversations")
def groups_from_sizes(spark, sf_dir):
    """Turns in pairs; each row is told how many stand in its group, the last one of an odd number alone."""
    pair = Window.partitionBy("conv_id", F.floor(F.col("turn") / 2))
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.count("*").over(pair).alias("size"))
    return filters.groups_from_sizes(c, "conv_id").select("conv_id", "pos", "grp")


@query("SELECT vec_id, 'p' || (label % 2) || ':m' || label || CASE WHEN label % 3 = 0 THEN '' ELSE '@' || (label % 3) END AS key FROM embeddings")
def model_keys(spark, sf_dir):
    e, label = table(spark, sf_dir, "embeddings"), F.col("label")
    s = lambda c: c.cast("string")
    return e.select("vec_id", filters.model_key(F.concat(F.lit("p"), s(label % 2)), F.concat(F.lit("m"), s(label)), F.when(label % 3 != 0, s(label % 3))).alias("key"))


@query("SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 ELSE 0.95 END AS score FROM documents")
def distinct_scoring(spark, sf_dir):
    return scorers.score_distinct(docs(spark, sf_dir).select("doc_id", "text"), scorers.SCORERS["stand_in"]).select("doc_id", F.col("score").cast("double").alias("score"))


@query("""WITH p AS (SELECT doc_id, substr(text, 1, 1500) AS t FROM documents), c AS (SELECT doc_id, [substr(t, i + 1, 500) for i in range(0, greatest(length(t), 1), 400)] AS ps FROM p),
k AS (SELECT doc_id, unnest(CASE WHEN len([x for x in ps if length(x) >= 200]) > 0 THEN [x for x in ps if length(x) >= 200] ELSE ps[1:1] END) AS x FROM c)
SELECT doc_id, round(avg(CASE length(x) % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 ELSE 0.95 END), 6) AS score FROM k GROUP BY doc_id""")
def chunked_scoring(spark, sf_dir):
    """A text's mean score over overlapping chunks."""
    s = scorers.pieces_mean(docs(spark, sf_dir), "doc_id", tx.chunks(F.col("text")), scorers.SCORERS["stand_in"])
    return s.select("doc_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"""SELECT doc_id, round(CASE WHEN quality = 1 THEN 0.95 ELSE 0.05 END, 4)::DOUBLE AS p_ai, md5(substr(regexp_replace(text, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g'), 1, 2000)) AS state_md5
FROM documents JOIN labels USING (doc_id) WHERE {WORDS_SQL} >= 40""")
def soft_training_rows(spark, sf_dir):
    """The documents' training rows, their state read back from its JSON: engines escape signs differently."""
    return document_training_rows(spark, sf_dir).select("doc_id", "p_ai", F.md5(F.from_json("state", "text string")["text"]).alias("state_md5"))


@query()
def document_training_rows(spark, sf_dir):
    """A training row for every labelled document of 40 words or more. `soft_training_rows` holds them against SQL, but for the JSON text itself."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").filter(tx.word_count(F.col("text")) >= 40)
    d = d.withColumn("text", F.regexp_replace("text", f"^[{tx.SPACE}]+|[{tx.SPACE}]+$", ""))
    rows = filters.training_row(d.withColumn("p_ai", filters.soft_label(F.col("quality") == 1)))
    return filters.asked(rows).select("doc_id", F.col("target")["ai"].alias("p_ai"), "state")
