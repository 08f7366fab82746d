"""Queries of readers, parsers, writers and guards: files are written from the tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import probability_from_labels
from ..operators import filters
from ..shared import shared_dir
from ..sources import readers, sinks
from .base import SCORED, scored
from .catalogue import query, table

EDITS = """CASE WHEN doc_id % 2 = 0 THEN '2022-0' || (1 + doc_id % 9) || '-15T10:00:00Z' END"""


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'qa:web:' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN ':h0' ELSE ':a0' END AS id, doc_id % 2 AS label, CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'gpt-3.5' END AS generator,
  'qa:web:' || (doc_id // 2) AS grp, md5(text) AS digest FROM documents WHERE trim(text) <> ''""")
def parsed_answers(spark, sf_dir):
    """Neighbours as question pairs in lines of JSON."""
    one = lambda y: F.array_compact(F.array(F.max(F.when(F.col("doc_id") % 2 == y, F.col("text")))))
    pairs = _docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 2).alias("line")).agg(F.lit("q").alias("question"), one(0).alias("human_answers"), one(1).alias("chatgpt_answers"))
    path = _folder(spark, "answers")
    pairs.write.json(path)
    items = readers.read_jsonl(spark, path, readers.QA + ", line long")
    rows = readers.make_rows(readers.parse_answers(items, "web"), "qa", {"web": "web"}, {"chatgpt": "gpt-3.5"})
    return rows.select("id", "label", "generator", "grp", F.md5("text").alias("digest"))


@query("""SELECT 'coded:train:' || doc_id AS id, source AS sub_source, (doc_id % 3 <> 0)::INT AS label, CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'g' || doc_id % 5 END AS generator,
  CASE doc_id % 3 WHEN 1 THEN 'topical' WHEN 2 THEN 'continuation' END AS prompt_type FROM documents WHERE trim(text) <> '' AND source <> 'src3'""")
def parsed_codes(spark, sf_dir):
    """Origins as codes in a CSV file with quoted texts of any length; one source is left out."""
    kind, s = F.col("doc_id") % 3, lambda c: c.cast("string")
    made = F.concat(F.col("source"), F.lit("_machine_"), F.when(kind == 1, "topical").otherwise("continuation"), F.lit("_g"), s(F.col("doc_id") % 5))
    d = _docs(spark, sf_dir).select("text", s((kind == 0).cast("int")).alias("label"), F.when(kind == 0, F.concat("source", F.lit("_human"))).otherwise(made).alias("src"), s(F.col("doc_id")).alias("line"))
    path = _folder(spark, "codes")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    names = [r[0] for r in _docs(spark, sf_dir).select("source").distinct().collect()]  # a fixed list of sources
    rows = readers.make_rows(readers.parse_coded(readers.read_csv(spark, path, ["text", "label", "src", "line"]), "train"), "coded", {n: None if n == "src3" else "web" for n in names})
    return rows.select("id", "sub_source", "label", "generator", F.col("meta")["prompt_type"].alias("prompt_type"))


@query("SELECT doc_id::VARCHAR AS id, (doc_id % 4 <> 0)::INT AS label, 'd' || (doc_id // 4) AS grp, CASE WHEN doc_id % 4 <> 0 THEN 'greedy' END AS decoding FROM documents WHERE doc_id % 5 <> 0")
def parsed_attacks(spark, sf_dir):
    s = lambda c: c.cast("string")
    d = _docs(spark, sf_dir).select(
        s(F.col("doc_id")).alias("id"), F.concat(F.lit("d"), s(F.floor(F.col("doc_id") / 4))).alias("source_id"), F.lit("news").alias("domain"), F.when(F.col("doc_id") % 4 == 0, "human").otherwise("g1").alias("model"),
        F.when(F.col("doc_id") % 5 == 0, "zero_width").otherwise("none").alias("attack"), F.lit("greedy").alias("decoding"), F.lit("no").alias("repetition_penalty"), F.col("text").alias("generation"),
    )
    return readers.parse_attacked(d, ["news"]).select("id", "label", "grp", F.col("meta")["decoding"].alias("decoding"))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang <> 'en' THEN source END AS source FROM documents")
def tab_separated(spark, sf_dir):
    """Lines with comments and empty ones between; a last field may be absent."""
    line = F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), "source"))
    path = _folder(spark, "lines")
    _docs(spark, sf_dir).select(F.explode(F.array(line, F.lit("# comment"), F.lit(" "))).alias("value")).write.text(path)
    return readers.read_tsv(spark, path, ["doc_id", "source"])


@query("SELECT count(*) FILTER (lang <> 'es' AND length(text) % 7 <> 0) AS n, count(*) FILTER (lang = 'es') AS excluded, count(*) FILTER (lang <> 'es' AND length(text) % 7 = 0) AS empty FROM documents")
def written_rows(spark, sf_dir):
    """What a writer's receipt says of rows, excluded rows and empty texts."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", F.when(F.length("text") % 7 != 0, F.col("text")).otherwise(" ").alias("text"))
    got = sinks.write_rows(d, _folder(spark, "rows"), text="text", excluded=F.col("lang") == "es")
    return spark.createDataFrame([(got["n"], got["excluded"], got["empty"])], "n long, excluded long, empty long")


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, lang, count(*) AS n FROM documents GROUP BY ALL")
def split_report(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    path = _folder(spark, "splits")
    sinks.write_splits(d, path, by=["lang"])
    return spark.read.parquet(path + "-report")


@query(f"WITH {SCORED} SELECT doc_id AS id, score FROM sc")
def joined_scores(spark, sf_dir):
    """Every row has its score, or the run stops."""
    s = scored(spark, sf_dir).select(F.col("doc_id").alias("id"), "score")
    return filters.join_scores(s.select("id"), s, "id")


@query(f"""WITH d AS (SELECT doc_id, '20' || (19 + doc_id % 5) || '-06-30T23:59:59Z' AS created, {EDITS} AS edited FROM documents)
SELECT doc_id FROM d WHERE substr(created, 1, 10) <= '2022-06-30' AND (edited IS NULL OR substr(edited, 1, 10) <= '2022-06-30')""")
def before_cutoff(spark, sf_dir):
    created = F.concat(F.lit("20"), (19 + F.col("doc_id") % 5).cast("string"), F.lit("-06-30T23:59:59Z"))
    edited = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2022-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("-15T10:00:00Z")))
    return _docs(spark, sf_dir).filter(filters.before_cutoff(created, edited, "2022-06-30")).select("doc_id")


@query("""SELECT doc_id, CASE WHEN m BETWEEN 200 AND 100000 THEN m END AS max_chars, CASE WHEN r BETWEEN 0 AND 1 THEN r END AS red_from,
  concat_ws(',', CASE WHEN NOT m BETWEEN 200 AND 100000 THEN 'maxChars' END, CASE WHEN NOT r BETWEEN 0 AND 1 THEN 'redFrom' END) AS notes FROM (SELECT doc_id, length(text)::INT AS m, (doc_id % 13) / 10 AS r FROM documents)""")
def server_infos(spark, sf_dir):
    """What a server tells of itself: values out of range are left out and named."""
    info = F.to_json(F.struct(F.length("text").alias("maxChars"), ((F.col("doc_id") % 13) / 10).alias("redFrom")))
    d = _docs(spark, sf_dir).select("doc_id", filters.server_info(info).alias("i"))
    return d.select("doc_id", F.col("i.maxChars").alias("max_chars"), F.col("i.redFrom").alias("red_from"), F.concat_ws(",", "i.notes").alias("notes"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN s WHEN 1 THEN round(1 - s, 9) WHEN 2 THEN s END AS p FROM (SELECT doc_id, (doc_id % 101) / 100 AS s FROM documents)""")
def label_probabilities(spark, sf_dir):
    """Answers of classifiers: the AI label's score, the human one's complement, both, or neither."""
    s, kind = (F.col("doc_id") % 101) / 100, F.col("doc_id") % 4
    one = lambda name, v: F.struct(F.lit(name).alias("label"), v.cast("double").alias("score"))
    labels = F.when(kind == 0, F.array(one("Fake", s))).when(kind == 1, F.array(one("human-written", s))).when(kind == 2, F.array(one("real", F.lit(0.3)), one("LABEL_1", s))).otherwise(F.array(one("other", s)))
    return _docs(spark, sf_dir).select("doc_id", F.round(probability_from_labels(labels), 9).alias("p"))


@query("""WITH d AS (SELECT doc_id, (doc_id * 37 % 5000)::DOUBLE AS top FROM documents), s AS (SELECT doc_id, greatest(1000 - (top + 20), top - 1800, 0) AS distance FROM d)
SELECT doc_id, distance, distance <= 1200 AS near FROM s""")
def scan_distance(spark, sf_dir):
    top = (F.col("doc_id") * 37 % 5000).cast("double")
    d = _docs(spark, sf_dir).select("doc_id", top.alias("top"), (top + 20).alias("bottom"))
    return filters.scan_order(d, "top", "bottom", 1000.0, 1800.0).select("doc_id", "distance", "near")
