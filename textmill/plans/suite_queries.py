"""Queries of evaluation suites and reference sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, word_count
from ..operators import suites
from .base import SCORED, WORDS_SQL, scored
from .catalogue import query, table

_strip = f"regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_before, _behind, _not = (rx.replace("'", "''") for rx in (suites.SPACE_BEFORE, suites.SPACE_BEHIND, suites.SPACE_NOT))
_ends = suites.SENTENCE_ENDS.replace("'", "''").replace('\\"', '"')


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"""WITH w AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g')), '{_before}', '\\1', 'g'), ' ') AS w FROM documents),
e AS (SELECT doc_id, w, list_max([i for i in range({suites.LEAST}, least(len(w), {suites.MOST + suites.OVER}) + 1) if regexp_matches(w[i], '{_ends}')]) AS stop FROM w)
SELECT doc_id, md5(t) AS digest, len(string_split(t, ' ')) AS words FROM (SELECT doc_id, array_to_string(CASE WHEN len(w) <= {suites.MOST} THEN w ELSE w[1:coalesce(stop, {suites.MOST})] END, ' ') AS t FROM e WHERE len(w) >= {suites.LEAST})""")
def suite_excerpts(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", suites.suite_excerpt(F.col("text")).alias("t")).filter("t IS NOT NULL")
    return d.select("doc_id", F.md5("t").alias("digest"), F.size(F.split("t", " ")).alias("words"))


@query(f"""SELECT doc_id, md5(regexp_replace(t, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS digest FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(text, '{_before}', '\\1', 'g'), '{_behind}', '\\1', 'g'), '{_not}', 'n''t', 'g') AS t FROM (SELECT doc_id, replace(replace(text, ',', ' ,'), '(', '( ') AS text FROM documents))""")
def untokenised_texts(spark, sf_dir):
    spaced = F.replace(F.replace(F.col("text"), F.lit(","), F.lit(" ,")), F.lit("("), F.lit("( "))
    return _docs(spark, sf_dir).select("doc_id", F.md5(suites.untokenised(spaced)).alias("digest"))


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'first' WHEN 'src2' THEN 'second' ELSE 'first' END AS domain FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de')")
def suite_cells(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("sub_source"), F.col("lang").alias("model"))
    return suites.cells(d, {"src1": "first", "src2": "second", "src3": "first"}, ["en", "de"]).select("doc_id", "domain")


@query(f"""WITH {SCORED}, x AS (SELECT doc_id // 4 AS grp, doc_id, label, words, source FROM sc), g AS (SELECT grp, grp % 3 AS domain, arg_min({{'id': doc_id, 'words': words}}, doc_id) FILTER (label = 0) AS h,
  arg_min({{'id': doc_id, 'words': words}}, doc_id) FILTER (label = 1) AS a FROM x GROUP BY grp),
b AS (SELECT *, CASE WHEN h.words < 120 THEN 'short' ELSE 'long' END AS length FROM g WHERE h IS NOT NULL AND a IS NOT NULL AND (h.words < 120) = (a.words < 120)),
p AS (SELECT *, row_number() OVER (PARTITION BY domain, length ORDER BY sha256('5:' || grp), grp) AS p FROM b)
SELECT grp, domain, length, unnest([h.id, a.id]) AS id, unnest([0, 1]) AS label, unnest([h.words, a.words]) AS words FROM p WHERE p <= 4""")
def reference_pairs(spark, sf_dir):
    grp = F.floor(F.col("doc_id") / 4)
    s = scored(spark, sf_dir).select(grp.alias("grp"), (grp % 3).alias("domain"), "label", F.col("doc_id").alias("ord"), "words", F.col("doc_id").alias("id"))
    return suites.reference_pairs(s, 4, "5")


@query(f"""WITH {SCORED}, r AS (SELECT doc_id AS id, generator, CASE WHEN words < 120 THEN 'short' ELSE 'long' END AS length FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY generator, length ORDER BY sha256('1:' || id), id) AS p FROM r), a AS (SELECT * FROM k WHERE generator <> 'human' AND p <= 3),
n AS (SELECT length, count(*) AS n FROM a GROUP BY length) SELECT id, generator, length FROM a UNION ALL SELECT id, generator, length FROM k JOIN n USING (length) WHERE generator = 'human' AND p <= n""")
def matched_humans(spark, sf_dir):
    s = scored(spark, sf_dir).select(F.col("doc_id").alias("id"), "generator", suites.length_class(F.col("words")).alias("length"))
    return suites.matched_humans(s, 3, "1")


@query(f"WITH {SCORED} SELECT generator, round(avg(score), 6) AS mean, min(score) AS lowest, max(score) AS highest, count(*) AS n FROM sc GROUP BY generator")
def generator_scores(spark, sf_dir):
    return suites.score_range(scored(spark, sf_dir), ["generator"]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {SCORED} SELECT label, round(avg(CASE WHEN words >= 120 THEN score >= 0.7 ELSE score >= 0.9 END::INT), 6) AS rate, count(*) AS n FROM sc GROUP BY label")
def shown_rates(spark, sf_dir):
    return suites.shown_rates(scored(spark, sf_dir), 0.7, 0.9).withColumn("rate", F.round("rate", 6))


@query(f"WITH {SCORED} SELECT doc_id FROM sc WHERE words BETWEEN 40 AND 119 AND score >= 0.87")
def worth_splitting(spark, sf_dir):
    return suites.worth_splitting(scored(spark, sf_dir)).select("doc_id")


@query(f"WITH {SCORED} SELECT length, n, row_number() OVER (ORDER BY coalesce(list_position(['120-330', '40-119'], length), 3), length) - 1 AS place FROM (SELECT length, count(*) AS n FROM sc GROUP BY length)")
def report_order(spark, sf_dir):
    return suites.in_report_order(scored(spark, sf_dir).groupBy("length").agg(F.count("*").alias("n")), "length", ["120-330", "40-119"])


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS p FROM documents) SELECT doc_id, CASE WHEN p <= 30 THEN 'calibration' ELSE 'training' END AS part FROM h WHERE p <= 400""")
def seeded_take(spark, sf_dir):
    return suites.seeded_take(_docs(spark, sf_dir).select("doc_id"), "doc_id", 400, 30, "7")


@query("""WITH r AS (SELECT event_type AS stage, 'm' || user_id % 4 AS run, min(value) AS v FROM events GROUP BY ALL) SELECT r.stage, r.run, r.v AS fastest, b.v AS base, round(r.v / b.v, 6) AS ratio
FROM r LEFT JOIN r b ON b.stage = r.stage AND b.run = 'm0' WHERE r.run <> 'm0'""")
def side_by_side(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("run")).agg(F.min("value").alias("fastest"))
    return suites.side_by_side(e, ["stage"], "run", "fastest", "m0", measured=False).withColumn("ratio", F.round("ratio", 6))


@query("SELECT DISTINCT source, lang FROM documents WHERE (source, lang) NOT IN (SELECT source, lang FROM documents GROUP BY ALL HAVING count(*) >= 15)")
def newly_found(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", "lang")
    return suites.newly_found(d, d.groupBy("source", "lang").count().filter("count >= 15"), ["source", "lang"])


@query("SELECT strftime(ts, '%Y') AS year, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1")
def accepted_by_year(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("created"), F.when(F.col("value") >= 50, "same").otherwise("changed").alias("state"))
    return suites.accepted_by_year(e)


@query("SELECT count(*) AS entries, count(*) * 235 AS bytes FROM events")
def store_size(spark, sf_dir):
    return suites.store_size(table(spark, sf_dir, "events"))


@query("SELECT doc_id, strftime(make_timestamp((1000000000 + doc_id * 86399)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM documents")
def utc_stamps(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", suites.utc_stamp(F.lit(1_000_000_000) + F.col("doc_id") * 86399).alias("stamp"))


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'de' AND doc_id % 3 <> 0) AND source NOT IN ('src4', 'src5')")
def may_be_sent(spark, sf_dir):
    """Texts as requests: their source is the host, German ones are papers, every third goes to a local provider."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("host"), F.when(F.col("lang") == "de", "pdf").otherwise("page").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "local").otherwise("remote").alias("provider"))
    return suites.may_be_sent(rows, ["local"], spark.createDataFrame([("src4",), ("src5",)], "host string")).select("doc_id")
