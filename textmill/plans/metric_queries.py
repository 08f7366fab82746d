"""Queries on scores: ranking measures, thresholds, evaluation tables, agreement, grading, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import Grading, level, log_odds, logit
from ..functions.text import FLAGS, PER_100_WORDS, feature_rates, surface_features
from ..operators import grading, metrics
from ..shared import stage
from .base import SCORED, WORDS_SQL, area_sql, scored
from .catalogue import query, table
from .text_queries import Q

TARGET = 0.1
GRID = [0.3, 0.5, 0.7, 0.9]
LIGHT = Grading(0.5, 0.8, 120, 0.9)


@query(f"""WITH {SCORED}, r AS (SELECT lang, length, label, score FROM sc), a AS ({area_sql('r', 'lang, length')})
SELECT lang, length, n1 AS ai, n0 AS human, round(auroc, 6) AS auroc, x.fa, x.detected FROM a JOIN (SELECT lang, length, round(avg((score >= 0.7)::INT) FILTER (label = 0), 6) AS fa,
  round(avg((score >= 0.7)::INT) FILTER (label = 1), 6) AS detected FROM sc GROUP BY lang, length) x USING (lang, length)""")
def flagship(spark, sf_dir):
    """Scored documents by language and length: ranking quality, false alarms and detection."""
    s = scored(spark, sf_dir)
    a = metrics.auroc(s, ["lang", "length"])
    rate = lambda y: F.round(F.avg(F.when(F.col("label") == y, (F.col("score") >= 0.7).cast("double"))), 6)
    x = s.groupBy("lang", "length").agg(rate(0).alias("fa"), rate(1).alias("detected"))
    return a.join(x, ["lang", "length"]).select("lang", "length", F.col("n1").alias("ai"), F.col("n0").alias("human"), F.round("auroc", 6).alias("auroc"), "fa", "detected")


@query(f"WITH {SCORED}, r AS (SELECT label, score FROM sc) SELECT n1, n0, round(auroc, 6) AS auroc FROM ({area_sql('r')})")
def auroc_overall(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir), []).withColumn("auroc", F.round("auroc", 6))


@query(f"WITH {SCORED}, r AS (SELECT source, label, score FROM sc) SELECT source, n1, n0, round(auroc, 6) AS auroc FROM ({area_sql('r', 'source')})")
def auroc_by_domain(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir), ["source"]).withColumn("auroc", F.round("auroc", 6))


_rate = lambda n: f"100.0 * len(regexp_extract_all(text, '{Q(('(?m)' if n == 'markdown' else '') + PER_100_WORDS[n])}')) / greatest({WORDS_SQL}, 1)"
_values = {"words": f"greatest({WORDS_SQL}, 1)::DOUBLE", "chars_per_word": f"length(text) / greatest({WORDS_SQL}, 1)"} | {n: _rate(n) for n in PER_100_WORDS} | {n: f"regexp_matches(text, '{Q(rx)}')::INT::DOUBLE" for n, rx in FLAGS.items()}
_fsql = ", ".join(f"{{'f': '{n}', 'v': round({v}, 6)::DOUBLE}}" for n, v in _values.items())


@query(f"""WITH d AS (SELECT toxic AS label, unnest([{_fsql}]) AS x FROM documents JOIN labels USING (doc_id)), r AS (SELECT x.f AS feature, label, x.v AS score FROM d)
SELECT feature, round(greatest(auroc, 1 - auroc), 6) AS folded, CASE WHEN auroc > 0.5 THEN 'ai' ELSE 'human' END AS side FROM ({area_sql('r', 'feature')})""")
def single_feature_auroc(spark, sf_dir):
    """Every feature of a text's surface for itself: how well it tells the classes apart, and which one it is high for."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    values = surface_features(F.col("text"))
    d = d.select("label", F.array(*[F.struct(F.lit(n).alias("feature"), F.round(c, 6).alias("score")) for n, c in values.items()]).alias("x"))
    long = d.select("label", F.explode("x").alias("x")).select("label", "x.feature", "x.score")
    a = metrics.auroc_of_counts(stage(metrics.value_counts(long, ["feature"], "label", "score"), "features"), ["feature"])
    return a.select("feature", F.round(F.greatest("auroc", 1 - F.col("auroc")), 6).alias("folded"), F.when(F.col("auroc") > 0.5, "ai").otherwise("human").alias("side"))


def threshold_sql(rows: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, max(score) FILTER (allowed > 0 AND k = n_all - allowed + 1) AS threshold,
  coalesce(max(score) FILTER (allowed > 0 AND k = n_all - allowed + 1) = max(score) FILTER (allowed > 0 AND k = n_all - allowed), false) AS strict
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score) AS k, count(*) OVER (PARTITION BY {by}) AS n_all, floor({TARGET} * count(*) OVER (PARTITION BY {by}))::BIGINT AS allowed FROM {rows}) GROUP BY {by}"""


HUMANS = """h AS (SELECT length, score FROM sc WHERE "view" = 'main' AND label = 0)"""
FLAGGED = f"""{HUMANS}, th AS ({threshold_sql('h', 'length')}),
fl AS (SELECT sc.*, coalesce(CASE WHEN strict THEN score > threshold ELSE score >= threshold END, false) AS flag FROM sc LEFT JOIN th USING (length))"""


def thresholds(s):
    return metrics.thresholds(s.filter("view = 'main' AND label = 0"), ["length"], target=TARGET)


def flagged(spark, sf_dir):
    s = scored(spark, sf_dir)
    t = thresholds(s).select("length", "threshold", "strict")  # a row for each length group
    return s.join(F.broadcast(t), "length", "left").withColumn("flag", F.coalesce(metrics.flagged(F.col("score"), F.col("threshold"), F.col("strict")), F.lit(False)))


@query(f"WITH {SCORED}, {HUMANS} {threshold_sql('h', 'length')}")
def threshold_fa(spark, sf_dir):
    return thresholds(scored(spark, sf_dir))


def measures_sql(rows: str, by: str, lent: str | None = None) -> str:
    """Measures as SQL; lent: humans(score, flag) for groups that have none."""
    pool = f"SELECT {by}, label, score FROM {rows}"
    if lent:
        pool += f" UNION ALL SELECT g.*, 0, score FROM (SELECT {by} FROM {rows} GROUP BY {by} HAVING count(*) FILTER (label = 0) = 0) g, {lent}"
    fp = f"CASE WHEN human = 0 THEN (SELECT count(*) FILTER (flag) FROM {lent}) ELSE fp END" if lent else "fp"
    return f"""SELECT {by}, human, ai, round(auroc, 6) AS auroc, CASE WHEN human > 0 THEN round(fp / human, 6) END AS fa, CASE WHEN ai > 0 THEN round(tp / ai, 6) END AS detected,
  CASE WHEN auroc IS NOT NULL THEN round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + {fp} + ai) END, 6) END AS f1
  FROM (SELECT {by}, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai, count(*) FILTER (label = 1 AND flag) AS tp, count(*) FILTER (label = 0 AND flag) AS fp FROM {rows} GROUP BY {by})
  LEFT JOIN ({area_sql(f'({pool})', by)}) USING ({by})"""


@query(f"""WITH {SCORED}, {FLAGGED}, lent AS (SELECT score, flag FROM fl WHERE "view" = 'main' AND label = 0), v AS (SELECT "view" AS key, label, score, flag FROM fl) {measures_sql('v', 'key', 'lent')}""")
def measures_by_view(spark, sf_dir):
    f = flagged(spark, sf_dir)
    return metrics.measures(f.withColumn("key", F.col("view")), ["key"], f.filter("view = 'main'"))


_dims = """d AS (SELECT x.dim || ':' || x.key AS key, label, score, flag FROM (SELECT label, score, flag, unnest([{'dim': 'length', 'key': length}, {'dim': 'lang', 'key': lang}, {'dim': 'source', 'key': source}]) AS x FROM fl WHERE "view" = 'main'))"""


@query(f"WITH {SCORED}, {FLAGGED}, {_dims} {measures_sql('d', 'key')}")
def measures_by_dimension(spark, sf_dir):
    m = metrics.by_dimensions(flagged(spark, sf_dir).filter("view = 'main'"), ["length", "lang", "source"])
    return m.select(F.concat_ws(":", "dim", "key").alias("key"), *m.columns[2:])


@query(f"""WITH {SCORED}, {FLAGGED}, lent AS (SELECT score, flag FROM fl WHERE "view" = 'main' AND label = 0),
g AS (SELECT generator AS key, label, score, flag FROM fl WHERE label = 1 AND "view" = 'main' OR "view" = 'held_out_generator') {measures_sql('g', 'key', 'lent')}""")
def borrowed_humans(spark, sf_dir):
    f = flagged(spark, sf_dir)
    rows = f.filter("(label = 1 AND view = 'main') OR view = 'held_out_generator'").withColumn("key", F.col("generator"))
    return metrics.measures(rows, ["key"], f.filter("view = 'main'"))


@query(f"WITH {SCORED} SELECT lang, " + ", ".join(f"round(quantile_cont(score, {p}), 6) AS p{int(p * 100)}" for p in (0.05, 0.5, 0.95)) + " FROM sc GROUP BY lang")
def percentiles(spark, sf_dir):
    p = metrics.percentiles(scored(spark, sf_dir), ["lang"], "score", {f"p{int(p * 100)}": p for p in (0.05, 0.5, 0.95)})
    return p.select("lang", *[F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")])


@query(f"WITH {SCORED} SELECT source, length, t AS threshold, count(*) AS n, round(avg((score >= t)::INT), 6) AS share FROM sc, (SELECT unnest({GRID}::DOUBLE[]) AS t) WHERE label = 0 GROUP BY ALL")
def threshold_grid(spark, sf_dir):
    return metrics.threshold_grid(scored(spark, sf_dir).filter("label = 0"), ["source", "length"], GRID)


@query(f"WITH {SCORED} SELECT t / 100 AS threshold, avg(((score >= t / 100) = (label = 1))::INT) AS accuracy FROM sc, range(1, 100) r(t) GROUP BY t ORDER BY accuracy DESC, t <> 50, t LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT max(a) AS accuracy FROM (SELECT t.score, avg(((sc.score >= t.score) = (label = 1))::INT) AS a FROM sc, (SELECT DISTINCT score FROM sc) t GROUP BY t.score)")
def best_accuracy(spark, sf_dir):
    return metrics.best_accuracy(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT lang, " + ", ".join(f"count(*) FILTER ({'' if h else 'NOT '}score >= 0.7 AND label = {y}) AS {n}" for n, h, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))) + " FROM sc GROUP BY lang")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), 0.7, ["lang"])


@query(f"""WITH {SCORED}, a AS (SELECT doc_id, lang, label, score, rep, row_number() OVER (PARTITION BY rep, lang, label ORDER BY sha256('21:' || rep || ':' || doc_id), doc_id) AS k,
  count(*) OVER (PARTITION BY rep, lang, label) AS m FROM sc, range(200) t(rep)),
b AS (SELECT *, CASE WHEN k <= m // 2 THEN 0 ELSE 1 END AS half FROM a), h AS (SELECT rep, score FROM b WHERE half = 0 AND label = 0), t AS ({threshold_sql('h', 'rep')}),
e AS (SELECT rep, avg((CASE WHEN strict THEN score > threshold ELSE score >= threshold END)::INT) FILTER (label = 0) AS fa, avg((CASE WHEN strict THEN score > threshold ELSE score >= threshold END)::INT) FILTER (label = 1) AS detected
  FROM b JOIN t USING (rep) WHERE half = 1 AND threshold IS NOT NULL GROUP BY rep)
SELECT m AS measure, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, count(v) AS n
FROM (SELECT unnest(['fa', 'detected']) AS m, unnest([fa, detected]) AS v FROM e) GROUP BY m""")
def crossval_summary(spark, sf_dir):
    """Thresholds set on one half of the rows and measured on the other, over seeded repetitions."""
    from ..operators.split import half_split

    b = half_split(scored(spark, sf_dir).select("doc_id", "lang", "label", "score"), ["lang", "label"], "doc_id", 200, "21")
    t = metrics.thresholds(b.filter("half = 0 AND label = 0"), ["rep"], target=TARGET).filter("threshold IS NOT NULL").select("rep", "threshold", "strict")
    e = b.filter("half = 1").join(F.broadcast(t), "rep").withColumn("flag", metrics.flagged(F.col("score"), F.col("threshold"), F.col("strict")).cast("double"))
    e = e.groupBy("rep").agg(F.avg(F.when(F.col("label") == 0, F.col("flag"))).alias("fa"), F.avg(F.when(F.col("label") == 1, F.col("flag"))).alias("detected"))
    e = stage(e, "halves")  # a row for each repetition, read more than once
    return metrics.summary(e.unpivot("rep", ["fa", "detected"], "measure", "value"), ["measure"], "value")


@query(f"""WITH {SCORED} SELECT count(*) AS n, round(corr(score, other), 6) AS pearson, round(max(abs(score - other)), 6) AS max_diff, round(avg(abs(score - other)), 6) AS mean_diff,
  round(quantile_cont(abs(score - other), 0.5), 6) AS median_diff, count(*) FILTER (abs(score - other) > 0.01) AS over_1, count(*) FILTER (abs(score - other) > 0.05) AS over_5,
  count(*) FILTER ((score >= 0.5) <> (other >= 0.5)) AS moved_50, count(*) FILTER ((score >= 0.8) <> (other >= 0.8)) AS moved_80 FROM sc""")
def score_agreement(spark, sf_dir):
    return metrics.agreement(scored(spark, sf_dir), "score", "other", [0.5, 0.8])


_up2 = lambda x: f"ceil(({x}) * 100 - 1e-9) / 100"


@query(f"""WITH {SCORED}, h AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM sc WHERE label = 0), x AS (SELECT max(score) AS top, max(score) FILTER (k = floor(0.75 * (n - 1)) + 1) AS q FROM h),
r AS (SELECT q, least(greatest({_up2('top + 0.01')}, 0.06), 0.99) AS red_from FROM x) SELECT least(greatest({_up2('q')}, 0.05), round((red_from - 0.01) * 100) / 100) AS yellow_from, red_from FROM r""")
def suggest_thresholds(spark, sf_dir):
    return grading.suggest_thresholds(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, s AS (SELECT label, score FROM sc WHERE words < 120), c AS (SELECT least(greatest({_up2('max(score) FILTER (label = 0) + 0.01')}, 0.5), 0.99) AS candidate FROM s),
g AS (SELECT candidate, count(*) FILTER (label = 0) AS n_human, count(*) FILTER (label = 1) AS n_ai, avg((score >= candidate)::INT) FILTER (label = 1) AS caught FROM s, c GROUP BY candidate)
SELECT candidate, round(caught, 6) AS caught, CASE WHEN n_human >= 15 AND n_ai >= 15 AND caught >= 0.3 THEN candidate END AS short_red_from, n_human, n_ai FROM g""")
def suggest_short_red(spark, sf_dir):
    return grading.suggest_short_red(scored(spark, sf_dir), 0.5)


@query(f"""WITH {SCORED}, r AS (SELECT label, score FROM sc), f AS (SELECT count(*) AS n, count(*) FILTER (score IS NULL OR score NOT BETWEEN 0 AND 1) AS invalid, avg(score) FILTER (label = 1) AS a, avg(score) FILTER (label = 0) AS h FROM sc)
SELECT n, invalid, a > h AS direction_ok, round(auroc, 6) AS auroc, CASE WHEN invalid > 0 OR a <= h OR auroc < 0.6 THEN 'fail' WHEN auroc < 0.8 THEN 'warn' ELSE 'ok' END AS status FROM f, ({area_sql('r')})""")
def model_verdict(spark, sf_dir):
    return grading.verdict(scored(spark, sf_dir))


@query(f"WITH {SCORED}, i AS (SELECT doc_id, label, 1 - score AS score FROM sc) SELECT doc_id, round(CASE WHEN f THEN 1 - score ELSE score END, 6) AS score, f AS flipped FROM i, (SELECT avg(score) FILTER (label = 1) < avg(score) FILTER (label = 0) AS f FROM i)")
def model_orientation(spark, sf_dir):
    return grading.oriented(scored(spark, sf_dir).withColumn("score", 1 - F.col("score"))).select("doc_id", F.round("score", 6).alias("score"), "flipped")


LEVEL_SQL = "CASE WHEN score < 0.5 THEN 'green' WHEN words >= 120 THEN CASE WHEN score >= 0.8 THEN 'red' ELSE 'yellow' END WHEN score >= 0.9 THEN 'red' ELSE 'uncertain' END"


@query(f"WITH {SCORED} SELECT doc_id, {LEVEL_SQL} AS level FROM sc")
def traffic_light(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", level(F.col("score"), F.col("words"), LIGHT).alias("level"))


@query(f"WITH {SCORED} SELECT source, " + ", ".join(f"count(*) FILTER (level = '{v}') AS {v}" for v in ("red", "yellow", "green", "uncertain")) + f" FROM (SELECT source, {LEVEL_SQL} AS level FROM sc) GROUP BY source")
def level_counts(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("level", level(F.col("score"), F.col("words"), LIGHT))
    return s.groupBy("source").agg(*[F.count_if(F.col("level") == v).alias(v) for v in ("red", "yellow", "green", "uncertain")])


@query(f"WITH {SCORED} SELECT doc_id, round(ln(score / (1 - score)), 6) AS logit, round(ln(score / (1 - score)) - ln(exp(0.0) + exp(0.5)), 6) AS odds FROM sc")
def log_odds_of_scores(spark, sf_dir):
    s = scored(spark, sf_dir).select("doc_id", logit(F.col("score")).alias("x"))
    return s.select("doc_id", F.round("x", 6).alias("logit"), F.round(log_odds(F.array("x", F.lit(0.0), F.lit(0.5)), 0), 6).alias("odds"))


@query(f"""WITH {SCORED}, r AS (SELECT (label = (score > 0.5)::INT)::INT AS hit, CASE WHEN score > 0.5 THEN 0.9 * label + 0.05 ELSE 0.95 - 0.9 * label END AS soft, greatest(score, 1 - score) AS top, 2 * (0.9 * label + 0.05 - score) ** 2 AS brier,
  abs(0.9 * label + 0.05 - score) AS tv, (0.9 * label + 0.05) * ln((0.9 * label + 0.05) / score) + (0.95 - 0.9 * label) * ln((0.95 - 0.9 * label) / (1 - score)) AS kl FROM sc),
b AS (SELECT least(greatest(ceil(top * 10) - 1, 0), 9) AS bin, count(*) AS n, abs(avg(hit) - avg(top)) AS gap FROM r GROUP BY bin)
SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(soft), 6) AS soft_accuracy, round(avg(brier), 6) AS brier, round(avg(tv), 6) AS tv, round(avg(kl), 6) AS kl, (SELECT round(sum(n * gap) / sum(n), 6) FROM b) AS ece FROM r""")
def distribution_scores(spark, sf_dir):
    soft = F.col("label") * 0.9 + 0.05
    s = scored(spark, sf_dir).select(F.array(soft, 1 - soft).alias("p"), F.array("score", 1 - F.col("score")).alias("q"))
    return metrics.distribution_scores(s, F.col("p"), F.col("q"))


@query()
def temperature(spark, sf_dir):
    s = scored(spark, sf_dir).select(logit(F.col("score")).alias("logit"), "label")
    return spark.createDataFrame([(round(metrics.temperature(s), 4),)], "temperature double")


@query()
def surface_classifier(spark, sf_dir):
    """Grouped cross-validated AUROC of a gradient-boosted classifier on surface features."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rates = feature_rates(F.col("text"))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    d = d.select("doc_id", "label", F.pmod(F.xxhash64("source"), F.lit(3)).alias("fold"), *[c.alias(n) for n, c in rates.items()])
    x = VectorAssembler(inputCols=list(rates), outputCol="features").transform(d).select("doc_id", "label", "fold", "features").persist()
    out = None
    for k in range(3):
        train = x.filter(F.col("fold") != k)
        if train.agg(F.count_distinct("label")).first()[0] < 2:
            continue
        model = GBTClassifier(maxIter=10, maxDepth=3, seed=0).fit(train)
        part = model.transform(x.filter(F.col("fold") == k)).select(F.col("label").cast("int").alias("label"), F.round(vector_to_array("probability")[1], 9).alias("score"))
        out = part if out is None else out.union(part)
    return metrics.auroc(out, []).select(F.round("auroc", 3).alias("auroc"))
