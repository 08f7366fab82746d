"""Ranking measures and thresholds.

Ranks never come from one global window. Scores are first counted by value, which reduces them before the shuffle; the
counts of values are then ranked within their group. A group with very many distinct values is ranked within ranges of
values, whose totals are added (`counted_ranks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64


def value_counts(rows: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """(by, v, n, n1): rows and positive rows of each value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n1"))


def counted_ranks(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds `below`, the rows with smaller values in the group. Values fall into ranges between quantiles; a window
    runs within a range, and the totals of the ranges before it are added."""
    cuts = counts.groupBy(*by).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts")) if by else counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    c = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # one row of cuts for all
    c = c.withColumn("_r", F.size(F.filter("_cuts", lambda x: x < F.col("v")))).drop("_cuts")
    totals = c.groupBy(*by, "_r").agg(F.sum("n").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*by, "_r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_i", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return c.join(totals, [*by, "_r"]).withColumn("below", F.col("_b") + F.col("_i")).drop("_b", "_i", "_r")


def auroc(rows: DataFrame, by: list[str], label: str = "label", value: str = "score") -> DataFrame:
    """(by, n1, n0, auroc): rank sum with averaged ties; null if a class is empty."""
    return auroc_of_counts(value_counts(rows, by, label, value), by)


def auroc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """auroc from value_counts, which are read three times: written ones if the rows are dear."""
    c = counted_ranks(counts, by)
    rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    got = c.groupBy(*by).agg(F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n0"), F.sum(F.col("n1") * rank).alias("_s"))
    a = (F.col("_s") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)) / (F.col("n1").cast("double") * F.col("n0"))
    return got.select(*by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), a).alias("auroc"))


def thresholds(rows: DataFrame, by: list[str], value: str = "score", target: float = 0.01) -> DataFrame:
    """(by, n, threshold, strict): at most int(target * n) values are flagged; flagged is > threshold if strict, else >=.

    The threshold is null, and nothing is flagged, if no value may be.
    """
    c = counted_ranks(value_counts(rows.withColumn("_one", F.lit(0)), by, "_one", value), by)
    total = c.groupBy(*by).agg(F.sum("n").alias("total"))
    c = c.join(total, by) if by else c.crossJoin(F.broadcast(total))
    allowed = F.floor(F.lit(target) * F.col("total"))
    place = F.col("total") - allowed  # 0-based place of the smallest flagged value
    hit = (allowed > 0) & (F.col("below") <= place) & (F.col("below") + F.col("n") > place)
    strict = F.col("below") < place  # an equal value comes before: more tie than may be flagged
    return c.groupBy(*by).agg(F.max("total").alias("n"), F.max(F.when(hit, F.col("v"))).alias("threshold"), F.coalesce(F.max(F.when(hit, strict)), F.lit(False)).alias("strict"))


def flagged(value: Column, threshold: Column, strict: Column) -> Column:
    return F.coalesce(F.when(strict, value > threshold).otherwise(value >= threshold), F.lit(False))


def measures(rows: DataFrame, by: list[str], borrowed: DataFrame | None = None) -> DataFrame:
    """(by, human, ai, auroc, fa, detected, f1) of rows(label, score, flag). Groups without human rows use the borrowed
    ones for auroc and f1; what is undefined is null."""
    count = rows.groupBy(*by).agg(
        F.count_if(F.col("label") == 0).alias("human"), F.count_if(F.col("label") == 1).alias("ai"),
        F.count_if((F.col("label") == 1) & F.col("flag")).alias("tp"), F.count_if((F.col("label") == 0) & F.col("flag")).alias("own_fp"),
    )
    ranked = rows.select(*by, "label", "score")
    fp = F.col("own_fp")
    if borrowed is not None:
        lacking = count.filter((F.col("human") == 0) & (F.col("ai") > 0)).select(*by)  # group names only
        lent = value_counts(borrowed.filter("label = 0"), [], "label", "score")
        ranked_counts = value_counts(ranked, by, "label", "score").unionByName(lacking.crossJoin(F.broadcast(lent)).select(*by, "v", "n", "n1"))
        ranked_counts = ranked_counts.groupBy(*by, "v").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
        lent_fp = borrowed.filter("label = 0").agg(F.count_if("flag").alias("lent_fp"))
        count = count.crossJoin(F.broadcast(lent_fp))
        fp = F.when(F.col("human") == 0, F.col("lent_fp")).otherwise(F.col("own_fp"))
    else:
        ranked_counts = value_counts(ranked, by, "label", "score")
    c = counted_ranks(ranked_counts, by)
    rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    a = c.groupBy(*by).agg(F.sum("n1").alias("_1"), F.sum(F.col("n") - F.col("n1")).alias("_0"), F.sum(F.col("n1") * rank).alias("_s"))
    area = F.when((F.col("_1") > 0) & (F.col("_0") > 0), (F.col("_s") - F.col("_1") * (F.col("_1") + 1) / F.lit(2.0)) / (F.col("_1").cast("double") * F.col("_0")))
    got = count.join(a, by, "left") if by else count.crossJoin(F.broadcast(a))
    f1 = F.when((F.col("_1") > 0) & (F.col("_0") > 0), F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("tp") + fp + F.col("ai"))))
    return got.select(
        *by, "human", "ai", F.round(area, 6).alias("auroc"),
        F.when(F.col("human") > 0, F.round(F.col("own_fp") / F.col("human"), 6)).alias("fa"), F.when(F.col("ai") > 0, F.round(F.col("tp") / F.col("ai"), 6)).alias("detected"), F.round(f1, 6).alias("f1"),
    )


def by_dimensions(rows: DataFrame, dims: list[str], **more) -> DataFrame:
    """measures for every value of every dimension, in one pass over the rows: (dim, key, ...)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims])).alias("_d")
    long = rows.select("label", "score", "flag", pairs).select("label", "score", "flag", "_d.dim", "_d.key")
    return measures(long, ["dim", "key"], **more)


def threshold_grid(rows: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """Share at or above each threshold, for each group."""
    long = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    return long.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") >= F.col("threshold")).cast("double")), 6).alias("share"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """(threshold, accuracy) of the best of 0.01 .. 0.99 by accuracy; 0.5 wins ties, then the lowest."""
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: i / F.lit(100.0)))
    c = value_counts(rows, [], "label", "score").withColumn("threshold", grid)
    right = F.when(F.col("v") >= F.col("threshold"), F.col("n1")).otherwise(F.col("n") - F.col("n1"))
    a = c.groupBy("threshold").agg((F.sum(right) / F.sum("n")).alias("accuracy"))
    return a.orderBy(F.desc("accuracy"), (F.col("threshold") != 0.5), "threshold").limit(1)


def best_accuracy(rows: DataFrame) -> DataFrame:
    """The best accuracy of any observed score as threshold."""
    c = counted_ranks(value_counts(rows, [], "label", "score"), [])
    low = c.select("v", F.col("n") - F.col("n1"), "n1").toDF("v", "n", "n1")
    humans_below = counted_ranks(low, []).select("v", F.col("below").alias("tn"))
    ai_below = counted_ranks(c.select("v", F.col("n1").alias("n"), "n1"), []).select("v", F.col("below").alias("fn"))
    total = c.agg(F.sum("n").alias("t"), F.sum("n1").alias("t1"))
    got = humans_below.join(ai_below, "v").crossJoin(F.broadcast(total))
    return got.agg(F.max((F.col("tn") + F.col("t1") - F.col("fn")) / F.col("t")).alias("accuracy"))


def confusion(rows: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    return rows.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, *shares): exact percentiles by place, with linear interpolation, from counted values; null values play no part.

    Places come from ranks within ranges of values, so no task holds a group's values and none sorts them whole.
    """
    known = rows.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(0))
    c = counted_ranks(value_counts(known, by, "_one", value), by)
    total = c.groupBy(*by).agg(F.sum("n").alias("_total"))
    c = c.join(total, by) if by else c.crossJoin(F.broadcast(total))  # one row
    at = lambda place: F.max(F.when((F.col("below") <= place) & (F.col("below") + F.col("n") > place), F.col("v")))
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return c.groupBy(*by).agg(*out)


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """median, p5, p95, min, max and count of the defined values."""
    rows = rows.withColumn("_v", F.when(~F.isnan(value), F.col(value)))
    places = percentiles(rows, by, "_v", {"median": 0.5, "p5": 0.05, "p95": 0.95})
    ends = rows.groupBy(*by).agg(F.round(F.min("_v"), 6).alias("lowest"), F.round(F.max("_v"), 6).alias("highest"), F.count("_v").alias("n"))
    return ends.join(places, by, "left").select(*by, *[F.round(c, 6).alias(c) for c in ("median", "p5", "p95")], "lowest", "highest", "n")


def agreement(rows: DataFrame, a: str, b: str, limits: list[float]) -> DataFrame:
    """Correlation and differences of two scorers, and how many rows change sides at each threshold."""
    d = F.abs(F.col(a) - F.col(b))
    moved = [F.count_if((F.col(a) >= t) != (F.col(b) >= t)).alias(f"moved_{int(t * 100)}") for t in limits]
    whole = rows.agg(F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("pearson"), F.round(F.max(d), 6).alias("max_diff"), F.round(F.avg(d), 6).alias("mean_diff"), F.count_if(d > 0.01).alias("over_1"), F.count_if(d > 0.05).alias("over_5"), *moved)
    median = percentiles(rows.select(d.alias("d")), [], "d", {"median_diff": 0.5}).select(F.round("median_diff", 6).alias("median_diff"))
    return whole.crossJoin(F.broadcast(median))  # a row each


def distribution_scores(rows: DataFrame, p: Column, q: Column, bins: int = 10) -> DataFrame:
    """Accuracy, soft accuracy, Brier, total variation, KL and calibration error of predicted q against target p (arrays).

    Calibration: equal-width bins of the top predicted weight, right edge included; the mean gap weighted by rows.
    """
    both = F.zip_with(p, q, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    total = lambda f: F.aggregate(F.transform(both, f), F.lit(0.0), lambda s, x: s + x)
    top = F.array_max(q)
    hit = (F.array_position(p, F.array_max(p)) == F.array_position(q, top)).cast("double")
    soft = F.get(p, (F.array_position(q, top) - 1).cast("int")).cast("double")
    clipped = lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1e4))
    r = rows.select(
        hit.alias("hit"), soft.alias("soft"), top.cast("double").alias("top"), total(lambda z: (z["x"] - z["y"]) ** 2).alias("brier"),
        (total(lambda z: F.abs(z["x"] - z["y"])) / 2).alias("tv"), total(lambda z: F.when(z["x"] > 0, z["x"] * F.log(clipped(z["x"]) / clipped(z["y"]))).otherwise(0.0)).alias("kl"),
    ).withColumn("bin", F.least(F.greatest(F.ceil(F.col("top") * bins) - 1, F.lit(0)), F.lit(bins - 1)))
    per = r.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("hit") - F.avg("top")).alias("gap"), *[F.sum(c).alias(c) for c in ("hit", "soft", "brier", "tv", "kl")])
    n = F.sum("n")
    return per.agg(n.alias("n"), F.round(F.sum("hit") / n, 6).alias("accuracy"), F.round(F.sum("soft") / n, 6).alias("soft_accuracy"), F.round(F.sum("brier") / n, 6).alias("brier"), F.round(F.sum("tv") / n, 6).alias("tv"), F.round(F.sum("kl") / n, 6).alias("kl"), F.round(F.sum(F.col("n") * F.col("gap")) / n, 6).alias("ece"))


def temperature(rows: DataFrame, logit: str = "logit", label: str = "label", lo: float = 0.1, hi: float = 10.0, steps: int = 41, rounds: int = 3) -> float:
    """The temperature with the least log loss, on ever finer grids of its logarithm; 1 for fewer than ten rows.

    Every round is one aggregate over the rows for all grid points.
    """
    import math

    if rows.limit(10).count() < 10:
        return 1.0
    a, b = math.log(lo), math.log(hi)
    best = 0.0
    for _ in range(rounds):
        grid = [a + (b - a) * i / (steps - 1) for i in range(steps)]
        loss = [F.avg(F.log1p(F.exp(-F.abs(F.col(logit)) / math.exp(g))) + F.greatest(-F.col(logit) * (2 * F.col(label) - 1), F.lit(0.0)) / math.exp(g)) for g in grid]
        got = rows.agg(*[x.alias(f"l{i}") for i, x in enumerate(loss)]).first()
        k = min(range(steps), key=lambda i: got[i])
        best = grid[k]
        a, b = grid[max(0, k - 1)], grid[min(steps - 1, k + 1)]
    return math.exp(best)
