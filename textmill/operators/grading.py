"""Thresholds suggested from reference scores, and the verdict on a scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp, up2

#: Fixed values.
AUROC_MIN, AUROC_WARN, RELIABLE_WORDS, MIN_SHORT, LEAST_CAUGHT = 0.6, 0.8, 120, 15, 0.3


def oriented(rows: DataFrame) -> DataFrame:
    """Scores turned round if AI texts score lower than human ones on average."""
    mean = rows.agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("_a"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("_h"))
    flip = F.col("_a") < F.col("_h")
    return rows.crossJoin(F.broadcast(mean)).withColumn("score", F.when(flip, 1 - F.col("score")).otherwise(F.col("score"))).withColumn("flipped", F.coalesce(flip, F.lit(False))).drop("_a", "_h")


def nearest_rank(rows: DataFrame, value: str, share: float) -> DataFrame:
    """(n, v): the value at place floor(share * (n - 1)) in ascending order, from counts of values."""
    from .metrics import counted_ranks, value_counts

    c = counted_ranks(value_counts(rows.withColumn("_z", F.lit(0)), [], "_z", value), [])
    total = c.agg(F.sum("n").alias("total"))
    at = F.floor(F.lit(share) * (F.col("total") - 1))
    c = c.crossJoin(F.broadcast(total))
    return c.filter((F.col("below") <= at) & (F.col("below") + F.col("n") > at)).select(F.col("total").alias("n"), "v")


def suggest_thresholds(rows: DataFrame) -> DataFrame:
    """(yellow_from, red_from): red just above the highest human score, yellow from their upper quartile."""
    human = rows.filter("label = 0 AND score IS NOT NULL")
    red = human.agg(clamp(up2(F.max("score") + 0.01), 0.06, 0.99).alias("red_from"))
    got = nearest_rank(human, "score", 0.75).crossJoin(F.broadcast(red))
    return got.select(F.least(F.greatest(up2(F.col("v")), F.lit(0.05)), F.round((F.col("red_from") - 0.01) * 100) / 100).alias("yellow_from"), "red_from")


def suggest_short_red(rows: DataFrame, red_from: float) -> DataFrame:
    """(candidate, caught, short_red_from, n_human, n_ai) of texts under RELIABLE_WORDS; null if it catches too few or there are too few."""
    short = rows.filter((F.col("words") < RELIABLE_WORDS) & F.col("score").isNotNull())
    top = short.agg(clamp(up2(F.max(F.when(F.col("label") == 0, F.col("score"))) + 0.01), red_from, 0.99).alias("candidate"))
    got = short.crossJoin(F.broadcast(top)).groupBy("candidate").agg(
        F.count_if(F.col("label") == 0).alias("n_human"), F.count_if(F.col("label") == 1).alias("n_ai"), F.avg(F.when(F.col("label") == 1, (F.col("score") >= F.col("candidate")).cast("double"))).alias("caught")
    )
    enough = (F.col("n_human") >= MIN_SHORT) & (F.col("n_ai") >= MIN_SHORT) & (F.col("caught") >= LEAST_CAUGHT)
    return got.select("candidate", F.round("caught", 6).alias("caught"), F.when(enough, F.col("candidate")).alias("short_red_from"), "n_human", "n_ai")


def verdict(rows: DataFrame) -> DataFrame:
    """One row: n, invalid, direction_ok, auroc, status (fail, warn, ok)."""
    from .metrics import auroc

    bad = F.col("score").isNull() | ~F.col("score").between(0, 1)
    facts = rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid"), F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("a"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("h"))
    got = facts.crossJoin(F.broadcast(auroc(rows, []).select("auroc")))
    right = F.col("a") > F.col("h")
    status = F.when((F.col("invalid") > 0) | ~right | (F.col("auroc") < AUROC_MIN), "fail").when(F.col("auroc") < AUROC_WARN, "warn").otherwise("ok")
    return got.select("n", "invalid", right.alias("direction_ok"), F.round("auroc", 6).alias("auroc"), status.alias("status"))
