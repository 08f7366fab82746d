"""Receipts, shares, latency tables, digests and checks of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def receipt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts by several subsets of keys in one pass: GROUPING SETS, with null for keys left out."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    cols = [F.col(k) for k in keys]
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *cols).agg(F.count("*").alias("n"))


def share_of_parent(rows: DataFrame, keys: list[str], parent: list[str]) -> DataFrame:
    """Counts by keys with their percentage of the parent's count."""
    c = receipt(rows, keys)
    return c.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*parent)), 6))


def top(rows: DataFrame, key: str, n: int) -> DataFrame:
    return receipt(rows, [key]).orderBy(F.desc("n"), key).limit(n)


def checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest): a count and an order-free sum of row hashes, to pin a result."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return receipt(rows, [key]).filter("n > 1")


def until_exit(rows: DataFrame, by: list[str], stage: str, value: str) -> DataFrame:
    """Median of each stage and the running sum up to it."""
    from .metrics import percentiles

    m = rows.groupBy(*by, stage).agg(F.min(value).alias("fastest")).join(percentiles(rows, [*by, stage], value, {"median": 0.5}), [*by, stage])
    w = Window.partitionBy(*by).orderBy(stage).rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("until_exit", F.sum("median").over(w))


def expected_time(until: DataFrame, shares: DataFrame, by: list[str], stage: str) -> DataFrame:
    """Mean time by the share of inputs that leave at each stage, and what that saves against the last one."""
    got = until.join(shares, [*by, stage]) if set(by) <= set(shares.columns) else until.join(F.broadcast(shares), stage)
    return got.groupBy(*by).agg(F.sum(F.col("share") * F.col("until_exit")).alias("expected"), F.max("until_exit").alias("whole")).withColumn("saved", F.lit(100.0) * (1 - F.col("expected") / F.col("whole")))


def best_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(value).alias(value))


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): same, changed or gone for every old row, new for the others."""
    j = old.select(key, F.col(digest).alias("_o")).join(new.select(key, F.col(digest).alias("_n")), key, "full")
    return j.select(key, F.when(F.col("_n").isNull(), "gone").when(F.col("_o").isNull(), "new").when(F.col("_o") != F.col("_n"), "changed").otherwise("same").alias("state"))


def markdown(small: DataFrame) -> str:
    """A small result as a table; null and NaN as a dash."""
    head = small.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in small.collect():
        lines.append("| " + " | ".join("–" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)
