"""Splits without leakage and seeded samples. Orders come from hashes of keys, so they are the same for any order of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import unit

RANKS = ("train", "validation", "test")
#: Shares of the hash range.
TEST, VALIDATION = 0.10, 0.05


def side_of(group: Column, seed: str, test: float = TEST, validation: float = VALIDATION) -> Column:
    u = unit(F.concat(F.lit(seed + ":split:"), group))
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def rank_of(side: Column) -> Column:
    return F.when(side == "test", 2).when(side == "validation", 1).otherwise(0)


def split_groups(rows: DataFrame, seed: str, merged: str, source_group: str, forced: Column | None = None) -> DataFrame:
    """Adds `split`: the furthest side of any source group in the merged group; forced rows' groups go to test."""
    rank = rank_of(side_of(F.col(source_group), seed))
    rank = rank if forced is None else F.when(forced, 2).otherwise(rank)
    top = rows.groupBy(merged).agg(F.max(rank).alias("_rank"))  # reduced before the shuffle, so a hot group is one row
    return rows.join(top, merged).withColumn("split", F.element_at(F.array(*map(F.lit, RANKS)), F.col("_rank") + 1)).drop("_rank")


def view_of(domain: Column, group: Column, generator: Column, domains: list[str], prefixes: list[str], generators: list[str]) -> Column:
    """The first of held_out_domain, testbed, held_out_generator that holds, else main."""
    testbed = F.lit(False)
    for p in prefixes:
        testbed = testbed | group.startswith(p)
    return F.when(domain.isin(domains), "held_out_domain").when(testbed, "testbed").when(generator.isin(generators), "held_out_generator").otherwise("main")


def disjoint(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in several parts; empty if the split is sound."""
    return rows.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).filter("lo <> hi").select(group)


def select_generations(rows: DataFrame, group: str, kind: str, key: str, k: int, seed: str, always: list[str] = ()) -> DataFrame:
    """k rows a group, from different kinds as long as there are any, by seeded order; the always kinds whole, uncounted."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    own = rows.filter(~F.col(kind).isin(*always)) if always else rows
    r = own.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy(group, kind).orderBy("_h", key)))
    # only the first k of each kind can be among the first k of the group
    r = r.filter(F.col("_r") <= k).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_r") > 1, "_h", key))).filter(F.col("_n") <= k)
    kept = r.drop("_h", "_r", "_n")
    return kept.unionByName(rows.filter(F.col(kind).isin(*always))) if always else kept


def first_per(rows: DataFrame, by: list[str], order: list, n: Column | int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """About n rows, as many from each stratum (one at least), n at most."""
    keys = max(1, rows.select(*strata).distinct().count())
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    got = first_per(rows.withColumn("_h", h), strata, ["_h", key], max(1, n // keys))
    return got.orderBy("_h", key).limit(n).drop("_h")


def half_split(rows: DataFrame, strata: list[str], key: str, repetitions: int, seed: str) -> DataFrame:
    """Each row once for every repetition, with `half`: 0 for the first floor(n / 2) of its stratum in seeded order, else 1.

    The order is that of a hash. Its first digits are counted, so the class of digits in which the middle lies is known for each
    repetition and stratum; all other rows are decided by their digits, and only that class is ranked.
    """
    by = ["rep", *strata]
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    reps = reps.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col(key).cast("string")), 256)).withColumn("_c", F.substring("_h", 1, 3))
    counts = reps.groupBy(*by, "_c").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_c"))
    half = F.floor(F.sum("_n").over(Window.partitionBy(*by)) / 2)
    # the first class in which the middle is reached, and how many of its rows are still in the first half
    cut = counts.withColumn("_need", half - (upto - F.col("_n"))).filter((F.col("_need") >= 0) & (F.col("_need") < F.col("_n")))
    cut = cut.groupBy(*by).agg(F.min(F.struct("_c", "_need")).alias("_m"))
    same = [reps[c].eqNullSafe(cut[c]) for c in by]
    r = reps.join(cut, reduce(lambda a, b: a & b, same)).select(reps["*"], "_m")
    sure = r.filter(F.col("_c") != F.col("_m._c")).withColumn("half", F.when(F.col("_c") < F.col("_m._c"), 0).otherwise(1))
    ranked = r.filter(F.col("_c") == F.col("_m._c"))
    ranked = ranked.withColumn("half", F.when(F.row_number().over(Window.partitionBy(*by).orderBy("_h", key)) <= F.col("_m._need"), 0).otherwise(1))
    return sure.unionByName(ranked).drop("_h", "_c", "_m")


def quota_sample(rows: DataFrame, kinds: list[str], per_kind: int, key: str, seed: str, by: str = "source") -> DataFrame:
    """per_kind rows of each kind, shared evenly between its `by` values; the remainder goes to the first of them."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    have = rows.select(*kinds, by).distinct()
    of_kind = Window.partitionBy(*kinds)
    quota = have.withColumn("_m", F.count("*").over(of_kind)).withColumn("_i", F.row_number().over(of_kind.orderBy(by)))
    quota = quota.withColumn("quota", F.floor(F.lit(per_kind) / F.col("_m")) + F.when(F.col("_i") == 1, F.lit(per_kind) % F.col("_m")).otherwise(0)).drop("_m", "_i")
    return first_per(rows.withColumn("_h", h).join(quota, [*kinds, by]), [*kinds, by], ["_h", key], F.col("quota")).drop("_h", "quota")


def holdout(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """`part`: train for the first share of the rows in seeded order (by hash range: no global sort), else holdout."""
    return rows.withColumn("part", F.when(unit(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))) < share, "train").otherwise("holdout"))
