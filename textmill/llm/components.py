"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of edges(a, b); root is the smallest vertex of its component.

    Each round turns every vertex's neighbours to its smallest one (large star), then every vertex and its smaller
    neighbours to the smallest of them (small star), until nothing changes; rounds grow with the logarithm of the
    size. Vertices meet only as minima, which are taken before each shuffle; the join back is against a written table
    with a row for each vertex. Self-loops keep vertices without other edges; null vertices are left out.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    alone = edges.select(F.explode(F.array("a", "b")).alias("v"))
    e = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{name}-0")
    k, seen = 0, None
    while True:
        k += 1
        both = e.union(e.select("u", "v"))
        least = scratch.table(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m")), f"{name}-{k}a")
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        large = scratch.table(large, f"{name}-{k}b")
        least = scratch.table(large.groupBy("v").agg(F.min("u").alias("m")), f"{name}-{k}c")
        to = large.join(least, "v")
        small = to.select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).filter("u <> v").distinct()
        new = scratch.table(small, f"{name}-{k}")
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        for old in (f"{name}-{k}a", f"{name}-{k}b", f"{name}-{k}c", f"{name}-{k - 1}"):
            scratch.drop(old)
        e = new
        if mark == seen:
            break
        seen = mark
    stars = e.select("v", F.col("u").alias("root"))
    return stars.union(alone.distinct().join(stars, "v", "left_anti").select("v", F.col("v").alias("root")))
