"""The registry of queries: name to (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, other numbers as double: the types that both engines return."""
    cast = {T.IntegerType: "long", T.ShortType: "long", T.ByteType: "long", T.FloatType: "double", T.DecimalType: "double"}
    return df.select(*[F.col(f.name).cast(cast[type(f.dataType)]).alias(f.name) if type(f.dataType) in cast else F.col(f.name) for f in df.schema])


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir); sql is its equal for DuckDB. A name is given once."""

    def put(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return put


#: Tables whose rows cost far more to work on than to move.
HEAVY = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a heavy one that comes in fewer pieces than there are cores (a small file is one piece) is dealt out anew."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
