"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is absent, as in tests, a temporary folder, but only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_textmill_shared", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = spark._textmill_shared = "file://" + tempfile.mkdtemp(prefix="textmill-")
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage of loops, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
