"""What the operators of this package share: written stage tables, texts and words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Stage tables of one operator call, under the shared folder.

    A written table cuts the lineage: a lost executor costs at most the tasks after the last table, and every later
    reader sees the same rows, even where they hold ids given by position.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps; without it they stay until the driver's next full GC."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and further named columns; all other columns of the input are left aside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def words(text: Column) -> Column:
    """Lower-case words of a text: runs of letters, digits and underscores, in any script."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
