"""Writers: row files with a receipt, split files, append, atomic swap, pinned results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import checksum, duplicate_ids


class DataError(Exception):
    """A result that breaks what was promised about it."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap(spark: SparkSession, new: str, path: str) -> None:
    """new takes the place of path; the old folder is set aside first and deleted last."""
    fs, to = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(path + ".old")
    fs.delete(aside, True)
    if fs.exists(to):
        fs.rename(to, aside)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), to):
        fs.rename(aside, to)
        raise DataError(f"{path} could not be replaced")
    fs.delete(aside, True)


def write_rows(rows: DataFrame, path: str, key: str = "id", fmt: str = "json", text: str | None = None, excluded: Column | None = None) -> dict:
    """Written beside and swapped in; ids must be unique. Returns {n, digest} of what was written, and of what wasn't how many rows
    were `excluded` or, of the rest, had an `empty` text."""
    spark = rows.sparkSession
    counts = {}
    if text is not None or excluded is not None:
        out = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
        empty = F.lit(False) if text is None else F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
        counts = rows.agg(F.count_if(out).alias("excluded"), F.count_if(~out & empty).alias("empty")).first().asDict()
        rows = rows.filter(~out & ~empty)
    rows.write.mode("overwrite").format(fmt).save(path + ".new")
    back = spark.read.schema(rows.schema).format(fmt).load(path + ".new")
    twice = [r[0] for r in duplicate_ids(back, key).limit(3).collect()]
    if twice:
        raise DataError(f"ids occur more than once, such as {twice}")
    receipt = checksum(back, [key, *[c for c in rows.columns if c != key]]).first().asDict() | counts
    swap(spark, path + ".new", path)
    return receipt


def write_splits(rows: DataFrame, path: str, split: str = "split", key: str = "id", fmt: str = "parquet", by: list[str] = ()) -> dict[str, int]:
    """A folder for each part, sorted by id within its files; beside it the ids with their parts, in order, and a report of rows by
    part and the `by` columns. Returns the rows of each part."""
    rows.repartition(split, key).sortWithinPartitions(split, key).write.mode("overwrite").partitionBy(split).format(fmt).save(path)
    rows.select(split, key).orderBy(split, key).write.mode("overwrite").format(fmt).save(path + "-ids")
    report = rows.groupBy(split, *by).agg(F.count("*").alias("n"))
    report.orderBy(split, *by).write.mode("overwrite").format(fmt).save(path + "-report")
    return {r[0]: r[1] for r in rows.groupBy(split).count().collect()}  # a row for each part


def export_feedback(rows: DataFrame, path: str, at: str = "at") -> None:
    """Feedback as lines of JSON, oldest first."""
    rows.orderBy(at).write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("append").format(fmt).save(path)


def check_pinned(found: dict, pinned: dict) -> None:
    """Raise if counts or digests differ from the pinned ones."""
    off = {k: (found.get(k), v) for k, v in pinned.items() if found.get(k) != v}
    if off:
        raise DataError("differs from what is pinned: " + json.dumps(off, default=str, sort_keys=True))


def check_frozen(frozen: DataFrame, rows: DataFrame, key: str = "id", split: str = "split") -> None:
    """Rows that were once in the test part must not be trained on."""
    bad = rows.filter(f"{split} <> 'test'").join(frozen.select(key), key, "left_semi").select(key).limit(3).collect()
    if bad:
        raise DataError(f"once test, now in training: {[r[0] for r in bad]}")
