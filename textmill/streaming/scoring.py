"""Incremental scoring: changed texts, a keyed store, live level counts, and windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import Grading, level, store_key
from ..operators.store import CAP, DAY_MS, KEEP_DAYS, prune


def stream_table(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A file stream over a Parquet folder; files: at most so many a batch (back-pressure)."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def distinct_keys(texts: DataFrame, signature: str, at: str, late: str = "1 day") -> DataFrame:
    """The first arrival of every distinct text, with its key; state is dropped after the lateness bound."""
    return texts.withColumn("k", store_key(signature, F.col("text"))).withWatermark(at, late).dropDuplicatesWithinWatermark(["k"])


def score_batch(store_path: str, model: str, scorer: Callable[[Column], Column], now_ms: int, days: int = KEEP_DAYS, every: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: each distinct text that the store lacks is scored once and added.

    The store is a folder of one sub-folder a batch, so a batch that is run again overwrites its own rows and nothing else. Every
    so many batches their live entries are written together as a base; a batch reads the last base and what came after it.
    Entries older than `days` don't count and enter no base; `sweep` deletes what bases have replaced.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = _parts(spark, store_path, number)
        new = batch.select(store_key(model, F.col("text")).alias("k"), "text").dropDuplicates(["k"])
        live = F.col("at") >= now_ms - days * DAY_MS
        if earlier:
            new = new.join(spark.read.parquet(*earlier).filter((F.col("m") == model) & live).select("k"), "k", "left_anti")
        own = f"{store_path}/batch={number}"
        new.select("k", scorer(F.col("text")).alias("p"), F.lit(model).alias("m"), F.lit(now_ms).cast("long").alias("at")).write.mode("overwrite").parquet(own)
        if number and number % every == 0:
            spark.read.parquet(*earlier, own).filter(live).write.mode("overwrite").parquet(f"{store_path}/base={number}")

    return run


def _parts(spark: SparkSession, path: str, before: int) -> list[str]:
    """The last base and the batches after it, of numbers under `before`; one listing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName().split("=") for s in fs.listStatus(p)] if fs.exists(p) else []
    have = sorted((int(n[1]), n[0]) for n in names if n[0] in ("base", "batch") and n[1:] and int(n[1]) < before)
    base = max((n for n, kind in have if kind == "base"), default=None)
    return [f"{path}/{kind}={n}" for n, kind in have if (n == base if kind == "base" else base is None or n > base)]


def read_store(spark: SparkSession, path: str, model: str, now_ms: int, days: int = KEEP_DAYS, cap: int = CAP) -> DataFrame:
    """(k, p, m, at): live entries of a model, the newest `cap`."""
    return prune(spark.read.parquet(*_parts(spark, path, 2**62)).filter(F.col("m") == model), now_ms, days, cap)


def sweep(spark: SparkSession, path: str) -> None:
    """Delete parts that the last base but one has replaced; a batch that runs again never needs them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    bases = sorted(int(n[5:]) for n in names if n.startswith("base="))
    for n in names if bases[1:] else []:
        kind, _, number = n.partition("=")
        if kind == "batch" and int(number) <= bases[-2] or kind == "base" and int(number) < bases[-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)


def run_available(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> None:
    """Process all there is, exactly once over restarts, then stop."""
    stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live_levels(scored: DataFrame, g: Grading, by: str) -> DataFrame:
    """Running counts of levels; for update or complete mode."""
    return scored.groupBy(F.col(by), level(F.col("p"), F.col("words"), g).alias("level")).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, at: str, late: str, size: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums in event-time windows, late rows within the bound included."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def latest_generation(results: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Results of the current generation of each key; answers to an older one are left out."""
    return results.join(current.select(key, F.col("generation").alias("_g")), key).filter(F.col("generation") == F.col("_g")).drop("_g")


def changed_texts(arrivals: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """arrivals(element, text) as a stream: elements whose text differs from the last one seen.

    A stream that runs on should set forget_ms: an element that isn't seen for so long is forgotten, so the state is
    bounded. A run that stops at the end of its input can't, as timeouts keep it going.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in frames:
            texts = pdf["text"].reset_index(drop=True)
            before = texts.shift(1)
            before.iloc[:1] = last
            yield pd.DataFrame({"element": key[0], "text": texts[texts != before]})
            last = texts.iloc[-1] if len(texts) else last
        state.update((last,))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)

    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return arrivals.groupBy("element").applyInPandasWithState(step, "element long, text string", "text string", "append", timeout)
