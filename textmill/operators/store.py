"""Keyed score store and feedback: lookup with a lifetime, upsert, pruning, newest entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
DAY_MS, KEEP_DAYS, CAP, BYTES_PER_ENTRY = 86_400_000, 30, 200_000, 235
LABELS, BASES = ("human", "ai"), ("own", "date", "marked", "guess")
CONFIDENCE = {"own": 0.95, "date": 0.90, "marked": 0.90, "guess": 0.60}


def lookup(keys: DataFrame, store: DataFrame, model: str, now_ms: int, days: int = KEEP_DAYS) -> DataFrame:
    """keys(k) with p of live entries of this model; null where there is none."""
    live = store.filter((F.col("m") == model) & (F.col("at") >= now_ms - days * DAY_MS)).select("k", "p")
    return keys.join(live, "k", "left")


def newest(rows: DataFrame, key: list[str], at: str, order: str) -> DataFrame:
    """The newest entry of each key; of equally new ones the first read."""
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(at, -F.col(order))).alias("_r"))
    return top.select(*key, "_r.*")


def upsert(store: DataFrame, new: DataFrame, key: str = "k") -> DataFrame:
    """The store with new entries in place of old ones of the same key."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def prune(store: DataFrame, now_ms: int, days: int = KEEP_DAYS, cap: int = CAP) -> DataFrame:
    """Without entries past their lifetime, and without the oldest beyond cap. The cut is found from counts a timestamp
    (a hash aggregate), so no sort of the whole store in one task; ties at the cut go by key."""
    live = store.filter(F.col("at") >= now_ms - days * DAY_MS)
    if live.count() <= cap:
        return live
    from .metrics import counted_ranks, value_counts

    # rows newer than each timestamp: ranks of the negated time
    counts = counted_ranks(value_counts(live.select((-F.col("at")).cast("double").alias("v"), F.lit(0).alias("z")), [], "z", "v"), [])
    cut = counts.filter((F.col("below") < cap) & (F.col("below") + F.col("n") >= cap)).select((-F.col("v")).cast("long").alias("cut"), (F.lit(cap) - F.col("below")).alias("left"))
    edge = live.join(F.broadcast(cut), F.col("at") == F.col("cut"))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy("at").orderBy("k"))).filter(F.col("_r") <= F.col("left")).drop("_r", "cut", "left")
    newer = live.crossJoin(F.broadcast(cut)).filter(F.col("at") > F.col("cut")).drop("cut", "left")
    return newer.unionByName(edge.select(*newer.columns))


def sanitise_feedback(rows: DataFrame) -> DataFrame:
    """Texts trimmed and cut to 2,000 signs, p outside 0..1 to null, names cut, source defaulted; `valid` tells rows to reject."""
    text = F.substring(F.trim("text"), 1, 2000)
    valid = F.col("label").isin(*LABELS) & F.col("basis").isin(*BASES) & (F.length(text) > 0)
    return rows.withColumn("text", text).withColumn("p", F.when(F.col("p").between(0, 1), F.col("p"))).withColumn("model", F.substring(F.coalesce("model", F.lit("")), 1, 200)).withColumn("lang", F.substring(F.coalesce("lang", F.lit("")), 1, 20)).withColumn("source", F.coalesce("source", F.lit("page"))).withColumn("valid", F.coalesce(valid, F.lit(False)))


def feedback_info(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, human, ai, guess, disagree (the score's side is not the label's), bytes."""
    wrong = F.col("p").isNotNull() & ((F.col("p") >= 0.5) != (F.col("label") == "ai"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "human").alias("human"), F.count_if(F.col("label") == "ai").alias("ai"), F.count_if(F.col("basis") == "guess").alias("guess"), F.count_if(wrong).alias("disagree"), F.sum(F.length("text")).alias("chars"))


def errors_by_model(rows: DataFrame) -> DataFrame:
    scored = rows.filter("p IS NOT NULL AND basis <> 'guess'")
    return scored.groupBy("model").agg(F.count("*").alias("n"), F.count_if((F.col("label") == "human") & (F.col("p") >= 0.5)).alias("fp"), F.count_if((F.col("label") == "ai") & (F.col("p") < 0.5)).alias("fn"))


def confidence(basis: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(basis == name, value).otherwise(out)
    return out


def score_missing(texts: DataFrame, done: DataFrame, scorer, key: str = "k") -> DataFrame:
    """done with the scores of texts it lacks: each distinct text is scored once. scorer maps a text Column to a score."""
    todo = texts.select(key, "text").join(done.select(key), key, "left_anti").dropDuplicates([key])
    return done.select(key, "score").unionByName(todo.select(key, scorer(F.col("text")).alias("score")))
