"""Scorers by name. A scorer maps a text Column to a score Column; a model is loaded once a worker and fed length-sorted batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import valid_probability

SCORERS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, scorer: Callable[[Column], Column]) -> None:
    SCORERS[name] = scorer


def from_model(load: Callable[[], Callable[[list[str]], list[float | None]]], batch: int = 25) -> Callable[[Column], Column]:
    """A scorer from a loader of a function on texts: one load a worker, batches of similar length, invalid scores to null."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in texts:
            order = s.fillna("").str.len().sort_values(kind="stable").index
            out = pd.Series(index=s.index, dtype="float64")
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                out.loc[part] = model(s.loc[part].fillna("").tolist())
            yield out

    return lambda text: valid_probability(run(text))


register("stand_in", lambda t: F.element_at(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.95)), (F.length(t) % 3 + 1).cast("int")))


def score_distinct(rows: DataFrame, scorer: Callable[[Column], Column], text: str = "text", lang: str | None = None) -> DataFrame:
    """rows with `score`; equal texts (of one language) are scored once and share the result."""
    keys = [text] + ([lang] if lang else [])
    own = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    own = own.withColumn("score", scorer(F.col(f"_{text}")))
    return rows.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def pieces_mean(rows: DataFrame, key: str, pieces: Column, scorer: Callable[[Column], Column]) -> DataFrame:
    """(key, score): the mean score of a text's pieces, such as chunks, clips or halves."""
    return rows.select(key, F.explode(pieces).alias("_p")).groupBy(key).agg(F.avg(scorer(F.col("_p"))).alias("score"))
