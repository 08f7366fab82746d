"""Greedy operators whose state runs along an order: rows of a group (page, document) are sorted next to each other, and a step
function numbers them as they stream by, so no group has to fit into memory. Arrow batches, no row UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = 2  # signs between the paragraphs of a group


def run_folder(most_chars: int = 2000, reliable: int = 120, known: list[str] | None = None) -> Callable[[tuple], int]:
    """A step from (text length, words, lang, break key) to the number of the group: short neighbours of one language and
    break key join while their text fits; long or foreign ones stay alone."""
    number, room = 0, None

    def step(item: tuple) -> int:
        nonlocal number, room
        length, words, lang, key = item
        lang = lang or ""
        short = words < reliable and not (lang and known is not None and lang not in known)
        if short and room and room[:2] == (lang, key) and room[2] + SEPARATOR + length <= most_chars:
            room = (lang, key, room[2] + SEPARATOR + length)
        else:
            number += 1
            room = (lang, key, length) if short else None
        return number

    return step


def batch_folder(most_items: int | None = 5, most_chars: int = 2500) -> Callable[[int], int]:
    """A step from a length to the batch's number: a batch closes when it is full or the next text would not fit; a long text may go alone."""
    number = items = chars = 0

    def step(n: int) -> int:
        nonlocal number, items, chars
        if items and (chars + n > most_chars or most_items is not None and items >= most_items):
            number, items, chars = number + 1, 0, 0
        items, chars = items + 1, chars + n
        return number

    return step


def length_folder(ratio: float = 1.25, slack: float = 16) -> Callable[[int], int]:
    """A step from ascending lengths to the bucket's number; a bucket reaches from its first length to ratio times that plus slack."""
    number, top = -1, None

    def step(n: int) -> int:
        nonlocal number, top
        if top is None or n > top:
            number, top = number + 1, n * ratio + slack
        return number

    return step


def fold_runs(items: list[tuple], most_chars: int, reliable: int, known: list[str] | None) -> list[int]:
    return list(map(run_folder(most_chars, reliable, known), items))


def fold_batches(lengths: list[int], most_items: int | None = 5, most_chars: int = 2500) -> list[int]:
    return list(map(batch_folder(most_items, most_chars), lengths))


def fold_lengths(lengths: list[int], ratio: float = 1.25, slack: float = 16) -> list[int]:
    return list(map(length_folder(ratio, slack), lengths))


def _numbered(rows: DataFrame, by: str, order: list[str], name: str, folder: Callable[[], Callable], columns: list[str], keep: list[str]) -> DataFrame:
    """rows(by, *keep) with the number that a fresh step function gives each row of a group, in order."""
    fields = rows.select(by, *keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = object(), None
        for frame in frames:
            items = frame[columns[0]].tolist() if len(columns) == 1 else list(frame[columns].itertuples(index=False, name=None))
            numbers = []
            for group, item in zip(frame[by].tolist(), items):
                if group != at:
                    at, step = group, folder()
                numbers.append(step(item))
            yield frame[[by, *keep]].assign(**{name: numbers})

    need = list(dict.fromkeys([by, *order, *columns, *keep]))
    return rows.select(*need).filter(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def group_short(rows: DataFrame, by: str = "page_id", most_chars: int = 2000, reliable: int = 120, known: list[str] | None = None) -> DataFrame:
    """rows(by, pos, text_length, words, lang, break_key) with `grp`."""
    return _numbered(rows, by, ["pos"], "grp", lambda: run_folder(most_chars, reliable, known), ["text_length", "words", "lang", "break_key"], ["pos", "text_length", "words"])


def drop_small_groups(rows: DataFrame, by: str, grp: str, least: int = 40, reliable_alone: int = 40) -> DataFrame:
    """Without groups that only hold paragraphs under reliable_alone words and together stay under `least`."""
    w = Window.partitionBy(by, grp)
    total, most = F.sum("words").over(w), F.max("words").over(w)
    return rows.withColumn("_t", total).withColumn("_m", most).filter(~((F.col("_t") < least) & (F.col("_m") < reliable_alone))).drop("_t", "_m")


def batches(rows: DataFrame, by: str, most_items: int | None = 5, most_chars: int = 2500) -> DataFrame:
    return _numbered(rows, by, ["pos"], "batch", lambda: batch_folder(most_items, most_chars), ["text_length"], ["pos", "text_length"])


def length_buckets(rows: DataFrame, by: str, ratio: float = 1.25, slack: float = 16) -> DataFrame:
    return _numbered(rows, by, ["text_length", "pos"], "bucket", lambda: length_folder(ratio, slack), ["text_length"], ["pos", "text_length"])


def take_until(rows: DataFrame, by: str, least_words: int = 15, most_words: int = 2000) -> DataFrame:
    """Paragraphs of least_words or more, in order, until the next one would pass most_words (the first always stays)."""
    w = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.filter(F.col("words") >= least_words).withColumn("_sum", F.sum("words").over(w))
    # sums only grow, so the paragraphs that fit are a prefix
    return r.withColumn("_first", F.min("pos").over(Window.partitionBy(by))).filter((F.col("_sum") <= most_words) | (F.col("pos") == F.col("_first"))).drop("_sum", "_first")


def running_islands(rows: DataFrame, by: str, breaks) -> DataFrame:
    """Adds `island`: breaks so far in reading order."""
    return rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
