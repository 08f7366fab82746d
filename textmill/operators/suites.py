"""Evaluation suites and reference sets: excerpts, cells, balanced samples, and what is reported of them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, single_spaces
from ..functions.udfs import excerpt
from .filters import GuardError

#: Limits of an excerpt in words, the words behind them that may still hold a sentence's end, ends of
#: sentences, spaces that a tokeniser leaves, bytes of a stored score.
LEAST, MOST, OVER = 40, 400, 20
SENTENCE_ENDS = r"[.!?…][\"'”’»)\]]?$"
SPACE_BEFORE, SPACE_BEHIND, SPACE_NOT = rf"[{SPACE}]+([.,!?;:)\]'])", rf"([(\[])[{SPACE}]+", rf"[{SPACE}]+n't"
ENTRY_BYTES = 235


def _hash(seed: str, *key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256)


def suite_excerpt(text: Column) -> Column:
    """One paragraph of LEAST to MOST words: the text itself, or its words up to the last sentence's end within OVER more, or the
    first MOST; null if it has too few."""
    words = F.split(F.regexp_replace(single_spaces(text), SPACE_BEFORE, "$1"), " ")
    near = F.slice(words, 1, MOST + OVER)
    ends = F.filter(F.transform(near, lambda w, i: F.when((i + 1 >= LEAST) & w.rlike(SENTENCE_ENDS), i + 1)), lambda i: i.isNotNull())
    stop = F.coalesce(F.array_max(ends), F.lit(MOST))
    first = lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
    return F.when(F.size(words) < LEAST, None).when(F.size(words) <= MOST, F.array_join(words, " ")).otherwise(first(stop))


def untokenised(text: Column) -> Column:
    """Without the spaces that a tokeniser puts before marks, behind opening brackets and before n't."""
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACE_BEFORE, "$1"), SPACE_BEHIND, "$1"), SPACE_NOT, "n't")
    return F.regexp_replace(joined, f"^[{SPACE}]+|[{SPACE}]+$", "")


def cells(rows: DataFrame, domains: Mapping[str, str], generators: list[str]) -> DataFrame:
    """rows(sub_source, model, ...) of the wanted sub-sources and models, with their domain. The filter reaches the scan."""
    named = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair])
    return rows.filter(F.col("sub_source").isin(*domains) & F.col("model").isin("human", *generators)).withColumn("domain", named[F.col("sub_source")])


def length_class(words: Column, reliable: int = 120) -> Column:
    return F.when(words < reliable, "short").otherwise("long")


def reference_pairs(rows: DataFrame, per_class: int, seed: str, reliable: int = 120) -> DataFrame:
    """From rows(grp, domain, label, ord, words, id), the first human and the first AI text of a group, as a pair if they are of one
    length class; at most per_class pairs of each domain and class, by seeded hash. Returns (grp, domain, length, id, label, words)."""
    first = rows.groupBy("grp", "domain").agg(*[F.min_by(F.struct("id", "words"), F.when(F.col("label") == y, F.col("ord"))).alias(n) for y, n in ((0, "h"), (1, "a"))])
    both = first.filter(F.col("h").isNotNull() & F.col("a").isNotNull()).withColumn("length", length_class(F.col("h.words"), reliable))
    both = both.filter(F.col("length") == length_class(F.col("a.words"), reliable))
    place = F.row_number().over(Window.partitionBy("domain", "length").orderBy(_hash(seed, "grp"), "grp"))
    kept = both.withColumn("_p", place).filter(F.col("_p") <= per_class)
    sides = F.explode(F.array(*[F.struct(F.col(f"{n}.id").alias("id"), F.lit(y).alias("label"), F.col(f"{n}.words").alias("words")) for y, n in ((0, "h"), (1, "a"))]))
    return kept.select("grp", "domain", "length", sides.alias("x")).select("grp", "domain", "length", "x.*")


def matched_humans(rows: DataFrame, per_generator: int, seed: str) -> DataFrame:
    """From rows(id, generator, length), per_generator AI texts of each generator and length class, and as many human ones of the class."""
    place = F.row_number().over(Window.partitionBy("generator", "length").orderBy(_hash(seed, "id"), "id"))
    ranked = rows.withColumn("_p", place)
    ai = ranked.filter((F.col("generator") != "human") & (F.col("_p") <= per_generator))
    wanted = ai.groupBy("length").agg(F.count("*").alias("_n"))  # a row for each class
    human = ranked.filter("generator = 'human'").join(wanted, "length").filter(F.col("_p") <= F.col("_n")).drop("_n")
    return human.unionByName(ai).drop("_p")


def raw_excerpts(sample: DataFrame, raw: DataFrame, **options) -> DataFrame:
    """sample with `raw`: an excerpt of the unchanged text of the same id, drawn like the data set's own; null without such a text."""
    drawn = raw.join(sample.select("id").distinct(), "id", "left_semi").select("id", "text").withColumn("_e", excerpt(**options)(F.col("id").cast("string"), F.col("text")))
    cut = F.substr("text", F.col("_e.start") + 1, F.col("_e.end") - F.col("_e.start"))
    return sample.join(drawn.select("id", cut.alias("raw")), "id", "left")


def score_range(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, mean, lowest, highest, n)."""
    return rows.groupBy(*by).agg(F.avg(score).alias("mean"), F.min(score).alias("lowest"), F.max(score).alias("highest"), F.count(score).alias("n"))


def shown_red(score: Column, words: Column, red: float, short_red: float | None, reliable: int = 120) -> Column:
    """Whether a reader sees red: short texts have a threshold of their own, or are never red."""
    short = F.lit(False) if short_red is None else score >= short_red
    return F.when(words >= reliable, score >= red).otherwise(short)


def shown_rates(rows: DataFrame, red: float, short_red: float | None, reliable: int = 120) -> DataFrame:
    """(label, rate, n) as displayed."""
    seen = shown_red(F.col("score"), F.col("words"), red, short_red, reliable).cast("double")
    return rows.groupBy("label").agg(F.avg(seen).alias("rate"), F.count("*").alias("n"))


def worth_splitting(rows: DataFrame, least: int = 40, most: int = 119, score: float = 0.87) -> DataFrame:
    """Texts of a middle length with a high score."""
    return rows.filter(F.col("words").between(least, most) & (F.col("score") >= score))


def in_report_order(rows: DataFrame, key: str, drawn: list[str]) -> DataFrame:
    """Adds `place`: keys of the drawn list in its order, then all others by name."""
    at = F.array_position(F.array(*map(F.lit, drawn)), F.col(key))
    known = F.when(at > 0, at - 1).otherwise(len(drawn))
    return rows.withColumn("place", F.dense_rank().over(Window.orderBy(known, key)) - 1)


def store_size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), (F.count("*") * ENTRY_BYTES).alias("bytes"))


def seeded_take(rows: DataFrame, key: str, n: int, most_held: int, seed: str) -> DataFrame:
    """The first n rows in seeded order, with `part`: the first min(most_held, n // 10) of them calibrate, the others train."""
    got = rows.withColumn("_h", _hash(seed, key)).orderBy("_h", key).limit(n)
    held = F.least(F.lit(most_held), F.floor(F.count("*").over(Window.partitionBy()) / 10))
    place = F.row_number().over(Window.orderBy("_h", key))  # over n rows, not over the table
    return got.withColumn("part", F.when(place <= held, "calibration").otherwise("training")).drop("_h")


def side_by_side(results: DataFrame, key: list[str], run: str, value: str, base: str, measured: bool = True) -> DataFrame:
    """(key, run, value, base, ratio): each run's value beside that of the base run; runs without a value are left out if `measured`.

    Ratios to a base of zero are those of IEEE 754: infinite, or NaN for zero.
    """
    known = results.filter(F.col(value).isNotNull()) if measured else results
    of_base = known.filter(F.col(run) == base).select(*key, F.col(value).alias("base"))
    ratio = F.when(F.col("base") == 0, F.col(value) * F.pow("base", F.lit(-1.0))).otherwise(F.col(value) / F.col("base"))
    return known.filter(F.col(run) != base).join(of_base, key, "left").select(*key, run, value, "base", ratio.alias("ratio"))


def failed(results: DataFrame, run: str, error: str) -> DataFrame:
    return results.filter(F.col(error).isNotNull()).select(run, error).distinct()


def require_same_environment(old: DataFrame, new: DataFrame, fields: list[str]) -> None:
    """An error if measurements of different environments would be mixed."""
    same = reduce(lambda a, b: a & b, [old[f].eqNullSafe(new[f]) for f in fields])
    strange = new.select(*fields).distinct().join(old.select(*fields).distinct(), same, "left_anti").limit(1).collect() if not old.isEmpty() else []
    if strange:
        raise GuardError(f"measured elsewhere: {strange[0].asDict()}")


def newly_found(found: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Found items that weren't seen before, each once."""
    return found.dropDuplicates(key).join(seen.select(*key), key, "left_anti")


def accepted_by_year(states: DataFrame, created: str = "created", state: str = "state") -> DataFrame:
    """(year, n) of items whose text is unchanged."""
    return states.filter(F.col(state) == "same").groupBy(F.substring(created, 1, 4).alias("year")).agg(F.count("*").alias("n"))


def utc_stamp(seconds: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC, whatever the session's time zone."""
    zone = F.current_timezone()
    return F.date_format(F.convert_timezone(zone, F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def may_be_sent(rows: DataFrame, local: list[str], blocked: DataFrame) -> DataFrame:
    """Rows(host, provider, kind) that may leave: none of a blocked host, and papers only to local providers."""
    papers = (F.col("kind") == "pdf") & ~F.col("provider").isin(*local)
    return rows.filter(~papers).join(blocked.select("host").distinct(), "host", "left_anti")
