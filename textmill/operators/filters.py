"""Filters, small lookups and guards over corpus rows, pages and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import unit
from ..functions.text import SPACE
from ..shared import stage


class GuardError(Exception):
    """A check on the data that must hold before work goes on."""


def matches_rules(rules: list[dict[str, str]]) -> Column:
    """Whether a row equals some rule in all of the rule's columns; a rule's `reason` says why and plays no part."""
    one = lambda rule: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in rule.items() if k != "reason"])
    return reduce(lambda a, b: a | b, [one(r) for r in rules], F.lit(False))


def drop_reasons(rows: DataFrame, rules: list[dict[str, str]], keep: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Adds reason: `configured`, then `surplus` for AI rows that keep(key) lacks; null for the rest."""
    reason = F.when(matches_rules(rules), "configured")
    if keep is not None:
        rows = rows.join(keep.select(key).distinct().withColumn("_kept", F.lit(True)), key, "left")
        reason = reason.when((F.col("label") == 1) & F.col("_kept").isNull(), "surplus")
    out = rows.withColumn("reason", reason)
    return out.drop("_kept") if keep is not None else out


def before_cutoff(created: Column, edited: Column, cutoff: str) -> Column:
    """Both dates (ISO texts) on the cutoff's day or before; an unedited row counts by its creation."""
    day = lambda c: F.substring(c, 1, 10) <= cutoff
    return day(created) & (edited.isNull() | day(edited))


#: Titles of pages that aren't prose; anywhere in the title where no start is asked for.
SKIP_TITLES = r"^(Lists? of |Index of |Outline of |Timeline of |Wikinews Shorts|News briefs|Crosswords/)|\(disambiguation\)"


def qualified_page(title: Column, size_now: Column, size_then: Column, least: int) -> Column:
    return ~title.rlike(SKIP_TITLES) & (size_now >= least) & (size_then >= least)


def large_cells(rows: DataFrame, keys: list[str], least: int = 200) -> DataFrame:
    """Rows of cells with `least` rows or more; counts are made before the join, so a hot cell is one row of it."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n"), keys)


def require_sources(rows: DataFrame, least: dict[str, int], by: str = "source") -> DataFrame:
    """rows, or an error that names the sources with fewer distinct rows than they must have."""
    have = {r[0]: r[1] for r in rows.filter(F.col(by).isin(*least)).groupBy(by).agg(F.count("*")).collect()}
    few = {s: have.get(s, 0) for s, n in least.items() if have.get(s, 0) < n}
    if few:
        raise GuardError(f"too few rows: {few}")
    return rows


def join_scores(rows: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Rows with their scores; a row without one is an error, not a loss."""
    missing = [r[0] for r in rows.join(scores, key, "left_anti").select(key).limit(3).collect()]
    if missing:
        raise GuardError(f"no score for {missing} and perhaps others")
    return rows.join(scores, key)


def first_openings(rows: DataFrame, words: int = 60) -> DataFrame:
    """(grp, opening): the first human row (by ord) of each group, its first words."""
    first = rows.filter("label = 0").groupBy("grp").agg(F.min_by("text", "ord").alias("text"))
    w = F.regexp_extract_all("text", F.lit(f"([^{SPACE}]+)"), F.lit(1))
    return first.select("grp", F.array_join(F.slice(w, 1, words), " ").alias("opening"))


def paired_answers(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(grp, human, ai): of each group the first answer of either side with least to most words, where both have one."""
    fits = rows.filter(F.col("words").between(least, most))
    one = lambda y: F.min_by(F.when(F.col("label") == y, F.col("id")), F.when(F.col("label") == y, F.col("ord")))
    return fits.groupBy("grp").agg(one(0).alias("human"), one(1).alias("ai")).filter("human IS NOT NULL AND ai IS NOT NULL")


def references(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """(key, state): keys that only one side has: `missing` from outer, or `unused` by inner."""
    a, b = inner.select(key).distinct(), outer.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("unused")))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): everything that leads to a root over edges(child, parent), roots included. Semi-naive: a round joins only
    what the last one found; rounds are the longest path."""
    found = stage(roots.select("node").distinct(), "closure")
    new = found
    while not new.isEmpty():
        near = edges.join(new.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node")).distinct()
        new = stage(near.join(found, "node", "left_anti"), "closure")
        found = stage(found.union(new), "closure")
    return found


def migrate(rows: DataFrame, old: dict[str, float], new: dict[str, float]) -> DataFrame:
    """Settings that still equal all old defaults get the new ones; any that were changed stay."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in old.items()])
    return rows.withColumn("_same", same).select(*[F.when(F.col("_same"), F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def with_defaults(settings: DataFrame, defaults: dict) -> DataFrame:
    return settings.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if defaults.get(c) is not None else F.col(c) for c in settings.columns])


def check_settings(yellow_from: float, red_from: float, short_red_from: float | None = None) -> None:
    if not 0 <= yellow_from < red_from <= 1 or short_red_from is not None and not 0 <= short_red_from <= 1:
        raise GuardError(f"thresholds out of order: {yellow_from}, {red_from}, {short_red_from}")


def next_flagged(rows: DataFrame, by: str = "page_id") -> DataFrame:
    """rows(by, pos) of flagged items with their number and the next one's place; the last leads back to the first."""
    w = Window.partitionBy(by).orderBy("pos")
    return rows.withColumn("number", F.row_number().over(w)).withColumn("next_pos", F.coalesce(F.lead("pos").over(w), F.min("pos").over(Window.partitionBy(by))))


def scan_order(rows: DataFrame, top: str, bottom: str, view_top: float, view_bottom: float, near: float = 1.5) -> DataFrame:
    """Items by distance from the viewport, then place; `near`: within so many screens."""
    distance = F.greatest(F.lit(view_top) - F.col(bottom), F.col(top) - F.lit(view_bottom), F.lit(0.0))
    return rows.withColumn("distance", distance).withColumn("near", distance <= near * (view_bottom - view_top)).orderBy("distance", top)


def text_index(items: DataFrame, by: str) -> DataFrame:
    """Adds `span`: how many texts come before an item that has one, -1 for empty ones."""
    full = F.length(F.coalesce("text", F.lit(""))) > 0
    before = F.sum(F.when(full, 1).otherwise(0)).over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("span", F.when(full, before - 1).otherwise(-1))


def groups_from_sizes(rows: DataFrame, by: str) -> DataFrame:
    """Adds `grp` to rows(by, pos, size) where each group of size n stands as n neighbouring rows of size n.

    Runs of equal sizes are islands; within one the place divided by the size tells the group.
    """
    w = Window.partitionBy(by).orderBy("pos")
    r = rows.withColumn("_new", F.coalesce((F.lag("size").over(w) != F.col("size")).cast("int"), F.lit(1)))
    r = r.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_run").orderBy("pos")) - 1)
    at = F.struct("_run", F.floor(F.col("_k") / F.col("size")))
    return r.withColumn("grp", F.dense_rank().over(Window.partitionBy(by).orderBy(at))).drop("_new", "_run", "_k")


def stride(rows: DataFrame, key: str, limit: int, seed: str) -> DataFrame:
    """About `limit` rows, evenly over the longest-first order, without sorting it: by hash range within length classes."""
    n = rows.count()
    step = max(1, n // max(1, limit))
    return rows.filter(unit(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))) < 1.0 / step)


def soft_label(is_ai: Column, confidence: Column | float = 0.95) -> Column:
    """P(AI) as a training target: the confidence for AI texts, its complement for human ones, to four digits."""
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.round(F.when(is_ai, c).otherwise(1 - c), 4)


def training_row(rows: DataFrame, most: int = 2000) -> DataFrame:
    """rows(text, p_ai) with JSON columns state, questions and gold, as a distribution trainer reads them."""
    state = F.to_json(F.struct(F.substring("text", 1, most).alias("text")))
    questions = F.to_json(F.struct(F.struct(F.lit("choice").alias("type"), F.array(F.lit("ai"), F.lit("human")).alias("options")).alias("origin")))
    gold = F.to_json(F.struct(F.struct(F.col("p_ai").alias("ai"), F.round(1 - F.col("p_ai"), 4).alias("human")).alias("origin")))
    return rows.withColumn("state", state).withColumn("questions", questions).withColumn("gold", gold)


def asked(rows: DataFrame) -> DataFrame:
    """One row for each question that has a gold answer: adds question, target (map)."""
    gold = F.from_json("gold", "map<string,map<string,double>>")
    named = F.map_keys(F.from_json("questions", "map<string,string>"))
    r = rows.withColumn("question", F.explode(named)).withColumn("target", gold[F.col("question")])
    return r.filter(F.col("target").isNotNull())


def model_key(provider: Column, name: Column, version: Column) -> Column:
    return F.concat(F.concat_ws(":", provider, name), F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise(""))


def server_info(info: Column) -> Column:
    """struct(name, version, max_chars, reliable_words, red_from, yellow_from, notes) from a server's JSON: fields out of range are
    left out and named in notes."""
    get = lambda k: F.get_json_object(info, f"$.{k}")
    number = lambda k: get(k).try_cast("double")
    fields = {
        "name": (get("name"), F.length(get("name")).between(1, 200), "string"), "version": (get("version"), F.length(get("version")).between(1, 200), "string"),
        "maxChars": (number("maxChars"), number("maxChars").between(200, 100_000), "int"), "reliableWords": (number("reliableWords"), number("reliableWords").between(1, 10_000), "int"),
        "yellowFrom": (number("yellowFrom"), number("yellowFrom").between(0, 1), "double"), "redFrom": (number("redFrom"), number("redFrom").between(0, 1), "double"),
    }
    notes = F.array_compact(F.array(*[F.when(get(k).isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, (_, ok, _) in fields.items()]))
    return F.struct(*[F.when(ok, v).cast(t).alias(k) for k, (v, ok, t) in fields.items()], notes.alias("notes"))
