"""Hashes, score arithmetic and levels, Column to Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's SHA-256; the same in any engine."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / 2.0**52


def text_key(text: Column, chars: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def store_key(signature: str, text: Column) -> Column:
    return text_key(F.concat(F.lit(signature + "\u0002"), text))


def sigmoid(x: Column) -> Column:
    return F.when(x > -700, 1 / (1 + F.exp(-x))).otherwise(F.lit(0.0))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def log_odds(logits: Column, index: int) -> Column:
    """log(p / (1 - p)) of one class from its logits; a single logit is taken as it is."""
    top = F.array_max(F.filter(logits, lambda x, i: i != index))
    others = F.aggregate(F.filter(logits, lambda x, i: i != index), F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(F.size(logits) == 1, logits[0]).otherwise(logits[index] - (top + F.log(others)))


def valid_probability(p: Column) -> Column:
    return F.when(p.between(0, 1) & ~F.isnan(p), p)


#: Names that classifiers give the two classes.
_AI, _HUMAN = r"(?i)^(ai|fake|chatgpt|generated|machine|label_1|1)", r"(?i)^(human|real|label_0|0)"


def probability_from_labels(labels: Column) -> Column:
    """P(AI) from array<struct<label,score>>: the AI label's score, else the complement of the human one's."""
    ai, human = F.filter(labels, lambda x: x["label"].rlike(_AI)), F.filter(labels, lambda x: x["label"].rlike(_HUMAN))
    return valid_probability(F.when(F.size(ai) > 0, F.get(ai, F.lit(0))["score"]).when(F.size(human) > 0, 1 - F.get(human, F.lit(0))["score"]))


def up2(x: Column) -> Column:
    """To the next hundredth."""
    return F.ceil(x * 100 - 1e-9) / 100


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


@dataclass(frozen=True)
class Grading:
    """Thresholds of a traffic light; short_red_from None: short texts never turn red."""

    yellow_from: float = 0.75
    red_from: float = 0.94
    reliable_words: int = 120
    short_red_from: float | None = None


def level(p: Column, words: Column, g: Grading) -> Column:
    """red, yellow, green, or uncertain for short texts with a high score; unknown lengths count as long. No score, no level."""
    base = F.when(p >= g.red_from, "red").when(p >= g.yellow_from, "yellow").otherwise("green")
    short = F.lit("uncertain")
    if g.short_red_from is not None:
        short = F.when(p >= max(g.short_red_from, g.red_from), "red").otherwise("uncertain")
    long = words.isNull() | (words >= g.reliable_words)
    return F.when(p.isNotNull(), F.when((base == "green") | long, base).otherwise(short))


def quantise(x: Column) -> Column:
    """struct(scale, values): a row as signed bytes, the largest at 127, halves to even."""
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(x, lambda v: F.rint(v.cast("double") / scale).cast("int")).alias("values"))


def quantise_blocks(x: Column, block: int = 32, zero: int = 128) -> Column:
    """array<struct<scale,values>>: blocks as unsigned bytes around a zero point, the scale from the largest magnitude."""

    def one(start):
        part = F.transform(F.slice(x, start, block), lambda v: v.cast("double"))
        top = F.array_max(F.transform(part, F.abs))
        sign = F.when(F.array_contains(part, -top), -top).otherwise(top)
        scale = F.when(top > 0, sign / -zero).otherwise(F.lit(1.0))
        return F.struct(scale.alias("scale"), F.transform(part, lambda v: F.least(F.greatest(F.rint(v / scale) + zero, F.lit(0.0)), F.lit(255.0)).cast("int")).alias("values"))

    return F.transform(F.sequence(F.lit(1), F.size(x), F.lit(block)), one)


def pool_pairs(x: Column) -> Column:
    """Means of neighbours; a last single value stays."""
    at = F.sequence(F.lit(0), F.size(x) - 1, F.lit(2))
    return F.transform(at, lambda i: F.when(i + 1 < F.size(x), (F.get(x, i).cast("double") + F.get(x, i + 1)) / 2).otherwise(F.get(x, i).cast("double")))


def normalised(p: Column) -> Column:
    """Weights that sum to 1; uniform if they are all 0."""
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def arg_max(p: Column) -> Column:
    return F.array_position(p, F.array_max(p)).cast("int") - 1
