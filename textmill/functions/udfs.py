"""Functions that Spark has no built-in for, over Arrow batches."""

from __future__ import annotations

import hashlib
import html
import random
import re
import sys
from bisect import bisect_left
from functools import cache
from itertools import accumulate, islice
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or "&" not in t else _ENTITY.sub(lambda m: html.unescape(m.group()), t))


@F.pandas_udf(T.DecimalType(20, 0))
def seeded(key: pd.Series) -> pd.Series:
    """A 64-bit number from BLAKE2b of a key such as seed:part:part."""
    from decimal import Decimal

    return key.map(lambda k: None if k is None else Decimal(int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big")))


@F.pandas_udf(T.LongType())
def words(text: pd.Series) -> pd.Series:
    """How many words a text has, as text.word_count; Python's white space is that of text.SPACE."""
    return pd.Series([None if t is None else len(t.split()) for t in text], dtype="Int64")


#: Kinds of single signs that text.PER_100_WORDS counts; a sign can be of several.
_KINDS = {
    "newline": "\n", "curly_quote": "\u2018\u2019\u201c\u201d", "double_quote": '"', "apostrophe": "'", "long_dash": "\u2013\u2014", "bracket": "()[]",
    "comma": ",", "full_stop": ".", "question_exclamation": "?!", "colon_semicolon": ":;",
}
#: The other features of text.PER_100_WORDS, by what finds them.
_FOUND = {
    "double_space": "  +", "spaced_hyphen": " - ", "html_tag": r"</?[a-zA-Z][^>\n]{0,40}>", "markdown": r"(?m)\*\*|^#{1,4} |^[-*] ", "url": r"https?://|www\.", "ellipsis": r"\.\.\.|\u2026",
}
_FOUND = {k: re.compile(v) for k, v in _FOUND.items()}
_SPACED = re.compile(r" [,.!?](?= |\n?\Z)")
_ORDER = (
    "newline", "double_space", "space_before_punct", "curly_quote", "double_quote", "apostrophe", "long_dash", "spaced_hyphen", "bracket", "html_tag", "markdown", "url", "ellipsis",
    "comma", "full_stop", "question_exclamation", "colon_semicolon", "digit", "uppercase", "non_ascii", "other_symbol",
)


def _is_word(sign: str) -> bool:
    return sign == "_" or unicodedata.category(sign)[0] in "LN"


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A class for each code point, and which kinds each class is of."""
    names = [*_KINDS, "digit", "uppercase", "non_ascii", "other_symbol"]
    category = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    of = np.zeros((len(category), len(names)), np.int64)
    for i, signs in enumerate(_KINDS.values()):
        of[[ord(s) for s in signs], i] = 1
    of[:, -4] = [c == "Nd" for c in category]
    of[ord("A") : ord("Z") + 1, -3] = 1
    of[128:, -2] = 1
    of[:, -1] = [c[0] not in "LN" for c in category]
    of[[c for c, kind in enumerate(category) if kind[0] in "ZC" and chr(c).isspace()], -1] = 0
    of[[ord(s) for s in "_.,;:!?'\"()[]-"], -1] = 0
    kinds, table = np.unique(of @ (1 << np.arange(len(names))), return_inverse=True)
    return table.astype(np.uint8), kinds[:, None] >> np.arange(len(names)) & 1, names


def surface_values(t: str) -> list[float]:
    table, kinds, names = _classes()
    signs = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = dict(zip(names, np.bincount(table[signs], minlength=len(kinds)) @ kinds))
    n |= {k: len(rx.findall(t)) if k != "spaced_hyphen" else t.count(" - ") for k, rx in _FOUND.items()}
    n["space_before_punct"] = sum(1 for m in _SPACED.finditer(t) if m.start() and _is_word(t[m.start() - 1]))
    words = max(1, len(t.split()))
    first, body = t[:1], t[:-1] if t.endswith("\n") else t
    upper, lower = "A" <= first <= "Z", "a" <= first <= "z"
    closed, last = body.rstrip("\"')]")[-1:], body[-1:]
    flags = (upper, lower, first != "" and not upper and not lower, closed != "" and closed in ".!?\u2026", last.isascii() and last.isalnum(), first.isspace() or t[-1:].isspace())
    return [float(words), len(t) / words, *(float(n[k]) * 100.0 / words for k in _ORDER), *map(float, flags)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def surface(text: pd.Series) -> pd.Series:
    """The values of text.surface_features in its order; of a null text there is one word and nothing else."""
    return text.map(lambda t: [1.0] + [None] * (len(_ORDER) + 7) if t is None else surface_values(t))


_SENTENCE = re.compile(r"[.!?…]+[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the sentences, without the white space between them; what surrounds the whole text stays."""
    cuts = [(m.start() + len(m.group().rstrip()), m.end()) for m in _SENTENCE.finditer(text)]
    begins, ends = [0, *(after for _, after in cuts)], [*(end for end, _ in cuts), len(text)]
    return [(b, e) for b, e in zip(begins, ends) if b < e or e < len(text)]


def choose_excerpt(text: str, draw: random.Random, lengths, most_chars: int, min_words: int = 15) -> tuple[int, int]:
    """Offsets of an excerpt of whole sentences.

    A range of words is drawn by weight, and a number in it. A text of no more words is taken whole; else a start is drawn
    among the sentences from which the excerpt's words fall into the range, or among all from which the text still holds
    so many. Sentences at the end go while limits are passed and min_words stay; a sentence is cut only where it alone
    passes them.
    """
    lo, hi = draw.choices([(a, b) for _, a, b in lengths], [w for w, _, _ in lengths])[0]
    target, most_words = draw.randint(lo, hi), lengths[-1][2]
    spans = sentence_spans(text)
    if not spans:
        return 0, 0
    until = list(accumulate((len(text[a:b].split()) for a, b in spans), initial=0))  # words before each sentence

    def stop(i: int) -> int:
        """Where an excerpt from sentence i ends: where its words reach the target, or one before if that overshoots the range."""
        j = bisect_left(until, until[i] + target)
        return j - 1 if until[j] - until[i] > hi and until[j - 1] - until[i] >= lo else j

    if until[-1] <= target:
        first, last = 0, len(spans)
    else:
        ways = [(i, stop(i)) for i in range(len(spans)) if until[-1] - until[i] >= target]
        first, last = draw.choice([(i, j) for i, j in ways if lo <= until[j] - until[i] <= hi] or ways)
    start = spans[first][0]
    while until[last - 1] - until[first] >= min_words and (spans[last - 1][1] - start > most_chars or until[last] - until[first] > most_words):
        last -= 1
    end = spans[last - 1][1]
    if until[last] - until[first] > most_words:
        end = start + [m.end() for m in islice(re.finditer(r"\S+", text[start:end]), most_words)][-1]
    if end - start > most_chars:  # at a space, or within a word that alone is too long
        space = text.rfind(" ", start, start + most_chars + 1)
        end = space if space > start else start + most_chars
    return start, end


def excerpt(lengths=((0.3, 15, 39), (0.4, 40, 119), (0.3, 120, 330)), most_chars: int = 2000, seed: int = 50):
    """struct(start, end) of an excerpt of a text, drawn by the row's key."""

    @F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    def draw(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        got = [choose_excerpt(t or "", random.Random(f"{seed}:excerpt:{k}"), lengths, most_chars) for k, t in zip(key, text)]
        return pd.DataFrame(got, columns=["start", "end"])

    return draw


@F.pandas_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("second", T.StringType())]))
def split_half(text: pd.Series) -> pd.DataFrame:
    """Two parts, cut at the sentence boundary nearest the middle (between 25 and 75 %), else at the middle word."""

    def cut(t):
        t = t or ""
        at = [m.end() for m in _SENTENCE.finditer(t) if 0.25 * len(t) <= m.end() <= 0.75 * len(t)]
        if at:
            k = min(at, key=lambda x: abs(x - len(t) / 2))
            return t[:k].strip(), t[k:].strip()
        w = t.split()
        return " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])

    return pd.DataFrame([cut(t) for t in text], columns=["first", "second"])
