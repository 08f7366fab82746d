"""Token counts with overlap resynchronisation.

Ordinary texts are counted by the tokenizer's pieces, each of which is encoded once, or encoded whole. A huge document is first cut at the tokenizer's special strings, which the library
takes out before anything else, and each part is encoded in overlapping chunks. A chunk's pre-token boundaries hold for
the whole text if the chunk began at such a boundary and the boundary lies at least ``MARGIN`` code points before the
chunk's end: the pre-tokenizer reads from left to right, starts anew at each boundary and looks ahead by less. Two
neighbours are spliced at the first such boundary of the left chunk that the right one has too; from a shared boundary on
both read the same. Where there is none, the overlap is doubled and the right chunk is encoded again, up to the point
where it begins at the left chunk's own start, and then the left chunk is lengthened instead.

Defined results: null and empty texts have 0 tokens; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, texts

CHUNK, OVERLAP, MARGIN = 32_768, 512, 16
#: Code points encoded by one call of the library, to bound what its results hold.
CALL_CHARS = 400_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def calls(lengths: list[int], most: int = CALL_CHARS) -> Iterator[slice]:
    """Runs of neighbours with at most `most` code points together, one at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if lengths:
        yield slice(start, len(lengths))


def _encode(tok, text: str) -> tuple[list[int], list[int]]:
    """Starts of the pre-tokens and starts of the tokens of one chunk, in code points."""
    starts = [a for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str(text)]
    return starts, [a for a, _ in tok.encode(text, add_special_tokens=False).offsets]


def _count_part(tok, text: str, chunk: int, overlap: int) -> int:
    total, at, size = 0, 0, chunk
    while True:
        end = min(len(text), at + size)
        bounds, tokens = _encode(tok, text[at:end])
        if end == len(text):
            return total + len(tokens)
        # boundaries of this chunk that hold for the whole text
        sure = [at + b for b in bounds if 0 < b <= end - at - MARGIN]
        back, found = overlap, None
        while sure and found is None:
            begin = max(at + 1, end - back)
            first = bisect_left(sure, begin)
            if first < len(sure):
                right = {begin + b for b, in zip(_encode(tok, text[begin : min(len(text), end + overlap)])[0])}
                found = next((p for p in sure[first:] if p in right), None)
            if begin == at + 1:
                break
            back *= 2
        if found is None:  # one pre-token fills the chunk
            size *= 2
            continue
        total += bisect_left(tokens, found - at)
        at, size = found, chunk


def count_huge(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, never encoding much more than a chunk at once."""
    parts, n = [text], 0
    for special in (t.content for t in tok.get_added_tokens_decoder().values()):
        cut = [p.split(special) for p in parts]
        n += sum(len(c) - 1 for c in cut)
        parts = [x for c in cut for x in c]
    return n + sum(_count_part(tok, p, chunk, overlap) for p in parts if p)


#: The library's split into pieces, spelled out for texts whose code points are all below 256.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class PieceCounter:
    """Numbers of tokens of texts by a byte-level tokenizer, whose merges never cross the pieces of its split.

    Pieces are encoded once and their numbers remembered. The split by `_PIECES` equals the tokenizer's for texts within
    Latin-1 that hold none of its special strings; any other text goes through the library as it is. Beyond `most` pieces
    the memory starts anew.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.tok, self.most, self.known = tokenizer(path), most, {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _split(self, text: str) -> list[str] | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(s in text for s in self.special) else _PIECES.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        split = [self._split(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        new = list(set().union(*(s for s in split if s)).difference(self.known))
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.known.update(zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False))))
        whole = iter(self.tok.encode_batch_fast([t for s, t in zip(split, texts) if s is None], add_special_tokens=False))
        get = self.known.__getitem__
        return [len(next(whole)) if s is None else sum(map(get, s)) for s in split]


@lru_cache(maxsize=1)
def counter(path: str) -> PieceCounter:
    """One for each Python worker."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pieces = tokenizer(path), counter(path)
        for batch in batches:
            all_texts = batch.column(1)
            for part in calls([n.as_py() for n in pc.utf8_length(all_texts)]):
                own = all_texts[part].to_pylist()
                counted = iter(pieces.counts([t for t in own if len(t) <= chunk]))
                n = [next(counted) if len(t) <= chunk else count_huge(tok, t, chunk, overlap) for t in own]
                size = pc.cast(pc.binary_length(all_texts[part]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents; odd rows as defined above."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
