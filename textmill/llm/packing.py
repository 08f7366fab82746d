"""Packing: concatenate and cut.

Pass one tokenizes each document once and writes its ids with the partition that made them and the count of ids before it
in that partition. Prefix sums over the partitions' totals (one number for each partition) then give every document a
global offset, and fixed windows over these offsets are the sequences. A document that crosses a window's end is cut
there; every piece is a boundary record. Only the very last sequence is shorter than the window: it alone needs padding.

Defined results: null and empty texts consist of the end token alone; repeated rows are packed as often as they come; an
empty table has no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, texts
from .token_count import calls, tokenizer

WINDOW, END = 4096, 2
#: The library's split into words, spelled out for lower-case texts whose code points are all below 256.
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class WordEncoder:
    """Ids of texts by a tokenizer that splits into words first and marks the last token of each word.

    Words are encoded once and remembered. That is exact as no merge crosses words. New words are encoded together, with
    a space between, and told apart by the marks; if their number is off, one by one. The split by `_PIECES` equals the
    tokenizer's for texts within Latin-1 that hold none of its special strings; any other text goes through the library
    as it is. The memory is bounded: beyond `most` entries, and between tasks, only the first `keep` words stay, among which the
    frequent ones are.
    """

    def __init__(self, path: str, most: int = 400_000, keep: int = 100_000):
        self.tok, self.most, self.keep, self.known, self.core = tokenizer(path), most, keep, {}, {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def shrink(self) -> None:
        self.known = dict(self.core)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) == len(words) and ends[-1] == 4 * len(ids):
            raw = ids.tobytes()
            self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        else:
            for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()
        if len(self.core) < self.keep:
            self.core.update((w, self.known[w]) for w in words)

    def _split(self, text: str) -> list[str] | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(s in text for s in self.special) else _PIECES.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        split = [self._split(t) for t in texts]
        if len(self.known) > self.most:
            self.shrink()
        new = list(set().union(*(s for s in split if s)).difference(self.known))
        for i in range(0, len(new), 10_000):
            self._learn(new[i : i + 10_000])
        get = self.known.__getitem__
        return [b"".join(map(get, s)) if s is not None else array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes() for s, t in zip(split, texts)]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, part, before, n, ids: a document's ids, the partition that made them and the ids before it in there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before, last = encoder(path), TaskContext.get().partitionId(), 0, np.array([end], "<u4").tobytes()
        for batch in batches:
            column = batch.column(1)
            for s in calls([n.as_py() for n in pc.utf8_length(column)], 2_000_000):
                ids = [x + last for x in enc.encode(column[s].to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], pa.array(np.full(len(n), part, np.int32)), pa.array(at), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])
        enc.shrink()

    return texts(docs).mapInArrow(run, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Boundary records: doc_id, start, length, ids, doc_tokens, sequence_id, offset; one row for each piece."""
    spark = docs.sparkSession
    made = Scratch(spark, "packing").table(tokenized(docs, path, end), "ids")
    totals = sorted(made.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part int, base long")
    g = made.join(F.broadcast(bases), "part").withColumn("g", F.col("base") + F.col("before"))
    w = F.lit(window).cast("long")
    numbers = F.sequence(F.expr(f"g div {window}"), F.expr(f"(g + n - 1) div {window}"))

    def piece(k):
        start = F.greatest(F.lit(0).cast("long"), k * w - F.col("g"))
        stop = F.least(F.col("n"), (k + 1) * w - F.col("g"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"),
            F.substr("ids", (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
            k.alias("sequence_id"), (F.greatest(F.col("g"), k * w) - k * w).alias("offset"),
        )

    pieces = g.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(numbers, piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; odd rows as defined above."""
    import public_tokenizers

    got = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
