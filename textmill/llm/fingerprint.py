"""Document fingerprints: SpotSigs.

Common words (antecedents) are spots; the chain of the next ``CHAIN`` content words behind a spot, with the spot itself, is
a signature. A document's fingerprint is its set of signatures, written as text: the ascending 32-bit hashes in
base64. Two fingerprints compare by Jaccard; as the Jaccard is at most the ratio of the set sizes, `search` partitions sets
by length, and a pair is given up unread where the sizes rule the asked likeness out.

Defined results: a text without a complete chain has one signature, made of all its words, and without words one made of
the text itself, so equal texts have equal fingerprints, also empty ones. Null texts are empty. Documents that share an id
follow each other by text. The next of the last document is the first. `with_next` leaves rows without a doc_id aside, as
they have no place in the order. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shuffle_partitions, texts
from .wordhash import PLACES, WordHasher, mix

CHAIN = 3
#: Common words of English, German, French and Spanish.
ANTECEDENTS = frozenset(
    "the a an is was are were be been to of and in that for on it with as by at or from this not but have has had he she they we you i "
    "der die das und ist in den von zu mit im ein eine auf für als dem des nicht es sich auch an war wird sind oder aus bei nach "
    "le la les un une de du des et en est que qui pour dans par sur au aux ne pas ce il elle se sont avec "
    "el los las una y o del al que es por con para su lo como más pero sus son fue".split()
)
_hashed = WordHasher(ANTECEDENTS)  # one for each worker, bounded


def signatures(text: str) -> np.ndarray:
    """The distinct signatures of a text, ascending, as unsigned 32-bit numbers; one at least."""
    h = _hashed(text)
    spot = (h & np.uint64(1)).astype(bool)
    content = h[~spot]
    behind = (np.arange(len(h)) - np.cumsum(spot) + 1)[spot]  # content words up to each spot
    full = behind + CHAIN <= len(content)
    if full.any():
        at = behind[full]
        acc = h[spot][full] * PLACES[0]
        for i in range(CHAIN):
            acc = acc + content[at + i] * PLACES[i + 1]
        return np.unique((mix(acc) >> np.uint64(32)).astype("<u4"))
    whole = h.tobytes() if len(h) else b"text" + text.encode("utf-8", "surrogatepass")
    return np.frombuffer(blake2b(whole, digest_size=4).digest(), "<u4")


def dump(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.tobytes()).decode()


def load(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two ascending sets; 0 without a look at them if their sizes rule out `least`."""
    small, large = sorted((len(a), len(b)))
    if not large or small < least * large:
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def length_partitions(n: Column, least: float) -> Column:
    """Length classes in which a set of n signatures meets all sets that can reach `least`: its own and the next one up.

    Class k holds sizes from (1/least)^k to (1/least)^(k+1); two sets whose ratio is `least` or more are in one class or
    in neighbouring ones.
    """
    k = F.floor(F.log(n) / F.lit(float(-np.log(least))) + 1e-9)
    return F.array(k, k + 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, signatures (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sigs = [signatures(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(dump, sigs), pa.string()), pa.array([s.astype(np.int64) for s in sigs], pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "signatures"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string, signatures array<long>")


def search(queries: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """query_id, doc_id, likeness of each query and each different fingerprint among docs with likeness >= least.

    doc_id is the smallest id with that fingerprint. Sets meet only within their length partitions, and there by the prefix
    of their signatures: sets as alike as `least` share one of the first n - ceil(least * n) + 1 in the common order.
    Equal fingerprints of docs are one row before they meet anything; candidates are compared on the whole sets.
    """
    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("n", F.size("signatures"))
        first = F.slice("signatures", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))
        return df.select("id", F.explode(length_partitions(F.col("n"), least)).alias("k"), first.alias("first")).select("id", "k", F.explode("first").alias("s"))

    own = fingerprints(queries).select(F.col("doc_id").alias("id"), "signatures")
    all_docs = fingerprints(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.any_value("signatures").alias("signatures")).select("id", "signatures")
    met = dealt(own).withColumnRenamed("id", "query_id").join(dealt(all_docs).withColumnRenamed("id", "doc_id"), ["k", "s"]).select("query_id", "doc_id").distinct()
    both = met.join(own.toDF("query_id", "a"), "query_id").join(all_docs.toDF("doc_id", "b"), "doc_id")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("query_id", "doc_id", (shared / (F.size("a") + F.size("b") - shared)).alias("likeness")).filter(F.col("likeness") >= least)


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """fn(doc_id, text, next text) -> row, over all documents in ascending (doc_id, text); the last meets the first.

    Ids are dealt into ranges between quantiles that are ids themselves, so the first document of a range is known
    beforehand: it also goes, as the last row, to the range before it. No task sees more than its ranges.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    parts = 4 * shuffle_partitions(spark)
    ids = docs.select("doc_id").agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts")).first()
    cuts = np.array(sorted({ids.low, *(ids.cuts or [])} - {None}), np.int64)

    @F.pandas_udf("array<struct<range:int,peek:int>>")
    def ranges(doc_id):
        import pandas as pd

        k = np.searchsorted(cuts, doc_id.to_numpy(np.int64), "right") - 1
        first = cuts[k] == doc_id.to_numpy(np.int64)
        return pd.Series([[(a, 0), ((a - 1) % len(cuts), 1)] if f else [(a, 0)] for a, f in zip(k.tolist(), first.tolist())])

    dealt = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.explode(ranges("doc_id")).alias("r")).select("r.range", "r.peek", "doc_id", "text")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(kinds)
        state = fn()
        last, out, held = None, [], 0
        for batch in batches:
            for rng, peek, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is not None and last[0] == rng:
                    out.append(state(last[1], last[2], text))
                    held += len(text)
                last = None if peek else (rng, doc_id, text)
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), to.types)], names=names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), to.types)], names=names)

    sort = dealt.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "peek", "doc_id", "text")
    return sort.mapInArrow(run, schema)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside its edited text and the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; odd rows as defined above."""

    def start():
        kept: dict = {}

        def one(doc_id: int, text: str, following: str):
            own = kept.pop(text, None) if kept else None
            kept.clear()
            own = signatures(text) if own is None else own
            after = kept.setdefault(following, signatures(following))
            cut = len(text) // 4
            edited = text[: len(text) - cut] + following[:cut]
            changed = signatures(edited)
            return doc_id, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), dump(own), dump(changed), likeness(own, changed), likeness(own, after)

        return one

    return with_next(read_table(spark, sf_dir, "documents"), start, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
