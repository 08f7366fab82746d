"""N-gram Jaccard join: MinHash LSH forest, verified exactly.

Texts are sets of word shingles. Documents with equal sets are one class from the start; one row stands for them. Each set
has a signature of `TREES` labels of `DEPTH` MinHashes, big-endian, so that the sorted labels of a tree are its trie and a
prefix of a label is a node. All trees are climbed at the same time: sets first meet under nodes of full depth, then the
prefix is shortened by one minimum, and so on until a pair at the threshold meets in some tree with the target recall. At
each depth only nodes over sets that haven't met yet count, those with two labels or more (a set's label is the smallest set
it was linked to): a group of copies that has come together at a longer prefix isn't looked at again. Sets under one node are linked where their whole signatures
don't rule the threshold out by far; links make clusters. Within a cluster the pairs that share a node are compared by
exact Jaccard.

What is lost: a pair at the threshold of 0.8 meets in no tree with a probability of 6e-7, and its signature strays below
the filter with one of 4e-7; together they stay under 1 - `RECALL`. Nothing is dropped for being frequent.

Nodes and clusters larger than a block are dealt as pairs of blocks, so no task holds more than two, and only counts and
one link for each member leave a task, never pairs. Clusters are joined to the texts by broadcast if their counted rows are
at most `BROADCAST_ROWS`, by shuffle otherwise.

Defined results: null and empty texts and texts without words have no shingles: class of their own, no links. A text of fewer
words than a shingle is one shingle. Repeated rows are copies and count as links. class_id is the smallest doc_id of the
class, which is a connected component of the links; n_links counts the other rows with Jaccard >= threshold, copies
included. A row without a doc_id counts as a copy and has the class of its text, null if no row with an id has that text,
and then no links to other texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, release, shuffle_partitions, texts
from .components import components
from .wordhash import WordHasher, mix, shingles

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 20, 4, 0.99999
BLOCK_SETS, BLOCK_SHINGLES, BROADCAST_ROWS = 512, 2_000_000, 200_000
_random = np.random.default_rng(11)
_A = _random.integers(0, 2**63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, TREES * DEPTH, np.uint64)


def depths(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """The lengths of the prefixes to climb through: from the whole label to the first with which a pair at the threshold
    meets in some tree with the asked probability."""
    out = [depth]
    while out[-1] > 1 and 1 - (1 - threshold ** out[-1]) ** trees < recall:
        out.append(out[-1] - 1)
    return out


def shingle_set(text: str, n: int, hashed: WordHasher) -> np.ndarray:
    return shingles(hashed(text), n)


def set_key(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, each the high half of a permuted hash."""
    least = np.full(TREES * DEPTH, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(least, (s[i : i + 512, None] * _A + _B).min(0), out=least)
    return least >> np.uint64(32)


def labels(sig: np.ndarray) -> bytes:
    """The signature as bytes: for each tree its label, DEPTH numbers of four bytes, big-endian, so bytes sort as numbers do."""
    return sig.astype(">u4").tobytes()


def node_ids(sigs: np.ndarray, depth: int) -> np.ndarray:
    """(sets, TREES) numbers that agree where the labels' prefixes of `depth` minima do; sigs as (sets, TREES, DEPTH)."""
    h = np.zeros(sigs.shape[:2], np.uint64)
    for d in range(depth):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, d].astype(np.uint64) + np.uint64(1))
    return h


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, k (null without shingles), size, labels (of all trees), sig (one byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()  # dropped with the task
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                keys, sizes, tries, sigs = [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), n, hashed)
                    sizes.append(len(s))
                    if len(s):
                        keys.append(set_key(s))
                        tries.append(labels(signature(s)))
                        sigs.append(tries[-1][3::4])
                    else:
                        keys.append(None), tries.append(None), sigs.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tries, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "k", "size", "labels", "sig"])

    return docs.mapInArrow(run, "doc_id long, k binary, size long, labels binary, sig binary")


def _blocks(df: DataFrame, count: Column) -> DataFrame:
    """Each row once for every pair of blocks (pi <= pj) its own block is in; mine is its own block; one pair if one block holds all."""
    own = F.pmod(F.xxhash64("k"), count).cast("int")
    other = F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    df = df.withColumn("mine", own).withColumn("_o", other)
    return df.withColumn("pi", F.least("mine", "_o")).withColumn("pj", F.greatest("mine", "_o")).drop("_o")


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows that agree in the first `by` columns: the key and the other columns as lists."""
    key, held = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:by] != key:
                if held:
                    yield key, held
                key, held = row[:by], [[] for _ in row[by:]]
            for c, v in zip(held, row[by:]):
                c.append(v)
    if held:
        yield key, held


def link_alike(sigs: np.ndarray, cluster: np.ndarray, least: float) -> list[int]:
    """For each signature the first of those it is linked to, over chains of agreement >= least or of a common cluster."""
    n = len(sigs)
    first = [-1] * n
    free = np.arange(n)
    while len(free):
        leader, free = int(free[0]), free[1:]
        first[leader], front = leader, [leader]
        while front and len(free):
            one = front.pop()
            alike = cluster[free] == cluster[one]
            other = np.flatnonzero(~alike)
            alike[other] = (sigs[free[other]] == sigs[one]).mean(1) >= least
            for j in free[alike].tolist():
                first[j] = leader
                front.append(j)
            free = free[~alike]
    return first


def compare_block(sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted partners of each set at >= threshold among those it shares a node with, and for each set the first of its component.

    side tells the two blocks of a pair apart; then only pairs across count. All 0: all pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    _, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    ordered = sizes[order]
    across = side.any()
    links, root = np.zeros(n, np.int64), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(int(ids.max()) + 1, np.int32)
    for a in range(n - 1):
        last = int(np.searchsorted(ordered, ordered[a] / threshold + 1e-9, "right"))
        if last <= a + 1:
            continue
        i = int(order[a])
        met = (nodes[order[a + 1 : last]] == nodes[i]).any(1)
        if across:
            met &= side[order[a + 1 : last]] != side[i]
        with_ = a + 1 + np.flatnonzero(met)
        if not len(with_):
            continue
        own = ids[starts[a] : ends[a]]
        mark[own] = 1
        if 2 * len(with_) >= last - a - 1:
            shared = np.add.reduceat(mark[ids[starts[a + 1] : ends[last - 1]]], starts[a + 1 : last] - starts[a + 1])[with_ - a - 1]
        else:
            shared = np.array([mark[ids[starts[b] : ends[b]]].sum() for b in with_.tolist()])
        mark[own] = 0
        partners = order[with_[shared >= threshold * (ordered[a] + ordered[with_] - shared) - 1e-9]]
        if len(partners):
            links[i] += weight[partners].sum()
            links[partners] += weight[i]
            for j in partners.tolist():
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return links, np.array([find(i) for i in range(n)])


def _linked(reps: DataFrame, label: DataFrame | None, depth: int, least: float, scratch: Scratch, many: int) -> DataFrame:
    """Links (a, b) between sets that share a prefix of `depth` minima and haven't met before, that is, have other labels (v, label)."""
    nodes = F.array(*[F.xxhash64(F.lit(t), F.substring("labels", 4 * DEPTH * t + 1, 4 * depth)) for t in range(TREES)])
    at = reps.select("k", F.explode(nodes).alias("node"))
    if label is not None:
        at = at.join(label.select(F.col("v").alias("k"), "label"), "k", "left").select("k", "node", F.xxhash64(F.coalesce("label", "k")).alias("cluster"))
    else:
        at = at.withColumn("cluster", F.xxhash64("k"))
    # nodes over sets that haven't met: two clusters or more
    shared = at.groupBy("node").agg(F.count("*").alias("n"), F.min("cluster").alias("_a"), F.max("cluster").alias("_b")).filter("_a <> _b").select("node", "n")
    shared = scratch.table(shared, f"shared-{depth}")
    at = scratch.table(at.join(shared, "node"), f"at-{depth}")
    at = _blocks(at.join(reps.select("k", "sig"), "k"), F.ceil(F.col("n") / BLOCK_SETS).cast("long"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, (k, own, sig) in _groups(batches, 3):
            ids = np.array(own)
            # one byte of each minimum: the share of equal ones strays by 0.045 at most, one byte may agree by chance
            first = link_alike(np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1), ids, least)
            head: dict[int, bytes] = {}
            for i, f in enumerate(first):
                head[f] = min(k[i], head.get(f, k[i]))
            seen = {(f, own[i]) for i, f in enumerate(first) if k[i] == head[f]}
            for i, f in enumerate(first):
                if (f, own[i]) not in seen:  # one link for each cluster, to the smallest set
                    seen.add((f, own[i]))
                    a.append(k[i]), b.append(head[f])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = at.select("node", "pi", "pj", "k", "cluster", "sig").repartition(many, "node", "pi", "pj").sortWithinPartitions("node", "pi", "pj", "k")
    links = scratch.table(dealt.mapInArrow(link, "a binary, b binary").distinct(), f"linked-{depth}")
    for name in ("shared", "at"):
        scratch.drop(f"{name}-{depth}")
    return links


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = texts(docs)
    many = 2 * shuffle_partitions(spark)
    base = scratch.table(_signed(docs, n), "base")
    reps = base.filter("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("labels").alias("labels"), F.any_value("sig").alias("sig"))
    reps = scratch.table(reps, "reps")
    keys = scratch.table(base.select("doc_id", "k"), "keys")
    scratch.drop("base")
    climb = depths(threshold, recall)
    links, label = None, None
    for depth in climb:
        if links is not None:
            label = scratch.table(links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")), f"labels-{depth}")
        new = _linked(reps, label, depth, 0.7 * threshold, scratch, many)
        links = new if links is None else links.union(new)
        release(spark)
    cluster = scratch.table(components(links, scratch, "clusters"), "clusters")

    # pairs within a cluster that share a node, exactly
    total = cluster.join(reps.select(F.col("k").alias("v"), "size", "copies", "rep"), "v")
    total = scratch.table(total.select(F.col("v").alias("k"), "root", "size", "copies", "rep"), "members")
    sums = scratch.table(total.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "sums")
    count = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    members = total.join(sums, "root").select("k", "root", "copies", "rep", count.alias("count"))
    members = scratch.table(members, "counted")
    few = members.count() <= BROADCAST_ROWS
    chosen = docs.join(F.broadcast(members) if few else members, F.col("doc_id") == F.col("rep")).select("text", "k", "root", "copies", "count")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                own = [shingle_set(t.as_py(), n, hashed) for t in part.column(0)]
                # rows that share a doc_id may hold other texts
                right = pa.array([set_key(s) == k.as_py() for s, k in zip(own, part.column(1))])
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([labels(signature(s)) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], names=["k", "root", "copies", "count", "labels", "shingles"])
                yield out.filter(right)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, pi, pj), (k, mine, copies, tries, raw) in _groups(batches, 3):
            keep = [i for i in range(len(k)) if not i or k[i] != k[i - 1]]  # a repeated row came twice
            own = [np.frombuffer(raw[i], np.uint64) for i in keep]
            side = np.array([mine[i] != pi for i in keep], np.int8) if pi != pj else np.zeros(len(keep), np.int8)
            nodes = node_ids(np.frombuffer(b"".join(tries[i] for i in keep), ">u4").reshape(len(keep), TREES, DEPTH), climb[-1])
            links, first = compare_block(own, nodes, side, np.array([copies[i] for i in keep], np.int64), threshold)
            hit = [j for j in range(len(keep)) if links[j]]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([k[keep[j]] for j in hit], pa.binary()), pa.array([k[keep[first[j]]] for j in hit], pa.binary()), pa.array(links[hit])], names=["a", "b", "links"])

    made = _blocks(chosen.mapInArrow(sets, "k binary, root binary, copies long, count long, labels binary, shingles binary"), F.col("count"))
    made = made.select("root", "pi", "pj", "k", "mine", "copies", "labels", "shingles").repartition(many, "root", "pi", "pj").sortWithinPartitions("root", "pi", "pj", "k")
    found = scratch.table(made.mapInArrow(compare, "a binary, b binary, links long"), "found")
    joined = components(found.select("a", "b"), scratch, "classes")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    result = reps.join(joined, F.col("k") == F.col("v"), "left").join(links, F.col("k") == F.col("a"), "left")
    result = scratch.table(result.select("k", "rep", "copies", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "result")
    least_id = scratch.table(result.groupBy("root").agg(F.min("rep").alias("class_id")), "class-ids")
    of_set = scratch.table(result.join(least_id, "root").select("k", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "sets")
    got = keys.join(of_set, "k", "left")
    got = scratch.table(got.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes-of-rows")
    for name in (*(f"{x}-{d}" for d in climb for x in ("linked", "labels")), "reps", "keys", "clusters", "members", "sums", "counted", "found", "result", "class-ids", "sets"):
        scratch.drop(name)
    release(spark)
    return got


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links for each row of documents; odd rows as defined above."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
q AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN q x ON x.doc_id = a JOIN q y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT doc_id, min(m) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.doc_id, class_id, coalesce(k.n, 0) AS n_links FROM c LEFT JOIN k ON k.a = c.doc_id"""
