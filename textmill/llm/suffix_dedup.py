"""Suffix-array dedup: remove every byte that a string of `LENGTH` bytes covers which also starts earlier.

1. Every document's prefix polynomial hashes give the hash of any of its substrings. In each window of LENGTH bytes the
   GRAM-byte substrings with the smallest hash are anchors; equal windows have equal anchors at equal places. An anchor
   comes with a BLAKE2b digest of 128 bits of its surroundings, the part of the text that all windows around it make up.
2. Of anchors that agree in both, only the first of a part of the text leaves its task, so copies are reduced before any
   shuffle; the rest, and after the shuffle all but the first of all parts, are covered as a whole.
3. Where equal anchors stand in different surroundings, the suffixes behind the anchor, and the reversed prefixes before
   it, are sorted: a mergesort whose comparisons find the common extension by binary search on prefix hashes. The
   neighbours' common extensions are verified byte by byte; a group with a collision is sorted by its bytes instead. Ranks
   at each length then tell which windows agree, and all but the first of those are covered. Half of the windows around an
   anchor share at least HALF bytes before it, the others as many more behind it; each half is grouped by these bytes
   too, so that a frequent short string doesn't bring all its places together.
4. Anchors that stand in more than `PLACES` different surroundings never meet in one task: each window around them goes
   by its own digest, of which only the first place is kept before the shuffle, and joins back to a table with a row for each.
5. Each document's covered spans are merged and cut out of its bytes.

The polynomial hashes, modulo 2^64, only ever propose: which substrings are anchors (any choice that depends on the content
alone is right) and where extensions end (verified). Equality of whole surroundings and of frequent windows rests on BLAKE2b
digests of their bytes, to which no two different inputs are known to agree; sending the bytes themselves would be 4.5 times
the input.

Defined results: null texts are empty; documents shorter than LENGTH lose nothing; if a doc_id is null or occurs more than
once, rows are ordered by (doc_id, text), nulls first, and each is a document; other columns are ignored; an empty table
stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, release, shuffle_partitions, texts

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1  # grams of a window
BACK = LENGTH - GRAM  # bytes before an anchor that some window around it has
HALF = BACK // 2
#: Bytes of text hashed together, bytes after which a task hands on its anchors, and places sorted together; an anchor with more
#: surroundings goes by single windows.
CHUNK, FLUSH, PLACES = 1_000_000, 16_000_000, 50_000
U = np.uint64
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_SIGNS = np.random.default_rng(3).integers(0, 2**63, 256, dtype=U) * U(2) + U(1)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(1 << bits, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums s and inverse powers v: (s[j] - s[i]) * v[i] is the hash of buf[i:j]."""
    power, inverse = _powers(max(20, int(len(buf) + 1).bit_length()))
    s = np.zeros(len(buf) + 1, U)
    np.cumsum(_SIGNS[buf] * power[: len(buf)], out=s[1:])
    return s, inverse


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * _M1
    x = (x ^ (x >> U(32))) * _M2
    return x ^ (x >> U(29))


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over each n neighbours, by doubling."""
    size = 1
    while 2 * size <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each raw[lo:hi], as two numbers."""
    view = memoryview(raw)
    out = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())])
    both = np.frombuffer(out, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def anchors(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For documents that end at `ends` of raw: each anchor's document, place in it, bytes before and behind it within the
    surroundings, the hash of the anchor and the digest of the surroundings."""
    buf = np.frombuffer(raw, np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U, U))
    if len(buf) < LENGTH:
        return none
    begins = np.concatenate(([0], ends[:-1]))
    s, inverse = prefix_hashes(buf)
    h = _spread((s[GRAM:] - s[:-GRAM]) * inverse[: len(buf) - GRAM + 1])
    least = _sliding(h, WINDOW, np.minimum)  # for each window of LENGTH bytes
    whole = np.zeros(len(least), bool)
    for b, e in zip(begins.tolist(), ends.tolist()):
        whole[b : max(b, e - LENGTH + 1)] = True
    least[~whole] = 0
    # an anchor is the least gram of one of the windows around it
    around = np.concatenate((np.zeros(BACK, U), least, np.zeros(BACK, U)))
    at = np.flatnonzero((_sliding(around, WINDOW, np.maximum) == h) & (h > 0))
    if not len(at):
        return none
    doc = np.searchsorted(ends, at, "right")
    lo, hi = np.maximum(at - BACK, begins[doc]), np.minimum(at + LENGTH, ends[doc])
    c, c2 = digests(raw, lo, hi)
    # the same bytes around another place are other surroundings
    return doc, at - begins[doc], at - lo, hi - at, h[at], c ^ _spread((at - lo).astype(U) * U(_BASE)), c2


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal runs, ascending."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, top = lo[o], np.maximum.accumulate(hi[o])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1])))
    return lo[new], top[np.concatenate((new[1:], [len(lo)])) - 1]


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Documents and their spans (pairs of 64-bit numbers), merged."""
    if not len(doc):
        return [], []
    o = np.argsort(doc, kind="stable")
    doc, lo, hi = doc[o], lo[o], hi[o]
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    ids, out = [], []
    for b, e in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)]):
        ids.append(int(doc[b]))
        out.append(np.stack(merged(lo[b:e], hi[b:e]), 1).astype("<i8").tobytes())
    return ids, out


def _first_of(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A sorting by keys, then order, and whether each sorted row is the first of its keys."""
    o = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[o][1:] != k[o][:-1]
    return o, new


# the hash-compared mergesort


def common(s: np.ndarray, inverse: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at i and j, `most` at most, by binary search on prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), most.copy()
    while (busy := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (s[i + mid] - s[i]) * inverse[i] == (s[j + mid] - s[j]) * inverse[j]
        lo, hi = np.where(busy & same, mid, lo), np.where(busy & ~same, mid - 1, hi)
    return lo


def sort_suffixes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes buf[start : start + size] within each group (groups are contiguous), and each one's common
    extension with the one before it in its group (-1 for the first)."""
    n = len(start)
    s, inverse = prefix_hashes(buf)
    order = np.arange(n)
    first = np.searchsorted(group, group, "left")
    count = np.searchsorted(group, group, "right") - first

    def less(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(size[a], size[b])
        l = common(s, inverse, start[a], start[b], most)
        inside = l < most
        x = buf[np.where(inside, start[a] + l, 0)].astype(np.int64)
        y = buf[np.where(inside, start[b] + l, 0)].astype(np.int64)
        x, y = np.where(inside, x, size[a]), np.where(inside, y, size[b])
        return (x < y) | (or_equal & (x == y))

    width, place = 1, np.arange(n)
    while (live := np.flatnonzero(count > width)).size:
        # each element finds its rank in the neighbouring run by binary search
        rel = place[live] - first[live]
        run = rel // width
        right = run % 2 == 1
        mate = first[live] + np.where(right, run - 1, run + 1) * width
        lo = np.zeros(len(live), np.int64)
        hi = np.clip(np.minimum(width, first[live] + count[live] - mate), 0, None)
        own = order[live]
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) >> 1
            before = less(order[mate[busy] + mid], own[busy], right[busy])
            lo[busy] = np.where(before, mid + 1, lo[busy])
            hi[busy] = np.where(before, hi[busy], mid)
        base = first[live] + (run - right) * width
        order[base + (rel - run * width) + lo] = own
        width *= 2
    ext = np.full(n, -1, np.int64)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = order[inner - 1], order[inner]
    ext[inner] = common(s, inverse, start[a], start[b], np.minimum(size[a], size[b]))
    # verification: equal up to the extension, different behind it, and in order
    longest = int(size.max(initial=0)) + 1
    broken: set[int] = set()
    for i in range(0, len(inner), 10_000):
        k, x, y = inner[i : i + 10_000], a[i : i + 10_000], b[i : i + 10_000]
        step = np.arange(longest)
        most = np.minimum(size[x], size[y])
        inside = step < most[:, None]
        p = np.where(inside, start[x][:, None] + step, 0)
        q = np.where(inside, start[y][:, None] + step, 0)
        same = (buf[p] == buf[q]) & inside
        real = np.argmin(same, 1)
        end = real >= most
        later = np.where(end, size[x] <= size[y], buf[np.minimum(start[x] + real, len(buf) - 1)] < buf[np.minimum(start[y] + real, len(buf) - 1)])
        broken.update(group[k[(real != ext[k]) | ~later]].tolist())
    for g in broken:
        b, e = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
        raw = {i: buf[start[i] : start[i] + size[i]].tobytes() for i in range(b, e)}
        own = sorted(raw, key=raw.__getitem__)
        order[b:e] = own
        for k in range(1, e - b):
            x, y = raw[own[k - 1]], raw[own[k]]
            ext[b + k] = next((m for m, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
    return order, ext


def covered_windows(parts: list[bytes], before: np.ndarray, group: np.ndarray, doc: np.ndarray, pos: np.ndarray, offsets: range) -> tuple[np.ndarray, ...]:
    """Places that agree in an anchor: doc, lo, hi of windows that an earlier place of the group has too.

    parts are the surroundings, `before` the bytes of them before the anchor; offsets are those of the anchor in a window.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    anchor = begin + before
    rank = np.arange(len(parts))
    classes = []
    for data, start, size in ((buf, anchor, sizes - before), (np.ascontiguousarray(buf[::-1]), len(buf) - anchor, before)):
        order, ext = sort_suffixes(data, start, size, group)
        classes.append((order, ext))
    time = np.lexsort((pos, doc))
    when = np.empty(len(parts), np.int64)
    when[time] = rank
    out: list[tuple[np.ndarray, np.ndarray]] = []
    ids = [np.empty(len(parts), np.int64) for _ in classes]
    for a in offsets:
        have = np.flatnonzero((before >= a) & (sizes - before >= LENGTH - a))
        if len(have) < 2:
            continue
        for own, (order, ext), need in zip(ids, classes, (LENGTH - a, a)):
            own[order] = np.cumsum(ext < need)
        o, new = _first_of((ids[0][have], ids[1][have]), (when[have],))
        again = have[o[~new]]
        out.append((again, pos[again] - a))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    who, lo = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    return doc[who], lo, lo + LENGTH


# stages


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, len(sizes))


def _span_batch(ids: list[int], spans: list[bytes], columns: list[str]) -> pa.RecordBatch:
    """Rows that only hold spans: their key spreads them, and all other columns are null."""
    n = len(ids)
    own = {"key": pa.array(_spread(np.array(ids, np.int64).view(U)).view(np.int64)), "doc": pa.array(ids, pa.int64()), "spans": pa.array(spans, pa.binary())}
    kinds = {"key": pa.int64(), "c": pa.int64(), "c2": pa.int64(), "doc": pa.int64(), "pos": pa.int64(), "before": pa.int32(), "behind": pa.int32(), "spans": pa.binary()}
    return pa.RecordBatch.from_arrays([own.get(k, pa.nulls(n, kinds[k])) for k in columns], names=columns)


_COLUMNS = ["key", "c", "c2", "doc", "pos", "before", "behind", "spans"]
_SCHEMA = "key long, c long, c2 long, doc long, pos long, before int, behind int, spans binary"


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, text) to the first anchors of each FLUSH bytes of text, and spans of the others."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        doc, pos, before, behind, h, c, c2 = (np.concatenate(x) for x in zip(*held))
        held.clear()
        o, new = _first_of((h, c, c2), (doc, pos))
        k = o[new]
        yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), pa.array(c[k].view(np.int64)), pa.array(c2[k].view(np.int64)), pa.array(doc[k]), pa.array(pos[k]), pa.array(before[k]), pa.array(behind[k]), pa.nulls(len(k), pa.binary())], names=_COLUMNS)
        k = o[~new]
        if len(k):
            yield _span_batch(*_spans(doc[k], pos[k] - before[k], pos[k] + behind[k]), _COLUMNS)

    for batch in batches:
        column = batch.column(1)
        for part in _chunks(pc.binary_length(column).to_pylist(), CHUNK):
            raw = column[part].cast(pa.binary()).to_pylist()
            ends = np.cumsum(np.array([len(x) for x in raw], np.int64))
            doc, pos, before, behind, h, c, c2 = anchors(b"".join(raw), ends)
            size += int(ends[-1])
            if len(doc):
                held.append((batch.column(0)[part].to_numpy()[doc], pos, before.astype(np.int32), behind.astype(np.int32), h, c, c2))
            if size >= FLUSH and held:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, c, c2, doc, pos): spans of all but the first of each (key, c, c2); the first ones, where a key has several."""
    held: list[np.ndarray] | None = None  # the first rows so far of the key that may go on: key, c, c2, doc, pos

    def emit(first: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(first[0]):
            n = len(first[0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in first] + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_COLUMNS)

    def several(key: np.ndarray) -> np.ndarray:
        edge = np.concatenate(([True], key[1:] != key[:-1]))
        return ~(edge & np.concatenate((edge[1:], [True])))

    for batch in batches:
        yield batch.filter(pc.is_valid(batch.column(7)))
        batch = batch.filter(pc.is_null(batch.column(7)))
        if not batch.num_rows:
            continue
        key, c, c2, doc, pos, before, behind = (batch.column(i).to_numpy() for i in range(7))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
        if held is not None and len(held[0]):
            new[0] = key[0] != held[0][-1] or c[0] != held[1][-1] or c2[0] != held[2][-1]
        again = ~new
        if again.any():
            yield _span_batch(*_spans(doc[again], pos[again] - before[again], pos[again] + behind[again]), _COLUMNS)
        first = [x[new] for x in (key, c, c2, doc, pos)]
        if held is not None:
            first = [np.concatenate((a, b)) for a, b in zip(held, first)]
        if not len(first[0]):
            continue
        cut = int(np.searchsorted(first[0], first[0][-1], "left"))
        done, tail = [x[:cut] for x in first], [x[cut:] for x in first]
        if cut:
            yield from emit([x[several(done[0])] for x in done])
        if len(tail[0]) > 10_000:  # a key that goes on and on: hand on what is there, two rows stay to tell of it
            yield from emit([x[:-2] for x in tail])
            tail = [x[-2:] for x in tail]
        held = tail
    if held is not None and len(held[0]):
        yield from emit([x[several(held[0])] for x in held])


def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, text, anchors) to (half, key, near, doc, pos, before, part), for each half of the windows around an anchor."""
    for batch in batches:
        column = batch.column(1)
        for part in _chunks(pc.binary_length(column).to_pylist(), CHUNK):
            rows: list[list] = [[] for _ in range(7)]
            for doc, raw, at in zip(batch.column(0)[part].to_pylist(), column[part].cast(pa.binary()).to_pylist(), batch.column(2)[part].to_pylist()):
                for one in at:
                    pos, key = one["pos"], one["key"]
                    for half, lo, hi in ((0, pos - HALF + 1, pos + LENGTH), (1, pos - BACK, pos + LENGTH - HALF)):
                        lo, hi = max(0, lo), min(len(raw), hi)
                        # the bytes that all windows of this half have beside the anchor
                        near = raw[pos - HALF : pos] if half else raw[pos : pos + LENGTH - HALF + 1]
                        if len(near) < (HALF if half else LENGTH - HALF + 1):
                            continue
                        for r, v in zip(rows, (half, key, hash_of(near), doc, pos, pos - lo, raw[lo:hi])):
                            r.append(v)
            if rows[0]:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["half", "key", "near", "doc", "pos", "before", "part"])


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, text, anchors) to (a, b, doc, lo): the digest and the place of each window around an anchor."""
    for batch in batches:
        column = batch.column(1)
        for part in _chunks(pc.binary_length(column).to_pylist(), CHUNK):
            for doc, raw, at in zip(batch.column(0)[part].to_pylist(), column[part].cast(pa.binary()).to_pylist(), batch.column(2)[part].to_pylist()):
                pos = np.array([one["pos"] for one in at], np.int64)
                lo = np.unique((pos[:, None] - np.arange(BACK + 1)).ravel())
                lo = lo[(lo >= 0) & (lo + LENGTH <= len(raw))]
                for i in range(0, len(lo), 100_000):
                    own = lo[i : i + 100_000]
                    a, b = digests(raw, own, own + LENGTH)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(own), doc)), pa.array(own)], names=["a", "b", "doc", "lo"])


def window_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, lo) to spans of these windows."""
    for batch in batches:
        lo = batch.column(1).to_numpy()
        ids, spans = _spans(batch.column(0).to_numpy(), lo, lo + LENGTH)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], names=["doc", "spans"])


def hash_of(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) - 2**63


def match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (half, key, near): spans of the windows that an earlier place has too."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        half, key, near, doc, pos, before = (t.column(i).to_numpy() for i in range(6))
        edge = np.ones(len(half), bool)
        edge[1:] = (half[1:] != half[:-1]) | (key[1:] != key[:-1]) | (near[1:] != near[:-1])
        group = np.cumsum(edge)
        more = np.flatnonzero(~(edge & np.concatenate((edge[1:], [True]))))
        parts = t.column(6)
        for value, offsets in ((0, range(HALF)), (1, range(HALF, BACK + 1))):
            k = more[half[more] == value]
            if len(k):
                got = covered_windows(parts.take(pa.array(k)).to_pylist(), before[k].astype(np.int64), group[k], doc[k], pos[k], offsets)
                if len(got[0]):
                    ids, spans = _spans(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], names=["doc", "spans"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < PLACES:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        half, key, near = (whole.column(i).to_numpy() for i in range(3))
        last = (half == half[-1]) & (key == key[-1]) & (near == near[-1])
        cut = int(np.argmax(last))
        if cut:
            yield from work([whole.slice(0, cut)])
        held, count = [whole.slice(cut)], len(half) - cut
    if held:
        yield from work(held)


def cut_out(raw: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left."""
    if not spans:
        return 0, 0, raw
    lo, hi = merged(*np.frombuffer(spans, "<i8").reshape(-1, 2).T)
    keep = [raw[b:e] for b, e in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)])]
    return int((hi - lo).sum()), len(lo), b"".join(keep)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    docs = texts(docs)
    many = 2 * shuffle_partitions(spark)
    total, different = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total != different:  # an id for each row, in the defined order; ascending over the sorted partitions, not gapless
        docs = scratch.table(docs.orderBy("doc_id", "text").select(F.monotonically_increasing_id().alias("doc"), "text", "doc_id"), "numbered")
    else:
        docs = docs.select(F.col("doc_id").alias("doc"), "text", "doc_id")
    found = docs.select("doc", "text").mapInArrow(find_anchors, _SCHEMA).repartition(many, "key").sortWithinPartitions("key", "c", "c2", "doc", "pos")
    matched = scratch.table(found.mapInArrow(match_anchors, _SCHEMA), "matched")
    del found
    release(spark)
    places = matched.filter("spans IS NULL").select("doc", "pos", "key")
    hot = scratch.table(places.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PLACES).select("key"), "hot")
    some = not hot.isEmpty()
    cold = places.join(hot, "key", "left_anti") if some else places
    gathered = lambda p: p.groupBy("doc").agg(F.collect_set(F.struct("pos", "key")).alias("at")).hint("merge")
    around = docs.select("doc", "text").join(gathered(cold), "doc").mapInArrow(surroundings, "half int, key long, near long, doc long, pos long, before int, part binary")
    around = around.repartition(many, "half", "key", "near").sortWithinPartitions("half", "key", "near", "doc", "pos")
    windows = scratch.table(around.mapInArrow(match_windows, "doc long, spans binary"), "windows")
    if some:
        single = docs.select("doc", "text").join(gathered(places.join(hot, "key", "left_semi")), "doc").mapInArrow(single_windows, "a long, b long, doc long, lo long")
        single = scratch.table(single, "single")
        place = F.struct("doc", "lo")
        first = single.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("a", "b", "first")
        again = single.join(scratch.table(first, "first").hint("merge"), ["a", "b"]).filter(place != F.col("first")).select("doc", "lo")
        windows = windows.union(scratch.table(again.mapInArrow(window_spans, "doc long, spans binary"), "frequent"))
    del around, places, cold
    release(spark)
    spans = matched.filter("spans IS NOT NULL").select("doc", "spans").union(windows).groupBy("doc").agg(F.array_join(F.collect_list(F.hex("spans")), "").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(pc.binary_length(batch.column(1)).to_pylist(), CHUNK):
                raw = batch.column(1)[part].cast(pa.binary()).to_pylist()
                got = [cut_out(r, s and bytes.fromhex(s)) for r, s in zip(raw, batch.column(2)[part].to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([len(r) for r in raw], pa.int64()), *(pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    left = docs.join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans")
    return left.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of documents; odd rows as defined above."""
    got = dedup_bytes(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
