"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (words of the training sample) beside the mean vector of its character n-grams: all runs of
three and four bytes of the word between two marks, hashed, so unseen words have them too. Two gated recurrent layers read a
window of `SPAN` words from either side, attention pools their states, and a logistic unit gives the window's logit. Windows
overlap by a quarter and cover the whole text; the document's score is that of its worst window. As a document's label holds
for some window of it, training also follows the worst window of each document. All parameters start at random and are
learned by gradient steps alone.

The sample is bounded in rows and bytes: of the labelled training rows whose text has at most `MOST_CHARS` code points, those
with the smallest hashes of their ids, at most `MOST_TOXIC` toxic and `MOST_CLEAN` others. Scoring runs over all rows and
whole texts. A word's inputs to both layers are computed once and remembered, so a window costs only the recurrent part.

Defined results: null and empty texts and texts without words form one window without words, which scores as the model
does without evidence; labels that are null are left out, a doc_id with several labels is toxic if one is; without labels of both
classes every score is the share of toxic labels (0 without any); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts

SPAN, STRIDE, UNITS, WIDTH, BUCKETS = 64, 48, 8, 8, 1 << 15
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 3000, 20_000
_WORD = re.compile(r"\w+")
_f4 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def char_buckets(word: str) -> list[int]:
    """The buckets of all runs of three and four bytes of ^word$."""
    w = f"^{word}$".encode("utf-8", "surrogatepass")
    return [zlib.crc32(w[i : i + n]) % BUCKETS for n in (3, 4) for i in range(len(w) - n + 1)]


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= SPAN:
        return [0]
    out = list(range(0, n - SPAN, STRIDE))
    return [*out, n - SPAN]


class Network:
    """Parameters: word vectors E, sign vectors C, input weights W and biases b, recurrent weights U (both directions), attention a, output o."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        normal = lambda *shape, s=0.3: (rnd.standard_normal(shape) * s).astype(_f4)
        self.p = {
            "E": normal(len(vocabulary) + 1, WIDTH, s=0.05), "C": normal(BUCKETS, WIDTH, s=0.05),
            "W": normal(2, 2 * WIDTH, 3 * UNITS), "b": np.zeros((2, 3 * UNITS), _f4), "U": normal(2, UNITS, 3 * UNITS),
            "a": normal(2 * UNITS), "o": normal(2 * UNITS), "c": np.array([-1], _f4),
        }
        self.p["E"][0] = 0  # words outside the sample
        self.p["b"][:, :UNITS] = -1  # states start by taking up their input

    # words
    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary rows, the buckets of all words one after the other, and where those of each word begin."""
        buckets = [char_buckets(w) for w in words]
        begins = np.cumsum([0, *map(len, buckets)])
        flat = np.fromiter((b for own in buckets for b in own), np.int64, int(begins[-1]))
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64), flat, begins

    def vectors(self, rows: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Each word's own vector beside the mean of its n-grams' vectors."""
        if not len(rows):
            return np.zeros((0, 2 * WIDTH), _f4)
        sums = np.add.reduceat(self.p["C"][flat], begins[:-1], axis=0)
        return np.concatenate((self.p["E"][rows], sums / np.diff(begins)[:, None]), 1).astype(self.p["C"].dtype)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["W"][d] + self.p["b"][d] for d in (0, 1)], 1)

    # windows
    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: inputs (steps, windows, 6 * UNITS); mask: (steps, windows). Logits, and what a way back needs."""
        steps, n, _ = x.shape
        h3, u2 = 3 * UNITS, 2 * UNITS
        # both directions step together: the second one reads from the end
        both = np.stack((x[:, :, :h3], x[::-1, :, h3:]), 1)
        on = np.stack((mask, mask[::-1]), 1)[:, :, :, None]
        path = np.zeros((steps, 2, n, UNITS), x.dtype)
        saved = []
        h = np.zeros((2, n, UNITS), x.dtype)
        for t in range(steps):
            g = h @ self.p["U"]
            zr = _sigmoid(both[t, :, :, :u2] + g[:, :, :u2])
            z, r, k = zr[:, :, :UNITS], zr[:, :, UNITS:], g[:, :, u2:]
            c = 2 * _sigmoid(2 * (both[t, :, :, u2:] + r * k)) - 1
            new = (c + z * (h - c)) * on[t]
            if keep:
                saved.append((h, z, r, k, c))
            path[t] = h = new
        states = np.concatenate((path[:, 0], path[::-1, 1]), 2)
        e = states @ self.p["a"]
        e[~mask] = -30
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, states, optimize=False)
        logits = pooled @ self.p["o"] + self.p["c"]
        return (logits, (states, saved, w, pooled)) if keep else logits

    def back(self, x_words: np.ndarray, mask: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the inputs, and of the word vectors (steps, windows, 2 * WIDTH)."""
        states, saved, w, pooled = kept
        h3, u2 = 3 * UNITS, 2 * UNITS
        g = {k: np.zeros_like(self.p[k]) for k in ("W", "b", "U", "a", "o", "c")}
        g["o"], g["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], _f4)
        dpool = dlogit[:, None] * self.p["o"]
        de = np.einsum("tnh,nh->tn", states, dpool)
        de = w * (de - (w * de).sum(0))
        g["a"] = np.einsum("tn,tnh->h", de, states)
        dstates = w[:, :, None] * dpool + de[:, :, None] * self.p["a"]
        dboth = np.zeros((len(mask), 2, mask.shape[1], h3), x_words.dtype)
        dpath = np.stack((dstates[:, :, :UNITS], dstates[::-1, :, UNITS:]), 1)
        on = np.stack((mask, mask[::-1]), 1)[:, :, :, None]
        dh, ut = np.zeros(dpath.shape[1:], x_words.dtype), self.p["U"].transpose(0, 2, 1)
        for t in range(len(mask) - 1, -1, -1):
            h, z, r, k, c = saved[t]
            dnew = (dpath[t] + dh) * on[t]
            dc = dnew * (1 - z) * (1 - c * c)
            dz = dnew * (h - c) * z * (1 - z)
            dr = dc * k * r * (1 - r)
            dg = np.concatenate((dz, dr, dc * r), 2)
            g["U"] += h.transpose(0, 2, 1) @ dg
            dh = dnew * z + dg @ ut
            dboth[t, :, :, :u2], dboth[t, :, :, u2:] = dg[:, :, :u2], dc
        dx = np.concatenate((dboth[:, 0], dboth[::-1, 1]), 2)
        dwords = np.zeros(x_words.shape, x_words.dtype)
        flat = x_words.reshape(-1, x_words.shape[-1])
        for d in (0, 1):
            own = dx[:, :, d * h3 : (d + 1) * h3].reshape(-1, h3)
            g["W"][d], g["b"][d] = flat.T @ own, own.sum(0)
            dwords += dx[:, :, d * h3 : (d + 1) * h3] @ self.p["W"][d].T
        return g, dwords


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the values of each key, and the distinct keys, ascending."""
    if not len(keys):
        return values, keys
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return np.add.reduceat(values[order], new, axis=0), keys[order][new]


def train(samples: list[tuple[str, int]], seed: int = 7, passes: int = 6, batch: int = 32, rate: float = 0.01, most: int = 500) -> Network | float:
    """Fit on (text, label) pairs in about so many passes, `most` updates at most; a number if they hold one class only."""
    labels = np.array([y for _, y in samples], _f4)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return share
    docs = [_WORD.findall((t or "").lower()) for t, _ in samples]
    words = Counter(w for d in docs for w in set(d))
    known = sorted(w for w, n in words.items() if n >= 5)
    net = Network({w: i + 1 for i, w in enumerate(known)}, seed)
    all_words = list(words)
    rows, flat, begins = net.inputs(all_words)
    at = {w: i for i, w in enumerate(all_words)}
    index = [np.array([at[w] for w in d], np.int64) for d in docs]

    def grams(used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some words, and where those of each begin."""
        n = begins[used + 1] - begins[used]
        first = np.concatenate(([0], np.cumsum(n)))
        return flat[np.arange(first[-1]) + np.repeat(begins[used] - first[:-1], n)], first

    rnd = np.random.default_rng(seed)
    updates = int(np.clip(passes * len(docs) / batch, 60, most))
    m, v, step = {}, {}, 0

    def adam(name: str, g: np.ndarray, where=slice(None)) -> None:
        if name not in m:
            m[name], v[name] = np.zeros_like(net.p[name]), np.zeros_like(net.p[name])
        m[name][where] = 0.9 * m[name][where] + 0.1 * g
        v[name][where] = 0.99 * v[name][where] + 0.01 * g * g
        fix = np.sqrt(1 - 0.99 ** min(step, 1000)) / (1 - 0.9 ** min(step, 1000))
        net.p[name][where] -= rate * fix * m[name][where] / (np.sqrt(v[name][where]) + 1e-6)

    pos, neg = np.flatnonzero(labels > 0), np.flatnonzero(labels == 0)
    decks: dict[int, list[int]] = {0: [], 1: []}

    def draw(kind: int) -> int:
        if not decks[kind]:
            decks[kind] = rnd.permutation(pos if kind else neg).tolist()
        return decks[kind].pop()

    for step in range(1, updates + 1):
        if step == updates * 3 // 4:
            rate *= 0.3
        chosen = [draw(int(k % 8 < 3)) for k in range(batch)]
        starts = [(j, s) for j, i in enumerate(chosen) for s in window_starts(len(index[i]))]
        ids = np.full((len(starts), SPAN), -1, np.int64)
        for k, (j, s) in enumerate(starts):
            own = index[chosen[j]][s : s + SPAN]
            ids[k, : len(own)] = own
        used, ids_at = np.unique(ids, return_inverse=True)  # -1, no word, may stand for any: it is masked
        ids_at, used = ids_at.reshape(ids.shape), np.maximum(used, 0)
        own, first = grams(used)
        vec = net.vectors(rows[used], own, first)
        logits = net.run(net.projected(vec)[ids_at.T], (ids >= 0).T)
        owner = np.array([j for j, _ in starts])
        worst = np.array([np.flatnonzero(owner == j)[np.argmax(logits[owner == j])] for j in range(batch)])
        # only the words of these windows have gradients
        mask = (ids[worst] >= 0).T
        near, at_near = np.unique(ids_at[worst].T, return_inverse=True)
        at_near, used, vec = at_near.reshape(mask.shape), used[near], vec[near]
        own, first = grams(used)
        xw = vec[at_near]
        out, kept = net.run(net.projected(vec)[at_near], mask, keep=True)
        d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[chosen]) / batch).astype(_f4)
        g, dwords = net.back(xw, mask, kept, d)
        per = np.zeros_like(vec)
        np.add.at(per, at_near[mask], dwords[mask])
        for name in g:
            adam(name, g[name].astype(_f4))
        r = rows[used]
        by_row, known_rows = _sums(r[r > 0], per[r > 0, :WIDTH])
        adam("E", by_row, known_rows)
        n = np.diff(first)
        by_gram, touched = _sums(own, np.repeat(per[:, WIDTH:] / n[:, None], n, 0))
        adam("C", by_gram, touched)
    return net


class Scorer:
    """Scores of texts; remembers the inputs of up to `most` words."""

    def __init__(self, net: Network, most: int = 120_000, windows: int = 2048):
        self.net, self.most, self.windows = net, most, windows
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * UNITS), _f4)

    def _learn(self, words: list[str]) -> None:
        n = len(self.at) + 1
        while n + len(words) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            self.table[n + i : n + i + len(part)] = self.net.projected(self.net.vectors(*self.net.inputs(part)))
        self.at.update(zip(words, range(n, n + len(words))))

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.at) > self.most:
            self._forget()
        docs = [_WORD.findall(t.lower()) for t in texts]
        self._learn(list(set().union(*docs).difference(self.at)))
        get = self.at.__getitem__
        ids, owner = [], []
        for j, d in enumerate(docs):
            own = np.fromiter(map(get, d), np.int32, len(d))
            if len(d) < SPAN:
                ids.append(np.concatenate((own, np.zeros(SPAN - len(d), np.int32)))[None])
            else:
                ids.append(np.lib.stride_tricks.sliding_window_view(own, SPAN)[window_starts(len(d))])
            owner.append(np.full(len(ids[-1]), j))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        worst = np.full(len(texts), -np.inf, _f4)
        for i in range(0, len(ids), self.windows):
            part = np.ascontiguousarray(ids[i : i + self.windows].T)
            np.maximum.at(worst, owner[i : i + self.windows], self.net.run(self.table[part], part > 0))
        return 1 / (1 + np.exp(-worst.astype(np.float64)))


def training_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> list[tuple[str, int]]:
    """At most so many labelled training texts of each kind, none longer than most_chars: those whose ids have the smallest hashes."""
    usable = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).withColumn("_o", F.xxhash64("doc_id"))
    short = texts(docs).filter(F.length("text") <= most_chars)
    usable = usable.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    pick = lambda y, n: usable.filter((F.col("toxic") > 0) == bool(y)).orderBy("_o", "doc_id").limit(n)
    chosen = pick(1, most_toxic).unionByName(pick(0, most_clean))  # a bounded number of ids
    got = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r.text, int(r.toxic > 0)) for r in sorted(got, key=lambda r: (r.doc_id, r.text))]


def _scored(docs: DataFrame, labels: DataFrame, text_at: int):
    """A function from (Arrow batch) to pieces (slice of the batch, scores), by a network fitted on docs; the text is column text_at."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs, labels)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        net = model.value
        scorer = None if isinstance(net, float) else Scorer(net)
        for batch in batches:
            own = [t or "" for t in batch.column(text_at).to_pylist()]
            i = 0
            while i < len(own):
                j, chars = i, 0
                while j < len(own) and (j == i or chars + len(own[j]) <= 1_000_000):
                    chars += len(own[j])
                    j += 1
                s = scorer.scores(own[i:j]) if scorer else np.full(j - i, net)
                yield batch.slice(i, j - i), s
                i = j

    return pieces


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, by a network fitted on the labelled ones among them."""
    pieces = _scored(docs, labels, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in pieces(batches):
            held = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def filtered(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `most`; each row is judged by its own text."""
    pieces = _scored(docs, labels, docs.columns.index("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in pieces(batches):
            yield part.filter(pa.array(s < most))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents; odd rows as defined above."""
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
