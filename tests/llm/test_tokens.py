import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ..conftest import DATA
from textmill.llm import packing, token_count

from .conftest import ODD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_text(rnd, n):
    return "".join(rnd.choice(["word", " ", "  ", "\n", "'re", "'", "don't", "123", "é", "漢", "<|endoftext|>", "<|endo", "...", " ", "x" * 40]) for _ in range(n))


def test_spliced_counts_are_the_library_s():
    rnd, tok = random.Random(1), Tokenizer.from_file(BYTES)
    for k in range(150):
        t = odd_text(rnd, rnd.randint(1, 400)) if k % 5 else rnd.choice(["a", " ", "ab ", "é"]) * rnd.randint(1, 900)
        assert token_count.count_huge(tok, t, rnd.choice([40, 64, 200]), rnd.choice([20, 32])) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_counts(make_docs):
    tok = Tokenizer.from_file(BYTES)
    long = odd_text(random.Random(2), 30_000)
    rows = [*ODD, long]
    got = {r.doc_id: r for r in token_count.count_tokens(make_docs(rows, more=True), BYTES, chunk=1000, overlap=64).collect()}
    for i, t in enumerate(rows):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_count.count_tokens(make_docs([]), BYTES).count() == 0


def test_piece_counter_is_the_library(sf_dir):
    import pyarrow.parquet as pq

    rnd, tok = random.Random(7), Tokenizer.from_file(BYTES)
    texts = [t or "" for t in ODD] + [odd_text(rnd, 50) for _ in range(200)] + ["".join(chr(rnd.randrange(256)) for _ in range(80)) for _ in range(3000)]
    texts += ["".join(rnd.choice(" \t\n\x1c\x1f\x85\xa0'sartévedlmS12²½.,") for _ in range(60)) for _ in range(3000)]
    texts += pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()
    few = token_count.PieceCounter(BYTES, most=500)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        want = [len(tok.encode(t, add_special_tokens=False).ids) for t in part]
        assert token_count.counter(BYTES).counts(part) == want and few.counts(part) == want


def test_word_encoder_is_the_library(sf_dir):
    import pyarrow.parquet as pq

    rnd, tok = random.Random(3), Tokenizer.from_file(WORDS)
    texts = [t or "" for t in ODD] + [odd_text(rnd, 50) for _ in range(200)] + ["".join(chr(rnd.randrange(256)) for _ in range(80)) for _ in range(300)]
    texts += pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()[:300]
    for t, ids in zip(texts, packing.WordEncoder(WORDS).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_holds_each_id_once(make_docs):
    tok = Tokenizer.from_file(WORDS)
    rows = [*ODD, *(f"some words {i} " * (7 * i) for i in range(30))]
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in enumerate(rows)}
    for window in (16, 64):
        got = packing.pack(make_docs(rows, more=True), WORDS, window).collect()
        per, seq = {}, {}
        for r in got:
            assert r.doc_tokens == len(ids[r.doc_id])
            own = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert own == ids[r.doc_id][r.start : r.start + r.length] and zlib.crc32(bytes(r.ids)) >= 0
            per[r.doc_id] = per.get(r.doc_id, 0) + r.length
            seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert per == {i: len(x) for i, x in ids.items()}
        full = sorted(seq)
        assert full == list(range(len(full)))
        for s in full:
            at = 0
            for offset, n in sorted(seq[s]):
                assert offset == at
                at += n
            assert at == window or s == full[-1] and 0 < at <= window
    assert packing.pack(make_docs([]), WORDS).count() == 0
