"""Queries on small tables made for what only larger or odd ones hold."""

import json
import math
import random
import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textmill.functions import text as tx
from textmill.functions import udfs
from textmill.operators import layout, suites
from textmill.plans import catalogue


@pytest.fixture
def against(spark, tmp_path):
    """Rows of a query and of its SQL over tables given as name to (schema, rows), without an order."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        sql = con.sql(entry.oracle_sql()[name])
        got = entry.queries()[name](spark, str(tmp_path))
        tidy = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
        return sorted(map(tidy, got.select(*sql.columns).collect()), key=repr), sorted(map(tidy, sql.fetchall()), key=repr)

    return run


def test_side_by_side_with_a_base_of_zero(spark, against):
    at = [("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, 0.0), ("a", 3, -2.0), ("b", 0, 0.5), ("b", 1, 0.25), ("b", 2, None), ("c", 1, 1.0), ("d", 0, None), ("d", 1, 3.0)]
    got, want = against("side_by_side", events=("event_type string, user_id long, value double", at))
    assert got == want and [r[4] for r in got if r[0] == "a"] == [math.inf, "nan", -math.inf]
    r = suites.side_by_side(spark.createDataFrame([("k", "x", 2), ("k", "y", 3), ("k", "z", None)], "k string, run string, v int"), ["k"], "run", "v", "x").collect()
    assert [tuple(x) for x in r] == [("k", "y", 3, 2, 1.5)]


def test_layout_paragraphs_of_a_single_letter(spark, against):
    words = ["w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(161)]
    texts = ["A.", "a", "I am", "", "1 2", " ".join(words[:40]) + " a", " ".join(words[:80]) + " a", " ".join(words[:120]) + " a", " ".join(words[:160]) + " B"]
    got, want = against("layout_paragraphs", documents=("doc_id long, text string", list(enumerate(texts))))
    assert got == want and len(got) == 20
    one = spark.createDataFrame([("A.", 10.0, 1, 10.0), ("12 34.5 = 9", 10.0, 1, 10.0)], "text string, size double, n_lines int, body double")
    assert [tuple(r) for r in one.select(layout.kind_of(), layout.kind_of(prose=True)).collect()] == [("table", "text"), ("table", "table")]


def test_training_rows_of_conversations(spark, against):
    texts = ["plain", "", None, 'a "b" \\ / \t\n\r\b\f\x00\x1f\x7f ', "😀" * 2100, "é</x>" * 900]
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "tool", None]) for t, text in enumerate(texts)]
    got, want = against("training_rows", conversations=("conv_id long, turn long, role string, text string", rows))
    assert got == [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in want] and len(got) == 12


def test_training_rows_of_whole_texts(against):
    texts = ["a" * 2000, "b" * 2000 + "!", "😀" * 2001, "".join(map(chr, range(1, 0x3000))) + " end", 'He said "é" \\ /\n' * 30000 + "."]
    got, want = against("training_rows", conversations=("conv_id long, turn long, role string, text string", [(1, t, "assistant", text) for t, text in enumerate(texts)]))
    assert got == [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in want] and [json.loads(r[2])["text"] for r in got] == texts


def test_document_training_rows(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text, quality FROM '{sf_dir}/documents.parquet' JOIN '{sf_dir}/labels.parquet' USING (doc_id)").fetchall()
    want = sorted((i, 0.95 if q == 1 else 0.05, t.strip()[:2000]) for i, t, q in docs if t is not None and len(t.split()) >= 40)
    assert sorted((r.doc_id, r.p_ai, json.loads(r.state)["text"]) for r in entry.queries()["document_training_rows"](spark, sf_dir).collect()) == want


def test_a_query_name_is_given_once():
    with pytest.raises(ValueError):
        catalogue.query(name="training_rows")(lambda spark, sf_dir: None)


#: Signs of blocks that no version of Unicode has added to since Java's: Python and DuckDB know some newer letters.
SIGNS = [chr(c) for c in (*range(0x530), 0x1680, *range(0x2000, 0x20A0), *range(0x3000, 0x3100))] + list("﻿�😀𝒜") + list(" \n.,!?…\"')]-*#</>aZ0") * 60


def odd_texts(n=150):
    draw = random.Random(7)
    return [None, "", " ", "\n", "a", "a.\n", "x .", "x ,\n", 'He said so."\n'] + ["".join(draw.choices(SIGNS, k=draw.choice([1, 3, 30, 400]))) for _ in range(n)]


def test_length_group_receipt_counts_words_once(spark, against):
    rows = [("en" if i % 2 else None, t) for i, t in enumerate(odd_texts() + ["w " * n for n in (14, 15, 39, 40, 119, 120)])]
    got, want = against("length_group_receipt", documents=("lang string, text string", rows))
    assert got == want and sum(r[2] for r in got) == len(rows)
    d = spark.createDataFrame(rows, "lang string, text string")
    assert d.filter(~udfs.words("text").eqNullSafe(tx.word_count(F.col("text")))).count() == 0
    plan = entry.queries()["length_group_receipt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("words(") <= 2 and "regexp_extract_all" not in plan


def test_surface_features_in_one_reading(spark):
    texts = odd_texts(400) + ["a - - - b", "x ,  y . \n", "x , , y", "**a**\n# b\n- c\n* d\n##### e", "<a>< b></p>< <div class='x'>", "....…...", "https://www.http://", "٣ x ⅷ ² ¼", "  a   b  "]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    t = F.col("text")
    want = tx.feature_rates(t) | {n: c.cast("double") for n, c in tx.feature_flags(t).items()}
    got = tx.surface_features(t)
    assert list(got) == list(want)
    wrong = d.select("i", *[F.when(~got[n].eqNullSafe(want[n]), n).alias(n) for n in want]).select("i", F.array_compact(F.array(*want)).alias("w")).filter("size(w) > 0")
    assert wrong.collect() == []


def test_single_feature_auroc_reads_documents_once(spark, against):
    rows = [(i, t) for i, t in enumerate(odd_texts()) if t is not None]
    got, want = against("single_feature_auroc", documents=("doc_id long, text string", rows), labels=("doc_id long, toxic int", [(i, i % 3 % 2) for i, _ in rows]))
    assert got == want and len(got) == 29
    plan = entry.queries()["single_feature_auroc"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "surface(" not in plan and "documents" not in plan


def test_words_of_odd_texts(spark):
    texts = odd_texts() + ["w x y", "w x y ", " w x", "a b c. d", "one two. three", "a. b", "   "]
    d = spark.createDataFrame([(t, texts[(i + k) % len(texts)], k) for i, t in enumerate(texts) for k in (0, 3, 30)], "t string, o string, k int")
    a = d.select("*", tx.word_count(F.col("t")).alias("n"), tx.shared_words(F.col("t"), F.col("o")).alias("s"), tx.cut_words(F.col("t"), F.col("k")).alias("c"), tx.trim_end(F.col("t"), 2).alias("e"))
    space = "[\\s\\x1c-\\x1f]"
    for r in a.collect():
        if r.t is None:
            assert (r.n, r.s, r.c, r.e) == (None, None, None, None)
            continue
        w, o = r.t.split(), None if r.o is None else r.o.split()
        assert r.n == len(w)
        same = None if o is None else next((i for i, (x, y) in enumerate(zip(w, o)) if x != y), min(len(w), len(o)))
        assert r.s == same
        pieces = re.split(f"(?<!{space})(?={space})", re.sub(f"^{space}+", "", r.t))
        assert r.c == "".join(pieces[r.k :])
        kept = re.search(f"^([\\s\\S]*[.!?…]+[\"')\\]]*)(?={space})", r.t)
        done = re.search("[.!?…]+[\"')\\]]*\n?\\Z", r.t) or not kept or len(kept[1].split()) < 2 or 2 * len(kept[1].split()) < len(w)
        assert r.e == (r.t if done else kept[1])


def test_cleaning_receipt_reads_documents_twice(spark):
    q = entry.queries()
    got = {(r.lang, r.reason): r.n for r in q["clean_drop_receipt"](spark, "/root/testdata/sf0.001").collect()}
    rows = q["clean_rows"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got == {(r.lang, r.reason): r["count"] for r in rows.groupBy("lang", "reason").count().collect()}
    plan = q["clean_drop_receipt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
