import pytest
from pyspark.sql import functions as F

from textmill.operators import filters, scorers


def test_guards(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, source string")
    with pytest.raises(filters.GuardError):
        filters.require_sources(rows, {"x": 2, "y": 2})
    assert filters.require_sources(rows, {"x": 2, "y": 1}) is rows
    s = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, score double")
    with pytest.raises(filters.GuardError):
        filters.join_scores(rows, s)
    assert filters.join_scores(rows.filter("id <> 'c'"), s).count() == 2
    with pytest.raises(filters.GuardError):
        filters.check_settings(0.9, 0.8)
    filters.check_settings(0.5, 0.8, 0.9)


def test_closure_and_migration(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("a", "c")], "child string, parent string")
    assert {r.node for r in filters.closure(e, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}
    rows = spark.createDataFrame([(1, 0.5, 0.87), (2, 0.5, 0.9)], "id int, yellow double, red double")
    got = {r.id: (r.yellow, r.red) for r in filters.migrate(rows, {"yellow": 0.5, "red": 0.87}, {"yellow": 0.75, "red": 0.94}).collect()}
    assert got == {1: (0.75, 0.94), 2: (0.5, 0.9)}


def test_dates_and_titles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(filters.before_cutoff(F.lit("2021-06-30T23:59:59Z"), F.lit(None).cast("string"), "2021-06-30"))
    assert not one(filters.before_cutoff(F.lit("2021-06-30"), F.lit("2021-07-01"), "2021-06-30"))
    assert not one(filters.qualified_page(F.lit("List of birds"), F.lit(9000), F.lit(9000), 3000))
    assert one(filters.qualified_page(F.lit("Birds"), F.lit(9000), F.lit(3000), 3000))


def test_orders(spark):
    r = spark.createDataFrame([(1, k, s) for k, s in enumerate([2, 2, 2, 2, 3, 3, 3, 1, 1])], "page_id int, pos int, size int")
    assert [x.grp for x in filters.groups_from_sizes(r, "page_id").orderBy("pos").collect()] == [1, 1, 2, 2, 3, 3, 3, 4, 5]
    s = spark.createDataFrame([("far", 3000.0, 3100.0), ("in", 100.0, 200.0), ("above", -300.0, -200.0)], "k string, top double, bottom double")
    got = filters.scan_order(s, "top", "bottom", 0.0, 800.0).collect()
    assert [x.k for x in got] == ["in", "above", "far"] and [x.near for x in got] == [True, True, False]


def test_server_info(spark):
    j = '{"name": "m", "maxChars": 10, "redFrom": 0.9, "yellowFrom": "x"}'
    r = spark.createDataFrame([(j,)], "j string").select(filters.server_info(F.col("j")).alias("i")).first().i
    assert (r.name, r.maxChars, r.redFrom, r.yellowFrom, sorted(r.notes)) == ("m", None, 0.9, None, ["maxChars", "yellowFrom"])


def test_model_scorer(spark):
    def load():
        return lambda texts: [len(t) / 10 if len(t) < 12 else 7.0 for t in texts]

    rows = spark.createDataFrame([("a" * k,) for k in (1, 5, 1, 20)] + [(None,)], "text string")
    got = scorers.score_distinct(rows, scorers.from_model(load, 2)).collect()
    assert sorted((len(r.text or ""), r.score) for r in got if r.score is not None) == [(0, 0.0), (1, 0.1), (1, 0.1), (5, 0.5)]
    assert [r.score for r in got if r.text and len(r.text) == 20] == [None]


def test_training_rows_of_every_labelled_document(spark, sf_dir):
    import json

    import duckdb

    import __spark_entry__ as entry

    docs = duckdb.sql(f"SELECT doc_id, text, quality FROM '{sf_dir}/documents.parquet' JOIN '{sf_dir}/labels.parquet' USING (doc_id)").fetchall()
    want = sorted((i, 0.95 if q == 1 else 0.05, t.strip()[:2000]) for i, t, q in docs if t is not None and len(t.split()) >= 40)
    got = sorted((r.doc_id, r.p_ai, json.loads(r.state)["text"]) for r in entry.queries()["training_rows"](spark, sf_dir).collect())
    assert got == want
    assert any('"' in t or "/" in t or len(t) < 300 for _, _, t in want) and len(want) > entry.queries()["soft_training_rows"](spark, sf_dir).count()
