from pyspark.sql import functions as F

from textmill.streaming import scoring


def test_scores_each_text_once_over_batches(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    for k, texts in enumerate((["a", "bb", "a"], ["bb", "ccc"], ["a"])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(src)
    stream = scoring.stream_table(spark, src, files=1)
    scoring.run_available(stream, f"{out}-checkpoint", scoring.score_batch(out, "m", lambda t: F.length(t) / 10, 5))
    got = [r.p for r in spark.read.parquet(f"{out}/batch=*").collect()]
    assert sorted(got) == [0.1, 0.2, 0.3]
    scoring.run_available(stream, f"{out}-checkpoint", scoring.score_batch(out, "m", lambda t: F.length(t) / 10, 5))
    assert spark.read.parquet(f"{out}/batch=*").count() == 3  # nothing new, nothing again


def test_changed_texts(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x")], "element long, text string").coalesce(1).write.parquet(src)
    q = scoring.changed_texts(scoring.stream_table(spark, src)).writeStream.format("memory").queryName("changed").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.element, r.text) for r in spark.table("changed").collect()) == [(1, "a"), (1, "b"), (2, "x")]


def test_latest_generation(spark):
    r = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "page int, generation int, p double")
    c = spark.createDataFrame([(1, 2)], "page int, generation int")
    assert [x.p for x in scoring.latest_generation(r, c, "page").collect()] == [0.2]


def test_store_has_bases_and_a_lifetime(spark, tmp_path):
    out, day = f"file://{tmp_path}/store", 86_400_000
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    for number, (now, batch) in enumerate([(0, ("a", "b")), (1, ("b", "c")), (2, ("d",)), (3, ("a", "e")), (40, ("a", "f")), (41, ("a", "g"))]):
        scoring.score_batch(out, "m", lambda t: F.length(t) / 10, now * day, days=30, every=2)(texts(*batch), number)
    per = {n: spark.read.parquet(f"{out}/batch={n}").count() for n in range(6)}
    assert per == {0: 2, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1}  # "a" is scored again once its entry is too old
    assert spark.read.parquet(f"{out}/base=2").count() == 4 and spark.read.parquet(f"{out}/base=4").count() == 2
    assert scoring.read_store(spark, out, "m", 41 * day).count() == 3 and scoring.read_store(spark, out, "m", 41 * day, cap=1).count() == 1
    scoring.sweep(spark, out)
    assert scoring.read_store(spark, out, "m", 41 * day).count() == 3
    assert [p.rsplit("/", 1)[1] for p in scoring._parts(spark, out, 5)] == ["base=4"] and scoring._parts(spark, out, 3) == [f"{out}/base=2"]
