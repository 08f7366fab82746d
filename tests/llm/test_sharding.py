import pytest
from pyspark.sql import functions as F

from textmill.llm.sharding import Conflict, Lost, ShardStore, op7_sharding

from .conftest import ODD


def store(spark, tmp_path, **more):
    return ShardStore(spark, f"file://{tmp_path}/store", **more)


def folders(s):
    return [(x.getPath().getName(),) for x in s._fs.listStatus(s._path("")) if not x.getPath().getName().startswith("_")]


def test_writer_in_flight_survives_vacuum(spark, make_docs, tmp_path):
    a, b = store(spark, tmp_path, fan_in=2), store(spark, tmp_path, fan_in=2)
    a.append(make_docs(["one"]))
    a.append(make_docs(["two"]))
    folder, files = b._write_run(make_docs(["three"]), "a", b.manifest())  # b has written and not committed
    a.compact()
    a.vacuum(grace=0)
    old = b.manifest()
    new = [{"name": folder, "files": [f["file"] for f in files], "bytes": 1, "rows": [f["rows"] for f in files]}]
    b._commit(old, None, old["runs"] + new, new)
    b._done([folder])
    assert sorted(r.text for r in a.read().collect()) == ["one", "three", "two"]
    a.vacuum(grace=0)
    assert a.read().count() == 3


def test_writer_that_lost_its_files_cannot_commit(spark, make_docs, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.append(make_docs(["one"]))
    folder, files = b._write_run(make_docs(["two"]), "a", b.manifest())
    a.vacuum(grace=0, writer=0)  # its time is over
    with pytest.raises(Lost):
        b._commit(b.manifest(), None, [], [{"files": [f["file"] for f in files]}])
    assert a.read().count() == 1


def test_two_that_append_and_compact_lose_nothing(spark, make_docs, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    a, b = store(spark, tmp_path, fan_in=2), store(spark, tmp_path, fan_in=2)
    a.append(make_docs([(0, "start")]))
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(s.append, make_docs([(i, f"text {i}")])) for i, s in enumerate((a, b, a, b, b), 1)] + [pool.submit(a.compact), pool.submit(b.compact)]
        for j in jobs:
            j.result()
    a.compact()
    assert sorted(r.doc_id for r in b.read().collect()) == list(range(6))


def test_query(spark, make_docs, tmp_path):
    rows = [(i, t) for i, t in enumerate([*ODD, "long text " * 300_000])] + [(3, None), (3, None), (None, "x")]
    make_docs(rows, more=True).write.parquet(f"{tmp_path}/d/documents.parquet")
    got = op7_sharding(spark, f"{tmp_path}/d").collect()
    assert len(got) == len(rows) and {(r.shard_agrees, r.manifest_rows, r.merges_due) for r in got} == {(True, len(rows), 0)}
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t in rows)
    make_docs([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op7_sharding(spark, f"{tmp_path}/e").count() == 0


def test_compaction_keeps_rows_and_sizes(spark, make_docs, tmp_path):
    rows = [(i, None if i % 17 == 0 else f"text {i} " * (i % 50)) for i in range(3000)]
    docs = make_docs(rows + rows[:100], more=True)
    s = store(spark, tmp_path, target_bytes=40_000)
    for k in range(3):
        s.append(docs.filter(F.col("doc_id") % 3 == k), shard_rows=100)
    before = s.manifest()
    assert before["version"] == 3 and len(before["runs"]) >= 30
    after = s.compact()
    assert len(after["runs"]) < len(before["runs"]) / 3 and after["version"] > 3
    assert not s.merges(after["runs"])
    merged = [r for r in after["runs"] if r["name"].startswith("m")]
    assert merged and all(r["bytes"] <= 3 * s.target for r in merged)
    assert s.read().exceptAll(docs).count() == 0 and docs.exceptAll(s.read()).count() == 0
    assert s.read().dtypes == docs.dtypes
    named = {f for r in after["runs"] for f in r["files"]}
    assert len(named) == sum(len(r["files"]) for r in after["runs"])
    assert sum(sum(r["rows"]) for r in after["runs"]) == len(rows) + 100
    assert s.read(before["version"]).count() == len(rows) + 100  # readers of the old version are not disturbed
    s.vacuum()
    assert s.read(before["version"]).count() == len(rows) + 100 and len(s.versions()) == after["version"]
    s.vacuum(grace=0)
    assert s.versions() == [after["version"]] and s.read().count() == len(rows) + 100
    assert not {x[0] for x in folders(s)} - {f.split("/")[0] for f in named}


def test_one_writer_wins(spark, make_docs, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.append(make_docs(["one"]))
    old = b.manifest()
    a.append(make_docs(["two"]))
    with pytest.raises(Conflict):
        b._commit(old, None, [])
    assert a.read().count() == 2 and a.read(1).count() == 1


def test_dead_files_are_ignored_and_removed(spark, make_docs, tmp_path):
    s = store(spark, tmp_path)
    s.append(make_docs(["one", "two"]))
    make_docs(["lost"]).write.parquet(f"{s.root}/a000009-dead")
    assert s.read().count() == 2
    s.vacuum()
    assert s._fs.exists(s._path("a000009-dead"))  # it may be of a writer in flight
    s.vacuum(grace=0)
    assert s.read().count() == 2 and not s._fs.exists(s._path("a000009-dead"))


def test_empty(spark, make_docs, tmp_path):
    s = store(spark, tmp_path)
    assert s.manifest()["version"] == 0
    s.append(make_docs([]))
    s.compact()
    assert s.read().count() == 0 and s.read().columns == make_docs([]).columns
