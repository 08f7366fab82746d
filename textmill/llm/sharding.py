"""Sharding: size-tiered compaction under versioned manifests.

Arrivals are appended as small immutable shards, each a run of its own. Runs of similar size (within half to one and a half
times their mean) form a tier; a tier of `FAN_IN` runs or more is merged, up to `MOST` runs or one target size at a time,
into files of the target size. A run of the target size is sealed, so a row is rewritten about log(target / arrival) times.

A manifest lists the runs that count, with the rows of each file. It is written aside and renamed to its version number
without overwriting: of two writers one wins, and the other starts again from the new version. Readers see the old or the
new version. A job that dies leaves files that no manifest names.

Only `vacuum` deletes, and nothing calls it by itself. It keeps every version that was the last one less than `GRACE`
seconds ago, so a reader has that long; files that no kept version names go once they are older than that, unless their
writer has announced them: a writer leaves an intent before it writes its first file and takes it back after the commit.
An intent counts for `WRITER` seconds. A writer slower than that may lose files, and then its commit fails: a version never
names a file that isn't there at its commit. Merging reads whole files and writes whole files, without a shuffle and without
Python on the rows.

Defined results: all columns and rows, nulls and repeated ones too, stay as they are; an empty append makes no run but a
version; what a text holds plays no part.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

SHARD_ROWS, TARGET_BYTES, FAN_IN, MOST, JOBS = 1000, 64 << 20, 4, 32, 4
#: Seconds for which a reader may use an old version, and in which a writer must commit.
GRACE, WRITER = 86_400, 7 * 86_400
RESERVED = ("_manifests", "_intents")


class Conflict(Exception):
    """Another writer has committed this version first."""


class Lost(Exception):
    """Files of this writer were removed before it committed."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, most: int = MOST):
        self.spark, self.root, self.target, self.fan_in, self.most = spark, root.rstrip("/"), target_bytes, fan_in, most
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in RESERVED:
            self._fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        return sorted((f"{folder}/{s.getPath().getName()}", s.getLen()) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet"))

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(self._path("_manifests")) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, runs: [{name, files, bytes}]}; of the last version unless one is named."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"_manifests/v{version or have[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: str) -> None:
        out = self._fs.create(self._path(name), False)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()

    def _commit(self, old: dict, schema: str | None, runs: list[dict], new: list[dict] = ()) -> dict:
        """A version after `old` with these runs; `new` are those whose files this writer has made."""
        for r in new:
            for f in r["files"]:
                if not self._fs.exists(self._path(f)):
                    raise Lost(f)
        made = {"version": old["version"] + 1, "schema": schema or old["schema"], "runs": runs}
        name = f"_manifests/.{made['version']}-{self._unique()}"
        self._write(name, json.dumps(made))
        aside, to = self._path(name), self._path(f"_manifests/v{made['version']:012d}.json")
        try:
            context = self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(aside, to, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(to):
                raise Conflict(f"version {made['version']}") from e
            raise
        return made

    def _unique(self) -> str:
        return str(self.spark._jvm.java.util.UUID.randomUUID())

    def _write_run(self, rows: DataFrame, kind: str, at: dict, **options) -> tuple[str, list[dict]]:
        """Announce a folder, write rows into it, and tell its files: name, bytes, rows."""
        folder = f"{kind}{at['version'] + 1:06d}-{self._unique()}"
        self._write(f"_intents/{folder}", "")
        rows.write.options(compression="zstd", **options).parquet(f"{self.root}/{folder}")
        counted = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}").groupBy("_metadata.file_name").count().collect()  # a row for each file
        have = {r[0]: r[1] for r in counted}
        return folder, [{"file": f, "bytes": n, "rows": have.get(f.split("/")[1], 0)} for f, n in self._files(folder)]

    def _done(self, folders: list[str]) -> None:
        for folder in folders:
            self._fs.delete(self._path(f"_intents/{folder}"), False)

    def append(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> dict:
        """Write rows as small shards, each one run, and commit a version that has them, however many others commit meanwhile."""
        folder, files = self._write_run(rows, "a", self.manifest(), maxRecordsPerFile=shard_rows)
        new = [{"name": f"{folder}/{i:06d}", "files": [f["file"]], "bytes": f["bytes"], "rows": [f["rows"]]} for i, f in enumerate(files) if f["rows"]]
        while True:
            old = self.manifest()
            try:
                got = self._commit(old, rows.schema.json(), old["runs"] + new, new)
                break
            except Conflict:
                continue
        self._done([folder])
        return got

    def merges(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized runs that are due: each of fan_in runs at least, or enough for a whole target."""
        tiers: list[list[dict]] = []
        for run in sorted((r for r in runs if r["bytes"] < self.target), key=lambda r: (r["bytes"], r["name"])):
            if tiers and run["bytes"] <= 1.5 * sum(r["bytes"] for r in tiers[-1]) / len(tiers[-1]):
                tiers[-1].append(run)
            else:
                tiers.append([run])
        out = []
        for tier in tiers:
            group: list[dict] = []
            for run in sorted(tier, key=lambda r: r["name"]):
                group.append(run)
                if len(group) >= self.most or len(group) > 1 and sum(r["bytes"] for r in group) >= self.target:
                    out.append(group)
                    group = []
            if len(group) >= self.fan_in:
                out.append(group)
        return out

    def compact(self) -> dict:
        """Merge tier by tier until none is due; every pass commits a version. Old files stay for `vacuum`."""
        at = self.manifest()
        while groups := self.merges(at["runs"]):

            def merge(group: list[dict]) -> tuple[str, dict]:
                n = max(1, -(-sum(r["bytes"] for r in group) // self.target))
                folder, files = self._write_run(self._read(at, group).coalesce(n), "m", at)
                return folder, {"name": folder, "files": [f["file"] for f in files], "bytes": sum(f["bytes"] for f in files), "rows": [f["rows"] for f in files]}

            with ThreadPoolExecutor(JOBS) as pool:  # a few merges at once; each is a Spark job of its own
                made = list(pool.map(merge, groups))
            while True:
                # a merge counts if all it has read still does; another writer may have merged some of it
                names = {r["name"] for r in at["runs"]}
                whole = [(g, run) for g, (_, run) in zip(groups, made) if all(r["name"] in names for r in g)]
                gone = {r["name"] for g, _ in whole for r in g}
                merged = [run for _, run in whole]
                if not merged:
                    break
                try:
                    at = self._commit(at, None, [r for r in at["runs"] if r["name"] not in gone] + merged, merged)
                    break
                except Conflict:
                    at = self.manifest()
            self._done([folder for folder, _ in made])
        return at

    def vacuum(self, keep: int = 1, grace: float = GRACE, writer: float = WRITER) -> None:
        """Delete versions that haven't been the last one for `grace` seconds (but for the last `keep`), and files that no
        kept version and no writer's intent of the last `writer` seconds names, if they are older than `grace` seconds."""
        now = time.time()
        age = lambda status: now - status.getModificationTime() / 1000
        intents = {s.getPath().getName(): age(s) for s in self._fs.listStatus(self._path("_intents"))}
        # before the versions: what a writer commits from here on is younger than grace or announced
        folders = [(s.getPath().getName(), age(s)) for s in self._fs.listStatus(self._path(""))]
        have = self.versions()
        ages = {v: age(self._fs.getFileStatus(self._path(f"_manifests/v{v:012d}.json"))) for v in have}
        kept = [v for i, v in enumerate(have) if i >= len(have) - max(1, keep) or ages[have[i + 1]] < grace]
        named = {f.split("/")[0] for v in kept for r in self.manifest(v)["runs"] for f in r["files"]}
        for v in have:
            if v not in kept:
                self._fs.delete(self._path(f"_manifests/v{v:012d}.json"), False)
        for folder, old in folders:
            if folder not in RESERVED and folder not in named and old >= grace and intents.get(folder, writer) >= writer:
                self._fs.delete(self._path(folder), True)
        for folder, old in intents.items():
            if old >= writer:
                self._done([folder])

    def _read(self, manifest: dict, runs: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        files = [f"{self.root}/{f}" for r in runs for f in r["files"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m, m["runs"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended and compacted, then read back through the last manifest.

    doc_id, n_bytes, text_sha256 of each row, and what its shard says: shard_agrees (the shard holds as many rows as the
    manifest tells), manifest_rows (rows of all shards by the manifest), merges_due (tiers that compaction has left: 0).
    """
    store = ShardStore(spark, Scratch(spark, "shards").root)
    store.append(read_table(spark, sf_dir, "documents"))
    at = store.compact()
    told = [(f, n) for r in at["runs"] for f, n in zip(r["files"], r["rows"])]
    shards = spark.createDataFrame(told, "shard string, told long")  # a row for each file of the target size
    name = F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1).alias("shard")
    counted = store.read().groupBy(name).agg(F.count("*").alias("held"))
    agrees = shards.join(counted, "shard", "full").select("shard", F.equal_null("told", "held").alias("shard_agrees"))
    text = F.coalesce("text", F.lit(""))
    rows = store.read().select("doc_id", F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), name)
    return rows.join(agrees, "shard").select(
        "doc_id", "n_bytes", "text_sha256", "shard_agrees", F.lit(sum(n for _, n in told)).cast("long").alias("manifest_rows"), F.lit(len(store.merges(at["runs"]))).cast("long").alias("merges_due")
    )


OP7_SQL = """SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256,
  true AS shard_agrees, count(*) OVER () AS manifest_rows, 0::BIGINT AS merges_due FROM documents"""
