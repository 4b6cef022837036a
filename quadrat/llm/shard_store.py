"""A table of immutable Parquet shards with versioned manifests and size-tiered compaction (operator 2).

Arrivals are appended as small shards. Compaction sorts shards into tiers by
size (each tier ``FANOUT`` times the one below) and merges a tier with at least
``FANOUT`` shards into files of about the target size; shards of at least half
the target are left alone. Merging reads neighbouring shards in one task and
writes them again: nothing is shuffled.

A version is a folder with a manifest that lists its shards. The folder is
written beside its place and renamed into it. A folder with content is never
replaced by a rename, on local disks or HDFS: what comes second fails, or ends
up inside the first. So the writer reads the version back; if another's name is
in it, that one was first, and the writer tries again on top of it. Readers see
a whole version or none, and a job that dies leaves only files that no manifest
names. Object stores whose rename copies file by file give no such guarantee:
there, one writer at a time, or a committer that puts a folder in place at once. ``vacuum`` removes those when they
are older than an age in which every writer commits, and the shards of versions
that were replaced longer ago than that, so neither a writer that has not yet
committed nor a reader of an older version loses files.

The driver handles a manifest as one list: some 100 bytes a shard, so a table of
100 TB needs shards of a few hundred megabytes (``target_bytes``) to keep it at
tens of megabytes.

Results in odd cases: an empty arrival or table gives a version whose read is
empty; rows come back as they were, nulls and repeated rows included; an
arrival whose columns differ from the table's is refused.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_ROWS, TARGET_BYTES, FANOUT = 2000, 64 << 20, 4
SAFE_AGE = 7 * 24 * 3600.0  # seconds
ARRIVALS = 4


class Conflict(Exception):
    """Another writer has removed shards that this change needs."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, shard_rows: int = SHARD_ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.shard_rows = target_bytes, fanout, shard_rows
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("_manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifests"))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, writer, schema, shards: [{path, bytes}]}; version 0 is empty."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"_manifests/v{version:08d}/manifest.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, schema: str, added: list[dict], removed: set[str], tries: int = 100) -> dict:
        for _ in range(tries):
            old = self.manifest()
            names = {s["path"] for s in old["shards"]}
            if not removed <= names:
                raise Conflict(sorted(removed - names))
            if old["schema"] not in (None, schema):
                raise ValueError(f"the table's columns are {old['schema']}, not {schema}")
            name = uuid.uuid4().hex
            new = {"version": old["version"] + 1, "writer": name, "schema": schema, "shards": [s for s in old["shards"] if s["path"] not in removed] + added}
            draft, place = f"_manifests/draft-{name}", f"_manifests/v{new['version']:08d}"
            out = self._fs.create(self._path(f"{draft}/manifest.json"), False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            try:
                moved = not self._fs.exists(self._path(place)) and self._fs.rename(self._path(draft), self._path(place))
            except Exception:
                if not self._fs.exists(self._path(place)):
                    raise
                moved = False
            if moved and self.manifest(new["version"]).get("writer") == name:
                return new
            for left in (draft, f"{place}/draft-{name}"):
                self._fs.delete(self._path(left), True)
        raise Conflict(f"no version could be committed in {tries} tries")

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        run = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{run}")
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(run))]
        return [{"path": f"{run}/{name}", "bytes": size} for name, size in sorted(found) if name.endswith(".parquet")]

    def append(self, df: DataFrame) -> dict:
        """Add the rows as small shards; the new version's manifest."""
        known = self.manifest()["schema"]
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).json()
        if known not in (None, plain):
            raise ValueError(f"the table's columns are {known}, not {plain}")
        return self._commit(plain, self._write(df, self.shard_rows), set())

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType()
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in m["shards"]))

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fanout))

    def tiers(self) -> dict[int, list[dict]]:
        """Shards that can be merged, by tier."""
        out: dict[int, list[dict]] = {}
        for s in self.manifest()["shards"]:
            if s["bytes"] < self.target // 2:
                out.setdefault(self.tier(s["bytes"]), []).append(s)
        return out

    def compact(self) -> dict:
        """Merge tiers until none has enough shards that fewer files can hold."""
        done: set[int] = set()
        while ready := sorted((t, own) for t, own in self.tiers().items() if len(own) >= self.fanout and t not in done):
            tier, own = ready[0]
            files = max(1, round(sum(s["bytes"] for s in own) / self.target))
            done.add(tier)
            if files < len(own):
                schema = self.manifest()["schema"]
                rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*(f"{self.root}/{s['path']}" for s in own))
                self._commit(schema, self._write(rows.coalesce(files)), {s["path"] for s in own})
        return self.manifest()

    def vacuum(self, safe_age: float = SAFE_AGE) -> int:
        """Delete files older than safe_age seconds that belong to no version read within that time; how many."""
        oldest = time.time() - safe_age
        known = self.versions()
        ended = {v: self._fs.getFileStatus(self._path(f"_manifests/v{after:08d}/manifest.json")).getModificationTime() / 1000 for v, after in zip(known, known[1:], strict=False)}
        kept = {s["path"] for v in known if v == known[-1] or ended[v] > oldest for s in self.manifest(v)["shards"]}
        gone = 0
        if not self._fs.exists(self._path("data")):
            return 0
        for run in self._fs.listStatus(self._path("data")):
            name = f"data/{run.getPath().getName()}"
            for f in self._fs.listStatus(run.getPath()):
                path = f"{name}/{f.getPath().getName()}"
                if path.endswith(".parquet") and path not in kept and f.getModificationTime() / 1000 <= oldest:
                    gone += bool(self._fs.delete(f.getPath(), False))
        return gone


def arrive(store: ShardStore, df: DataFrame, arrivals: int = ARRIVALS) -> None:
    """Append all rows of df in several arrivals: each row belongs to one, by the hash of its columns."""
    part = F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in df.columns]), F.lit(arrivals))
    for n in range(arrivals):
        store.append(df.where(part == n))


def compacted(df: DataFrame, root: str, arrivals: int = ARRIVALS, **options) -> tuple[DataFrame, dict, dict]:
    """The rows after a round through a new store, which has no other writers or readers: appended in several arrivals
    of small shards, compacted, read by the last manifest. And the manifests before and after compaction."""
    store = ShardStore(df.sparkSession, root, **options)
    arrive(store, df, arrivals)
    before = store.manifest()
    after = store.compact()
    store.vacuum(safe_age=0.0)
    return store.read(), before, after


def facts(before: dict, after: dict, target: int = TARGET_BYTES) -> dict:
    """What a compaction has done: whether arrivals were committed one by one, shards became fewer, and none that was merged is over twice the target."""
    old = {s["path"] for s in before["shards"]}
    merged = [s for s in after["shards"] if s["path"] not in old]
    return {"arrivals": before["version"], "merges": after["version"] > before["version"], "fewer_shards": len(after["shards"]) < len(before["shards"]), "within_target": all(s["bytes"] <= 2 * target for s in merged)}


COMPACTED_SQL = f"SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, {ARRIVALS} AS arrivals, true AS merges, true AS fewer_shards, true AS within_target FROM documents"
