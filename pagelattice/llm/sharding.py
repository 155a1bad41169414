"""Size-tiered compaction of immutable shards under a versioned manifest (operator 8), in DataFrame functions.

Arrivals are appended as runs of small Parquet files that are never changed.  Files of
similar size make a tier; a tier with enough files is merged into files of the target
size by joining whole input splits in a task, without a shuffle.  The state is a manifest: a version's
file says which data files it adds and which it drops, and every ``WHOLE_EVERY``-th lists all, so a commit writes
what changed and a reader goes back a few files.  A version is written under a name of its own and
then gets its final name without replacing one: by a hard link on local disks, else by the file system's
rename that refuses an existing name (atomic on HDFS and its like; an object store needs a
committer that writes on condition).  A writer that finds the name taken has lost the race, reads
the new version and applies its change to that.

Readers of an old version keep their files until ``vacuum``, which deletes what the last version doesn't list.  A run
that isn't committed yet has a marker; vacuum leaves its files until the marker is a day old.

Defined results: appending an empty table writes a version with no new rows; nulls,
repeated rows, empty and very long texts are carried as they are; columns are those
of the first append, whatever their names, and later appends must have them with the same types (others are refused);
a store without versions reads as no rows and no columns.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 64 << 20
#: Files of a tier are within this factor of each other; a tier of so many files is merged.
TIER_FACTOR, MIN_FILES = 4, 4
#: Versions between two that list all files, and the seconds after which a run that was never committed is taken for abandoned.
WHOLE_EVERY, ABANDONED = 10, 86_400


class Conflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._no_names = spark._sc._gateway.new_array(jvm.java.lang.String, 0)

    # -- manifest -----------------------------------------------------------------------------------------
    def _list(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(folder)
        for last in (False, False, False, False, True):
            out = []
            try:
                if self._fs.exists(path):
                    found = self._fs.listFiles(path, True)
                    while found.hasNext():
                        one = found.next()
                        out.append((one.getPath().toString(), one.getLen()))
                break
            except Py4JJavaError:  # another writer deleted a file meanwhile
                if last:
                    raise
        return sorted(out)

    def version(self) -> int:
        """The last committed version, 0 before any."""
        names = [p.rsplit("/", 1)[1] for p, _ in self._list(f"{self.root}/manifest")]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """{"schema": ..., "files": [{"path", "bytes"}]} of a version."""
        version = self.version() if version is None else version
        newer: list[dict] = []
        while version:
            newer.append(self._load(version))
            if "files" in newer[-1]:
                break
            version -= 1
        files: dict[str, dict] = {}
        for one in reversed(newer):
            files |= {f["path"]: f for f in one.get("files", one.get("add", []))}
            for path in one.get("drop", []):
                del files[path]
        return {"schema": newer[0]["schema"] if newer else None, "files": list(files.values())}

    def _claim(self, own, final) -> bool:
        """Gives a finished file its final name, unless that is taken."""
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":
                to = [jvm.java.nio.file.Path.of(self._path.getPathWithoutSchemeAndAuthority(p).toString(), self._no_names) for p in (final, own)]
                jvm.java.nio.file.Files.createLink(*to)
                self._fs.delete(own, False)
            else:
                option = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(own, final, option)
        except Py4JJavaError:
            if not self._fs.exists(final):
                raise
            return False
        return True

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _commit(self, base: int, schema: dict | None, add: list[dict], drop: list[str]) -> int:
        """Writes the version after base; Conflict if another writer has."""
        version = base + 1
        change: dict = {"schema": schema, "add": add, "drop": drop}
        if version % WHOLE_EVERY == 1:
            gone = set(drop)
            change = {"schema": schema, "files": [f for f in self.manifest(base)["files"] if f["path"] not in gone] + add}
        own, final = (self._path(f"{self.root}/{n}") for n in (f"staging/{uuid.uuid4().hex}", f"manifest/v{version:08d}.json"))
        self._fs.mkdirs(final.getParent())
        self._write(own, json.dumps(change))
        if not self._claim(own, final):
            self._fs.delete(own, False)
            raise Conflict(f"version {version} is committed")
        return version

    def _append(self, schema: T.StructType, files: list[dict]) -> int:
        while True:
            base = self.version()
            known = self._load(base)["schema"] if base else None
            self._check(known, schema)
            try:
                return self._commit(base, known or json.loads(schema.json()), files, [])
            except Conflict:
                continue

    # -- writing ------------------------------------------------------------------------------------------
    def _run(self, df: DataFrame, by: str | None = None) -> tuple[str, list[dict]]:
        """Writes df as a run of new files, marked as pending: the run and its files."""
        run = uuid.uuid4().hex
        self._write(self._path(f"{self.root}/pending/{run}"), "")
        folder = f"{self.root}/data/{run}"
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        return run, [{"path": p, "bytes": n} for p, n in self._list(folder) if p.endswith(".parquet")]

    def _done(self, run: str) -> None:
        self._fs.delete(self._path(f"{self.root}/pending/{run}"), False)

    def _check(self, known: dict | None, schema: T.StructType) -> None:
        kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
        if known is not None and kinds(T.StructType.fromJson(known)) != kinds(schema):
            raise ValueError("the columns or their types differ from the store's")

    def append(self, df: DataFrame) -> int:
        """Commits df's rows as small shards; the new version."""
        self._check(self.manifest()["schema"], df.schema)
        run, files = self._run(df)
        version = self._append(df.schema, files)
        self._done(run)
        return version

    def append_each(self, df: DataFrame, arrival: Column) -> list[int]:
        """Appends the rows of every value of arrival as an arrival of its own; one job, a version each."""
        self._check(self.manifest()["schema"], df.schema)
        name, taken = "arrival", {c.lower() for c in df.columns}
        while name in taken:
            name += "_"
        run, files = self._run(df.withColumn(name, arrival), name)
        runs: dict[str, list[dict]] = {}
        for f in files:
            runs.setdefault(f["path"].rsplit("/", 2)[1], []).append(f)
        versions = [self._append(df.schema, runs[k]) for k in sorted(runs)] or [self._append(df.schema, [])]
        self._done(run)
        return versions

    # -- compaction ---------------------------------------------------------------------------------------
    def plan(self) -> list[list[dict]]:
        """Tiers worth merging: files below the target within TIER_FACTOR of the tier's least, MIN_FILES or more."""
        small = sorted((f for f in self.manifest()["files"] if f["bytes"] < self.target / 2), key=lambda f: f["bytes"])
        tiers: list[list[dict]] = []
        for f in small:
            if not tiers or f["bytes"] > TIER_FACTOR * max(1, tiers[-1][0]["bytes"]):
                tiers.append([])
            tiers[-1].append(f)
        return [t for t in tiers if len(t) >= MIN_FILES]

    def compact(self) -> int:
        """Merges every tier of the plan once and commits; the version afterwards."""
        for tier in self.plan():
            gone = {f["path"] for f in tier}
            n = max(1, math.ceil(sum(f["bytes"] for f in tier) / self.target))
            schema = self.manifest()["schema"]
            run, files = self._run(self._read(sorted(gone), schema).coalesce(n))
            while True:
                base = self.version()
                if not gone <= {f["path"] for f in self.manifest(base)["files"]}:
                    raise ValueError("a merged file is no longer in the store")
                try:
                    self._commit(base, schema, files, sorted(gone))
                    break
                except Conflict:
                    continue
            self._done(run)
        return self.version()

    def vacuum(self, abandoned: float = ABANDONED) -> int:
        """Deletes files that the last version doesn't list and no run still writes; how many.

        Data files are listed first, then the markers, then the version: a file whose marker is gone by then is committed.
        """
        found = [p for p, _ in self._list(f"{self.root}/data") if p.endswith(".parquet")]
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        markers = [self._path(p) for p, _ in self._list(f"{self.root}/pending")]
        pending = {m.getName() for m in markers if now - self._fs.getFileStatus(m).getModificationTime() < 1000 * abandoned}
        live = {f["path"] for f in self.manifest()["files"]}
        start = len(f"{self._fs.makeQualified(self._path(self.root + '/data'))}/")
        dead = [p for p in found if p not in live and p[start:].split("/", 1)[0] not in pending]
        for p in dead:
            self._fs.delete(self._path(p), False)
        return len(dead)

    # -- reading ------------------------------------------------------------------------------------------
    def _read(self, paths: list[str], schema: dict) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        return self._read([f["path"] for f in m["files"]], m["schema"] or json.loads(T.StructType([]).json()))


def arrivals(n: int = 4) -> Column:
    """An arrival number by a hash of the row's doc_id: n deliveries that together hold every row."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(n))
