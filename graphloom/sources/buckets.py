"""A table in hash buckets, of which an upsert rewrites only those that it touches.

Files of a bucket are never changed. A manifest, one small JSON file for each version, names the folder of every bucket;
a commit writes the touched buckets to new folders and then creates the next manifest, which is the atomic switch: of two
writers that build on one version the second finds the manifest there and fails. Readers keep the version they opened.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.incremental import upsert


class Conflict(Exception):
    """Another writer has committed the version that this one was about to make."""


class BucketTable:
    """Rows with unique ``keys`` under ``root``, a path that all executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = self.manifest()
        if held is not None and held["keys"] != self.keys:
            raise ValueError(f"the table's keys are {held['keys']}")
        self.buckets = held["buckets"] if held else buckets

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, the last one by default; None for a table without versions."""
        known = self.versions()
        if version is None and not known or version is not None and version not in known:
            return None
        stream = self._files.open(self._path(self._name(known[-1] if version is None else version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Creates the manifest, or fails if it is there. It is written under another name and renamed, so none is ever half there."""
        name = self._path(self._name(manifest["version"]))
        part = self._path(f"{self.root}/manifests/.{manifest['version']}-{manifest['token']}")
        stream = self._files.create(part, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._files.exists(name) or not self._files.rename(part, name):
            self._files.delete(part, False)
            raise Conflict(f"version {manifest['version']} exists")

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """All rows of a version; with ``only`` those of some buckets."""
        held = self.manifest(version)
        if held is None:
            raise ValueError("no such version")
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.root}/{p}" for b, p in held["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def find(self, keys: DataFrame) -> DataFrame:
        """Rows with one of ``keys``, read from their buckets only."""
        wanted = self._typed(keys.select(*self.keys)).distinct()
        return self.read(only=self._touched(wanted)).join(wanted, self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # as many as there are buckets at most

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Keys in the types of the table, which their buckets depend on."""
        held = self.manifest()
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(held["schema"])} if held and held["schema"] else {}
        return rows.withColumns({k: F.col(k).cast(kinds[k]) for k in self.keys if k in kinds})

    def _usable(self, rows: DataFrame) -> DataFrame:
        rows = self._typed(rows)
        for k in self.keys:
            rows = rows.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
        return rows

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> int:
        """Rows of the batch in place of those with equal keys; returns the version.

        Rows with a null or empty key are left out; of rows with one key the last in the order of their other columns
        counts. New columns are null in older rows. A batch whose ``batch_id`` is not after the last one's has been
        applied already and changes nothing, so a stream may run it again.
        """
        return self._apply(self._usable(batch), batch_id, lambda old, new: upsert(old, new, self.keys))

    def delete(self, keys: DataFrame, batch_id: int | None = None) -> int:
        """Takes away the rows with one of ``keys``."""
        wanted = self._usable(keys.select(*self.keys)).distinct()
        return self._apply(wanted, batch_id, lambda old, gone: old.join(gone, self.keys, "left_anti"), grows=False)

    def _apply(self, rows: DataFrame, batch_id: int | None, change, grows: bool = True) -> int:
        import uuid

        held = self.manifest() or {"version": -1, "keys": self.keys, "buckets": self.buckets, "folders": {}, "schema": None, "batch": None}
        if batch_id is not None and held["batch"] is not None and batch_id <= held["batch"]:
            return held["version"]
        touched = self._touched(rows)
        token, version = uuid.uuid4().hex, held["version"] + 1
        schema = T.StructType.fromJson(held["schema"]) if held["schema"] else rows.schema
        if touched:
            known = {b for b in touched if str(b) in held["folders"]}
            old = self.read(only=known) if known else self.spark.createDataFrame([], schema)
            if grows:
                for f in rows.schema:
                    if f.name not in old.columns:
                        old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
            new = change(old, rows)
            schema = new.schema if grows else schema
            folder = f"data/{version:012d}-{token}"
            # Keys are unique, so buckets are even; each is written by one task.
            new.withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            made = {int(s.getPath().getName().split("=")[1]) for s in self._files.listStatus(self._path(f"{self.root}/{folder}")) if "=" in s.getPath().getName()}
            folders = {b: p for b, p in held["folders"].items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in made}
        else:
            folders = held["folders"]
        fields = [T.StructField(f.name, f.dataType, True) for f in schema]
        self._commit({**held, "version": version, "token": token, "folders": folders, "schema": T.StructType(fields).jsonValue(), "batch": batch_id if batch_id is not None else held["batch"]})
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` versions names, and older manifests; returns how many folders went.

        Meant for when no writer is at work, as it also deletes what a failed one has left.
        """
        known = self.versions()
        held = {p for v in known[-keep:] for p in self.manifest(v)["folders"].values()}
        gone, data = 0, self._path(f"{self.root}/data")
        for commit in self._files.listStatus(data) if self._files.exists(data) else []:
            for bucket in self._files.listStatus(commit.getPath()):
                name = f"data/{commit.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in held:
                    gone += bool(self._files.delete(bucket.getPath(), True))
        for v in known[:-keep]:
            self._files.delete(self._path(self._name(v)), False)
        return gone
