"""Tables as versioned Parquet: whole snapshots, or buckets by key of which a version rewrites only those it changes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import apply_merge


class Tables:
    """Named tables below one folder, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, name: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str, schema: str) -> DataFrame:
        """The latest version; an empty table if there is none."""
        versions = self._pointers(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/data/{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> str:
        """Write a new version.  Readers see it only once all of it is there; older versions stay as backups."""
        version = f"{len(self._pointers(name)):08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/data/{version}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/versions/{version}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path).close()
        return version

    def versions(self, name: str) -> list[str]:
        return self._pointers(name)

    def upsert(self, name: str, schema: str, rows: DataFrame, key: str) -> str:
        """A version in which ``rows``, one a key, stand in place of those that had their keys."""
        return self.write(name, apply_merge(self.read(name, schema), rows, key))


class Buckets:
    """Named tables below one folder, each in ``count`` buckets by a hash of its key.

    A version's file names for each bucket the folder that holds it, so a change writes the buckets it touches and a file of ``count`` lines; readers
    see all of it or nothing.  What no kept version names is deleted by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, count: int = 64):
        self.spark, self.root, self.count = spark, root.rstrip("/"), count

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, name: str) -> list[str]:
        fs, path = self._path(name, "versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _folders(self, name: str, version: str) -> dict[int, str]:
        lines = self.spark.read.text(f"{self.root}/{name}/versions/{version}").collect()  # a line a bucket
        return {int(b): folder for b, folder in (json.loads(r.value) for r in lines if r.value)}

    def current(self, name: str) -> dict[int, str]:
        """Bucket to folder, as the latest version has them."""
        versions = self.versions(name)
        return self._folders(name, versions[-1]) if versions else {}

    def read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The latest version, or some buckets of it; an empty table if there is none."""
        folders = [f"{self.root}/{name}/data/{v}/bucket={b}" for b, v in sorted(self.current(name).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.count)).cast("int")

    def _commit(self, name: str, key: str, schema: str, touched: list[int], rows: DataFrame) -> str:
        last = self.versions(name)[-1:]
        version = f"{int(last[0].split('-')[0]) + 1 if last else 0:08d}-{uuid.uuid4().hex[:8]}"
        columns = self.spark.createDataFrame([], schema).columns
        rows = rows.select(*columns).withColumn("bucket", self._bucket(key)).repartition("bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{name}/data/{version}")
        fs, path = self._path(name, "data", version)
        made = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}
        now = {b: v for b, v in self.current(name).items() if b not in touched} | {b: version for b in made}
        fs, path = self._path(name, "versions", version)
        out = fs.create(path)
        out.writeBytes("".join(json.dumps([b, v]) + "\n" for b, v in sorted(now.items())))
        out.close()
        return version

    def _touched(self, rows: DataFrame, key: str) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(key)).distinct().collect()]  # ``count`` at most

    def upsert(self, name: str, schema: str, rows: DataFrame, key: str) -> str:
        """A version in which ``rows``, one a key, stand in place of those that had their keys.  Reads and writes the buckets of their keys."""
        touched = self._touched(rows, key)
        return self._commit(name, key, schema, touched, apply_merge(self.read(name, schema, touched), rows, key))

    def remove(self, name: str, schema: str, keys: DataFrame, key: str) -> str:
        """A version without the rows of ``keys``."""
        touched = self._touched(keys, key)
        return self._commit(name, key, schema, touched, self.read(name, schema, touched).join(keys.select(key), key, "left_anti"))

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` versions and the folders of buckets that none of these names; says how many folders went."""
        versions = self.versions(name)
        named = {(v, b) for x in versions[-keep:] for b, v in self._folders(name, x).items()}
        gone = 0
        for old in versions[:-keep]:
            fs, path = self._path(name, "versions", old)
            fs.delete(path, False)
        fs, path = self._path(name, "data")
        for v in [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []:
            for b in [s.getPath() for s in fs.listStatus(v) if s.getPath().getName().startswith("bucket=")]:
                if (v.getName(), int(b.getName().split("=")[1])) not in named:
                    fs.delete(b, True)
                    gone += 1
        return gone
