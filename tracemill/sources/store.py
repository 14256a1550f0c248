"""A store of session tables that is rewritten in part: immutable buckets of sessions, and a manifest that says which of them count."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new store. A change rewrites whole buckets: take more of them for larger stores. So many folders Spark still lists without a job.
BUCKETS = 32
#: Tables that a commit writes at a time.
WRITERS = 4
MANIFEST = "table string, bucket int, version int, buckets int, schema string"


def bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key, by the first 32 bits of its MD5; null keys are those of the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


class Store:
    """Tables below a folder, keyed by session, in buckets.

    A commit writes the buckets that change to a folder of its own version and
    then a manifest, which names the version of every bucket of every table. It
    counts once it is complete, so that a broken commit changes nothing, and
    readers keep what they began with. Versions that no manifest of the last ones
    names can go (vacuum). One writer at a time: a second one finds the
    version's folder taken and fails.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int = BUCKETS):
        """keys: of each table the column that says the bucket."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.versions = sorted(int(n[1:]) for n in _names(spark, f"{self.path}/manifest") if n.startswith("v") and n[1:].isdigit() and "_SUCCESS" in _names(spark, f"{self.path}/manifest/{n}"))
        rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{self.versions[-1]}").collect() if self.versions else []
        self.schemas = {r["table"]: StructType.fromJson(json.loads(r["schema"])) for r in rows if r["bucket"] < 0}
        self.held: dict[str, dict[int, int]] = {t: {r["bucket"]: r["version"] for r in rows if r["table"] == t and r["bucket"] >= 0} for t in self.schemas}
        self.buckets = next((r["buckets"] for r in rows), buckets)

    @property
    def empty(self) -> bool:
        return not self.versions

    def read(self, table: str, only: list[int] | None = None) -> DataFrame | None:
        """A table, or what its named buckets hold; None if the store has no such table. Only their files are read."""
        if table not in self.schemas:
            return None
        held = {b: v for b, v in self.held[table].items() if only is None or b in set(only)}
        if not held:
            return self.spark.createDataFrame([], self.schemas[table])
        root = f"{self.path}/{table}"
        whole = {v for v in held.values() if only is None and {b for b, w in held.items() if w == v} >= self._written(table, v)}
        paths = [f"{root}/v={v}" for v in sorted(whole)] + [f"{root}/v={v}/bucket={b}" for b, v in sorted(held.items()) if v not in whole]
        return self.spark.read.schema(self.schemas[table]).option("recursiveFileLookup", True).parquet(*paths)  # folders are no columns

    def _written(self, table: str, version: int) -> set[int]:
        return {int(n.split("=")[1]) for n in _names(self.spark, f"{self.path}/{table}/v={version}") if n.startswith("bucket=")}

    def touched(self, keys: DataFrame, column: str = "session_id") -> list[int]:
        """The buckets of keys; at most as many numbers as there are buckets pass the driver."""
        return sorted(r[0] for r in keys.select(bucket(F.col(column), self.buckets)).distinct().collect())

    def commit(self, tables: dict[str, DataFrame], touched: list[int] | None = None) -> int:
        """Write tables, which hold all rows of the touched buckets (None: of all); the other buckets stay as they are.

        Rows are dealt by bucket; Spark splits a bucket that is too large for one
        task, since one session may hold most rows.
        """
        version = (self.versions or [0])[-1] + 1

        def write(name: str) -> None:
            dealt = tables[name].withColumn("bucket", bucket(F.col(self.keys[name]), self.buckets)).hint("rebalance", "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/v={version}")  # a commit that was broken off may have left a part

        with ThreadPoolExecutor(WRITERS) as pool:  # tables are jobs of their own: the small ones fill what the large ones leave idle
            list(pool.map(inheritable_thread_target(self.spark)(write), tables))
        for name, df in tables.items():
            self.schemas[name] = df.schema
            stay = {} if touched is None else {b: v for b, v in self.held.get(name, {}).items() if b not in set(touched)}
            self.held[name] = stay | {b: version for b in self._written(name, version)}
        rows = [(t, -1, version, self.buckets, json.dumps(s.jsonValue())) for t, s in self.schemas.items()] + [(t, b, v, self.buckets, None) for t, held in self.held.items() for b, v in held.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error" if version in self.versions else "overwrite").parquet(f"{self.path}/manifest/v{version}")
        self.versions.append(version)
        return version

    def rewritten(self) -> DataFrame:
        """Of each table: buckets that hold rows, and how many of them the last commit wrote and left alone."""
        last = (self.versions or [0])[-1]
        rows = [(t, len(h), sum(v == last for v in h.values()), sum(v != last for v in h.values())) for t, h in sorted(self.held.items())]
        return self.spark.createDataFrame(rows, "table string, buckets int, rewritten int, kept int")

    def files(self) -> dict[str, list[str]]:
        """The data files of each table that count now."""
        return {t: sorted(self.read(t).inputFiles()) for t in self.schemas}

    def vacuum(self, keep: int = 1) -> int:
        """Delete the buckets that none of the last keep manifests names, and older manifests; how many folders went."""
        keep_versions = self.versions[-keep:]
        rows = self.spark.read.schema(MANIFEST).parquet(*(f"{self.path}/manifest/v{v}" for v in keep_versions)).where("bucket >= 0").select("table", "bucket", "version").distinct().collect()
        named, gone = {(r["table"], r["version"], r["bucket"]) for r in rows}, 0
        doomed = [f"{self.path}/{t}/{v}/bucket={b}" for t in self.schemas for v in _names(self.spark, f"{self.path}/{t}") if v.startswith("v=") for b in self._written(t, int(v[2:])) if (t, int(v[2:]), b) not in named]
        doomed += [f"{self.path}/manifest/v{v}" for v in self.versions if v not in keep_versions]
        for path in doomed:
            fs, at = _fs(self.spark, path)
            gone += fs.delete(at, True)
        self.versions = keep_versions
        return gone
