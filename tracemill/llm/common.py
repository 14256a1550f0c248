"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as bytes: a run of anything but ASCII white space (bytes.split() cuts at the same six bytes).
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where Spark runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tracemill.own.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tracemill.own.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, when nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], mb: int = 16, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batches that Spark hands to a Python worker, cut smaller: texts take several times their size while they are worked on."""
    for b in batches:
        step = max(1, min(rows, (mb << 20) * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def readable(col: str) -> F.Column:
    """A column as text that Python can read: bytes that are no UTF-8, as crawled files hold them, become replacement characters."""
    return F.make_valid_utf8(F.col(col).cast("string"))


def text_hash(col: str = "text"):
    """Tells apart rows that repeat an id; null texts hash to the seed."""
    return F.xxhash64(F.col(col))


def unit_interval(*cols) -> F.Column:
    """A uniform number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(F.lit("tracemill"), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
