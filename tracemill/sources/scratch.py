"""Places in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "tracemill.own.checkpoint.dir"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in spark.checkpoint.dir; in a folder of our own only where Spark runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(OWN, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(OWN, named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: what several steps read is made once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what written() wrote for df, when nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: what is made from it holds as long as these stay."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(at) if fs.exists(at) else []
    return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in found))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
