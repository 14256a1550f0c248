"""Live analysis: bursts of events are waited out, then the rules of the scopes they touched run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators import metrics, rules
from tracemill.plans import snapshot

#: How long a scope has to be quiet before it is analysed, and how far back the analysis looks.
QUIET, WINDOW_MS = "1500 milliseconds", metrics.DAY_MS


def bursts(events: DataFrame, scope: str = "project_id", quiet: str = QUIET, late: str = "0 seconds") -> DataFrame:
    """(scope, first_ts, last_ts, events) of each burst of a stream of events (scope, ts in milliseconds): events of a scope that follow each other within quiet.

    Spark keeps a session window for each scope whose burst is open, no more, and
    gives it out once the events' own time has passed its end. Events later than
    late behind the newest one are left to the next burst's analysis, which
    reads the stored events.
    """
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    found = timed.groupBy(F.session_window("at", quiet).alias("w"), scope).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select(scope, "first_ts", "last_ts", "events")


def recent_snapshots(closed: DataFrame, activity: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """A snapshot for each closed burst, over the stored activity of its project in the window that ends with it; run is the burst's first_ts.

    Bursts are few beside events: they are what is sent to the events, of whose
    projects alone anything is read on.
    """
    ends = closed.select(F.col("project_id").alias("of"), F.col("first_ts").alias("run"), F.col("last_ts").alias("upto"))
    rows = activity.join(ends, (F.col("project_id") == F.col("of")) & (F.col("ts") <= F.col("upto")) & (F.col("ts") > F.col("upto") - window_ms))
    grains = snapshot.by_scope(rows.withColumn("session_id", F.col("run")).drop("of", "run", "upto"))
    return grains.where("session_id is not null").withColumnRenamed("session_id", "run")


def analyse(closed: DataFrame, activity: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """closed with found: the rules that fire in each burst's window, by id, and recommendations, their number."""
    hits = rules.evaluate(recent_snapshots(closed, activity, window_ms), scope=("project_id", "run")).groupBy("project_id", "run").agg(F.array_sort(F.collect_set("rule_id")).alias("found"))
    out = closed.join(hits.withColumnRenamed("run", "first_ts"), ["project_id", "first_ts"], "left")
    return out.withColumn("found", F.coalesce("found", F.array().cast("array<string>"))).withColumn("recommendations", F.size("found"))


def observe(stream: DataFrame, stored: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, quiet: str = QUIET, window_ms: int = WINDOW_MS, every: str | None = None) -> StreamingQuery:
    """Analyse the bursts of stream into path, a folder for each batch; a batch that runs again replaces its own.

    stored gives the events as they are stored when a batch runs. Without every
    what is there is worked off, and the query has ended; with it ("1 second") it
    goes on. Batches without a closed burst read and write nothing.
    """
    def run(batch: DataFrame, number: int) -> None:
        closed = batch.persist()
        if not closed.isEmpty():
            analyse(closed, stored(batch.sparkSession), window_ms).write.mode("overwrite").parquet(f"{path}/batch={number}")
        closed.unpersist()

    writer = bursts(stream, quiet=quiet).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
