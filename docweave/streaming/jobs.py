"""Edit log, work sessions and incremental ingest as Structured Streaming jobs.

The aggregations are plain DataFrame functions, so the same code runs in batch.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import labels as L
from ..session import checkpoint_dir, durable

EDIT_EVENTS = "ref_id long, kind string, value string, ts timestamp, seq long"


def read_events(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def latest_edits(events: DataFrame) -> DataFrame:
    """Latest value per reference and kind; a blank value deletes it. One small state row
    per key, combined before the shuffle."""
    out = events.groupBy("ref_id", "kind").agg(
        F.max(F.struct("ts", "seq", F.coalesce("value", F.lit("")).alias("value"))).alias("m"))
    return out.select("ref_id", "kind", F.col("m.ts").alias("ts"), F.col("m.seq").alias("seq"), F.col("m.value").alias("value"),
                      (F.trim("m.value") == "").alias("deleted"))


def sessions(events: DataFrame, ttl: str = "48 hours", delay: str = "1 hour") -> DataFrame:
    """Work sessions: a session ends after ``ttl`` without activity; events later than the
    watermark are dropped in a stream."""
    out = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", ttl)).agg(
        F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))
    return out.select("user_id", F.col("session_window.start").alias("start_ts"), "last_ts",
                      F.col("session_window.end").alias("end_ts"), "n_events")


def work_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder in the shared checkpoint area."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_to_table(stream: DataFrame, folder: str, mode: str) -> None:
    """Run a stream over what is available; each batch lands in its own partition, so a
    retried batch replaces itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
         .foreachBatch(save).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_edits(spark: SparkSession, events: DataFrame, folder: str | None = None) -> DataFrame:
    """Current edits after draining the event stream."""
    folder = folder or work_folder(spark, "edits")
    run_to_table(latest_edits(events), folder, "update")
    rows = spark.read.parquet(f"{folder}/out")
    cur = rows.groupBy("ref_id", "kind").agg(F.max_by(F.struct("ts", "seq", "value", "deleted"), "batch").alias("m"))
    return cur.select("ref_id", "kind", "m.ts", "m.value", "m.deleted").where("NOT deleted").drop("deleted")


def stream_sessions(spark: SparkSession, events: DataFrame, ttl: str = "48 hours", delay: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Closed sessions after draining the event stream."""
    folder = folder or work_folder(spark, "sessions")
    run_to_table(sessions(events, ttl, delay), folder, "append")
    return spark.read.parquet(f"{folder}/out").drop("batch")


def changed_documents(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents whose content or configuration hash is not recorded yet.
    docs(doc_id, content, config_hash)"""
    d = docs.withColumn("doc_hash", L.content_hash("content"))
    return d.join(state.select("doc_id", "doc_hash", "config_hash"), ["doc_id", "doc_hash", "config_hash"], "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stream_ingest(spark: SparkSession, docs: DataFrame, folder: str, process) -> None:
    """Process only new or changed documents of a stream. ``process(df)`` returns the rows
    to store. State and results of a batch are written under the batch id."""
    state_path = f"{folder}/hashes"

    def handle(batch: DataFrame, batch_id: int) -> None:
        if _exists(spark, state_path):
            seen = spark.read.parquet(state_path).where(F.col("batch") != batch_id)
        else:  # first batch: nothing recorded yet
            seen = spark.createDataFrame([], f"doc_id {batch.schema['doc_id'].dataType.simpleString()}, doc_hash string, config_hash string, batch long")
        latest = seen.groupBy("doc_id").agg(F.max_by(F.struct("doc_hash", "config_hash"), "batch").alias("s")).select("doc_id", "s.*")
        # Read twice below, so it is settled once; of two versions in one batch both are handled.
        todo = durable(changed_documents(batch, latest))
        process(todo).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        todo.select("doc_id", "doc_hash", "config_hash").write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    q = (docs.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(handle).trigger(availableNow=True).start())
    q.awaitTermination()


def expired_runs(runs: DataFrame, now, ttl_hours: int = 48) -> DataFrame:
    """Retention report: expired flag and whole hours left; a ttl of 0 or less turns it off."""
    left = (F.unix_timestamp("last_activity") + ttl_hours * 3600 - F.unix_timestamp(F.lit(now).cast("timestamp"))) / 3600
    off = F.lit(ttl_hours <= 0)
    return runs.select("doc_id", "run_id", "last_activity", F.when(off, False).otherwise(left < 0).alias("expired"),
                       F.when(off, F.lit(None)).otherwise(F.greatest(F.lit(0), left.cast("long"))).alias("hours_left"))
