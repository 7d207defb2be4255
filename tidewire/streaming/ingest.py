"""The same state kept by Structured Streaming: upserts by micro-batch, windows with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_root
from ..sources.state import insert_new


def _checkpoint(spark: SparkSession, name: str | None = None) -> str:
    """A named stream's own folder, where its next run goes on; without a name, one for this run."""
    return f"{shared_root(spark)}/stream-{name or uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A table's files as a stream. With None a micro-batch takes all that are there: files of a
    table are in no order of time, so a watermark that rises from file to file would drop rows as late.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch is not None:
        files = files.option("maxFilesPerTrigger", files_per_batch)
    return files.parquet(path if not name.endswith(".parquet") else f"{folder}/{name[:-8]}*.parquet")


def running_heat(spark: SparkSession, path: str) -> DataFrame:
    """Highest value and last time of each user, over all that has arrived; late rows only ever raise it.

    Runs the stream to the end of what is there. A micro-batch writes only the
    users that it changed, and again if it is repeated; as both values only
    rise, the state is the highest of what was written.
    """
    where = _checkpoint(spark)
    heat = event_stream(spark, path).groupBy("user_id").agg(F.max("value").alias("heat"), F.max("ts").alias("last"))

    def store(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/changes/batch={n}")

    run = heat.writeStream.outputMode("update").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).foreachBatch(store).start()
    run.awaitTermination()
    changes = spark.read.schema(heat.schema).parquet(f"{where}/changes")
    return changes.groupBy("user_id").agg(F.max("heat").alias("heat"), F.max("last").alias("last"))


def hourly_counts(events: DataFrame, *, ts: str = "ts", key: str = "event_type", late: str = "24 hours") -> DataFrame:
    """Counts by hour that close once the watermark has passed; a time without zone counts as UTC."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), key).agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, target: str, *, keys: tuple[str, ...] = ("url_hash", "hash"), order: str = "id", name: str | None = None):
    """Appends to ``target`` what it doesn't hold yet, a micro-batch at a time; a batch that is repeated adds nothing.

    A stream with a ``name`` resumes where its last run ended; its target must stay the same.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, n: int) -> None:
        try:
            stored = spark.read.schema(batch.schema).parquet(target)
        except Exception as e:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = batch.limit(0)
        insert_new(stored, batch, keys, order).write.mode("append").parquet(target)

    return stream.writeStream.option("checkpointLocation", _checkpoint(spark, name)).trigger(availableNow=True).foreachBatch(store).start()
