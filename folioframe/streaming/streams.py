"""Streaming forms of the event operators and of ingestion.

Every function takes and returns an unbounded DataFrame; ``drain`` runs one over the input
that is there and hands back what it wrote. State is bounded by watermarks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import index as I
from folioframe.operators.events import health_status
from folioframe.operators.resolve import dedup_first
from folioframe.functions.scores import r6
from folioframe.session import checkpoint_dir


def read_table(spark: SparkSession, root: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A table as a stream, with its schema: one file, or all files of its folder.

    A stream reads folders; a table that is one file is picked from its folder by its name.
    """
    path = f"{root}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch)
    if all(file.endswith(f"/{name}.parquet") for file in table.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return stream.parquet(path)


def events(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("failed", F.col("event_type") == "error").withColumn(
        "component", F.col("user_id") % 10)


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process all available input into files of the shared folder and read them back.

    The folder also holds the offsets: called again with it, only new input is processed.
    """
    spark = stream.sparkSession
    base = folder or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_ingest(stream: DataFrame, folder: str, key: str = "identity", arrival: str = "arrival") -> None:
    """Store the first record of every key; a key is never forgotten.

    Each micro-batch is reduced to its first records and compared with what all batches before
    it have stored. It writes to a folder of its number, and reads only lower numbers, so a
    batch that runs again after a failure gives the same rows and doubles none.
    """
    def store(batch: DataFrame, number: int) -> None:
        first = dedup_first(batch, key, arrival)
        if number:
            held = batch.sparkSession.read.parquet(*[f"{folder}/records/batch={n}" for n in range(number)]).select(key)
            first = first.join(held, first[key].eqNullSafe(held[key]), "left_anti")
        first.write.mode("overwrite").parquet(f"{folder}/records/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_ingest(stream: DataFrame, folder: str | None = None, key: str = "identity", arrival: str = "arrival") -> DataFrame:
    """Ingest all available input and read the stored records."""
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    stream_ingest(stream, folder, key, arrival)
    return spark.read.schema(stream.schema).parquet(f"{folder}/records/batch=*")


def stream_health(stream: DataFrame, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Component health per tumbling window; rows behind the watermark are dropped."""
    n, bad = F.count(F.lit(1)), F.count_if("failed")
    per = stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "component").agg(n.alias("total"), bad.alias("failed"), F.sum("value").alias("busy"))
    return per.select(F.col("window.start").alias("start"), "component", "total", "failed", r6(F.col("busy") / F.col("total")).alias("mean_ms"),
                      health_status(F.col("total"), F.col("failed")).alias("status"))


def stream_trend(stream: DataFrame, size: str = "2 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events per type in sliding windows."""
    per = stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n")


def stream_sessions(stream: DataFrame, gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """Events of a user without a pause of ``gap``."""
    per = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def stream_enrich(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Events with the attributes of a static table; no state."""
    return stream.join(dimension, key, "left")


def stream_index(stream: DataFrame, folder: str) -> None:
    """Index chunks as they arrive: postings of each micro-batch go to a folder of its number.

    A batch that is run again after a failure overwrites its own folder, so no row is doubled.
    """
    def store(batch: DataFrame, number: int) -> None:
        I.postings(I.index_valid_chunks(batch)).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_index(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    stream_index(stream, folder)
    return spark.read.parquet(f"{folder}/postings")
