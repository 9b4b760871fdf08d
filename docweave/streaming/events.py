"""The event log as a stream: records checked and normalised on their way into a table, counts by day, and files taken in once.

Streams end when what is there is read (availableNow) and go on from their checkpoint the next time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import cut_lineage


def read(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """Parquet files as they arrive below path, at most ``files`` in a batch. The path may be a folder, a pattern, or a
    single file, which a file stream takes as a pattern only."""
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def normalized(events: DataFrame) -> DataFrame:
    """Log records: blanks are null, the level follows the event; a record without a run or an event is marked invalid."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    level: Column = F.when(F.col("event").contains("failed"), "error").when(F.col("event").contains("partial") | F.col("event").contains("cancel"), "warning").otherwise("info")
    return events.select("logged_at", blank("run_id").alias("run_id"), blank("event").alias("event"), level.alias("level"), blank("status").alias("status"), blank("relative_path").alias("relative_path"), "size_bytes").withColumn("valid", F.col("run_id").isNotNull() & F.col("event").isNotNull())


def append(stream: DataFrame, table: str, checkpoint: str):
    """Appends the stream to a table of files; each record once, whatever fails on the way."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts(events: DataFrame) -> DataFrame:
    """Events by day. The state has a row per day and event, so late records need no watermark and none is dropped."""
    return events.where("logged_at is not null").groupBy(F.window("logged_at", "1 day").alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event", "n")


def keep_counts(stream: DataFrame, table: str, checkpoint: str):
    """Keeps the latest counts of an aggregating stream in a table, replaced as a whole with every batch."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def take_in(stream: DataFrame, table: str, checkpoint: str):
    """Adds files (sha256, relative_path and more) to a table, each content at a path once over all batches and runs.

    A batch is written to a folder of its own number, so a batch that is tried again replaces itself.
    """
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["sha256", "relative_path"])
        try:
            have = spark.read.parquet(table).where(F.col("batch") != number).select("sha256", "relative_path")
            new = new.join(have, ["sha256", "relative_path"], "left_anti")
        except Exception as x:
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
                raise
        cut_lineage(new).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
