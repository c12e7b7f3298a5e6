"""Streaming intake of connection logs and flood counts on live flows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StringType, StructField, StructType

from flowspark.functions.text import stem
from flowspark.schema import FLOWS
from flowspark.sinks.commits import Commits
from flowspark.sources.conn_log import MIN_FIELDS, parse_lines


def stream_conn_log(
    spark: SparkSession, path: str, min_fields: int = MIN_FIELDS, files_per_batch: int | None = None
) -> DataFrame:
    """Flows of log files as they arrive; `uid` orders equal times, there is no line number."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).select(
        stem(F.col("_metadata.file_name")).alias("log_name"), F.lit(None).cast("bigint").alias("line_no"), "value"
    )
    return parse_lines(lines, min_fields)


def without_repeats(flows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Flows of a stream, each (log, uid) once within `delay` of event time; a flow without uid is told by its line.

    So a file that comes again under its name, or a log whose end is sent
    twice, changes nothing as long as it comes within `delay`.
    """
    keyed = flows.withColumn("_flow", F.coalesce("uid", "raw"))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["log_name", "_flow"]).drop("_flow")


def land_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that has arrived by micro-batch and stop; each batch counts once.

    A batch's files go to a folder of their own, which its published entry names
    at the end. A batch that failed has no entry, one that is done again finds
    its entry and is left out, so `read_batches` sees every batch whole and once.
    """

    def land(batch: DataFrame, number: int) -> None:
        entries = Commits(batch.sparkSession, f"{path}/batches")
        name = f"{number:012d}"
        if name in entries.names():
            return
        folder = f"{name}-{os.urandom(6).hex()}"
        batch.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{path}/data/batch={folder}")
        entries.publish(name, folder)

    query = (
        stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The flows of all published batches, with `batch` and `day`; a filter on either reads only those folders."""
    entries = Commits(spark, f"{path}/batches")
    folders = [f"{path}/data/batch={entries.read(name)}" for name in entries.names()]
    schema = StructType([*FLOWS, StructField("batch", StringType()), StructField("day", DateType())])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)


def flood_window_counts(
    rows: DataFrame,
    threshold: int = 10,
    length: str = "20 seconds",
    slide: str = "5 seconds",
    delay: str | None = "1 minute",
    key: str = "dst_ip",
) -> DataFrame:
    """Targets with many rows in a sliding window of event time.

    An approximation of the exact bursts: windows start at multiples of `slide`.
    On a stream, rows later than `delay` are dropped; batch tables take the same
    plan with `delay=None`.
    """
    timed = rows.withWatermark("ts", delay) if delay else rows
    counted = timed.groupBy(F.window("ts", length, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= threshold).select(
        key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n"
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived and stop; a second run goes on where this one ended."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
