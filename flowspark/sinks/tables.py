"""Writing flows, parts, knowledge rows, labels, reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.scale import bucketed_row_number
from flowspark.operators.documents import upserted
from flowspark.session import cut_lineage
from flowspark.sources.conn_log import data_lines, is_comment

ROWS_PER_PART = 108
POSITIONS_PER_BUCKET = 1 << 20


def with_parts(
    rows: DataFrame, rows_per_part: int = ROWS_PER_PART, width: int = POSITIONS_PER_BUCKET, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Rows with `part`, counted from 1 in `line_no` order, and its `part_name`.

    `line_no` is unique per log, so a bucket of `width` positions has at most
    that many rows, whatever the log.
    """
    cell = F.floor(F.col("line_no") / width).cast("bigint")
    numbered = bucketed_row_number(rows, "_rn", cell, ["line_no"], keys)
    part = F.floor((F.col("_rn") - 1) / rows_per_part).cast("bigint") + 1
    return numbered.withColumn("part", part).select(
        *rows.columns, "part", F.concat(F.lit("conn_log_part_"), F.col("part").cast("string")).alias("part_name")
    )


def split_log_lines(lines: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(log_name, part, part_name, block, line_no, value): data lines in parts, the log's header lines in front of each."""
    parts = with_parts(data_lines(lines), rows_per_part, keys=("log_name",))
    headers = lines.filter(is_comment()).select("log_name", "line_no", "value")
    name = ["log_name", "part", "part_name"]
    copied = parts.select(*name).distinct().join(headers, "log_name")
    return parts.select(*name, F.lit(1).alias("block"), "line_no", "value").unionByName(
        copied.select(*name, F.lit(0).alias("block"), "line_no", "value")
    )


def write_parts(lines: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Text export: one folder per log and part, header first. For many parts `write_part_table` is the form."""
    split = split_log_lines(lines, rows_per_part)
    name = ["log_name", "part_name"]
    (
        split.repartition(*name)
        .sortWithinPartitions(*name, "block", "line_no")
        .select(*name, "value")
        .write.partitionBy(*name)
        .text(path)
    )


def write_part_table(lines: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """All parts as one Parquet table, sorted by log, part and line: a part is a filter that skips row groups."""
    order = ["log_name", "part", "block", "line_no"]
    split_log_lines(lines, rows_per_part).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def write_flows(flows: DataFrame, path: str) -> None:
    """Land parsed flows once as Parquet by day, for scans that read few columns and days."""
    flows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_filtered(rows: DataFrame, path: str) -> None:
    """Matching flows as tab-separated text with a header line."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def append_knowledge(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").partitionBy("collection").parquet(path)


def upsert_knowledge(docs: DataFrame, path: str) -> None:
    """Replace documents of the same id; only the collections of `docs` are rewritten.

    The new state is complete in the shared folder before the old one is
    touched. A store that is not there yet is begun.
    """
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        existing = spark.read.parquet(path).select(*docs.columns)
    else:
        existing = docs.limit(0)
    touched = docs.select("collection").distinct()
    merged = cut_lineage(upserted(existing.join(touched, "collection", "left_semi"), docs), "upsert")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection")
        .parquet(path)
    )


def write_labels(labels: DataFrame, path: str) -> None:
    """One JSON object per log."""
    labels.write.mode("overwrite").json(path)


def label_file_lines(entries: DataFrame) -> DataFrame:
    """(value): each log's entry as one JSON object {file: entry}; together they read as one label file."""
    named = F.create_map(F.concat("log_name", F.lit(".log")), "entry")
    return entries.select(F.to_json(named).alias("value"))


def write_label_file(entries: DataFrame, path: str) -> None:
    """Label entries in the label file's own shape, a log per line, as `read_label_map` reads them."""
    label_file_lines(entries).write.mode("overwrite").text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("log_name", "text").write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str, form: str = "csv") -> None:
    """Metric rows (a handful) as one CSV or JSON file."""
    writer = metrics.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.json(path)


# Report files that one task writes.
FILES_PER_TASK = 250


def write_report_files(reports: DataFrame, path: str) -> None:
    """Reports (log_name, text) as one text file each, in a folder `report=<log_name>` below the new folder `path`.

    The number of tasks follows from the files, as their bytes are few; tasks
    put files in their place themselves, where else the driver moves them one
    by one in the end. So `path` is whole only when the call has returned.
    """
    tasks = -(-reports.count() // FILES_PER_TASK) or 1
    rows = reports.select(F.col("log_name").alias("report"), "text").repartition(tasks, "report")
    rows.write.partitionBy("report").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
