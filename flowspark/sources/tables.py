"""Anomalies, rules, heuristics, labels, reports, metrics and the knowledge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.scale import bucketed_row_number, bucketed_running_sum
from flowspark.functions.text import stem
from flowspark.schema import ANOMALIES, LABEL_FILE, METRICS_FILE, RULES
from flowspark.sources.conn_log import line_position

ROWS_PER_CELL, BYTES_PER_CELL = 1 << 24, 4 << 20


def read_anomalies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Anomaly rows with `file_name` and `row_no`, the row's place in its file from 0.

    Numbers are read from text, so a column written with gaps ("80.0") keeps its values.
    """
    names = [f.name for f in ANOMALIES]
    text_schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.csv(path, header=True, schema=text_schema).select(
        F.col("_metadata.file_name").alias("file_name"), line_position().alias("_at"), *names
    )
    typed = {
        f.name: F.col(f.name).try_cast("double").cast("int") for f in ANOMALIES if f.dataType.typeName() == "integer"
    }
    cell = F.floor(F.col("_at") / ROWS_PER_CELL).cast("bigint")
    numbered = bucketed_row_number(rows, "row_no", cell, ["_at"], ["file_name"])
    return numbered.withColumns({**typed, "row_no": F.col("row_no") - 1}).select("file_name", "row_no", *names)


def read_anomaly_ips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ip, heuristic) lists, the other form of address file."""
    return spark.read.csv(path, header=True, schema="ip string, heuristic int")


def read_rules(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Wildcard rules as text; an empty field stays NULL and matches anything.

    A port written with gaps ("80.0") is the whole number, as in `read_anomalies`.
    """
    rules = spark.read.csv(path, header=True, schema=RULES)
    port = {c: F.coalesce(F.col(c).try_cast("double").cast("int").cast("string"), F.col(c)) for c in ("srcPort", "dstPort")}
    return rules.withColumns(port)


def read_heuristic_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """(log_name, label) of lines `name.log = True`; lines without exactly one "=" are skipped."""
    parts = F.split("value", "=")
    return lines.filter(F.size(parts) == 2).select(
        stem(F.trim(parts[0])).alias("log_name"), (F.lower(F.trim(parts[1])) == "true").alias("label")
    )


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_label_lines(spark.read.text(path))


def label_of(entry: Column, attack: str) -> Column:
    """The flag of one label entry; entries without it, error entries too, are False."""
    key = f"{attack}_detected" if attack in ("ping_flood", "syn_flood") else "attack_detected"
    return F.coalesce(entry[key], F.lit(False))


def parse_label_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """(log_name, entry) of each log in label files of the form {file: {...}}."""
    return texts.select(F.explode(F.from_json(F.col(column), LABEL_FILE)).alias("file", "entry")).select(
        stem(F.col("file")).alias("log_name"), "entry"
    )


def split_object(spark: SparkSession, path: str, bytes_per_cell: int = BYTES_PER_CELL) -> DataFrame:
    """(file, value): the top-level entries of files that are one JSON object each, every one as an object of its own.

    The text is cut at closing braces, so Spark deals out byte ranges of one
    file to many tasks. Each piece tells how its quotes and braces move on from
    either state, inside or outside a string; running sums over the pieces then
    give the state and the depth that each begins with, and an entry ends where
    the depth is back at the object's own. Entries that are no objects come
    together with the next one that is. No task sees more than an entry or a
    cell of `bytes_per_cell`.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), line_position().alias("at"), F.col("value").alias("text")
    )
    # Behind the last brace there is white space at most.
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)

    def opened(outside_at: int) -> Column:
        """Braces and brackets opened and not closed in the pieces of text outside strings, the cut brace left out."""
        outside = F.array_join(F.filter(parts, lambda _, k: k % 2 == outside_at), "")
        up, down = F.translate(outside, "{[", ""), F.translate(outside, "]", "")
        return (F.length(down) - F.length(up)).cast("bigint")

    cell = F.floor(F.col("at") / bytes_per_cell).cast("bigint")
    keys, order = ["file"], ["at"]
    quotes = (F.size(parts) - 1).cast("bigint")
    moves = pieces.select("file", "at", "text", quotes.alias("quotes"), opened(0).alias("from_outside"), opened(1).alias("from_inside"))
    placed = bucketed_running_sum(moves, "quotes_before", F.col("quotes"), cell, order, keys)
    inside, ends_inside = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    closing = F.when(ends_inside, 0).otherwise(1)
    change = F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside")) - closing
    deep = bucketed_running_sum(placed.select("file", "at", "text", (~ends_inside).alias("closes"), change.alias("change")), "depth", F.col("change"), cell, order, keys)
    after = F.col("depth") + F.col("change")
    ended = deep.select("file", "at", "text", (F.col("closes") & (after <= 1)).alias("ends"), (F.col("closes") & (after == 1)).alias("whole"))
    numbered = bucketed_running_sum(ended, "entry", F.col("ends").cast("bigint"), cell, order, keys)
    # The cut took a brace from the end of every piece; that of the whole object's end is not the entry's.
    piece = F.struct("at", F.when(F.col("ends") & ~F.col("whole"), F.col("text")).otherwise(F.concat("text", F.lit("}"))).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "")
    whole = numbered.groupBy("file", "entry").agg(text.alias("text"), F.bool_or("ends").alias("ended"))
    content = F.regexp_replace("text", r"^\s*[{,]", "")
    return whole.filter("ended").filter(F.trim(content, F.lit(" \t\r\n")) != "").select("file", F.concat(F.lit("{"), content, F.lit("}")).alias("value"))


def read_label_entries(spark: SparkSession, path: str, per_line: bool = False, split: bool = False) -> DataFrame:
    """(log_name, entry) of label files.

    A file is one JSON object, on as many lines as it likes, and one task reads
    it; `split=True` lets many tasks read one. `per_line=True` is for files with
    one object per line, which many tasks read anyway.
    """
    if split:
        return parse_label_map(split_object(spark, path))
    return parse_label_map(spark.read.text(path, wholetext=not per_line))


def read_label_map(spark: SparkSession, path: str, attack: str = "ping_flood", per_line: bool = False) -> DataFrame:
    entries = read_label_entries(spark, path, per_line)
    return entries.select("log_name", label_of(F.col("entry"), attack).alias("label"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(log_name, text), one row per report file."""
    return spark.read.text(path, wholetext=True).select(
        stem(F.col("_metadata.file_name")).alias("log_name"), F.col("value").alias("text")
    )


def read_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Saved result files, one row each, with the confusion counts as columns."""
    rows = spark.read.json(path, schema=METRICS_FILE, multiLine=True)
    counts = [F.col(f"confusion_matrix.{c}").alias(c.lower()) for c in ("TP", "TN", "FP", "FN")]
    return rows.select(*[c for c in rows.columns if c != "confusion_matrix"], *counts)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows landed by `write_flows`; a filter on `day` reads only those folders."""
    return spark.read.parquet(path)


def read_knowledge(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """The knowledge table, or one collection of it (only that folder is read)."""
    kb = spark.read.parquet(path)
    return kb if collection is None else kb.filter(F.col("collection") == collection)
