"""Connection logs: tab-separated text, one flow per line, `#` header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.text import stem
from flowspark.session import cut_lineage

# Characters taken off both ends of a line.
WHITE_SPACE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

MIN_FIELDS = 22
MIN_FIELDS_LENIENT = 12

# Position and type of the fields that are read.
TEXT_FIELDS = {"uid": 1, "src_ip": 2, "dst_ip": 4, "proto": 6, "service": 7, "conn_state": 11}
NUMBER_FIELDS = {
    "src_port": (3, "int"),
    "dst_port": (5, "int"),
    "duration": (8, "double"),
    "orig_bytes": (9, "bigint"),
    "resp_bytes": (10, "bigint"),
    "orig_pkts": (16, "bigint"),
    "resp_pkts": (18, "bigint"),
}

# Header names of the same fields.
HEADER_NAMES = {
    "uid": "uid", "id.orig_h": "src_ip", "id.orig_p": "src_port", "id.resp_h": "dst_ip", "id.resp_p": "dst_port",
    "proto": "proto", "service": "service", "duration": "duration", "orig_bytes": "orig_bytes",
    "resp_bytes": "resp_bytes", "conn_state": "conn_state", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts",
}


def line_position() -> Column:
    """A number that grows along each file: byte offset of the split plus place in the task.

    A file that is split fills one task per split, so the place in the task is
    below the split's length; a small file shares a task but has one split.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + place


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(log_name, line_no, value) of every line, comments included."""
    return spark.read.text(path).select(
        stem(F.col("_metadata.file_name")).alias("log_name"), line_position().alias("line_no"), "value"
    )


def is_comment() -> Column:
    return F.col("value").startswith("#")


def _trimmed() -> Column:
    return F.trim("value", F.lit(WHITE_SPACE))


def data_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_comment() & (_trimmed() != ""))


def _known(field: Column) -> Column:
    return F.nullif(field, F.lit("-"))


def _number(field: Column, kind: str) -> Column:
    return _known(field).try_cast(kind)


def _micros(field: Column) -> Column:
    return (field.try_cast("decimal(20,6)") * 1_000_000).cast("bigint")


def _at(place: int) -> Column:
    return F.get("_f", F.lit(place))


def _once(column: Column) -> Column:
    """Compute `column` once per row.

    Filters on a plain column are pushed below it, with a copy of its
    expression for every use; exploding a one-element array keeps them above.
    """
    return F.explode(F.array(column))


def _with_fields(lines: DataFrame, min_fields: int) -> DataFrame:
    """Lines with their fields `_f`, the typed ones `_t`, and the first bad field as `problem`."""
    split = data_lines(lines).withColumn("_f", _once(F.split(_trimmed(), "\t"))).filter(F.size("_f") >= min_fields)
    typed = [_number(_at(place), kind).alias(name) for name, (place, kind) in NUMBER_FIELDS.items()]
    rows = split.withColumn("_t", _once(F.struct(_micros(_at(0)).alias("ts_us"), *typed)))
    bad = [
        F.when(F.col(f"_t.{name}").isNull() & (_at(place) != "-"), name) for name, (place, _) in NUMBER_FIELDS.items()
    ]
    return rows.withColumn("problem", F.coalesce(F.when(F.col("_t.ts_us").isNull(), "ts"), *bad))


def parse_lines(lines: DataFrame, min_fields: int = MIN_FIELDS) -> DataFrame:
    """Flows from (log_name, line_no, value); short and malformed lines are left out."""
    rows = _with_fields(lines, min_fields).filter(F.col("problem").isNull())
    columns = {
        **{name: _known(_at(place)) for name, place in TEXT_FIELDS.items()},
        **{name: F.col(f"_t.{name}") for name in ("ts_us", *NUMBER_FIELDS)},
        "ts": F.timestamp_micros("_t.ts_us"),
        "raw": _trimmed(),
    }
    order = (
        "ts_us ts uid src_ip src_port dst_ip dst_port proto service duration "
        "orig_bytes resp_bytes conn_state orig_pkts resp_pkts raw"
    ).split()
    return rows.select("log_name", "line_no", *[columns[c].alias(c) for c in order])


def rejected_lines(lines: DataFrame, min_fields: int = MIN_FIELDS) -> DataFrame:
    """Lines with enough fields but a bad number: (log_name, line_no, value, problem)."""
    rows = _with_fields(lines, min_fields).filter(F.col("problem").isNotNull())
    return rows.select("log_name", "line_no", "value", "problem")


def read_conn_log(spark: SparkSession, path: str | list[str], min_fields: int = MIN_FIELDS) -> DataFrame:
    """Flows of all logs under `path`; `MIN_FIELDS_LENIENT` also takes older, shorter lines."""
    return parse_lines(read_lines(spark, path), min_fields)


def header_lines(lines: DataFrame) -> DataFrame:
    """(log_name, names): column names of each log, from its own `#fields` line."""
    names = F.slice(F.split(_trimmed(), "\t"), 2, 10_000)
    found = lines.filter(F.col("value").startswith("#fields"))
    return found.groupBy("log_name").agg(F.min_by(names, F.col("line_no")).alias("names"))


def rows_by_header(lines: DataFrame) -> DataFrame:
    """All columns of all logs as text, named by each log's own header; a column that a log lacks is NULL.

    Column names, a few dozen, come from all headers. A log without a header is an error.
    """
    headers = cut_lineage(header_lines(lines), "headers")
    data = data_lines(lines)
    missing = data.select("log_name").distinct().join(headers, "log_name", "left_anti").head(1)
    columns = headers.select(F.posexplode("names")).groupBy("col").agg(F.min("pos").alias("pos")).orderBy("pos", "col")
    names = [r["col"] for r in columns.collect()]
    if missing or not names:
        raise ValueError("no #fields header in the connection log")
    values = F.split("value", "\t")
    fields = F.map_from_arrays("names", F.transform("names", lambda _, k: F.get(values, k)))
    rows = data.join(headers, "log_name").withColumn("_fields", fields)
    return rows.select(*[F.nullif(F.col("_fields")[name], F.lit("")).alias(name) for name in names])


def read_by_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns of the logs under `path`, each file by its own `#fields` line, as text."""
    return rows_by_header(read_lines(spark, path))


def flows_by_header(rows: DataFrame) -> DataFrame:
    """Typed flow columns next to the original ones, for the operators on flows."""
    known = {new: F.col(f"`{old}`") for old, new in HEADER_NAMES.items() if old in rows.columns}
    numbers = {c: _number(known[c], kind) for c, (_, kind) in NUMBER_FIELDS.items() if c in known}
    text = {c: _known(known[c]) for c in TEXT_FIELDS if c in known}
    ts_us = _micros(F.col("ts"))
    return rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("source_row"),
        ts_us.alias("ts_us"),
        *[c.alias(n) for n, c in {**text, **numbers}.items()],
    ).filter(F.col("ts_us").isNotNull())


def to_line(flows: DataFrame) -> Column:
    """Flow columns written as one log line of 22 fields, gaps as "-"."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("-")) if name in flows.columns else F.lit("-")

    ts = F.format_string("%d.%06d", F.expr("ts_us div 1000000"), F.expr("pmod(ts_us, 1000000)"))
    fields = {0: ts, **{at: shown(c) for c, at in TEXT_FIELDS.items()}}
    fields.update({at: shown(c) for c, (at, _) in NUMBER_FIELDS.items()})
    return F.concat_ws("\t", *[fields.get(i, F.lit("-")) for i in range(MIN_FIELDS)])
