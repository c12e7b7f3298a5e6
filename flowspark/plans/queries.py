"""Every operator as a query over the shared tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions import alert_text, taxonomy
from flowspark.functions.text import all_tokens, cap_text, extract_ips, similarity_of, tokens
from flowspark.functions.time import HOUR
from flowspark.operators import bursts, documents, evidence, filters, labelling, metrics, ml, profile, retrieval
from flowspark.operators import postings, rule_match, rule_scores, verdicts
from flowspark.operators.vector_index import VectorIndex, recall_of
from flowspark.plans import pipelines
from flowspark.schema import ANOMALIES, RULE_FIELDS
from flowspark.session import checkpoint_dir, cut_lineage
from flowspark.sinks import tables as sinks
from flowspark.sinks.snapshots import SnapshotTable
from flowspark.sinks.tables import label_file_lines, with_parts
from flowspark.sources import conn_log, driver_tables as tables
from flowspark.sources import tables as readers
from flowspark.streaming.bursts import stream_ping_bursts
from flowspark.streaming.flows import flood_window_counts, land_batches, read_batches, run_available, without_repeats

# Events are sparse (a month in all), so windows are hours where a capture has seconds.
WINDOW = 12 * HOUR
# A 108-line log holds few echo rows, so per-log floods need fewer.
LOG_THRESHOLD = 5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _six(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _joined(column: str, separator: str = ","):
    return F.array_join(column, separator).alias(column)


def _fine_cases(flows: DataFrame) -> DataFrame:
    """Cases of one log and one target, small enough that some lack a protocol."""
    return flows.withColumn("log_name", F.concat_ws("_", "log_name", "dst_ip"))


# --- scans and sinks ---------------------------------------------------------------------------


def _line_table(flows: DataFrame) -> DataFrame:
    return flows.select("log_name", "line_no", F.explode(F.array(conn_log.to_line(flows))).alias("value"))


@query
def conn_log_parse(spark, sf):
    """Flows written as log lines and parsed back."""
    parsed = conn_log.parse_lines(_line_table(tables.flows(spark, sf)))
    return parsed.drop("ts", "uid", "service", "raw")


@query
def anomaly_ip_set(spark, sf):
    return rule_match.anomaly_ip_set(tables.anomalies(spark, sf))


def _heuristic_texts(spark, sf):
    return tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("text_id"),
        F.concat(
            F.lit("Heuristics\n* "), (F.col("p_partkey") % 1000).cast("string"), F.lit(": "), F.col("p_name"),
            F.lit(" \n*bad line\n* "), (F.col("p_size") * 20).cast("string"), F.lit(":"), F.col("p_type"),
            F.lit("\nAnomaly taxonomy\n* 999: not a heuristic"),
        ).alias("text"),
    )


@query
def heuristic_parse(spark, sf):
    return documents.parse_heuristics(_heuristic_texts(spark, sf))


@query
def heuristic_docs(spark, sf):
    docs = documents.heuristic_docs(documents.parse_heuristics(_heuristic_texts(spark, sf)))
    return docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def label_line_parse(spark, sf):
    lines = tables.table(spark, sf, "labels").select(
        F.when(F.col("toxic") == 1, F.lit("# no label here"))
        .otherwise(
            F.concat(
                F.lit(" conn_log_part_"), F.col("doc_id").cast("string"), F.lit(".log = "),
                F.when(F.col("quality") == 1, "TRUE ").otherwise("no"),
            )
        )
        .alias("value")
    )
    return readers.parse_label_lines(lines)


@query
def label_map_parse(spark, sf):
    texts = tables.table(spark, sf, "labels").select(
        F.concat(
            F.lit('{"conn_log_part_'), F.col("doc_id").cast("string"), F.lit('.log": {"ping_flood_detected": '),
            F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "num_floods": '),
            F.col("toxic").cast("string"), F.lit('}, "broken_'), F.col("doc_id").cast("string"),
            F.lit('.log": {"error": "unreadable"}}'),
        ).alias("value")
    )
    entries = readers.parse_label_map(texts)
    return entries.select("log_name", readers.label_of(F.col("entry"), "ping_flood").alias("label"), "entry.error")


@query
def split_log_parts(spark, sf):
    log = F.concat(F.lit("capture_"), F.pmod(F.floor(F.col("line_no") / 1000), F.lit(3)).cast("string"))
    lines = tables.flows(spark, sf).select(log.alias("log_name"), "line_no", "ts_us")
    return with_parts(lines, keys=("log_name",)).groupBy("log_name", "part", "part_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("min_ts_us"), F.max("ts_us").alias("max_ts_us")
    )


def _kb_rows(spark, sf):
    existing = documents.anomaly_docs(tables.anomalies(spark, sf)).select("collection", "doc_id", "text", "meta")
    new = tables.table(spark, sf, "supplier").select(
        F.lit(documents.ANOMALIES).alias("collection"),
        F.concat(F.lit("anomaly_"), F.expr("s_suppkey - pmod(s_suppkey, 3)").cast("string")).alias("doc_id"),
        F.col("s_name").alias("text"),
        F.create_map(F.lit("no"), F.col("s_suppkey").cast("string")).alias("meta"),
        "s_suppkey",
    )
    return existing, new


@query
def kb_upsert(spark, sf):
    rows = documents.upserted(*_kb_rows(spark, sf), order="s_suppkey")
    return rows.select("collection", "doc_id", "text", _shown_map("meta"))


def _shown_map(name: str):
    entries = F.array_sort(F.map_entries(name))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias(name)


@query
def header_scan(spark, sf):
    """Two kinds of logs with swapped columns, each read by its own header."""
    swapped = F.pmod(F.floor(F.col("line_no") / 108), F.lit(2)) == 1
    flows = tables.flows(spark, sf)
    first = flows.groupBy("log_name").agg(F.min("line_no").alias("line_no"))
    header = F.when(swapped, "#fields\tts\tid.resp_h\tid.orig_h").otherwise("#fields\tts\tid.orig_h\tid.resp_h\tproto")
    ends = F.when(swapped, F.concat_ws("\t", "dst_ip", "src_ip")).otherwise(F.concat_ws("\t", "src_ip", "dst_ip", "proto"))
    value = F.concat_ws("\t", F.col("line_no").cast("string"), ends)
    lines = flows.select("log_name", "line_no", value.alias("value")).unionByName(
        first.select("log_name", (F.col("line_no") - 1).alias("line_no"), header.alias("value"))
    )
    rows = conn_log.rows_by_header(lines)
    return rows.select(F.col("ts").cast("bigint").alias("line_no"), F.col("`id.orig_h`").alias("orig_h"), F.col("`id.resp_h`").alias("resp_h"), "proto")


@query
def label_file_round_trip(spark, sf):
    """Labels and floods written in the label file's shape and parsed back; every seventh log is unreadable."""
    flows = tables.flows(spark, sf)
    labels = cut_lineage(_labels(spark, sf), "labels")
    number = F.regexp_extract("log_name", r"(\d+)$", 1).cast("int")
    errors = labels.filter(number % 7 == 0).select("log_name", F.lit("unreadable").alias("error"))
    details = labelling.flood_details(flows, threshold=LOG_THRESHOLD, window_us=WINDOW)
    lines = label_file_lines(labelling.label_entries(labels, details, errors))
    entries = readers.parse_label_map(lines)
    return entries.select(
        "log_name",
        readers.label_of(F.col("entry"), "ping_flood").alias("label"),
        "entry.num_floods",
        F.size("entry.flood_details.many_to_one").alias("n_many"),
        F.size("entry.flood_details.one_to_many").alias("n_scans"),
        "entry.matching_anomaly_rows",
        F.array_join("entry.detection_reason", "; ").alias("detection_reason"),
        "entry.error",
    )


@query
def label_object_split(spark, sf):
    """All labels in one file that is one JSON object, read by many tasks."""
    path = f"{checkpoint_dir(spark)}/labels-{os.urandom(6).hex()}"
    entry = F.concat(
        F.lit('"conn_log_part_'), F.col("doc_id").cast("string"), F.lit('.log": {"ping_flood_detected": '), F.when(F.col("quality") == 1, "true").otherwise("false"),
        F.lit(', "flood_details": {"many_to_one": [{"type": "a \\"}{\\" b", "packet_count": '), F.col("toxic").cast("string"), F.lit("}]}}"),
    )
    labels = tables.table(spark, sf, "labels").select("doc_id", entry.alias("entry"))
    ends = labels.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    lines = labels.join(F.broadcast(ends)).select(  # one row
        "doc_id", F.concat(F.when(F.col("doc_id") == F.col("first"), "{").otherwise(""), "entry", F.when(F.col("doc_id") == F.col("last"), "}").otherwise(",")).alias("value")
    )
    lines.coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    entries = readers.read_label_entries(spark, path, split=True)
    return entries.select(
        "log_name",
        readers.label_of(F.col("entry"), "ping_flood").alias("label"),
        F.col("entry.flood_details.many_to_one")[0]["type"].alias("type"),
        F.col("entry.flood_details.many_to_one")[0]["packet_count"].alias("packet_count"),
    )


# --- files written and read back ---------------------------------------------------------------


def _file(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{os.urandom(6).hex()}"


@query
def lenient_scan(spark, sf):
    """Lines of 12 to 21 fields, as older captures write them; every fifth one is too short even for that."""
    lines = _line_table(tables.flows(spark, sf))
    kept = F.when(F.col("line_no") % 5 == 0, F.lit(11)).otherwise(12 + F.col("line_no") % 10).cast("int")
    short = lines.withColumn("value", F.array_join(F.slice(F.split("value", "\t"), F.lit(1), kept), "\t"))
    parsed = conn_log.parse_lines(short, conn_log.MIN_FIELDS_LENIENT)
    return parsed.select("line_no", "log_name", "ts_us", "src_ip", "dst_ip", "proto", "duration", "orig_bytes", "resp_bytes", "conn_state")


@query
def anomaly_file_scan(spark, sf):
    """Anomaly records through a CSV file; ports are written with gaps, as numbers with a point."""
    path, rows = _file(spark, "anomalies"), tables.anomalies(spark, sf)
    names = [f.name for f in ANOMALIES]
    port = {c: F.concat(F.col(c).cast("string"), F.lit(".0")) for c in ("srcPort", "dstPort")}
    rows.coalesce(1).sortWithinPartitions("row_no").withColumns(port).select(*names).write.csv(path, header=True)
    read = readers.read_anomalies(spark, path)
    return read.select("row_no", *names)


@query
def rule_file_scan(spark, sf):
    path, rows = _file(spark, "rules"), tables.rules(spark, sf)
    port = {c: F.concat(F.col(c), F.lit(".0")) for c in ("srcPort", "dstPort")}
    rows.withColumns(port).select(*RULE_FIELDS).write.csv(path, header=True)
    return readers.read_rules(spark, path).groupBy(*RULE_FIELDS).agg(F.count(F.lit(1)).alias("n"))


@query
def report_file_scan(spark, sf):
    """Reports as one text file each, read back by file name."""
    path, rows = _file(spark, "reports"), tables.reports(spark, sf)
    sinks.write_report_files(rows, path)
    listed = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    read = listed.select(F.regexp_extract(F.col("_metadata.file_path"), "report=([^/]+)", 1).alias("log_name"), F.col("value").alias("text"))
    # A written text ends in a line break.
    return read.select("log_name", F.regexp_replace("text", "\n$", "").alias("text"))


@query
def report_sink(spark, sf):
    path = _file(spark, "reports")
    sinks.write_reports(tables.reports(spark, sf), path)
    return spark.read.parquet(path)


@query
def metric_files(spark, sf):
    """Metrics per protocol as a CSV and as a JSON file."""
    flows = tables.flows(spark, sf)
    rows = flows.select("proto", (F.col("conn_state") == "S0").alias("label"), (F.col("dst_port") == 80).cast("int").alias("prediction"))
    found = _rounded_quality(metrics.confusion_metrics(rows, ["proto"])).select("proto", "tp", "tn", "fp", "fn", "total", *metrics.METRICS)
    found = cut_lineage(found, "metrics")
    read = []
    for form in ("csv", "json"):
        path = _file(spark, "metrics")
        sinks.write_metrics(found, path, form)
        schema = found.schema
        held = spark.read.csv(path, header=True, schema=schema) if form == "csv" else spark.read.json(path, schema=schema)
        read.append(held.withColumn("form", F.lit(form)))
    return read[0].unionByName(read[1])


@query
def result_file_scan(spark, sf):
    """Result files as a run saves them, one JSON object each, with their confusion counts."""
    counts = tables.flows(spark, sf).groupBy("proto").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("conn_state") == "S0").alias("s0"))
    saved = counts.select(
        F.lit("rule_based").alias("model_type"), F.col("proto").alias("attack_type"), (F.col("s0") / F.col("n")).alias("accuracy"),
        F.struct(F.col("s0").alias("TP"), (F.col("n") - F.col("s0")).alias("TN"), F.lit(0).alias("FP"), F.lit(1).alias("FN")).alias("confusion_matrix"),
        F.col("n").alias("total_samples"),
    )
    read = readers.read_metrics(spark, _one_file_each(spark, saved))
    return read.select("model_type", "attack_type", F.round("accuracy", 6).alias("accuracy"), "tp", "tn", "fp", "fn", "total_samples")


def _one_file_each(spark, rows: DataFrame) -> list[str]:
    """A JSON file per row; a handful of rows."""
    path = _file(spark, "results")
    rows.select(F.col("attack_type").alias("run"), F.to_json(F.struct(*rows.columns)).alias("value")).repartition("run").write.partitionBy("run").text(path)
    return [f"{path}/*"]


@query
def filtered_flow_file(spark, sf):
    """Flows that a rule matches as tab-separated text with a header, read back."""
    path, flows = _file(spark, "filtered"), tables.flows(spark, sf)
    sinks.write_filtered(rule_match.matches_any_rule(flows, tables.rules(spark, sf)), path)
    return spark.read.csv(path, sep="\t", header=True, schema=flows.schema).select(*_FLOW_ID, "src_port", "dst_port")


@query
def kb_collection_read(spark, sf):
    """Two collections appended to the knowledge table, one of them read."""
    path = _file(spark, "kb")
    sinks.append_knowledge(_anomaly_docs(spark, sf).drop("embedding"), path)
    parsed = documents.parse_heuristics(_heuristic_texts(spark, sf)).select("code", "label").distinct()
    sinks.append_knowledge(documents.heuristic_docs(parsed).drop("embedding"), path)
    one = readers.read_knowledge(spark, path, documents.HEURISTICS)
    return one.groupBy("collection", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def distance_similarity(spark, sf):
    """Cosine of each vector to the first one, from their squared distance."""
    vectors = tables.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = vectors.filter("vec_id = 0").select(F.col("v").alias("w"))
    apart = F.zip_with("v", "w", lambda a, b: (a - b) * (a - b))
    distance = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x)
    return vectors.join(F.broadcast(first)).select("vec_id", F.round(similarity_of(distance), 5).alias("similarity"))  # one row


# --- filters -----------------------------------------------------------------------------------

_FLOW_ID = ["line_no", "log_name", "ts_us", "src_ip", "dst_ip"]


@query
def icmp_echo_v1(spark, sf):
    return filters.echo_by_type(tables.flows(spark, sf)).select(*_FLOW_ID)


@query
def icmp_echo_v2(spark, sf):
    return filters.echo_by_pair(tables.flows(spark, sf)).select(*_FLOW_ID)


@query
def syn_state_filter(spark, sf):
    return filters.half_open(tables.flows(spark, sf)).select(*_FLOW_ID, "conn_state")


@query
def case_lines_with_fallback(spark, sf):
    cases = _fine_cases(tables.flows(spark, sf)).select("log_name", "line_no", "proto")
    return filters.protocol_or_all(cases, "icmp")


@query
def kb_metadata_filter(spark, sf):
    docs = documents.anomaly_docs(tables.anomalies(spark, sf))
    return filters.metadata_filter(docs, {"taxonomy": "ptpDoS", "label": "anomalous"}).select("doc_id", "text")


@query
def heuristic_category(spark, sf):
    code = F.col("o_orderkey") % 1000
    return tables.table(spark, sf, "orders").select(
        "o_orderkey", code.alias("code"), filters.heuristic_category(code).alias("category")
    )


@query
def query_filter_parse(spark, sf):
    opening = (
        F.when(F.col("conn_state") == "S0", "DDoS alert on Port ")
        .when(F.col("conn_state") == "SF", "Anomalous HTTP flood, port  ")
        .when(F.col("conn_state") == "REJ", "Suspicious portscan, anomalous port ")
        .when(F.col("conn_state") == "RSTO", "NetworkScan of report ")
        .otherwise("tcp traffic to ")
    )
    text = F.concat(opening, F.col("dst_port").cast("string"), F.lit(" from "), F.col("src_ip"))
    return tables.flows(spark, sf).select("line_no", filters.query_filters(text).alias("f")).select("line_no", "f.*")


@query
def echo_validation_band(spark, sf):
    capture = tables.flows(spark, sf).withColumn("log_name", F.lit("capture"))
    return filters.echo_validation_bands(capture, rule_match.anomaly_ip_set(tables.anomalies(spark, sf)))


# --- detection windows -------------------------------------------------------------------------


@query
def ping_burst(spark, sf):
    return bursts.ping_burst(tables.flows(spark, sf), window_us=WINDOW)


def _run_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{os.urandom(6).hex()}"


@query
def stream_ping_burst(spark, sf):
    """The same bursts from a stream of flow files in an order of their own; a last flow lets all windows close."""
    folder = _run_folder(spark)
    flows = tables.flows(spark, sf).filter("proto = 'icmp'").select("proto", "src_port", "dst_port", "dst_ip", "ts_us")
    # Four files: times are dealt out by a hash, so each file goes back to the beginning.
    flows.repartition(4, F.xxhash64("ts_us")).write.parquet(f"{folder}/in")
    last = flows.agg((F.max("ts_us") + 200 * WINDOW).alias("ts_us"))
    month = flows.agg(F.max("ts_us") - F.min("ts_us")).first()[0]
    closing = last.select(F.lit("icmp").alias("proto"), F.lit(0).alias("src_port"), F.lit(8).alias("dst_port"), F.lit("closing").alias("dst_ip"), "ts_us")
    for part in ("first", "second"):
        if part == "second":
            closing.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        found = stream_ping_bursts(arriving, window_us=WINDOW, delay_us=month or 0)
        run_available(found, f"{folder}/out", f"{folder}/state")
    return spark.read.schema("dst_ip string, start_us bigint, end_us bigint, count bigint").parquet(f"{folder}/out")


@query
def stream_intake(spark, sf):
    """Log files of which each comes twice, landed batch by batch; every flow is there once."""
    folder = _run_folder(spark)
    flows = tables.flows(spark, sf).withColumn("uid", F.col("line_no").cast("string"))
    flows.select(conn_log.to_line(flows).alias("value")).repartition(4).write.text(f"{folder}/once")
    for again in ("first", "second"):
        spark.read.text(f"{folder}/once").write.mode("append").text(f"{folder}/in/{again}")
    arriving = spark.readStream.option("maxFilesPerTrigger", 3).text(f"{folder}/in/*")
    named = arriving.select(F.lit("all").alias("log_name"), F.lit(None).cast("bigint").alias("line_no"), "value")
    land_batches(without_repeats(conn_log.parse_lines(named), "4000 days"), f"{folder}/out", f"{folder}/state")
    return read_batches(spark, f"{folder}/out").drop("log_name", "line_no", "ts", "uid", "service", "raw", "batch", "day")


@query
def kb_snapshots(spark, sf):
    """Anomaly documents, then suppliers put in their place, as two versions of a snapshot table."""
    table = SnapshotTable(spark, f"{checkpoint_dir(spark)}/kb-{os.urandom(6).hex()}", buckets=8)
    existing, new = _kb_rows(spark, sf)
    table.upsert(existing.withColumn("place", F.lit(0)), "place")
    table.upsert(new, "s_suppkey", mark=("suppliers", 1))
    # The same rows once more are a repeat.
    table.upsert(new.withColumn("text", F.lit("repeat")), "s_suppkey", mark=("suppliers", 1))
    return table.read().select("collection", "doc_id", "text", _shown_map("meta"))


@query
def syn_many_to_one(spark, sf):
    found = bursts.syn_many_to_one(tables.flows(spark, sf), window_us=WINDOW)
    return found.withColumns({c: F.array_join(c, ",") for c in ("source_ips", "conn_states")}).withColumn(
        "duration_seconds", F.round("duration_seconds", 6)
    )


@query
def syn_one_to_many(spark, sf):
    found = bursts.syn_one_to_many(tables.flows(spark, sf))
    return found.withColumns({c: F.array_join(c, ",") for c in ("target_ips", "conn_states")}).withColumn(
        "duration_seconds", F.round("duration_seconds", 6)
    )


@query
def ping_many_to_one(spark, sf):
    found = bursts.labelled_floods(tables.flows(spark, sf), "many_to_one", window_us=WINDOW, keys=())
    return found.withColumn("unique_src_ips", F.array_join("unique_src_ips", ","))


@query
def ping_one_to_many(spark, sf):
    found = bursts.labelled_floods(
        tables.flows(spark, sf), "one_to_many", threshold=LOG_THRESHOLD, window_us=20 * WINDOW, keys=()
    )
    return found.withColumn("unique_dst_ips", F.array_join("unique_dst_ips", ","))


# --- aggregations ------------------------------------------------------------------------------


@query
def protocol_profile(spark, sf):
    found = profile.protocol_profile(tables.flows(spark, sf), ["log_name"])
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.endswith("_pct")})


@query
def protocol_profile_total(spark, sf):
    found = profile.protocol_profile(tables.flows(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.endswith("_pct")})


@query
def tcp_state_census(spark, sf):
    return profile.tcp_state_census(tables.flows(spark, sf))


@query
def echo_count_by_dst(spark, sf):
    return profile.echo_count_by_target(tables.flows(spark, sf))


@query
def flow_features(spark, sf):
    return profile.flow_features(tables.flows(spark, sf)).select("log_name", *_six(*profile.FEATURES))


@query
def flow_features_from_state(spark, sf):
    """Features from daily states that arrive in halves; distinct counts are held against the exact ones."""
    flows = tables.flows(spark, sf)
    halves = [profile.daily_state(flows.filter(F.pmod("line_no", F.lit(2)) == k)) for k in (0, 1)]
    state = cut_lineage(halves[0].unionByName(halves[1]), "daily-state")
    exact = profile.flow_features(flows).select("log_name", *[F.col(c).alias(f"_{c}") for c in _SKETCHED])
    near = {c: F.abs(F.col(c) - F.col(f"_{c}")) <= 0.1 * F.col(f"_{c}") for c in _SKETCHED}
    whole = profile.flow_features_from_state(state).join(exact, "log_name").withColumns(near)
    return whole.select("log_name", *[c if c in _SKETCHED else F.round(c, 6).alias(c) for c in profile.FEATURES])


# Features that follow from sketches.
_SKETCHED = ("unique_src_ips", "unique_dst_ips", "src_ip_diversity", "dst_ip_diversity", "unique_src_ports", "unique_dst_ports")


@query
def flow_features_default(spark, sf):
    cases = tables.table(spark, sf, "documents").select(
        F.concat(F.lit("conn_log_part_"), F.col("doc_id").cast("string")).alias("log_name")
    )
    found = profile.features_or_zero(cases, profile.flow_features(tables.flows(spark, sf)))
    return found.select("log_name", *_six(*profile.FEATURES))


def _dataset(spark, sf):
    flows = tables.flows(spark, sf)
    return profile.feature_dataset(profile.flow_features(flows), labelling.state_label(flows))


@query
def feature_dataset(spark, sf):
    return _dataset(spark, sf).select("log_name", "label", *_six(*profile.FEATURES))


def _labels(spark, sf):
    ips = rule_match.anomaly_ip_set(tables.anomalies(spark, sf))
    return labelling.ping_flood_labels(tables.flows(spark, sf), ips, threshold=LOG_THRESHOLD, window_us=WINDOW)


@query
def label_counts(spark, sf):
    return profile.label_counts(_labels(spark, sf))


# --- joins -------------------------------------------------------------------------------------


@query
def wildcard_rule_filter(spark, sf):
    found = rule_match.matches_any_rule(tables.flows(spark, sf), tables.rules(spark, sf))
    return found.select(*_FLOW_ID, "src_port", "dst_port")


@query
def anomaly_ip_match_count(spark, sf):
    ips = rule_match.anomaly_ip_set(tables.anomalies(spark, sf))
    return rule_match.anomaly_ip_matches(tables.flows(spark, sf), ips)


@query
def ping_flood_labels(spark, sf):
    return _labels(spark, sf).withColumn("detection_reason", F.array_join("detection_reason", "; "))


@query
def flood_details(spark, sf):
    found = labelling.flood_details(tables.flows(spark, sf), threshold=LOG_THRESHOLD, window_us=WINDOW)
    return found.withColumns({c: F.array_join(c, ",") for c in ("unique_src_ips", "unique_dst_ips")})


@query
def state_label(spark, sf):
    return labelling.state_label(tables.flows(spark, sf))


def _unordered_flows(spark, sf):
    """Logs whose lines run against time, and every third log without line numbers."""
    number = F.floor(F.col("line_no") / 108)
    flows = tables.flows(spark, sf).withColumn("uid", F.concat(F.lit("C"), F.col("line_no").cast("string")))
    return flows.withColumn("line_no", F.when(number % 3 != 0, -F.col("line_no")))


@query
def state_label_record_order(spark, sf):
    return labelling.state_label(_unordered_flows(spark, sf))


@query
def decisive_state_record_order(spark, sf):
    return verdicts.decisive_states(_unordered_flows(spark, sf))


def _first_sentence(spark, sf):
    reports = tables.reports(spark, sf)
    return reports.select("log_name", verdicts.first_sentence_verdict(F.col("text")).alias("verdict"))


@query
def eval_join_report(spark, sf):
    return metrics.join_reports(labelling.state_label(tables.flows(spark, sf)), _first_sentence(spark, sf))


def _expert_labels(spark, sf):
    return tables.table(spark, sf, "labels").select(
        F.concat(F.lit("conn_log_part_"), F.col("doc_id").cast("string")).alias("log_name"),
        (F.col("quality") == 1).alias("label"),
    )


@query
def eval_join_baseline(spark, sf):
    scores = rule_scores.predictions(rule_scores.ping_rule_score(tables.flows(spark, sf)))
    return metrics.join_predictions(_expert_labels(spark, sf), scores).withColumn("score", F.round("score", 6))


@query
def pending_cases(spark, sf):
    cases = tables.flows(spark, sf).select("log_name").distinct()
    return labelling.pending_cases(cases, tables.reports(spark, sf))


@query
def case_batches(spark, sf):
    cases = _fine_cases(tables.flows(spark, sf)).select("log_name").distinct()
    return pipelines.case_batches(cases)


# --- documents ---------------------------------------------------------------------------------


@query
def extract_ips_from_text(spark, sf):
    ips = extract_ips(F.col("text"))
    return tables.table(spark, sf, "documents").select(
        "doc_id", F.size(ips).cast("bigint").alias("n_ips"), F.array_join(ips, ",").alias("ips")
    )


QUERIES["extract_ips"] = QUERIES.pop("extract_ips_from_text")


@query
def ping_alert_docs(spark, sf):
    alerts = documents.ping_alerts_with_totals(tables.flows(spark, sf), window_us=WINDOW)
    return documents.ping_alert_docs(alerts).select("doc_id", "text", F.col("meta.total_icmp_requests").alias("total"))


@query
def syn_alert_docs(spark, sf):
    alerts = bursts.syn_alerts(tables.flows(spark, sf), window_us=WINDOW)
    return documents.syn_alert_docs(alerts).select("doc_id", "text", F.col("meta.type").alias("type"))


@query
def anomaly_docs(spark, sf):
    return documents.anomaly_docs(tables.anomalies(spark, sf)).select(
        "doc_id", "text", F.col("meta.dstPort").alias("dst_port")
    )


@query
def unique_doc_ids(spark, sf):
    new = tables.table(spark, sf, "orders").select(
        # Bases that are other bases' suffix forms, and one with a third of all rows.
        F.when(F.col("o_orderkey") % 3 == 0, "anomaly_hot")
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("anomaly_hot_"), F.expr("o_custkey * 2").cast("string")))
        .otherwise(F.concat(F.lit("anomaly_"), F.col("o_custkey").cast("string")))
        .alias("doc_id"),
        F.col("o_orderkey").alias("row_no"),
    )
    customers = tables.table(spark, sf, "customer").withColumn("_id", F.concat(F.lit("anomaly_"), F.col("c_custkey").cast("string")))
    existing = customers.select(
        F.when(F.col("c_nationkey") < 8, F.col("_id"))
        .when(F.col("c_nationkey") < 16, F.concat("_id", F.lit("_2")))
        .otherwise(F.concat("_id", F.lit("_1")))
        .alias("doc_id")
    ).unionByName(customers.filter(F.col("c_acctbal") < 2000).select(F.concat("_id", F.lit("_1")).alias("doc_id")))
    return documents.unique_doc_ids(new, existing)


@query
def cap_lines(spark, sf):
    capped = cap_text(F.col("text"))
    return tables.table(spark, sf, "documents").select(
        "doc_id", F.length(capped).cast("bigint").alias("n_chars"), F.md5(capped).alias("digest")
    )


def _raw_flows(spark, sf):
    flows = tables.flows(spark, sf)
    return flows.withColumn("raw", conn_log.to_line(flows))


def _alerts(spark, sf):
    return evidence.alert_sections(filters.protocol_or_all(_raw_flows(spark, sf), "tcp"))


@query
def alert_sections(spark, sf):
    return _alerts(spark, sf)


# --- evidence and retrieval --------------------------------------------------------------------


def _anomaly_docs(spark, sf):
    return documents.anomaly_docs(tables.anomalies(spark, sf))


def _evidence(spark, sf):
    """Addresses of each log and the documents, both written once."""
    docs = cut_lineage(_anomaly_docs(spark, sf).select("doc_id", "text", "meta"), "anomalies")
    return cut_lineage(evidence.case_ips(tables.flows(spark, sf)), "addresses"), docs


@query
def ip_evidence_join(spark, sf):
    return evidence.ip_evidence(*_evidence(spark, sf))


def _heuristics(spark, sf):
    code = (F.col("p_partkey") % 1000).cast("string")
    named = tables.table(spark, sf, "part").groupBy(code.alias("code")).agg(F.min("p_name").alias("label"))
    return named.select("code", alert_text.heuristic_text(F.col("code"), F.col("label")).alias("text"))


@query
def heuristic_evidence_join(spark, sf):
    return evidence.heuristic_evidence(*_evidence(spark, sf), _heuristics(spark, sf))


@query
def heuristic_token_join(spark, sf):
    return evidence.heuristic_evidence(*_evidence(spark, sf), _heuristics(spark, sf), by_token=True)


@query
def taxonomy_category_join(spark, sf):
    return evidence.taxonomy_evidence(*_evidence(spark, sf), taxonomy.taxonomy_prefixes(spark))


def _vectors(spark, sf):
    table = tables.table(spark, sf, "embeddings")
    kb = table.select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.col("embedding").alias("vector"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("meta"),
    )
    return kb.select(F.col("doc_id").alias("query_id"), "vector"), kb


@query
def vector_topk(spark, sf):
    return _shown(retrieval.vector_topk(*_vectors(spark, sf), k=6))


@query
def vector_topk_indexed(spark, sf):
    """Neighbours through an index built for the purpose, held against the exact ones: how many queries, rows, and whether nine in ten are there."""
    queries, kb = _vectors(spark, sf)
    index = VectorIndex.build(kb, f"{checkpoint_dir(spark)}/index-{os.urandom(6).hex()}", k=6)
    found = cut_lineage(index.search(queries, k=6), "indexed")
    counts = found.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_rows"))
    recall = recall_of(found, retrieval.vector_topk(queries, kb, k=6))
    return counts.join(recall).select("n_queries", "n_rows", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 6))


@query
def vector_topk_query_filter(spark, sf):
    """Every other query has a filter of its own."""
    queries, kb = _vectors(spark, sf)
    number = F.col("query_id").cast("bigint")
    wanted = F.when(number % 2 == 0, F.create_map(F.lit("label"), (number % 5).cast("string")))
    return _shown(retrieval.vector_topk(queries.withColumn("wanted", wanted), kb, k=6))


@query
def vector_topk_filtered(spark, sf):
    return _shown(retrieval.vector_topk_filtered(*_vectors(spark, sf), {"label": "3"}, k=6))


@query
def vector_mmr(spark, sf):
    return _shown(retrieval.vector_mmr(*_vectors(spark, sf), k=4))


@query
def evidence_gate(spark, sf):
    docs = tables.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("case_id"),
        extract_ips(F.col("text")).alias("ips"),
        filters.query_filter_map(F.col("text")).alias("filters"),
    )
    hits = retrieval.vector_topk(*_vectors(spark, sf), k=18).filter("query_id <> doc_id")
    matched = docs.select(F.col("case_id").alias("doc_id"), F.col("ips").alias("_doc_ips"))
    scored = (
        hits.withColumnRenamed("query_id", "case_id")
        .join(docs.select("case_id", "ips"), "case_id")
        .join(matched, "doc_id")
        .select("case_id", "similarity", F.arrays_overlap("ips", "_doc_ips").alias("names_ip"))
    )
    return evidence.evidence_gate(docs, scored)


@query
def lexical_rerank(spark, sf):
    words = evidence.case_words(_raw_flows(spark, sf))
    ranked = pipelines.anomalies_by_address(words, *_evidence(spark, sf))
    return ranked.select("log_name", "doc_id", F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, sf):
    """The ten best documents for each benchmark item by the words of its text."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    items = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("token"))
    weights = cut_lineage(postings.impacts(docs, all_tokens(F.col("text")), only=items), "impacts")
    blocks = cut_lineage(postings.impact_blocks(weights), "blocks")
    return postings.best_documents(items, weights, blocks, 10)


@query
def tfidf_vectors(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    terms = retrieval.tfidf_terms(docs, all_tokens(F.col("text")))
    return terms.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.round(F.max("weight"), 6).alias("max_weight"),
        F.round(F.sum("weight"), 4).alias("sum_weight"),
    )


@query
def case_prompts(spark, sf):
    prompts = pipelines.prompts(
        _raw_flows(spark, sf), _anomaly_docs(spark, sf), _heuristics(spark, sf), taxonomy.taxonomy_prefixes(spark)
    )
    return prompts


@query
def evidence_within_budget(spark, sf):
    """The anomaly texts of each log that fit into 300 characters, those with the largest heuristic code first."""
    ips, docs = _evidence(spark, sf)
    texts = docs.select("doc_id", "text", F.col("meta.heuristic").cast("double").alias("score"))
    return evidence.within_budget(evidence.texts_of_addresses(ips, docs, texts, 300), 300).select("log_name", "text", "score")


@query
def query_prompts(spark, sf):
    """Documents as questions, with their vectors; anomalies answer with vectors of their own."""
    vectors = tables.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    cases = tables.table(spark, sf, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").cast("string").alias("case_id"), "text", "vector")
    docs = _anomaly_docs(spark, sf).drop("embedding")
    number = F.regexp_extract("doc_id", "([0-9]+)$", 1).cast("bigint")
    answers = docs.withColumn("_n", number).join(vectors, F.col("_n") == F.col("vec_id")).select("doc_id", "text", "meta", "vector")
    made = pipelines.query_prompts(cases, answers, _heuristics(spark, sf))
    return made.select("case_id", "abstain", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query
def kb_alert_rows(spark, sf):
    rows = pipelines.alert_rows(tables.flows(spark, sf), WINDOW, WINDOW)
    return rows.select("collection", "doc_id", "text", F.size("meta").cast("bigint").alias("n_meta"))


# --- reports and verdicts ----------------------------------------------------------------------


@query
def report_fields(spark, sf):
    fields = verdicts.report_fields(F.col("text"))
    return tables.reports(spark, sf).select("log_name", *[c.alias(n) for n, c in fields.items()])


@query
def verdict_first_sentence(spark, sf):
    text = F.col("text")
    return tables.table(spark, sf, "documents").select("doc_id", verdicts.first_sentence_verdict(text).alias("verdict"))


@query
def verdict_syn_cascade(spark, sf):
    return verdicts.syn_verdicts(tables.reports(spark, sf), tables.flows(spark, sf))


@query
def verdict_syn_text_only(spark, sf):
    return verdicts.syn_verdicts(tables.reports(spark, sf))


@query
def verdict_strict(spark, sf):
    text = F.col("text")
    strict = verdicts.strict_verdict(text, verdicts.first_sentence_verdict(text))
    return tables.reports(spark, sf).select("log_name", strict.alias("verdict"))


# --- evaluation --------------------------------------------------------------------------------


def _report_predictions(spark, sf):
    joined = metrics.join_reports(labelling.state_label(tables.flows(spark, sf)), _first_sentence(spark, sf))
    return joined.withColumn("prediction", F.col("verdict").cast("int"))


def _rounded_quality(df: DataFrame, *extra: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in (*metrics.METRICS, *extra)})


@query
def confusion_metrics(spark, sf):
    return _rounded_quality(metrics.confusion_metrics(_report_predictions(spark, sf)))


@query
def metric_intervals(spark, sf):
    rows = _report_predictions(spark, sf)
    return _rounded_quality(metrics.metric_intervals(rows, replicates=50), *[f"{c}_{end}" for c in metrics.METRICS for end in ("low", "high")])


@query
def roc_auc_binary(spark, sf):
    rows = _report_predictions(spark, sf).filter(F.col("prediction").isNotNull())
    return metrics.roc_auc(rows, score="prediction").withColumn("auc", F.round("auc", 6))


def _scored_flows(spark, sf):
    return tables.flows(spark, sf).select(
        "proto", (F.col("conn_state") == "S0").alias("label"), F.col("duration").alias("score")
    )


@query
def roc_curve(spark, sf):
    points = metrics.roc_points(_scored_flows(spark, sf), ["proto"])
    return points.select("proto", "score", "tp", "fp", *_six("tpr", "fpr"))


@query
def roc_auc_scores(spark, sf):
    return metrics.roc_auc(_scored_flows(spark, sf), ["proto"]).withColumn("auc", F.round("auc", 6))


def _rule_rows(spark, sf, attack: str, labels: DataFrame) -> DataFrame:
    rule = rule_scores.ping_rule_score if attack == "ping" else rule_scores.syn_rule_score
    return metrics.join_predictions(labels, rule_scores.predictions(rule(tables.flows(spark, sf))))


@query
def model_comparison(spark, sf):
    labels = cut_lineage(labelling.state_label(tables.flows(spark, sf)), "labels")
    models = {
        "report": _report_predictions(spark, sf).select("label", "prediction", F.col("prediction").cast("double").alias("score")),
        "rule_ping": _rule_rows(spark, sf, "ping", labels).select("label", "prediction", "score"),
        "rule_syn": _rule_rows(spark, sf, "syn", labels).select("label", "prediction", "score"),
    }
    rows = reduce(DataFrame.unionByName, [r.withColumn("model", F.lit(m)) for m, r in models.items()])
    return metrics.compare_models(metrics.evaluate(rows, ["model"]))


@query
def scenario_matrix(spark, sf):
    flood = cut_lineage(_labels(spark, sf).select("log_name", F.col("ping_flood_detected").alias("label")), "labels")
    automatic = {"ping": flood, "syn": cut_lineage(labelling.state_label(tables.flows(spark, sf)), "labels")}
    rows = None
    for attack, labels in automatic.items():
        for source, chosen in (("automatic", labels), ("expert", _expert_labels(spark, sf))):
            part = _rule_rows(spark, sf, attack, chosen).select(
                F.lit(attack).alias("attack"), F.lit(source).alias("label_source"), "label", "prediction"
            )
            rows = part if rows is None else rows.unionByName(part)
    return metrics.scenario_matrix(rows, ["automatic", "expert"])


# --- rules and classifiers ---------------------------------------------------------------------


@query
def rule_ping_score(spark, sf):
    found = rule_scores.ping_rule_score(tables.flows(spark, sf), time_window=86_400)
    return found.withColumns({c: F.round(c, 6) for c in ("confidence", "icmp_ratio", "time_span")})


@query
def rule_override(spark, sf):
    """Both rule scores under other thresholds."""
    flows = tables.flows(spark, sf)
    ping = rule_scores.ping_rule_score(flows, icmp_threshold=30, icmp_ratio=0.2, time_window=43_200)
    syn = rule_scores.syn_rule_score(flows, s0_threshold=12, s0_ratio=0.15, syn_rate=0.001)
    kept = ["log_name", "detected", "rules_matched"]
    return ping.select(F.lit("ping").alias("rules"), *kept).unionByName(syn.select(F.lit("syn").alias("rules"), *kept))


@query
def rule_syn_score(spark, sf):
    found = rule_scores.syn_rule_score(tables.flows(spark, sf), s0_ratio=0.2)
    return found.withColumns({c: F.round(c, 6) for c in ("confidence", "s0_ratio", "syn_rate", "time_span")})


@query
def scaled_features(spark, sf):
    scaled = ml.scaled_features(profile.flow_features(tables.flows(spark, sf)))
    return scaled.select("log_name", *[F.round(c, 4).alias(c) for c in profile.FEATURES])


def _model_rows(spark, sf, model: str) -> DataFrame:
    return ml.train_and_score(cut_lineage(_dataset(spark, sf), "dataset"), model).withColumn("score", F.round("score", 6))


@query
def ml_svm(spark, sf):
    return _model_rows(spark, sf, "svm")


@query
def ml_random_forest(spark, sf):
    return _model_rows(spark, sf, "random_forest")


@query
def ml_mlp(spark, sf):
    return _model_rows(spark, sf, "mlp")


@query
def ml_comparison(spark, sf):
    flows = tables.flows(spark, sf)
    return _rounded_quality(pipelines.baselines(flows, labelling.state_label(flows)), "auc")


@query
def ml_held_out(spark, sf):
    """What is sure of each model: the held-out logs and their labels, predictions that are labels, scores in their range."""
    dataset = cut_lineage(_dataset(spark, sf), "dataset")
    in_range = (F.col("model") == "svm") | F.col("score").between(0, 1)
    return ml.train_and_score_each(dataset).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("label").cast("bigint")).alias("n_attacks"),
        F.min("log_name").alias("first_log"),
        F.every(F.col("prediction").isin(0, 1) & in_range).alias("valid"),
    )


@query
def ml_quality(spark, sf):
    """Each model on held-out cases (a log and a target) with more half-open flows than usual: sizes, and whether it is at least as often right as the more frequent label."""
    features = profile.flow_features(_fine_cases(tables.flows(spark, sf)))
    dataset = cut_lineage(features.withColumn("label", (F.col("s0_ratio") > 1 / 6).cast("int")), "dataset")
    training, test = ml.held_out(dataset)
    attacks = F.sum(F.col("label").cast("bigint"))
    usual = test.agg(F.count(F.lit(1)).alias("n_test"), F.greatest(attacks, F.count(F.lit(1)) - attacks).alias("most"))
    sizes = training.agg(F.count(F.lit(1)).alias("n_train")).join(usual)
    rows = ml.train_and_score_each(dataset, (*ml.MODELS, "svm_rbf"))
    right = F.count_if(F.col("label").cast("int") == F.col("prediction")).alias("right")
    found = rows.groupBy("model").agg(right).join(F.broadcast(sizes))  # one row
    return found.select("model", "n_train", "n_test", (F.col("right") >= F.col("most")).alias("as_good_as_majority"))


@query
def ml_saved_model(spark, sf):
    """A model that was saved and loaded predicts what the fitted one does."""
    dataset, path = cut_lineage(_dataset(spark, sf), "dataset"), _file(spark, "model")
    fitted = ml.train(dataset, "svm")
    ml.save(fitted, path)
    again = ml.predict(ml.load(path), dataset).withColumnsRenamed({"prediction": "_p", "score": "_s"})
    same = (F.col("prediction") == F.col("_p")) & (F.col("score") == F.col("_s"))
    return ml.predict(fitted, dataset).join(again, "log_name").select("log_name", same.alias("same"))


@query
def ml_svm_rbf(spark, sf):
    """Points of the plane, labelled by their distance from the middle: what a Gaussian kernel parts and a plane cannot."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    points = tables.table(spark, sf, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("log_name"), x.alias("x"), y.alias("y"))
    ring = cut_lineage(points.withColumn("label", (F.col("x") * F.col("x") + F.col("y") * F.col("y") > 0.02).cast("int")), "ring")
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    by_model = {m: ml.train_and_score(ring, m, columns=["x", "y"]).agg(F.count(F.lit(1)).alias("n_test"), right.alias(m)) for m in ("svm", "svm_rbf")}
    both = by_model["svm"].join(by_model["svm_rbf"].drop("n_test"))
    return both.select("n_test", (F.col("svm_rbf") > F.col("svm")).alias("beats_linear"), (F.col("svm_rbf") > 0.9).alias("nine_in_ten"))


# --- streaming twin ----------------------------------------------------------------------------


@query
def flood_window_counts_batch(spark, sf):
    echoes = filters.echo_by_type(tables.flows(spark, sf)).withColumn("ts", F.timestamp_micros("ts_us"))
    counts = flood_window_counts(echoes, threshold=5, length="12 hours", slide="3 hours", delay=None)
    return counts.select(
        "dst_ip", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "n"
    )


QUERIES["flood_window_counts"] = QUERIES.pop("flood_window_counts_batch")
