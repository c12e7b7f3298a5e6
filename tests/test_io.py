"""Files in and out: conn logs, anomalies, labels, reports, parts, the knowledge table and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowspark.functions.taxonomy import taxonomy_groups
from flowspark.operators import documents, filters, labelling, rule_match
from flowspark.sinks import tables as sinks
from flowspark.sources import conn_log, tables
from flowspark.streaming import flows as streaming
from tests import flows as gen

NAMES = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state "
    "local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes tunnel_parents ip_proto"
).split()
STATES = "S0 S1 SF REJ S2 S3 RSTO RSTR RSTOS0 RSTRH SH SHR OTH".split()


def line(ts="1704067200.000001", src="10.0.0.1", sport="8", dst="192.0.2.1", dport="0", proto="icmp", dur="-", ob="-", rb="-", state="OTH", n=22):
    fields = [ts, "Cuid", src, sport, dst, dport, proto, "-", dur, ob, rb, state, "-", "-", "0", "Dd", "3", "0", "-", "0", "-", "1"]
    return "\t".join(fields[:n])


LOG = [
    "#separator \\x09", "#fields\t" + "\t".join(NAMES), line(), "", line(n=21), "\t".join(NAMES),
    line(ts="1704067201.5", dur="0.25", ob="10", rb="20", proto="tcp", state="S0", sport="1234", dport="80"),
    line(ts="1704067202", ob="many"), line(ts="yesterday"), line(ts="1704067203.25", sport="0", dport="8"), "#close\t2024",
]


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.b.log").write_text("\n".join(LOG) + "\n")
    (folder / "empty.log").write_text("#fields\tts\n")
    return str(folder)


def test_conn_log(spark, logs):
    rows = conn_log.read_conn_log(spark, logs + "/*.log").orderBy("line_no").collect()
    assert [(r.log_name, r.ts_us) for r in rows] == [("a.b", 1704067200000001), ("a.b", 1704067201500000), ("a.b", 1704067203250000)]
    first, second = rows[0], rows[1]
    assert (first.duration, first.orig_bytes, first.resp_pkts, first.orig_pkts, first.src_port) == (None, None, None, 3, 8)
    assert (second.duration, second.orig_bytes, second.resp_bytes, second.conn_state, second.dst_port) == (0.25, 10, 20, "S0", 80)
    assert second.raw.startswith("1704067201.5\tCuid") and second.uid == "Cuid"
    rejected = conn_log.rejected_lines(conn_log.read_lines(spark, logs)).collect()
    assert sorted(r.problem for r in rejected) == ["orig_bytes", "ts", "ts"]
    lenient = conn_log.read_conn_log(spark, logs, conn_log.MIN_FIELDS_LENIENT)
    assert lenient.count() == 4


def test_landed_flows(spark, logs, tmp_path):
    sinks.write_flows(conn_log.read_conn_log(spark, logs + "/*.log"), str(tmp_path / "flows"))
    flows = tables.read_flows(spark, str(tmp_path / "flows"))
    assert flows.count() == 3
    plan = filters.echo_by_type(flows.filter("day = '2024-01-01'")).select("dst_ip")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(proto), IsNotNull(dst_port), EqualTo(proto,icmp), EqualTo(dst_port,8)]" in plan
    assert "ReadSchema: struct<dst_ip:string,dst_port:int,proto:string>" in plan and "day#" in plan.split("PartitionFilters")[1]


def test_line_numbers_follow_the_file_when_it_is_split(spark, tmp_path):
    n = 3000
    (tmp_path / "big.log").write_text("\n".join(line(ts=f"{1704067200 + i}.0") for i in range(n)) + "\n")
    for i in range(5):
        (tmp_path / f"small{i}.log").write_text("\n".join(line(ts=f"{1704067200 + j}.0") for j in range(20)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        flows = conn_log.read_conn_log(spark, str(tmp_path / "*.log"))
        assert flows.rdd.getNumPartitions() > 5
        rows = flows.select("log_name", "line_no", "ts_us").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_log = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        by_log.setdefault(r.log_name, []).append(r.ts_us)
    assert len(by_log["big"]) == n and all(times == sorted(times) for times in by_log.values())
    assert len({(r.log_name, r.line_no) for r in rows}) == len(rows)


def test_header_driven_scan_and_filter_sink(spark, logs, tmp_path):
    rows = conn_log.read_by_header(spark, logs + "/a.b.log")
    assert rows.columns == NAMES
    flows = conn_log.flows_by_header(rows)
    rules = spark.createDataFrame([("10.0.0.1", None, None, "80")], "srcIP string, srcPort string, dstIP string, dstPort string")
    kept = rule_match.matches_any_rule(flows, rules).select("source_row.*")
    out = str(tmp_path / "filtered")
    sinks.write_filtered(kept, out)
    back = conn_log.read_lines(spark, out)
    assert [r.value.split("\t")[0] for r in back.orderBy("line_no").collect()] == ["ts", "1704067201.5"]
    # The header of a filtered file has no "#"; it is not a flow.
    assert conn_log.parse_lines(back).count() == 1
    with pytest.raises(ValueError):
        conn_log.rows_by_header(spark.createDataFrame([("a", 0, "x")], "log_name string, line_no bigint, value string"))


def test_anomalies_and_rules(spark, tmp_path):
    header = "srcIP,srcPort,dstIP,dstPort,taxonomy,heuristic,label\n"
    (tmp_path / "one.csv").write_text(header + "1.2.3.4,80.0,,,ntscIC,20,suspicious\n,,11.2.3.45,,DoS,10,anomalous\n")
    (tmp_path / "two.csv").write_text(header + "5.6.7.8,1,9.9.9.9,2,unk,20,\n")
    rows = tables.read_anomalies(spark, str(tmp_path / "*.csv"))
    got = {(r.file_name, r.row_no): (r.srcIP, r.srcPort, r.dstPort, r.heuristic) for r in rows.collect()}
    assert got == {("one.csv", 0): ("1.2.3.4", 80, None, 20), ("one.csv", 1): (None, None, None, 10), ("two.csv", 0): ("5.6.7.8", 1, 2, 20)}
    assert {r.ip for r in rule_match.anomaly_ip_set(rows).collect()} == {"1.2.3.4", "5.6.7.8", "9.9.9.9"}
    existing = spark.createDataFrame([("anomaly_0",)], "doc_id string")
    docs = {r.doc_id: r for r in documents.anomaly_docs(rows.filter("file_name = 'two.csv'"), existing).collect()}
    assert docs["anomaly_0_1"].text.startswith("Anomaly ID anomaly_0_1: A unknown connection was detected from source IP 5.6.7.8 on port 1 ")
    assert docs["anomaly_0_1"].meta["label"] == "unknown"
    (tmp_path / "ips.txt").write_text("ip,heuristic\n7.7.7.7,20\n8.8.8.8,10\n")
    assert [r.ip for r in rule_match.anomaly_ip_set(tables.read_anomaly_ips(spark, str(tmp_path / "ips.txt"))).collect()] == ["7.7.7.7"]
    rules = tables.read_rules(spark, str(tmp_path / "one.csv"))
    assert [tuple(r) for r in rules.collect()][0] == ("1.2.3.4", "80", None, None)


def test_heuristic_text(spark, tmp_path):
    codes = (10, 20, 499, 500, 899, 900)
    text = "Codes\n" + "".join(f"* {c}: label {c} \n" for c in codes) + "Anomaly taxonomy\n* 7: no\n"
    (tmp_path / "info.txt").write_text(text)
    found = documents.parse_heuristics(tables.read_heuristic_text(spark, str(tmp_path / "info.txt")))
    got = {int(r.code): (r.label, r.category) for r in found.collect()}
    assert set(got) == set(codes) and got[10][0] == "label 10"
    assert [got[c][1] for c in codes] == [filters.SUSPICIOUS_TEXT] * 3 + [filters.NORMAL_TEXT] * 2 + [filters.UNKNOWN_TEXT]
    docs = documents.taxonomy_docs(taxonomy_groups(spark)).collect()
    assert len(docs) == 11 and {d.meta["type"] for d in docs} == {"taxonomy_group"}


def test_labels_and_reports(spark, tmp_path):
    (tmp_path / "labels.json").write_text(
        json.dumps(
            {
                "a.log": {"ping_flood_detected": True, "num_floods": 1, "flood_details": {"many_to_one": [], "one_to_many": []}, "matching_anomaly_rows": 5, "detection_reason": ["x"]},
                "b.part.log": {"syn_flood_detected": True},
                "c.log": {"error": "bad"},
            },
            indent=2,
        )
    )
    for attack, want in (("ping_flood", [True, False, False]), ("syn_flood", [False, True, False]), ("other", [False] * 3)):
        got = tables.read_label_map(spark, str(tmp_path / "labels.json"), attack).orderBy("log_name").collect()
        assert [(r.log_name, r.label) for r in got] == list(zip(["a", "b.part", "c"], want))
    (tmp_path / "labels.txt").write_text("a.log = True\n\nno sign\n b.log=TRUE \nc.log = yes\nd.log = a = b\n")
    got = {r.log_name: r.label for r in tables.read_label_lines(spark, str(tmp_path / "labels.txt")).collect()}
    assert got == {"a": True, "b": True, "c": False}
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "a.txt").write_text("line one\nline two")
    assert [tuple(r) for r in tables.read_reports(spark, str(tmp_path / "reports")).collect()] == [("a", "line one\nline two")]
    out = str(tmp_path / "report_table")
    sinks.write_reports(tables.read_reports(spark, str(tmp_path / "reports")), out)
    pending = labelling.pending_cases(spark.createDataFrame([("a",), ("b",)], "log_name string"), spark.read.parquet(out))
    assert [r.log_name for r in pending.collect()] == ["b"]


def test_metrics_files(spark, tmp_path):
    result = {"model_type": "rule_based", "accuracy": 0.5, "confusion_matrix": {"TP": 1, "TN": 2, "FP": 3, "FN": 4}, "total_samples": 10}
    (tmp_path / "m.json").write_text(json.dumps(result, indent=2))
    row = tables.read_metrics(spark, str(tmp_path / "m.json")).collect()[0]
    assert (row.model_type, row.tp, row.tn, row.fp, row.fn, row.accuracy) == ("rule_based", 1, 2, 3, 4, 0.5)
    for form in ("csv", "json"):
        out = str(tmp_path / form)
        sinks.write_metrics(spark.createDataFrame([("m", 0.5)], "model string, accuracy double"), out, form)
        assert len([f for f in os.listdir(out) if f.startswith("part-")]) == 1


def test_parts_on_disk(spark, logs, tmp_path):
    out = str(tmp_path / "parts")
    sinks.write_parts(conn_log.read_lines(spark, logs + "/a.b.log"), out, rows_per_part=3)
    log = out + "/log_name=a.b"
    assert sorted(d for d in os.listdir(log) if d.startswith("part_name")) == [f"part_name=conn_log_part_{i}" for i in (1, 2, 3)]
    rows = spark.read.text(log + "/part_name=conn_log_part_1").collect()
    assert rows[0].value.startswith("#separator") and rows[1].value.startswith("#fields") and len(rows) == 3 + 3


def test_parts_of_several_logs_stay_apart(spark, tmp_path):
    lines = spark.createDataFrame(
        [(log, i, text) for log in ("a", "b") for i, text in enumerate(["#h " + log, "x" + log, "y" + log, "z" + log])],
        "log_name string, line_no bigint, value string",
    )
    sinks.write_part_table(lines, str(tmp_path / "table"), rows_per_part=2)
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.log_name, r.part, r.block, r.line_no)):
        got.setdefault((r.log_name, r.part_name), []).append(r.value)
    assert got == {(log, f"conn_log_part_{k}"): ["#h " + log, *[x + log for x in part]] for log in "ab" for k, part in ((1, "xy"), (2, "z"))}


def test_each_file_has_its_own_header(spark):
    lines = [("a", 0, "#fields\tts\tid.orig_h\tid.resp_h"), ("a", 1, "1.5\t1.1.1.1\t2.2.2.2")]
    lines += [("b", 0, "#fields\tts\tid.resp_h\tid.orig_h\textra"), ("b", 1, "2.5\t4.4.4.4\t3.3.3.3\t")]
    rows = conn_log.rows_by_header(spark.createDataFrame(lines, "log_name string, line_no bigint, value string"))
    assert set(rows.columns) == {"ts", "id.orig_h", "id.resp_h", "extra"}
    got = {(r["ts"], r["id.orig_h"], r["id.resp_h"], r["extra"]) for r in rows.collect()}
    assert got == {("1.5", "1.1.1.1", "2.2.2.2", None), ("2.5", "3.3.3.3", "4.4.4.4", None)}
    with pytest.raises(ValueError):
        conn_log.rows_by_header(spark.createDataFrame([*lines, ("c", 0, "1.5\tx")], "log_name string, line_no bigint, value string"))


def test_knowledge_table(spark, tmp_path):
    path = str(tmp_path / "kb")

    def docs(collection, rows):
        table = spark.createDataFrame(rows, "doc_id string, text string")
        return table.select(F.lit(collection).alias("collection"), "doc_id", "text", F.create_map(F.lit("k"), "text").alias("meta"))

    sinks.upsert_knowledge(docs("x", [("1", "old"), ("1", "a"), ("2", "b")]), path)
    sinks.append_knowledge(docs("y", [("1", "c")]), path)
    sinks.upsert_knowledge(docs("x", [("2", "B"), ("3", "d")]), path)
    got = {(r.collection, r.doc_id): r.text for r in tables.read_knowledge(spark, path).collect()}
    assert got == {("x", "1"): "a", ("x", "2"): "B", ("x", "3"): "d", ("y", "1"): "c"}
    one = tables.read_knowledge(spark, path, "y")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(collection" in one._jdf.queryExecution().executedPlan().toString()


def test_label_sink_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, ["r1", "r2"])], "log_name string, ping_flood_detected boolean, detection_reason array<string>")
    sinks.write_labels(rows, str(tmp_path / "labels"))
    back = spark.read.json(str(tmp_path / "labels"), schema=rows.schema).collect()
    assert back == rows.collect()


def test_label_file_round_trip(spark, tmp_path):
    flows = gen.make(spark, [dict(log_name="flood", ts_us=i * 1000, src_ip=f"10.0.0.{i % 4}") for i in range(12)])
    cases = spark.createDataFrame([("flood",), ("quiet",)], "log_name string")
    ips = spark.createDataFrame([], "ip string")
    labels = labelling.ping_flood_labels(flows, ips, cases=cases)
    errors = spark.createDataFrame([("broken", "unreadable")], "log_name string, error string")
    sinks.write_label_file(labelling.label_entries(labels, labelling.flood_details(flows), errors), str(tmp_path / "labels"))
    back = {r.log_name: r.entry for r in tables.read_label_entries(spark, str(tmp_path / "labels"), per_line=True).collect()}
    assert set(back) == {"flood", "quiet", "broken"} and back["broken"].error == "unreadable"
    assert back["flood"].ping_flood_detected and back["flood"].num_floods == len(back["flood"].flood_details.many_to_one) == 1
    assert back["flood"].flood_details.many_to_one[0].packet_count >= 10 and not back["quiet"].ping_flood_detected
    flags = {r.log_name: r.label for r in tables.read_label_map(spark, str(tmp_path / "labels"), per_line=True).collect()}
    assert flags == {"flood": True, "quiet": False, "broken": False}


def test_stream_resumes(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(LOG) + "\n")
    streaming.run_available(streaming.stream_conn_log(spark, str(folder), files_per_batch=1), out, state)
    assert spark.read.parquet(out).count() == 3
    (folder / "b.log").write_text(line() + "\n")
    streaming.run_available(streaming.stream_conn_log(spark, str(folder), files_per_batch=1), out, state)
    rows = spark.read.parquet(out)
    assert rows.count() == 4 and {r.log_name for r in rows.collect()} == {"a", "b"}


def test_stream_counts_and_late_rows(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def put(name, *seconds):
        (folder / name).write_text("\n".join(line(ts=f"{1704067200 + s}.0", sport="0", dport="8") for s in seconds) + "\n")
        rows = filters.echo_by_type(streaming.stream_conn_log(spark, str(folder)))
        counts = streaming.flood_window_counts(rows, threshold=3, length="20 seconds", slide="20 seconds")
        streaming.run_available(counts, out, state)

    put("a.log", 1, 2, 3, 25)
    put("b.log", 200)  # moves the watermark past the first windows
    put("c.log", 4, 5, 26, 400)  # too late for them
    put("d.log", 900)
    got = {(r.window_start.second, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 3)}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_object_is_read_by_many_tasks(spark, tmp_path, indent):
    """Rows of a file that is one object, cut anywhere: braces, quotes and backslashes in strings, entries that are no objects."""
    held = {}
    for k in range(900):
        held[f"log_{k}.log"] = {
            "ping_flood_detected": k % 3 == 0,
            "num_floods": k,
            "flood_details": {"many_to_one": [{"type": 'a"}{\\\\"' + "}" * (k % 4), "unique_src_ips": ["}", "[", "\\"]}] * (k % 3), "one_to_many": []},
            "error": "é{\\" if k % 7 == 0 else None,
        }
        if k % 100 == 50:
            held[f"odd_{k}.log"] = None
    folder = tmp_path / "labels"
    folder.mkdir()
    for name, part in (("a.json", held), ("empty.json", {}), ("one.json", {"single.log": {"num_floods": 1}}), ("last.json", {"x.log": {"num_floods": 2}, "y.log": None})):
        (folder / name).write_text(json.dumps(part, indent=indent, ensure_ascii=False) + "\n")
    whole = tables.read_label_entries(spark, str(folder))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = tables.split_object(spark, str(folder), bytes_per_cell=5_000)
        assert spark.read.option("lineSep", "}").text(str(folder / "a.json")).rdd.getNumPartitions() > 5
        split = tables.parse_label_map(pieces)
        key = lambda r: r[0]
        shown = lambda df: sorted(((r.log_name, r.entry.asDict(True) if r.entry else None) for r in df.collect()), key=key)
        assert shown(split) == shown(whole) and split.count() == 900 + 9 + 1 + 2
        # Each object of a file is an entry of its own.
        assert pieces.filter(F.col("file").endswith("a.json")).count() == 900
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_report_files_are_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILES_PER_TASK", 4)
    reports = spark.createDataFrame([(f"log{i}", f"text {i}\nmore") for i in range(40)], "log_name string, text string")
    sinks.write_report_files(reports, str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("report=*/part-*"))
    assert len(files) == 40 and len({f.name[:10] for f in files}) > 4
    sinks.write_report_files(reports.limit(0), str(tmp_path / "none"))
