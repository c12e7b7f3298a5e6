"""Verdicts, report fields, query filters, the gate and the metric arithmetic."""

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evidence, filters, labelling, metrics, profile, rule_scores, verdicts
from flowspark.functions.text import extract_ips
from tests import flows as gen


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "text,want",
    [
        ("", None), (" \n\t ", None), ("Attack seen. No doubt.", True), ("No attack. Yes.", False),
        ("An anomaly was seen. Attack.", False), ("Burst in conn.log against x. None.", True),
        ("Burst in conn.log, not an attack", False), ("  ", None), ("⚠️ **UNDECIDABLE** - Insufficient.", True),
    ],
)
def test_first_sentence(spark, text, want):
    assert _one(spark, text, verdicts.first_sentence_verdict(F.col("text"))) is want


def test_strict(spark):
    text = F.col("text")
    assert _one(spark, "UNDECIDABLE", verdicts.strict_verdict(text, verdicts.first_sentence_verdict(text))) is None


@pytest.mark.parametrize(
    "text,state,want",
    [
        ("", "S0", None), ("anything", "S0", True), ("S0 flag", "SF", False), ("tcp - - 0 0 S0 F F", None, True), ("tcp - 0.1 0 0 S0 F F", None, False),
        ("x tcp http 0.1 0 0 SH F F", None, False), ("x tcp - - - - S1 F F with s0", None, True), ("SH flag and S0 flag", None, False),
        ("not a SYN flood, (S0)", None, False), ("showing S0", None, True), ("TCP SYN flood detected", None, True),
        ("SYN flood and SYN packets", None, False), ("quiet", None, False), ("connection reset received", None, False),
    ],
)
def test_cascade(spark, text, state, want):
    row = spark.createDataFrame([(text, state)], "text string, state string")
    assert row.select(verdicts.syn_verdict(F.col("text"), F.col("state")).alias("v")).collect()[0].v is want


def test_decisive_state_skips_undecided_ones(spark):
    rows = [dict(conn_state=s, proto="tcp") for s in ("S1", "SHR", "SF", "S0")]
    got = verdicts.decisive_states(gen.make(spark, rows)).collect()
    assert [(r.log_name, r.decisive_state) for r in got] == [("log", "SF")]


def test_first_record_not_first_time(spark):
    rows = [dict(log_name="l", ts_us=9, conn_state="S0"), dict(log_name="l", ts_us=1, conn_state="SF")]
    rows += [dict(log_name="n", line_no=None, ts_us=t, conn_state=s) for t, s in ((5, "SF"), (5, "SF"), (2, "S0"))]
    flows = gen.make(spark, rows)
    assert {r.log_name: r.decisive_state for r in verdicts.decisive_states(flows).collect()} == {"l": "S0", "n": "S0"}
    assert {r.log_name: r.label for r in labelling.state_label(flows).collect()} == {"l": True, "n": True}
    tied = gen.make(spark, [dict(line_no=None, ts_us=1, conn_state=s) for s in ("SF", "S0")]).withColumn(
        "uid", F.when(F.col("conn_state") == "S0", "Ca").otherwise("Cb")
    )
    assert [r.decisive_state for r in verdicts.decisive_states(tied).collect()] == ["S0"]


def test_report_fields(spark):
    text = (
        "- SYN flood alert: attempt from 1.2.3.4 to 5.6.7.8 on port 23.\n"
        "  Justified by anomaly: No anomaly data found.\n  → Action: Investigate S0 rows."
    )
    fields = verdicts.report_fields(F.col("text"))
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(n) for n, c in fields.items()]).collect()[0]
    assert row.alert == "attempt from 1.2.3.4 to 5.6.7.8 on port 23." and row.action == "Investigate S0 rows."
    assert (row.justification, row.port, row.state, row.ips, row.abstained) == ("No anomaly data found.", 23, "S0", "1.2.3.4,5.6.7.8", False)


def test_ips_and_filters(spark):
    assert _one(spark, "999.1.1.1 x1.2.3.4 1.2.3.4.5 (1.2.3.4)", extract_ips(F.col("text"))) == ["999.1.1.1", "1.2.3.4", "1.2.3.4"]
    assert _one(spark, "DDoS on PORT 443, suspicious", filters.query_filter_map(F.col("text"))) == {
        "dstPort": "443", "taxonomy": "DoS", "label": "suspicious",
    }
    assert _one(spark, "tcp report 80", filters.query_filter_map(F.col("text"))) is None


def test_gate(spark):
    cases = spark.createDataFrame(
        [("a", ["1.1.1.1"], "nothing"), ("b", [], "port 443"), ("c", ["2.2.2.2", "2.2.2.2"], "suspicious DoS"), ("d", ["3.3.3.3"], "")],
        "case_id string, ips array<string>, query string",
    ).select("case_id", "ips", filters.query_filter_map(F.col("query")).alias("filters"))
    scored = spark.createDataFrame(
        [("a", 0.31, False), ("b", 0.9, True), ("c", 0.29, True), ("d", 0.5, True)], "case_id string, similarity double, names_ip boolean"
    )
    got = {r.case_id: r for r in evidence.evidence_gate(cases, scored).collect()}
    assert [got[k].abstain for k in "abcd"] == [False, True, True, False]
    assert "(0.00) is below threshold (0.3)" in got["b"].message and "no specific IP addresses identified; with filters: {'dstPort': '443'}" in got["b"].message
    assert "(0.29)" in got["c"].message and "IPs: 2.2.2.2, 2.2.2.2; with filters: {'taxonomy': 'DoS', 'label': 'suspicious'}." in got["c"].message
    assert got["a"].message is None and got["d"].kept_docs == 1


def test_evidence_is_whole_tokens_and_may_be_whole(spark):
    docs = spark.createDataFrame(
        [(f"anomaly_{i}", {"srcIP": "1.2.3.4", "dstIP": "11.2.3.45"}) for i in range(20)], "doc_id string, meta map<string,string>"
    )
    ips = spark.createDataFrame([("log", "1.2.3.4"), ("other", "1.2.3")], "log_name string, ip string")
    assert evidence.ip_evidence(ips, docs).count() == 20
    scores = docs.select(F.lit("log").alias("log_name"), "doc_id", (F.xxhash64("doc_id") % 1000 / 1000).alias("similarity"))
    best = [r.doc_id for r in scores.orderBy(F.desc("similarity"), "doc_id").limit(3).collect()]
    assert sorted(r.doc_id for r in evidence.ip_evidence(ips, docs, 3, scores).collect()) == sorted(best)


# Published confusion counts and the quality they imply, in percent.
PUBLISHED = [
    ((356, 4522, 122, 0), (97.56, 74.48, 100.0, 85.37), 0.9869),
    ((365, 4522, 113, 0), (97.74, 76.36, 100.0, 86.60), 0.9878),
    ((4075, 609, 0, 56), (98.82, 100.0, 98.64, 99.32), 0.9932),
    ((3960, 587, 114, 78), (95.95, 97.20, 98.07, 97.63), 0.9090),
]


@pytest.mark.parametrize("counts,quality,auc", PUBLISHED)
def test_published_quality(spark, counts, quality, auc):
    tp, tn, fp, fn = counts
    kinds = spark.createDataFrame([(True, 1, tp), (False, 0, tn), (False, 1, fp), (True, 0, fn)], "label boolean, prediction int, n int")
    rows = kinds.select("label", "prediction", F.explode(F.expr("sequence(1, n)")).alias("i")) if fn else kinds.filter("n > 0").select(
        "label", "prediction", F.explode(F.expr("sequence(1, n)")).alias("i"))
    rows = rows.join(kinds.filter("n > 0").select("label", "prediction"), ["label", "prediction"], "left_semi")
    got = metrics.evaluate(rows, score=None).collect()[0]
    assert (got.tp, got.tn, got.fp, got.fn) == counts
    shown = tuple(round(100 * v, 2) for v in (got.accuracy, got.precision, got.recall, got.f1_score))
    assert shown == pytest.approx(quality, abs=0.011) and got.auc == pytest.approx(auc, abs=6e-5)


def test_missing_is_treated_by_kind_of_evaluation(spark):
    labels = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "log_name string, label boolean")
    said = spark.createDataFrame([("a", True), ("b", None)], "log_name string, verdict boolean")
    got = {r.log_name: r.outcome for r in metrics.join_reports(labels, said).collect()}
    assert got == {"a": "TP", "b": "undecided", "c": "missing"}
    scores = spark.createDataFrame([("a", 1, 0.7)], "log_name string, prediction int, score double")
    got = {r.log_name: (r.prediction, r.score) for r in metrics.join_predictions(labels, scores).collect()}
    assert got == {"a": (1, 0.7), "b": (0, 0.0), "c": (0, 0.0)}


def test_rule_scores(spark):
    rows = [dict(log_name="ping", ts_us=i * 1_000_000) for i in range(6)]
    rows += [dict(log_name="still", ts_us=5)] * 5
    rows += [dict(log_name="syn", proto="tcp", conn_state="S0", ts_us=i) for i in range(12)]
    flows = gen.make(spark, rows)
    ping = {r.log_name: (r.detected, r.rules_matched) for r in rule_scores.ping_rule_score(flows).collect()}
    assert ping == {"ping": (True, 3), "still": (True, 2), "syn": (False, 1)}
    syn = {r.log_name: (r.detected, r.rules_matched, r.syn_rate) for r in rule_scores.syn_rule_score(flows).collect()}
    assert syn["syn"] == (True, 3, 12.0) and syn["ping"] == (False, 0, 0.0)
    stricter = rule_scores.syn_rule_score(flows, s0_threshold=13, syn_rate=13).filter("log_name = 'syn'").collect()[0]
    assert not stricter.detected


def test_features_with_gaps(spark):
    rows = [dict(duration=None, orig_bytes=None, src_port=None), dict(duration=2.0, orig_bytes=10, resp_bytes=0, ts_us=4_000_000)]
    got = profile.flow_features(gen.make(spark, rows)).collect()[0].asDict()
    assert [c for c in got if c != "log_name"] == list(profile.FEATURES)
    assert (got["avg_duration"], got["min_duration"], got["byte_ratio"], got["unique_src_ports"], got["flow_rate"]) == (1.0, 0.0, 10.0, 2.0, 0.5)
    cases = spark.createDataFrame([("log",), ("gone",)], "log_name string")
    filled = profile.features_or_zero(cases, profile.flow_features(gen.make(spark, rows)))
    assert {r.log_name: r.total_flows for r in filled.collect()} == {"log": 2.0, "gone": 0.0}
    empty = profile.protocol_profile(gen.make(spark, rows).limit(0)).collect()[0]
    assert empty.total == 0 and empty.tcp_pct is None and empty.flood_state_pct is None
