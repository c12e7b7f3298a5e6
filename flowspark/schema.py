"""Explicit schemas of the tables flowspark reads and writes."""

from pyspark.sql import types as T

FLOWS = T.StructType(
    [
        T.StructField("log_name", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("uid", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("orig_bytes", T.LongType()),
        T.StructField("resp_bytes", T.LongType()),
        T.StructField("conn_state", T.StringType()),
        T.StructField("orig_pkts", T.LongType()),
        T.StructField("resp_pkts", T.LongType()),
        T.StructField("raw", T.StringType()),
    ]
)

ANOMALIES = T.StructType(
    [
        T.StructField("srcIP", T.StringType()),
        T.StructField("srcPort", T.IntegerType()),
        T.StructField("dstIP", T.StringType()),
        T.StructField("dstPort", T.IntegerType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("heuristic", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)

# A missing field is a wildcard, so every field stays text and NULL is kept.
RULE_FIELDS = ("srcIP", "srcPort", "dstIP", "dstPort")
RULES = T.StructType([T.StructField(name, T.StringType()) for name in RULE_FIELDS])

KNOWLEDGE = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

LABEL_ENTRY = (
    "struct<ping_flood_detected: boolean, syn_flood_detected: boolean, attack_detected: boolean, num_floods: int, "
    "flood_details: struct<"
    "many_to_one: array<struct<type: string, dst_ip: string, unique_src_ips: array<string>, src_ip_count: int, "
    "packet_count: int, start_time: string, end_time: string>>, "
    "one_to_many: array<struct<type: string, src_ip: string, unique_dst_ips: array<string>, dst_ip_count: int, "
    "packet_count: int, start_time: string, end_time: string>>>, "
    "matching_anomaly_rows: int, detection_reason: array<string>, error: string>"
)
LABEL_FILE = f"map<string, {LABEL_ENTRY}>"

METRICS_FILE = (
    "model_type string, attack_type string, accuracy double, precision double, recall double, f1_score double, "
    "auc double, confusion_matrix struct<TP: bigint, TN: bigint, FP: bigint, FN: bigint>, total_samples bigint"
)
