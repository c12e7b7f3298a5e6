"""Row filters and classes over flows, alerts and queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Connection states that count towards a SYN flood, and states of normal TCP traffic.
FLOOD_STATES = ("S0", "S1", "REJ", "RSTO", "RSTOS0")
NORMAL_STATES = ("SF", "S2", "S3", "OTH", "RSTR")

# Heuristic code bands and their descriptions.
SUSPICIOUS_TEXT = "Suspicious traffic: abnormal TCP flags or well-known malware ports."
NORMAL_TEXT = "Normal protocol traffic seen on well-known ports."
UNKNOWN_TEXT = "Traffic anomaly observed on unknown or uncommon ports."

# Taxonomy words looked for in a query, in this order.
TAXONOMY_WORDS = ("DoS", "DDoS", "PortScan", "HTTP", "NetworkScan", "AlphaFlow", "MultiPoints")

# Alert types by number of distinct sources.
DISTRIBUTED_ALERT = "Distributed SYN Flood (DDoS)"
CONCENTRATED_ALERT = "Concentrated SYN Flood"
SCAN_ALERT = "SYN Scanning"


def echo_by_type(flows: DataFrame) -> DataFrame:
    """ICMP rows whose destination port field holds type 8 (echo request)."""
    return flows.filter((F.col("proto") == "icmp") & (F.col("dst_port") == 8))


def is_echo_pair() -> Column:
    """Port fields (8, 0) or (0, 8): echo type and code, either way round."""
    src, dst = F.col("src_port"), F.col("dst_port")
    return ((src == 8) & (dst == 0)) | ((src == 0) & (dst == 8))


def echo_by_pair(flows: DataFrame) -> DataFrame:
    """ICMP rows whose port fields are the echo pair."""
    return flows.filter((F.col("proto") == "icmp") & is_echo_pair())


def half_open(flows: DataFrame, states: Iterable[str] = FLOOD_STATES) -> DataFrame:
    """TCP rows whose connection state counts towards a SYN flood."""
    return flows.filter((F.col("proto") == "tcp") & F.col("conn_state").isin(*states))


def tcp_state_class(flood: Iterable[str] = FLOOD_STATES, normal: Iterable[str] = NORMAL_STATES) -> Column:
    """`tcp_flood`, `tcp_normal`, `tcp_other`, else the protocol (`icmp`, `udp`, `other`)."""
    return (
        F.when((F.col("proto") == "tcp") & F.col("conn_state").isin(*flood), "tcp_flood")
        .when((F.col("proto") == "tcp") & F.col("conn_state").isin(*normal), "tcp_normal")
        .when(F.col("proto") == "tcp", "tcp_other")
        .when(F.col("proto").isin("icmp", "udp"), F.col("proto"))
        .otherwise("other")
    )


def heuristic_category(code: Column) -> Column:
    """Description of a heuristic code: below 500, 500 to 899, 900 and above."""
    return F.when(code < 500, SUSPICIOUS_TEXT).when(code < 900, NORMAL_TEXT).otherwise(UNKNOWN_TEXT)


def syn_alert_type(source_count: Column, spread: int = 3) -> Column:
    return F.when(source_count >= spread, DISTRIBUTED_ALERT).otherwise(CONCENTRATED_ALERT)


def protocol_or_all(flows: DataFrame, proto: str) -> DataFrame:
    """Lines of `proto` in each log; all lines of a log that has none.

    Only rows of other protocols meet the list of logs, so lines that are kept
    anyway are never shuffled, and a huge log is split by the skew join.
    """
    wanted = F.coalesce(F.lower("proto") == proto, F.lit(False))
    without = flows.groupBy("log_name").agg(F.max(wanted).alias("_has")).filter(~F.col("_has")).select("log_name")
    return flows.filter(wanted).unionByName(flows.filter(~wanted).join(without, "log_name", "left_semi"))


def metadata_filter(kb: DataFrame, wanted: Mapping[str, str] | None) -> DataFrame:
    """Knowledge rows whose metadata equals every given value."""
    for key, value in (wanted or {}).items():
        kb = kb.filter(F.col("meta")[key] == str(value))
    return kb


def query_filters(text: Column, words: Iterable[str] = TAXONOMY_WORDS) -> Column:
    """Metadata filters named in a query text, as a struct with NULL for "not named".

    The first taxonomy word in order wins, so "DDoS" gives "DoS"; a protocol
    named in the text is not a stored field and sets nothing.
    """
    lowered = F.lower(text)
    port = F.regexp_extract(text, r"(?i)\bport\s+(\d+)", 1)
    taxonomy = F.coalesce(*[F.when(lowered.contains(word.lower()), F.lit(word)) for word in words])
    label = F.when(lowered.contains("suspicious"), "suspicious").when(lowered.contains("anomalous"), "anomalous")
    return F.struct(F.nullif(port, F.lit("")).alias("dstPort"), taxonomy.alias("taxonomy"), label.alias("label"))


def query_filter_map(text: Column) -> Column:
    """The same filters as a map without the unnamed fields; NULL if none is named."""
    fields = query_filters(text)
    pairs = [F.struct(F.lit(name).alias("key"), fields[name].alias("value")) for name in ("dstPort", "taxonomy", "label")]
    named = F.map_from_entries(F.filter(F.array(*pairs), lambda pair: pair["value"].isNotNull()))
    return F.when(F.size(named) > 0, named)


def echo_validation_bands(flows: DataFrame, anomaly_ips: DataFrame, flood: int = 10, review: int = 5) -> DataFrame:
    """Per log and source: `flood`, `review` (needs a known anomaly address) or `none`."""
    counts = echo_by_pair(flows).groupBy("log_name", "src_ip").agg(F.count(F.lit(1)).alias("echo_count"))
    known = anomaly_ips.select(F.col("ip").alias("src_ip"), F.lit(True).alias("corroborated"))
    n = F.col("echo_count")
    corroborated = F.coalesce("corroborated", F.lit(False))
    band = F.when(n >= flood, "flood").when((n >= review) & corroborated, "review").otherwise("none")
    return counts.join(known, "src_ip", "left").select(
        "log_name", "src_ip", "echo_count", corroborated.alias("corroborated"), band.alias("band")
    )
