"""Sentences for alerts, anomalies and heuristics (fixed wording throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.time import display_time
from flowspark.operators.filters import heuristic_category


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))


def ping_alert_text() -> Column:
    """Needs dst_ip, start_us, end_us and total_icmp_requests (of the whole capture)."""
    return F.format_string(
        "Ping flood detected targeting destination IP %s. %d ICMP Echo Requests received between %s and %s.",
        "dst_ip",
        "total_icmp_requests",
        display_time(F.col("start_us")),
        display_time(F.col("end_us")),
    )


def syn_alert_text() -> Column:
    """Needs the columns of `syn_alerts`; names the first five addresses."""
    times = display_time(F.col("start_us")), display_time(F.col("end_us"))
    states = F.array_join("conn_states", ", ")

    def first_five(column: str) -> Column:
        return F.array_join(F.slice(column, 1, 5), ", ")

    flood = F.format_string(
        "%s: %d SYN attempts detected to %s:%d from %d source(s) between %s and %s. "
        "Connection states: %s. Source IPs include: %s...",
        "attack_type", "syn_count", "target_ip", "target_port", "source_count", *times, states, first_five("source_ips"),
    )
    scan = F.format_string(
        "%s: %d SYN attempts from %s targeting %d different IPs between %s and %s. "
        "Connection states: %s. Targets include: %s...",
        "attack_type", "syn_count", "source_ip", "target_count", *times, states, first_five("target_ips"),
    )
    return F.when(F.col("type") == "many_to_one", flood).otherwise(scan)


def anomaly_text(doc_id: Column) -> Column:
    """Needs the anomaly columns; gaps read "unknown". The final id goes straight into the text."""
    return F.format_string(
        "Anomaly ID %s: A %s connection was detected from source IP %s on port %s to destination IP %s on port %s. "
        "This anomaly is categorized as '%s' based on heuristic %s.",
        doc_id,
        *[_or_unknown(c) for c in ("label", "srcIP", "srcPort", "dstIP", "dstPort", "taxonomy", "heuristic")],
    )


def heuristic_text(code: Column, label: Column) -> Column:
    return F.format_string(
        "Heuristic ID: %s\nLabel: %s\nCategory: %s", code, F.trim(label), heuristic_category(code.cast("int"))
    )


def taxonomy_text(category: Column, prefixes: Column) -> Column:
    return F.format_string("Category: %s\nPrefixes: %s", category, F.array_join(prefixes, ", "))
