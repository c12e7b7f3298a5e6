"""Matching flows against wildcard rules and address sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.scale import within_size
from flowspark.operators import filters
from flowspark.schema import RULE_FIELDS
from flowspark.session import cut_lineage

# Flow column behind each rule field; ports compare as text, as rules store them.
FLOW_FIELDS = dict(zip(RULE_FIELDS, ("src_ip", "src_port", "dst_ip", "dst_port"), strict=True))
BROADCAST_ROWS = 500_000


def _mask() -> Column:
    """Four bits: which rule fields are set."""
    return sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(RULE_FIELDS)), F.lit(0))


def _set_fields(mask: int) -> list[str]:
    return [c for i, c in enumerate(RULE_FIELDS) if mask >> i & 1]


def matches_any_rule(flows: DataFrame, rules: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Flows that satisfy at least one rule; a NULL rule field matches anything.

    Rules fall into at most sixteen NULL patterns, and within one pattern the
    match is plain equality: one lookup per pattern, on the flow's own columns.
    Up to `broadcast_rows` rules the lookups are broadcast and flows do not move;
    beyond that Spark picks the joins. The rows are the same.
    """
    rules = rules.select(*[F.col(c).cast("string").alias(c) for c in RULE_FIELDS]).withColumn("_mask", _mask())
    sizes = {r["_mask"]: r["count"] for r in rules.groupBy("_mask").count().collect()}  # at most 16 rows
    if not sizes:
        return flows.limit(0)
    if 0 in sizes:
        return flows
    masks, small = sorted(sizes), sum(sizes.values()) <= broadcast_rows
    found = flows
    for mask in masks:
        fields = _set_fields(mask)
        wanted = (
            rules.filter(F.col("_mask") == mask)
            .select(*[F.col(c).alias(f"_{mask}_{c}") for c in fields])
            .distinct()
            .withColumn(f"_hit_{mask}", F.lit(True))
        )
        same = [F.col(FLOW_FIELDS[c]).cast("string") == F.col(f"_{mask}_{c}") for c in fields]
        found = found.join(F.broadcast(wanted) if small else wanted, same, "left")
    hit = F.coalesce(*[F.col(f"_hit_{mask}") for mask in masks], F.lit(False))
    return found.filter(hit).select(*flows.columns)


def anomaly_ip_set(anomalies: DataFrame, heuristic: int = 20) -> DataFrame:
    """Distinct addresses of the anomalies with one heuristic code.

    Takes srcIP and dstIP, or a single column `ip` where those are absent.
    """
    wanted = anomalies.filter(F.col("heuristic") == heuristic)
    if {"srcIP", "dstIP"} <= set(anomalies.columns):
        ips = wanted.select(F.explode(F.array("srcIP", "dstIP")).alias("ip"))
    elif "ip" in anomalies.columns:
        ips = wanted.select("ip")
    else:
        ips = wanted.select(F.lit(None).cast("string").alias("ip"))
    return ips.filter(F.col("ip").isNotNull()).select(F.col("ip").cast("string").alias("ip")).distinct()


def anomaly_ip_matches(flows: DataFrame, ips: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Echo-pair rows per log whose source or destination is in the address set.

    Rows are counted per (log, source, destination) first, so what meets the
    address set is one row per conversation, not one per packet.
    """
    talks = (
        flows.filter(filters.is_echo_pair())
        .groupBy("log_name", "src_ip", "dst_ip")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # Read by the count and by both joins.
    ips = cut_lineage(ips, "addresses")
    small = within_size(ips, broadcast_rows)
    for side in ("src", "dst"):
        listed = ips.select(F.col("ip").alias(f"{side}_ip"), F.lit(True).alias(f"_{side}_listed"))
        talks = talks.join(F.broadcast(listed) if small else listed, f"{side}_ip", "left")
    listed = F.coalesce("_src_listed", "_dst_listed", F.lit(False))
    return talks.filter(listed).groupBy("log_name").agg(F.sum("_n").alias("matching_anomaly_rows"))
