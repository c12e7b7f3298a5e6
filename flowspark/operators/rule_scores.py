"""Threshold rules per log: how many of three rules hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.time import SECOND


def _span() -> Column:
    return (F.max("ts_us") - F.min("ts_us")) / SECOND


def _scored(df: DataFrame, details: list[str], *rules: Column) -> DataFrame:
    held = sum((F.when(rule, 1).otherwise(0) for rule in rules), F.lit(0))
    return df.withColumn("rules_matched", held).select(
        "log_name",
        (F.col("rules_matched") >= 2).alias("detected"),
        (F.col("rules_matched") / 3.0).alias("confidence"),
        "rules_matched",
        *details,
    )


def ping_rule_score(
    flows: DataFrame, icmp_threshold: int = 5, icmp_ratio: float = 0.3, time_window: float = 60
) -> DataFrame:
    """ICMP count, ICMP share, and a short but not empty time span."""
    icmp = F.count_if(F.col("proto") == "icmp")
    logs = flows.groupBy("log_name").agg(
        icmp.alias("icmp_count"),
        (icmp / F.count(F.lit(1))).alias("icmp_ratio"),
        _span().alias("time_span"),
        F.count(F.lit(1)).alias("total_flows"),
    )
    span = F.col("time_span")
    return _scored(
        logs,
        ["icmp_count", "icmp_ratio", "time_span", "total_flows"],
        F.col("icmp_count") >= icmp_threshold,
        F.col("icmp_ratio") >= icmp_ratio,
        (span > 0) & (span <= time_window),
    )


def syn_rule_score(
    flows: DataFrame, s0_threshold: int = 5, s0_ratio: float = 0.5, syn_rate: float = 10
) -> DataFrame:
    """Unanswered SYNs, their share of TCP, and TCP rows per second."""
    tcp = F.count_if(F.col("proto") == "tcp")
    s0 = F.count_if((F.col("proto") == "tcp") & (F.col("conn_state") == "S0"))
    logs = flows.groupBy("log_name").agg(
        s0.alias("s0_count"),
        F.coalesce(F.try_divide(s0, tcp), F.lit(0.0)).alias("s0_ratio"),
        tcp.alias("tcp_count"),
        _span().alias("time_span"),
        (tcp / F.greatest(_span(), F.lit(1.0))).alias("syn_rate"),
    )
    return _scored(
        logs,
        ["s0_count", "s0_ratio", "tcp_count", "syn_rate", "time_span"],
        F.col("s0_count") >= s0_threshold,
        F.col("s0_ratio") >= s0_ratio,
        F.col("syn_rate") >= syn_rate,
    )


def predictions(scores: DataFrame) -> DataFrame:
    """(log_name, prediction, score) as the metrics take them."""
    return scores.select("log_name", F.col("detected").cast("int").alias("prediction"), F.col("confidence").alias("score"))
