"""Labels of whole logs derived from their flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.time import SECOND, display_time, record_order
from flowspark.operators import bursts, rule_match
from flowspark.schema import LABEL_ENTRY


def ping_flood_labels(
    flows: DataFrame,
    anomaly_ips: DataFrame,
    threshold: int = 10,
    peers: int = 3,
    window_us: int = 20 * SECOND,
    matches: int = 5,
    cases: DataFrame | None = None,
) -> DataFrame:
    """One row per log: detected or not, the counts behind it and the reasons.

    `cases` (log_name) lists all logs; those without a usable row are not
    detected. Without it the logs are those of `flows`.
    """
    many, scans = (
        bursts.flood_counts(flows, pattern, threshold, peers, window_us) for pattern in ("many_to_one", "one_to_many")
    )
    joined = (
        (flows if cases is None else cases)
        .select("log_name")
        .distinct()
        .join(rule_match.anomaly_ip_matches(flows, anomaly_ips), "log_name", "left")
        .join(many, "log_name", "left")
        .join(scans, "log_name", "left")
        .na.fill(0)
    )
    matched, n_many, n_scans = F.col("matching_anomaly_rows"), F.col("many_to_one"), F.col("one_to_many")
    # The wording of the reasons.
    reasons = F.array_compact(
        F.array(
            F.when(
                matched >= matches,
                F.format_string(f"≥{matches} rows have both ICMP echo and heuristic 20 IP (%d match)", matched),
            ),
            F.when(n_many > 0, F.format_string("many-to-one ICMP ping flood detected (%d events)", n_many)),
            F.when(n_scans > 0, F.format_string("one-to-many ICMP ping flood detected (%d events)", n_scans)),
        )
    )
    return joined.select(
        "log_name",
        (F.size(reasons) > 0).alias("ping_flood_detected"),
        (n_many + n_scans).alias("num_floods"),
        "many_to_one",
        "one_to_many",
        "matching_anomaly_rows",
        reasons.alias("detection_reason"),
    )


def flood_details(flows: DataFrame, threshold: int = 10, peers: int = 3, window_us: int = 20 * SECOND) -> DataFrame:
    """One row per flood, in the shape of the label file's detail entries."""

    def entries(pattern: str, hub: str, peer: str) -> DataFrame:
        return bursts.labelled_floods(flows, pattern, threshold, peers, window_us).select(
            "log_name",
            F.lit(pattern).alias("type"),
            hub,
            f"unique_{peer}s",
            F.col(f"{peer}_count").cast("int").alias(f"{peer}_count"),
            F.col("packet_count").cast("int").alias("packet_count"),
            display_time(F.col("start_us")).alias("start_time"),
            display_time(F.col("end_us")).alias("end_time"),
        )

    return entries("many_to_one", "dst_ip", "src_ip").unionByName(
        entries("one_to_many", "src_ip", "dst_ip"), allowMissingColumns=True
    )


def label_entries(labels: DataFrame, details: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(log_name, entry) in the shape of the label file: counts, reasons and each flood, or the error of an unreadable log.

    Takes `ping_flood_labels`, `flood_details` and (log_name, error). A log has few floods, one per hub at most.
    """
    shown = T.StructType.fromDDL(f"entry {LABEL_ENTRY}")["entry"].dataType
    sides = {}
    for pattern in ("many_to_one", "one_to_many"):
        items = shown["flood_details"].dataType[pattern].dataType.elementType
        item = F.struct(*[F.col(f.name) for f in items])
        sides[pattern] = F.sort_array(F.collect_list(F.when(F.col("type") == pattern, item))).alias(f"_{pattern}")
    floods = details.groupBy("log_name").agg(*sides.values())
    none = {p: F.array().cast(shown["flood_details"].dataType[p].dataType) for p in sides}
    found = F.struct(*[F.coalesce(F.col(f"_{p}"), none[p]).alias(p) for p in sides])
    given = {
        "ping_flood_detected": F.col("ping_flood_detected"),
        "num_floods": F.col("num_floods").cast("int"),
        "flood_details": found,
        "matching_anomaly_rows": F.col("matching_anomaly_rows").cast("int"),
        "detection_reason": F.col("detection_reason"),
    }

    def entry(values: dict) -> Column:
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shown]).alias("entry")

    readable = labels if errors is None else labels.join(errors, "log_name", "left_anti")
    rows = readable.join(floods, "log_name", "left").select("log_name", entry(given))
    return rows if errors is None else rows.unionByName(errors.select("log_name", entry({"error": F.col("error")})))


def state_label(flows: DataFrame, attack_state: str = "S0") -> DataFrame:
    """Attack if the first record of the log has the attack state, in record order, not by time."""
    attacked = F.min_by(F.coalesce(F.col("conn_state") == attack_state, F.lit(False)), record_order(flows.columns))
    return flows.groupBy("log_name").agg(F.coalesce(attacked, F.lit(False)).alias("label"))


def pending_cases(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases that have no output yet."""
    return cases.join(done.select("log_name"), "log_name", "left_anti")
