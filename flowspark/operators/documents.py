"""Knowledge rows (id, text, metadata) built from alerts, anomalies and heuristics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions import alert_text
from flowspark.functions.scale import bucketed_row_number, hash_bucket, top_per_group
from flowspark.functions.time import SECOND, display_time
from flowspark.operators import bursts, profile
from flowspark.session import cut_lineage

# Collection names.
ANOMALIES = "anomaly_csv_logsc01"
HEURISTICS = "heuristic_info_txt4"
PING_ALERTS = "ping_flood_alerts2"
SYN_ALERTS = "syn_flood_alerts"

# Fixed pattern: heuristic lines read "* <code>:<label>".
HEURISTIC_LINE = r"\* (\d+):(.+)"


def _meta(**columns: Column) -> Column:
    """Metadata map of text values; missing values are left out."""
    pairs = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in columns.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def _rows(df: DataFrame, collection: str, doc_id: Column, text: Column, meta: Column) -> DataFrame:
    return df.select(
        F.lit(collection).alias("collection"),
        doc_id.alias("doc_id"),
        text.alias("text"),
        meta.alias("meta"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def parse_heuristics(texts: DataFrame, column: str = "text") -> DataFrame:
    """(code, label, category) of every heuristic line before the words "Anomaly taxonomy"."""
    section = F.split_part(F.col(column), F.lit("Anomaly taxonomy"), F.lit(1))
    lines = F.arrays_zip(
        F.regexp_extract_all(section, F.lit(HEURISTIC_LINE), F.lit(1)).alias("code"),
        F.regexp_extract_all(section, F.lit(HEURISTIC_LINE), F.lit(2)).alias("label"),
    )
    found = texts.withColumn("_line", F.explode(lines)).drop(column)
    return found.select(
        *found.columns[:-1],
        F.col("_line.code").alias("code"),
        F.trim("_line.label").alias("label"),
        alert_text.heuristic_category(F.col("_line.code").cast("int")).alias("category"),
    )


def heuristic_docs(heuristics: DataFrame) -> DataFrame:
    code = F.col("code").cast("string")
    return _rows(
        heuristics,
        HEURISTICS,
        F.concat(F.lit("heuristic_"), code),
        alert_text.heuristic_text(code, F.col("label")),
        _meta(type=F.lit("heuristic"), id=code, category=alert_text.heuristic_category(code.cast("int"))),
    )


def taxonomy_docs(groups: DataFrame) -> DataFrame:
    return _rows(
        groups,
        HEURISTICS,
        F.concat(F.lit("taxonomy_"), "category"),
        alert_text.taxonomy_text(F.col("category"), F.col("prefixes")),
        _meta(type=F.lit("taxonomy_group"), category=F.col("category"), prefixes=F.array_join("prefixes", ", ")),
    )


def unique_doc_ids(
    new: DataFrame,
    existing: DataFrame,
    base: str = "doc_id",
    order: str | Sequence[str] = "row_no",
    bucket_width: int = 1 << 20,
) -> DataFrame:
    """Collision-free ids: the k-th repeat of a base id takes its k-th free suffix.

    No suffix comes first, then `_1`, `_2` ... Suffixes used by `existing` are
    skipped, and those that make another base id of `new`. With taken suffixes
    t0 < t1 < ..., the k-th free one is k plus the number of j with t_j - j <= k.
    Rows and runs of taken suffixes meet in buckets of numbers, so a base with
    any number of rows and runs is spread over tasks. `order` begins with a
    number where one base id may have many rows. A base with one row that nobody
    holds keeps its row as it is: one aggregation, a job of its own, tells these
    from the others, and where there are no others nothing is numbered.
    """
    order = [order] if isinstance(order, str) else list(order)
    repeated = new.groupBy(F.col(base).alias("_base")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_base")
    held = existing.select(F.col("doc_id").alias("_base"))
    busy = cut_lineage(repeated.unionByName(held.join(new.select(F.col(base).alias("_base")), "_base", "left_semi")).distinct(), "busy-ids")
    if busy.isEmpty():
        return new.withColumn("unique_id", F.col(base))
    same = F.equal_null(F.col(base), F.col("_base"))
    free = new.join(busy, same, "left_anti").withColumn("unique_id", F.col(base))
    numbered = _numbered_ids(new.join(busy, same, "left_semi"), existing, new.select(F.col(base).alias("_base")).distinct(), base, order, bucket_width)
    return free.unionByName(numbered)


def _numbered_ids(new: DataFrame, existing: DataFrame, bases: DataFrame, base: str, order: list[str], bucket_width: int) -> DataFrame:
    """`new` with its unique ids; `bases` are all base ids of the batch, those of rows not in `new` too."""
    cell = F.floor(F.col(order[0]) / bucket_width).cast("bigint") if dict(new.dtypes)[order[0]] != "string" else F.lit(0)
    numbered = bucketed_row_number(new, "_k", cell, order, [base]).withColumn("_k", F.col("_k") - 1)
    # Numbers without leading zeros only: "x_01" is nobody's suffix form.
    taken = (
        existing.select(F.col("doc_id").alias("_base"), F.lit(0).cast("bigint").alias("_n"))
        .unionByName(_suffixes(existing.select("doc_id")))
        .unionByName(_suffixes(bases.select(F.col("_base").alias("doc_id"))))
        .distinct()
        .join(new.select(F.col(base).alias("_base")).distinct(), "_base", "left_semi")
    )
    # Runs of consecutive suffixes share t_j - j, so one row per run is left.
    ranked = bucketed_row_number(taken, "_j", F.floor(F.col("_n") / bucket_width).cast("bigint"), ["_n"], ["_base"])
    runs = (
        ranked.withColumn("_j", F.col("_j") - 1)
        .groupBy("_base", (F.col("_n") - F.col("_j")).alias("_at"))
        .agg((F.max("_j") + 1).alias("_skip"))
    )
    bucket = F.floor(F.col("_at") / bucket_width).cast("bigint").alias("_bucket")
    rows = numbered.select(F.col(base).alias("_base"), F.col("_k").alias("_at"), F.struct(*new.columns).alias("_row"))
    events = (
        rows.select("_base", "_at", bucket, F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_skip"), "_row")
    ).unionByName(runs.select("_base", "_at", bucket, F.lit(0).alias("_kind"), "_skip"), allowMissingColumns=True)
    # More runs skip more, so the largest so far is the last one.
    inside = Window.partitionBy("_base", "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_base").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = events.groupBy("_base", "_bucket").agg(F.max("_skip").alias("_most"))
    before = before.select(F.col("_base").alias("_b"), F.col("_bucket").alias("_c"), F.max("_most").over(earlier).alias("_before"))
    found = events.withColumn("_skip", F.max("_skip").over(inside)).filter("_kind = 1")
    same = F.equal_null(F.col("_base"), F.col("_b")) & (F.col("_bucket") == F.col("_c"))
    suffix = F.col("_at") + F.coalesce("_skip", "_before", F.lit(0))
    unique = F.when(suffix == 0, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("_"), suffix.cast("string")))
    return found.join(before, same).select("_row.*", unique.alias("unique_id"))


def _suffixes(ids: DataFrame) -> DataFrame:
    """(_base, _n) of the ids that end in a number after a base."""
    number = F.expr("try_cast(regexp_extract(doc_id, '^(.*)_([1-9][0-9]*)$', 2) AS BIGINT)").alias("_n")
    return ids.select(F.regexp_extract("doc_id", r"^(.*)_([1-9]\d*)$", 1).alias("_base"), number).filter("_n is not null")


def anomaly_docs(anomalies: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One document per anomaly row; `row_no` is the row's position in its file, `file_name` tells files apart."""
    base = anomalies.withColumn("doc_id", F.concat(F.lit("anomaly_"), F.col("row_no").cast("string")))
    if existing is None:
        existing = base.select("doc_id").limit(0)
    # A base id has one row per file.
    named = unique_doc_ids(base, existing, order=["file_name", "row_no"] if "file_name" in anomalies.columns else "row_no")
    fields = ("srcIP", "srcPort", "dstIP", "dstPort", "taxonomy", "heuristic", "label")
    meta = _meta(**{c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in fields})
    return _rows(named, ANOMALIES, F.col("unique_id"), alert_text.anomaly_text(F.col("unique_id")), meta)


def ping_alerts_with_totals(
    flows: DataFrame, threshold: int = 5, window_us: int = 5 * SECOND
) -> DataFrame:
    """Ping bursts with each target's echo requests over the whole capture."""
    totals = profile.echo_count_by_target(flows)
    alerts = bursts.ping_burst(flows, threshold, window_us)
    return alerts.join(totals, "dst_ip", "left").withColumn(
        "total_icmp_requests", F.coalesce("echo_requests", "count")
    )


def _numbered(alerts: DataFrame, name: str, key: Column) -> DataFrame:
    """Number alerts 1, 2, ... in a fixed order of their subject."""
    keyed = alerts.withColumn("_subject", key)
    return bucketed_row_number(keyed, name, hash_bucket("_subject"), ["_subject"])


def ping_alert_docs(alerts: DataFrame) -> DataFrame:
    """Ids `ping_flood_0`, `ping_flood_1`, ... for upsert."""
    numbered = _numbered(alerts, "_no", F.col("dst_ip"))
    meta = _meta(
        dst_ip=F.col("dst_ip"),
        start_time=F.format_string("%.6f", F.col("start_us") / SECOND),
        end_time=F.format_string("%.6f", F.col("end_us") / SECOND),
        count_in_window=F.col("count"),
        total_icmp_requests=F.col("total_icmp_requests"),
    )
    doc_id = F.concat(F.lit("ping_flood_"), (F.col("_no") - 1).cast("string"))
    return _rows(numbered, PING_ALERTS, doc_id, alert_text.ping_alert_text(), meta)


def syn_alert_docs(alerts: DataFrame) -> DataFrame:
    """Ids `syn_flood_1`, `syn_flood_2`, ...; all metadata is text."""
    subject = F.concat_ws(" ", "type", "target_ip", "source_ip")
    numbered = _numbered(alerts, "_no", subject)
    meta = _meta(
        type=F.col("type"),
        attack_type=F.col("attack_type"),
        syn_count=F.col("syn_count"),
        start_time=display_time(F.col("start_us")),
        conn_states=F.array_join("conn_states", ","),
        target_ip=F.col("target_ip"),
        target_port=F.col("target_port"),
        source_count=F.col("source_count"),
        source_ip=F.col("source_ip"),
        target_count=F.col("target_count"),
    )
    doc_id = F.concat(F.lit("syn_flood_"), F.col("_no").cast("string"))
    return _rows(numbered, SYN_ALERTS, doc_id, alert_text.syn_alert_text(), meta)


def upserted(existing: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """`existing` with the rows of `new` put in place of those with the same id.

    Of several new rows with one id the last one wins: by the column `order`,
    which is not stored. Without one it is the last in `new`'s own plan, which
    only a table that was read and not shuffled keeps.
    """
    key = ["collection", "doc_id"]
    placed = new.withColumn("_order", F.monotonically_increasing_id() if order is None else F.col(order))
    last = top_per_group(placed, key, [F.desc("_order")], 1).select(*existing.columns)
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(last)
