"""Flood and scan detection in sliding time windows.

Three window rules, kept apart on purpose:

* `ping_burst`: trailing window, row count only, first hit per target.
* `syn_many_to_one`: forward window, row count, then the full window is described.
* `labelled_floods`: trailing window, row count and number of distinct peers.

One victim may hold a third of all rows, and all of them in one instant, so no
window ever runs over a whole key. Time is cut into cells as wide as the window.
Inside a cell all rows fit in one window, so a cell's first `threshold` rows
already decide whether its first hit lies there; the rows behind them cannot
start or end an earlier one. Cells are thinned to those rows before the shuffle
and the windows then run over a few rows per cell.

To describe a window in full, the hits (at most one per key) are written to the
shared folder first. Their size is then known: a small table is broadcast, so
the flows are filtered where they are read; a large one is joined by (key,
cell), where a skewed cell is split. What is left is aggregated partially.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import top_per_group
from flowspark.functions.time import SECOND, cell_of
from flowspark.operators import filters
from flowspark.session import cut_lineage

# Cells are joined into spans so that only one cell in this many is held twice.
CELLS_PER_SPAN = 64
# Peers named in an alert; None names all.
SAMPLE_SIZE = 10


def _in_spans(cells: DataFrame) -> DataFrame:
    """Give each row its span; rows of a span's last cell also go to the next span.

    A window touches at most two neighbouring cells, so each one lies whole in a span.
    """
    span = cell_of("_cell", CELLS_PER_SPAN)
    last = F.pmod("_cell", F.lit(CELLS_PER_SPAN)) == CELLS_PER_SPAN - 1
    spans = F.when(last, F.array(span, span + 1)).otherwise(F.array(span))
    return cells.withColumn("_span", F.explode(spans))


def first_dense_run(rows: DataFrame, keys: Sequence[str], threshold: int, window_us: int) -> DataFrame:
    """Per key the first `threshold` consecutive rows that span at most `window_us`.

    Start and end serve both window rules: the first trailing hit ends where the
    first forward hit starts plus `threshold - 1` rows.
    """
    cells = rows.select(*keys, "ts_us").withColumn("_cell", cell_of("ts_us", window_us))
    heads = top_per_group(cells, [*keys, "_cell"], ["ts_us"], threshold)
    along = Window.partitionBy(*keys, "_span").orderBy("ts_us")
    runs = _in_spans(heads).withColumn("_start", F.lag("ts_us", threshold - 1).over(along))
    return (
        runs.filter(F.col("ts_us") - F.col("_start") <= window_us)
        .groupBy(*keys)
        .agg(F.min("_start").alias("start_us"), F.min("ts_us").alias("end_us"))
    )


def ping_burst(
    flows: DataFrame,
    threshold: int = 5,
    window_us: int = 5 * SECOND,
    keys: Sequence[str] = ("dst_ip",),
) -> DataFrame:
    """First burst of echo requests per target: `start_us`, `end_us`, `count`.

    The count at the first hit is the threshold itself: one row earlier there
    was none, and a row adds one.
    """
    runs = first_dense_run(filters.echo_by_type(flows), keys, threshold, window_us)
    return runs.select(*keys, "start_us", "end_us", F.lit(threshold).cast("bigint").alias("count"))


def _describe(
    rows: DataFrame,
    keys: Sequence[str],
    peer: str,
    states: Iterable[str],
    prefix: str,
    *first: Column,
    sample_size: int | None = SAMPLE_SIZE,
) -> DataFrame:
    """Counts, states, times and the first peers of each key's rows.

    Rows are first aggregated per (key, peer), which spreads a hot key over all
    tasks; the peer sample then needs at most `sample_size` rows per key and task. The
    sample carries whole rows, so that both branches read the same shuffle.
    Everything but `first` (aggregates of a key's first row) is of fixed width,
    so Spark aggregates by hash instead of sorting all rows.
    """
    states = sorted(states)
    per_peer = rows.groupBy(*keys, peer).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("ts_us").alias("_from"),
        F.max("ts_us").alias("_to"),
        *[F.max(F.col("conn_state") == s).alias(f"_is_{s}") for s in states],
        *first,
    )
    first_names = [c for c in per_peer.columns if c.startswith("_first")]
    seen = F.array_compact(F.array(*[F.when(F.max(f"_is_{s}"), F.lit(s)) for s in states]))
    totals = per_peer.groupBy(*keys).agg(
        F.sum("_n").alias("syn_count"),
        F.count(F.lit(1)).alias(f"{prefix}_count"),
        F.min("_from").alias("start_us"),
        F.max("_to").alias("end_us"),
        seen.alias("conn_states"),
        *[F.min(c).alias(c) for c in first_names],
    )
    sample = (
        (per_peer if sample_size is None else top_per_group(per_peer, keys, [peer], sample_size))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(peer, *[c for c in per_peer.columns if c.startswith("_")])).alias("_rows"))
        .select(*keys, F.array_sort(F.transform("_rows", lambda r: r[peer])).alias(f"{prefix}_ips"))
    )
    return totals.join(sample, list(keys)).select(
        *keys,
        *first_names,
        f"{prefix}_ips",
        f"{prefix}_count",
        "syn_count",
        "conn_states",
        "start_us",
        "end_us",
        ((F.col("end_us") - F.col("start_us")) / SECOND).alias("duration_seconds"),
    )


def syn_many_to_one(
    flows: DataFrame,
    threshold: int = 10,
    window_us: int = 20 * SECOND,
    keys: Sequence[str] = ("dst_ip",),
    states: Iterable[str] = filters.FLOOD_STATES,
    sample_size: int | None = SAMPLE_SIZE,
) -> DataFrame:
    """First dense forward window per target, with its first `sample_size` sources (None: all)."""
    rows = filters.half_open(flows, states).select(
        *keys, "src_ip", "dst_port", "conn_state", "ts_us", "line_no", cell_of("ts_us", window_us).alias("_cell")
    )
    runs = first_dense_run(rows, keys, threshold, window_us)
    first_cell = cell_of("start_us", window_us)
    wanted = runs.select(
        *keys, F.col("start_us").alias("_from"), F.explode(F.array(first_cell, first_cell + 1)).alias("_cell")
    )
    inside = rows.join(cut_lineage(wanted, "syn-windows"), [*keys, "_cell"]).filter(
        F.col("ts_us").between(F.col("_from"), F.col("_from") + window_us)
    )
    first_row = F.min(F.struct("ts_us", "line_no", "dst_port")).alias("_first")
    found = _describe(inside, keys, "src_ip", states, "source", first_row, sample_size=sample_size)
    return found.withColumns(
        {"first_port": F.col("_first.dst_port"), "attack_type": filters.syn_alert_type(F.col("source_count"))}
    ).drop("_first")


def syn_one_to_many(
    flows: DataFrame,
    threshold: int = 10,
    spread: int = 3,
    keys: Sequence[str] = ("src_ip",),
    states: Iterable[str] = filters.FLOOD_STATES,
    sample_size: int | None = SAMPLE_SIZE,
) -> DataFrame:
    """Sources with many half-open rows to at least `spread` targets; no time window."""
    found = _describe(filters.half_open(flows, states), keys, "dst_ip", states, "target", sample_size=sample_size)
    return found.filter((F.col("syn_count") >= threshold) & (F.col("target_count") >= spread)).withColumn(
        "attack_type", F.lit(filters.SCAN_ALERT)
    )


def syn_alerts(flows: DataFrame, threshold: int = 10, window_us: int = 20 * SECOND) -> DataFrame:
    """Both SYN alert kinds in one table; fields of the other kind are NULL."""
    flood = syn_many_to_one(flows, threshold, window_us).withColumnsRenamed(
        {"dst_ip": "target_ip", "first_port": "target_port"}
    )
    scan = syn_one_to_many(flows, threshold).withColumnRenamed("src_ip", "source_ip")
    return flood.withColumn("type", F.lit("many_to_one")).unionByName(
        scan.withColumn("type", F.lit("one_to_many")), allowMissingColumns=True
    )


def _thinned(rows: DataFrame, keys: Sequence[str], peer: str, threshold: int, peers: int) -> DataFrame:
    """The rows of each cell that can decide a count-and-spread window.

    For counts: the first `threshold` rows of a cell (windows ending in it) and
    the last ones (windows reaching back into it). For spread: the first row of
    the first `peers` peers and the last row of the last `peers` ones. A first
    hit is always one of them: it either completes the count or adds a peer.
    """
    cell = [*keys, "_cell"]
    row = [*cell, peer, "ts_us", "line_no"]
    at = F.struct("ts_us", "line_no")
    edges = rows.groupBy(*cell, peer).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    by_peer = edges.select(*cell, peer, F.explode(F.array(_end("_first", 1), _end("_last", -1))).alias("_end"))
    by_row = rows.select(*row).withColumn("_at", at)
    by_row = by_row.select(*cell, peer, F.explode(F.array(_end("_at", 1), _end("_at", -1))).alias("_end"))

    def kept(ends: DataFrame, n: int) -> DataFrame:
        ends = ends.select(*cell, peer, "_end.*")
        return top_per_group(ends, [*cell, "_side"], ["_ts", "_line"], n).select(
            *cell, peer, (F.col("_ts") * F.col("_side")).alias("ts_us"), (F.col("_line") * F.col("_side")).alias("line_no")
        )

    return kept(by_row, threshold).unionByName(kept(by_peer, peers)).distinct()


def _end(at: str, side: int) -> Column:
    """A row seen from the front (1) or, with its order reversed, from the back (-1)."""
    return F.struct(
        F.lit(side).alias("_side"),
        (F.col(f"{at}.ts_us") * side).alias("_ts"),
        (F.col(f"{at}.line_no") * side).alias("_line"),
    )


def first_spread_window(
    rows: DataFrame, keys: Sequence[str], peer: str, threshold: int, peers: int, window_us: int
) -> DataFrame:
    """Per key the first row whose trailing window has enough rows and enough peers."""
    along = Window.partitionBy(*keys, "_span")
    ordered = _in_spans(_thinned(rows, keys, peer, threshold, peers)).withColumn(
        "_rn", F.row_number().over(along.orderBy("ts_us", "line_no"))
    )
    trailing = along.orderBy("ts_us").rangeBetween(-window_us, Window.currentRow)
    # A range frame also takes in later rows with the same time; drop them by number.
    seen = ordered.withColumn("_oldest", F.min("_rn").over(trailing)).withColumn(
        "_frame", F.collect_list(F.struct("_rn", peer)).over(trailing)
    )
    upto = F.filter("_frame", lambda e: e["_rn"] <= F.col("_rn"))
    spread = F.size(F.array_distinct(F.transform(upto, lambda e: e[peer])))
    hit = (F.col("_rn") - F.col("_oldest") + 1 >= threshold) & (spread >= peers)
    return seen.filter(hit).groupBy(*keys).agg(F.min(F.struct("ts_us", "line_no")).alias("_hit"))


def _spread_rows(flows: DataFrame, pattern: str, window_us: int, keys: Sequence[str]) -> tuple[DataFrame, list[str], str]:
    """Echo rows of a pattern in cells, what they are grouped by, and the peer column.

    Rows without a line number are told apart by their time alone.
    """
    hub, peer = {"many_to_one": ("dst_ip", "src_ip"), "one_to_many": ("src_ip", "dst_ip")}[pattern]
    by = [*keys, hub]
    line = F.coalesce("line_no", "ts_us").alias("line_no")
    return filters.echo_by_pair(flows).select(*by, peer, "ts_us", line, cell_of("ts_us", window_us).alias("_cell")), by, peer


def flood_counts(
    flows: DataFrame,
    pattern: str,
    threshold: int = 10,
    peers: int = 3,
    window_us: int = 20 * SECOND,
    keys: Sequence[str] = ("log_name",),
) -> DataFrame:
    """How many ping floods `labelled_floods` finds per log, without describing them."""
    rows, by, peer = _spread_rows(flows, pattern, window_us, keys)
    hits = first_spread_window(rows, by, peer, threshold, peers, window_us)
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias(pattern))


def labelled_floods(
    flows: DataFrame,
    pattern: str,
    threshold: int = 10,
    peers: int = 3,
    window_us: int = 20 * SECOND,
    keys: Sequence[str] = ("log_name",),
) -> DataFrame:
    """First ping flood per log and hub: `many_to_one` by target, `one_to_many` by source.

    The address list is whole: at its first hit a window has at most
    `max(threshold, peers)` peers. Pass `keys=()` to look across log borders.
    """
    rows, by, peer = _spread_rows(flows, pattern, window_us, keys)
    hits = first_spread_window(rows, by, peer, threshold, peers, window_us)
    last_cell = cell_of("_hit.ts_us", window_us)
    wanted = hits.select(*by, "_hit", F.explode(F.array(last_cell - 1, last_cell)).alias("_cell"))
    inside = rows.join(cut_lineage(wanted, "ping-windows"), [*by, "_cell"]).filter(
        (F.col("ts_us") >= F.col("_hit.ts_us") - window_us) & (F.struct("ts_us", "line_no") <= F.col("_hit"))
    )
    per_peer = inside.groupBy(*by, peer).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_from"), F.max("ts_us").alias("_to")
    )
    return per_peer.groupBy(*by).agg(
        F.array_sort(F.collect_list(peer)).alias(f"unique_{peer}s"),
        F.count(F.lit(1)).alias(f"{peer}_count"),
        F.sum("_n").alias("packet_count"),
        F.min("_from").alias("start_us"),
        F.max("_to").alias("end_us"),
    )
