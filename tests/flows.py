"""Small flow tables and brute-force answers for the window tests."""

from __future__ import annotations

import random

COLUMNS = (
    "log_name string, line_no bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, "
    "proto string, conn_state string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint"
)


def make(spark, rows):
    """Flow table from dicts; what a row leaves out is filled with plain values."""
    filled = []
    for i, r in enumerate(rows):
        base = dict(
            log_name="log", line_no=i, ts_us=0, src_ip="10.0.0.1", src_port=8, dst_ip="192.0.2.1", dst_port=0,
            proto="icmp", conn_state="OTH", duration=0.0, orig_bytes=1, resp_bytes=1, orig_pkts=1, resp_pkts=1,
        )
        filled.append(tuple({**base, **r}.values()))
    return spark.createDataFrame(filled, COLUMNS)


def random_rows(seed: int, n: int, logs: int = 1, hubs: int = 2, peers: int = 4, spread_us: int = 400, **fixed):
    """Rows with many equal times and bursts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(
            dict(
                log_name=f"log{rng.randrange(logs)}",
                line_no=i,
                ts_us=rng.choice([rng.randrange(spread_us), rng.randrange(20) * (spread_us // 20)]),
                src_ip=f"10.0.0.{min(rng.randrange(peers), rng.randrange(peers))}",
                dst_ip=f"192.0.2.{rng.randrange(hubs)}",
                **fixed,
            )
        )
    return rows


def by_time(rows):
    return sorted(rows, key=lambda r: (r["ts_us"], r["line_no"]))


def groups(rows, *keys):
    found = {}
    for r in by_time(rows):
        found.setdefault(tuple(r[k] for k in keys), []).append(r)
    return found


def trailing_hit(rows, window, enough):
    """First (window rows) for which `enough(rows)` holds, checking every end row from scratch."""
    for end in range(len(rows)):
        seen = [r for r in rows[: end + 1] if rows[end]["ts_us"] - r["ts_us"] <= window]
        if enough(seen):
            return seen
    return None


def forward_hit(rows, window, threshold):
    for first in rows:
        seen = [r for r in rows if first["ts_us"] <= r["ts_us"] <= first["ts_us"] + window]
        if len(seen) >= threshold:
            return seen
    return None
