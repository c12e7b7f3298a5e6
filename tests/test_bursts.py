"""Window operators against a scan that tries every window."""

import pytest

from flowspark.operators import bursts
from tests import flows as gen


SEEDS = range(40)


def _cases(n, logs=1, **fixed):
    """Many random cases in one table, told apart by log_name."""
    rows = []
    for seed in SEEDS:
        for r in gen.random_rows(seed, n, logs=logs, **fixed):
            r["log_name"] = f"{seed}-{r['log_name']}"
            # Times of real size in most cases, small ones in the others.
            r["ts_us"] += 1_704_067_200_000_000 + seed * 977 if seed % 4 else 0
            rows.append(r)
    return rows


@pytest.mark.parametrize("window,threshold", [(1, 2), (7, 3), (40, 5), (90, 9)])
def test_ping_burst(spark, window, threshold):
    rows = _cases(60, proto="icmp", src_port=0, dst_port=8)
    want = set()
    for key, group in gen.groups(rows, "log_name", "dst_ip").items():
        hit = gen.trailing_hit(group, window, lambda seen: len(seen) >= threshold)
        if hit:
            want.add((*key, hit[0]["ts_us"], hit[-1]["ts_us"], len(hit)))
    got = bursts.ping_burst(gen.make(spark, rows), threshold, window, keys=("log_name", "dst_ip"))
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.mark.parametrize("window,threshold", [(2, 2), (5, 4), (33, 4), (80, 12)])
def test_syn_many_to_one(spark, window, threshold):
    rows = _cases(70, proto="tcp", src_port=1, dst_port=80, conn_state="S0")
    for r in rows[::3]:
        r["conn_state"] = "REJ"
    for r in rows[::5]:
        r["conn_state"] = "SF"  # not a flood state
    half_open = [r for r in rows if r["conn_state"] != "SF"]
    want = set()
    for key, group in gen.groups(half_open, "log_name", "dst_ip").items():
        hit = gen.forward_hit(group, window, threshold)
        if hit:
            sources = sorted({r["src_ip"] for r in hit})
            states = sorted({r["conn_state"] for r in hit})
            want.add((*key, tuple(sources[:10]), len(sources), len(hit), tuple(states), hit[0]["ts_us"], hit[-1]["ts_us"]))
    got = bursts.syn_many_to_one(gen.make(spark, rows), threshold, window, keys=("log_name", "dst_ip"))
    assert {
        (r.log_name, r.dst_ip, tuple(r.source_ips), r.source_count, r.syn_count, tuple(r.conn_states), r.start_us, r.end_us)
        for r in got.collect()
    } == want and want


@pytest.mark.parametrize("pattern,hub,peer", [("many_to_one", "dst_ip", "src_ip"), ("one_to_many", "src_ip", "dst_ip")])
@pytest.mark.parametrize("window,threshold,peers", [(6, 2, 2), (18, 4, 3), (45, 6, 3), (45, 3, 4), (250, 12, 3)])
def test_labelled_floods(spark, pattern, hub, peer, window, threshold, peers):
    rows = _cases(90, logs=2, hubs=4, peers=4)
    want = set()
    for key, group in gen.groups(rows, "log_name", hub).items():
        hit = gen.trailing_hit(group, window, lambda s: len(s) >= threshold and len({r[peer] for r in s}) >= peers)
        if hit:
            found = sorted({r[peer] for r in hit})
            want.add((*key, tuple(found), len(found), len(hit), hit[0]["ts_us"], hit[-1]["ts_us"]))
    got = bursts.labelled_floods(gen.make(spark, rows), pattern, threshold, peers, window)
    assert {(r[0], r[1], tuple(r[2]), *r[3:]) for r in got.collect()} == want and want


def test_window_border_counts(spark):
    """A burst exactly as long as the window is one; a microsecond more is not."""
    rows = [dict(ts_us=t, src_port=0, dst_port=8) for t in (0, 1, 2, 3, 5_000_000)]
    assert bursts.ping_burst(gen.make(spark, rows)).count() == 1
    rows[-1]["ts_us"] += 1
    assert bursts.ping_burst(gen.make(spark, rows)).count() == 0


def test_burst_across_span_border(spark):
    """A burst over the border between two spans of cells is found once."""
    window = 10
    border = window * bursts.CELLS_PER_SPAN
    rows = [dict(ts_us=border + d, src_port=0, dst_port=8) for d in (-6, -4, -1, 1, 3)]
    got = bursts.ping_burst(gen.make(spark, rows), 5, window).collect()
    assert [(r.start_us, r.end_us) for r in got] == [(border - 6, border + 3)]


def test_negative_times(spark):
    rows = [dict(ts_us=t, src_port=0, dst_port=8) for t in (-13, -9, -8, -7, -4)]
    got = bursts.ping_burst(gen.make(spark, rows), 5, 9).collect()
    assert [(r.start_us, r.end_us) for r in got] == [(-13, -4)]


def test_hot_target_is_thinned_before_the_shuffle(spark):
    """The plan limits rows per cell on the map side."""
    flows = gen.make(spark, gen.random_rows(1, 10, proto="icmp", src_port=0, dst_port=8))
    plan = bursts.ping_burst(flows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_peer_flood_then_third_peer(spark):
    """Thousands of rows of one peer hide neither the count nor the late third peer."""
    rows = [dict(ts_us=i // 100, src_ip="10.0.0.1") for i in range(2000)]
    rows += [dict(ts_us=30, src_ip="10.0.0.2"), dict(ts_us=31, src_ip="10.0.0.3"), dict(ts_us=60, src_ip="10.0.0.4")]
    got = bursts.labelled_floods(gen.make(spark, rows), "many_to_one", 10, 3, 50, keys=()).collect()
    assert [(r.src_ip_count, r.packet_count, r.end_us) for r in got] == [(3, 2002, 31)]


def test_syn_one_to_many(spark):
    rows = _cases(60, hubs=5, peers=5, proto="tcp", src_port=1, dst_port=80, conn_state="S0")
    want = set()
    for key, group in gen.groups(rows, "log_name", "src_ip").items():
        targets = {r["dst_ip"] for r in group}
        if len(group) >= 10 and len(targets) >= 3:
            want.add((*key, tuple(sorted(targets)), len(targets), len(group), group[0]["ts_us"], group[-1]["ts_us"]))
    got = bursts.syn_one_to_many(gen.make(spark, rows), keys=("log_name", "src_ip")).collect()
    assert {(r.log_name, r.src_ip, tuple(r.target_ips), r.target_count, r.syn_count, r.start_us, r.end_us) for r in got} == want
