"""Daily state against one pass; bootstrap intervals against their definition."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from flowspark.operators import metrics, profile
from tests import flows as gen

DAY = 86_400_000_000


def test_daily_state_merges_to_the_features_of_one_pass(spark):
    draw = random.Random(1)
    rows = []
    for k in range(6_000):
        log = "hot" if k % 3 == 0 else f"log{k % 7}"
        rows.append(dict(log_name=log, ts_us=draw.randrange(3 * DAY), src_ip=f"10.0.{draw.randrange(40)}.{draw.randrange(100)}", dst_ip=None if k % 50 == 0 else f"192.0.2.{draw.randrange(200)}",
                         src_port=draw.choice([None, draw.randrange(60_000)]), dst_port=draw.randrange(1_000), proto=draw.choice(["tcp", "udp", "icmp"]), conn_state=draw.choice(["S0", "SF", "REJ"]),
                         duration=draw.choice([None, draw.random()]), orig_bytes=draw.choice([None, draw.randrange(10**6)])))
    flows = gen.make(spark, rows).repartition(6)
    exact = {r.log_name: r for r in profile.flow_features(flows).collect()}
    # The parts of a day come one after the other, in any cut.
    parts = [profile.daily_state(flows.filter(F.pmod("line_no", F.lit(3)) == k)) for k in range(3)]
    state = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = profile.merged_state(state)
    assert merged.count() == merged.select("log_name", "day").distinct().count() == 8 * 3
    for given in (state, merged):
        found = {r.log_name: r for r in profile.flow_features_from_state(given).collect()}
        assert set(found) == set(exact)
        for log, want in exact.items():
            for name in profile.FEATURES:
                room = 0.05 if name.startswith("unique") or name.endswith("diversity") else 1e-9
                assert abs(found[log][name] - want[name]) <= room * max(1.0, abs(want[name])), (log, name)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and profile.daily_state(flows.limit(0)).count() == 0


def test_intervals_follow_their_draws(spark):
    draw = random.Random(2)
    rows = [(f"log{k}", draw.random() < 0.4, draw.choice([0, 1, 1, None]), k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "log_name string, label boolean, prediction int, side int").repartition(5)
    limits = metrics.poisson_limits()
    assert limits[0] == int(np.exp(-1) * 2**32) and len(limits) == 12 and limits == sorted(limits)
    for side, found in ((r.side, r) for r in metrics.metric_intervals(df, ["side"], replicates=60).collect()):
        accuracies = []
        for r in range(1, 61):
            right = total = 0
            for name, label, prediction, at in rows:
                if at == side and prediction is not None:
                    u = int(hashlib.md5(f"{name}:{r}".encode()).hexdigest()[:8], 16)
                    weight = sum(limit <= u for limit in limits)
                    right, total = right + weight * (label == bool(prediction)), total + weight
            accuracies.append(right / total)
        assert abs(found.accuracy_low - np.quantile(accuracies, 0.025)) < 1e-12 and abs(found.accuracy_high - np.quantile(accuracies, 0.975)) < 1e-12
        assert found.accuracy_low < found.accuracy < found.accuracy_high
    one = metrics.metric_intervals(df, replicates=20).first()
    assert one.total == sum(1 for r in rows if r[2] is not None) and one.recall_low <= one.recall <= one.recall_high
    none = metrics.metric_intervals(df.limit(0), replicates=5).first()
    assert none.total == 0 and none.accuracy_low is None
