"""Exact bursts and intake without doubles on streams that stop, fail and start again."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.bursts import ping_burst
from flowspark.sinks.commits import Commits, Taken
from flowspark.streaming import bursts, flows as streaming
from tests import flows as gen
from tests.test_io import line

ECHO = dict(proto="icmp", src_port=0, dst_port=8)


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("threshold,keys", [(4, ["dst_ip"]), (1, ["log_name", "dst_ip"])])
def test_bursts_of_a_stream_are_those_of_the_table(spark, tmp_path, threshold, keys):
    """Any order of arrival within the delay, equal times, a target without one, stops after any file."""
    window, spread, delay = 300, 60_000, 70_000
    rows = gen.random_rows(11, 240, logs=2, hubs=6, spread_us=spread, **ECHO)
    rows += [dict(ts_us=900 * k, dst_ip="slow", **ECHO) for k in range(40)] + [dict(ts_us=50_000 + k, dst_ip=None, **ECHO) for k in range(6)]
    rows += [dict(ts_us=k, dst_ip="tcp", proto="tcp", src_port=0, dst_port=8) for k in range(9)] + [dict(ts_us=None, dst_ip="slow", **ECHO)]
    # A hot target: a third of all rows, most of them in one instant.
    rows += [dict(ts_us=30_000 + (k % 3) * (k > 100), dst_ip="hot", **ECHO) for k in range(150)]
    random.Random(3).shuffle(rows)
    table = gen.make(spark, rows)
    want = shown(ping_burst(table.filter("ts_us IS NOT NULL"), threshold, window, keys))
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def arrive(part):
        gen.make(spark, part).coalesce(2).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(table.schema).parquet(folder)
        streaming.run_available(bursts.stream_ping_bursts(arriving, threshold, window, keys, delay), out, state)

    for at in range(0, len(rows), 200):
        arrive(rows[at : at + 200])
    arrive([dict(ts_us=10**9, dst_ip="closing", **ECHO)])
    # Far too late for anything, and no second burst of a target.
    arrive([dict(ts_us=k, dst_ip=target, **ECHO) for k in range(9) for target in ("late", "hot")] + [dict(ts_us=2 * 10**9, dst_ip="closing", **ECHO)])
    got = [r for r in shown(spark.read.parquet(out)) if "closing" not in r]
    assert got == [r for r in want if "closing" not in r] and len(got) > 4


def test_repeated_files_and_failed_batches_change_nothing(spark, tmp_path, monkeypatch):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def put(place, name, *seconds, uid="C"):
        (folder / place).mkdir(parents=True, exist_ok=True)
        rows = [line(ts=f"{1704067200 + s}.0").replace("Cuid", f"{uid}{s}" if uid else "-") for s in seconds]
        (folder / place / name).write_text("\n".join(rows) + "\n")

    def run():
        arriving = streaming.stream_conn_log(spark, str(folder / "*"), files_per_batch=1)
        streaming.land_batches(streaming.without_repeats(arriving), out, state)

    def seen():
        return sorted((r.log_name, r.ts_us // 10**6 - 1704067200, r.uid) for r in streaming.read_batches(spark, out).collect())

    assert seen() == []
    put("one", "a.log", 1, 2, 3)
    run()
    first = [("a", s, f"C{s}") for s in (1, 2, 3)]
    assert seen() == first
    # The same file again elsewhere, then with one more line; another log with the same uids; lines without uid.
    put("two", "a.log", 1, 2, 3)
    put("three", "a.log", 1, 2, 3, 4)
    put("one", "b.log", 1, 2)
    put("one", "c.log", 5, 5, 6, uid="")
    run()
    whole = sorted(first + [("a", 4, "C4"), ("b", 1, "C1"), ("b", 2, "C2"), ("c", 5, None), ("c", 6, None)], key=repr)
    assert sorted(seen(), key=repr) == whole
    # A batch that fails after its files are written is done again and counts once.
    put("one", "d.log", 7)
    with monkeypatch.context() as patch:
        patch.setattr(Commits, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    assert sorted(seen(), key=repr) == whole
    run()
    assert sorted(seen(), key=repr) == sorted(whole + [("d", 7, "C7")], key=repr)
    assert streaming.read_batches(spark, out).filter(F.col("day") == "2024-01-01").count() == len(whole) + 1


def test_a_name_is_published_once(spark, tmp_path):
    entries = Commits(spark, str(tmp_path / "entries"))
    assert entries.names() == []
    entries.publish("1", "a")
    with pytest.raises(Taken):
        entries.publish("1", "b")
    assert entries.names() == ["1"] and entries.read("1") == "a" and len([p for p in (tmp_path / "entries").iterdir() if not p.name.endswith(".crc")]) == 1
