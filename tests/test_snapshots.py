"""Snapshot tables: versions, merges of touched buckets, killed and competing writers, filters per bucket."""

import pytest
from pyspark.sql import functions as F

from flowspark.operators import documents, evidence
from flowspark.sinks.snapshots import Conflict, SnapshotTable


def docs(spark, rows):
    return spark.createDataFrame(rows, "collection string, doc_id string, text string, place int")


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_are_versions(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "kb"), buckets=8)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.upsert(docs(spark, [("x", "1", "old", 1), ("x", "1", "new", 2), ("y", "1", "a", 0), (None, "1", "b", 0), ("x", None, None, 0)]), "place") == 1
    first = [("x", "1", "new"), ("y", "1", "a"), (None, "1", "b"), ("x", None, None)]
    assert shown(table.read()) == sorted(first, key=repr)
    before = table.manifest()["files"]
    assert table.upsert(docs(spark, [("y", "1", "A", 0), ("z", "9", "c", 0)]), "place") == 2
    assert shown(table.read()) == sorted([("x", "1", "new"), ("y", "1", "A"), (None, "1", "b"), ("x", None, None), ("z", "9", "c")], key=repr)
    after = table.manifest()["files"]
    # Buckets without a new row keep their files.
    assert sum(before.get(b) != names for b, names in after.items()) <= 2 and any(before.get(b) == names for b, names in after.items())
    assert shown(table.read(version=1)) == sorted(first, key=repr)
    with pytest.raises(ValueError):
        table.upsert(docs(spark, [("y", "1", "A", 0)]).withColumn("more", F.lit(1)), "place")
    # No new rows: a version with the same rows.
    assert table.upsert(docs(spark, []), "place") == 3 and table.read().count() == 5
    table.clean()
    assert table.versions() == [3] and table.read().count() == 5


def test_a_killed_writer_changes_nothing(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "kb"), buckets=4)
    table.upsert(docs(spark, [("x", str(k), "old", 0) for k in range(20)]), "place")
    open_read = table.read()

    def killed(manifest):
        # The new files are all there; the manifest is not.
        assert any("00000002-" in name for names in manifest["files"].values() for name in names)
        assert {r.text for r in SnapshotTable(spark, table.path).read().collect()} == {"old"}
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(table, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(docs(spark, [("x", str(k), "new", 0) for k in range(20)]), "place")
    assert {r.text for r in table.read().collect()} == {"old"} and table.versions() == [1]
    table.upsert(docs(spark, [("x", str(k), "new", 0) for k in range(20)]), "place")
    assert {r.text for r in table.read().collect()} == {"new"}
    # A reader that began before still has its version's files.
    assert {r.text for r in open_read.collect()} == {"old"}
    # The killed writer's files belong to no version.
    assert table.clean(keep=2) == 1 and {r.text for r in table.read(version=1).collect()} == {"old"}


def test_of_two_writers_one_fails_whole(spark, tmp_path, monkeypatch):
    one, two = (SnapshotTable(spark, str(tmp_path / "kb"), buckets=4) for _ in range(2))
    one.upsert(docs(spark, [("x", "1", "a", 0)]), "place")
    commit = one._commit

    def overtaken(manifest):
        two.upsert(docs(spark, [("x", "1", "two", 0)]), "place")
        commit(manifest)

    monkeypatch.setattr(one, "_commit", overtaken)
    with pytest.raises(Conflict):
        one.upsert(docs(spark, [("x", "1", "one", 0)]), "place")
    assert one.versions() == [1, 2] and [r.text for r in one.read().collect()] == ["two"]
    assert not [p for p in (tmp_path / "kb" / "versions").iterdir() if "." in p.name.strip(".").removesuffix(".crc")]


def test_marked_batches_come_once(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "kb"), buckets=4)
    assert table.upsert(docs(spark, [("x", "1", "a", 0)]), "place", mark=("s", 0)) == 1
    assert table.upsert(docs(spark, [("x", "1", "repeat", 0)]), "place", mark=("s", 0)) == 1
    assert table.upsert(docs(spark, [("x", "2", "b", 0)]), "place", mark=("other", 0)) == 2
    assert table.upsert(docs(spark, [("x", "1", "c", 0)]), "place", mark=("s", 1)) == 3
    assert shown(table.read()) == [("x", "1", "c"), ("x", "2", "b")]


def test_evidence_opens_only_files_that_may_hold_an_address(spark, tmp_path):
    rows = [(k, f"10.0.{k % 200}.1", None, f"192.0.2.{k}" if k % 3 else None, 80, "DoS", 20, "anomalous") for k in range(400)]
    anomalies = spark.createDataFrame(rows, "row_no int, srcIP string, srcPort int, dstIP string, dstPort int, taxonomy string, heuristic int, label string")
    kb = documents.anomaly_docs(anomalies).select("collection", "doc_id", "text", "meta", F.lit(0).alias("place"))
    addresses = lambda: F.array("meta.srcIP", "meta.dstIP")
    table = SnapshotTable(spark, str(tmp_path / "kb"), buckets=64, indexed=addresses)
    table.upsert(kb, "place")
    ips = spark.createDataFrame([("a", "10.0.7.1"), ("b", "192.0.2.100"), ("b", "nowhere"), ("c", None)], "log_name string, ip string")
    few = table.read(values=ips.select("ip"))
    opened, there = set(few.inputFiles()), set(table.read().inputFiles())
    assert 0 < len(opened) <= 6 and len(there) > 50 and opened < there
    found, whole = (shown(evidence.ip_evidence(ips, held)) for held in (few, table.read()))
    assert found == whole and len(found) == 3
    assert table.read(values=ips.filter("ip = 'nowhere'").select("ip")).count() == 0
    # A merge renews the filters of its buckets.
    table.upsert(kb.limit(1).withColumn("meta", F.create_map(F.lit("srcIP"), F.lit("nowhere"), F.lit("dstIP"), F.lit("unknown"))), "place")
    assert table.read(values=ips.filter("ip = 'nowhere'").select("ip")).filter("meta['srcIP'] = 'nowhere'").count() == 1
