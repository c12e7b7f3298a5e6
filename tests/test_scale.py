"""Helpers that split hot groups give the same answer as the plain form."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from flowspark.functions.scale import bucketed_row_number, top_per_group, within_size
from flowspark.functions.text import cap_lines, cap_text
from flowspark.operators import documents, metrics, retrieval, rule_match
from flowspark.sinks.tables import with_parts
from tests import flows as gen


def test_row_number_over_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.3 else "cold", i * 7) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos bigint")
    got = bucketed_row_number(df, "rn", F.floor(F.col("pos") / 100).cast("bigint"), ["pos"], ["k"]).collect()
    seen = {}
    for k, pos in sorted(rows, key=lambda r: r[1]):
        seen[k, pos] = len([1 for a, b in rows if a == k and b <= pos])
    assert len(got) == len(rows) and all(seen[r.k, r.pos] == r.rn for r in got)


def test_top_per_group_and_size(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert top_per_group(df, ["g"], [F.desc("id")], 2).count() == 6
    assert within_size(df, 100) and not within_size(df, 99)


def test_parts(spark):
    df = spark.range(1000).withColumnRenamed("id", "line_no")
    got = {r.part: r["count"] for r in with_parts(df, width=64).groupBy("part").count().collect()}
    assert got == {**{i: 108 for i in range(1, 10)}, 10: 28}


def _capped(text, n):
    if len(text) <= n:
        return text
    kept = []
    for line in text.split("\n"):
        if len("\n".join([*kept, line])) + 1 > n:
            break
        kept.append(line)
    return "\n".join(kept)


def test_cap_text_and_lines(spark):
    rng = random.Random(3)
    texts = ["\n".join("x" * rng.randrange(9) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += ["", "\n" * 50, "a" * 40, "ab\n" + "c" * 50, "x" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for cap in (10, 30):
        got = {r.id: r.t for r in df.select("id", cap_text(F.col("text"), cap).alias("t")).collect()}
        assert got == {i: _capped(t, cap) for i, t in enumerate(texts)}
        lines = df.select(F.col("id").alias("log_name"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        kept = cap_lines(lines, cap).groupBy("log_name").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("l"))
        by_line = {r.log_name: "\n".join(x.raw for x in r.l) for r in kept.collect()}
        assert {i: by_line.get(i, "") for i in got} == got


def test_unique_ids_within_one_batch(spark):
    new = spark.createDataFrame([("a", 0), ("a", 1), ("a_1", 2), ("a_1_1", 3), ("a_1", 4)] + [("hot", i) for i in range(5, 3000)], "doc_id string, row_no bigint")
    existing = spark.createDataFrame([(f"hot_{2 * i}",) for i in range(1, 1500)] + [("a_3",)], "doc_id string")
    ids = [r.unique_id for r in documents.unique_doc_ids(new, existing, bucket_width=64).collect()]
    assert len(ids) == len(set(ids)) == new.count() and not set(ids) & {r.doc_id for r in existing.collect()}
    by_row = {r.row_no: r.unique_id for r in documents.unique_doc_ids(new, existing, bucket_width=64).collect()}
    assert [by_row[i] for i in range(5)] == ["a", "a_2", "a_1", "a_1_1", "a_1_2"] and by_row[7] == "hot_3"


def test_same_row_of_two_files(spark):
    rows = spark.createDataFrame(
        [(f, 0, None, None, None, None, None, 20, None) for f in ("x", "y")],
        "file_name string, row_no bigint, srcIP string, srcPort int, dstIP string, dstPort int, taxonomy string, heuristic int, label string",
    )
    assert sorted(r.doc_id for r in documents.anomaly_docs(rows).collect()) == ["anomaly_0", "anomaly_0_1"]


def test_unique_ids_fill_gaps(spark):
    new = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), ("c", 1), ("c", 2)], "doc_id string, row_no bigint")
    existing = spark.createDataFrame([("a",), ("a_2",), ("a_3",), ("c_1",), ("a_05",), ("zz",)], "doc_id string")
    got = {(r.doc_id, r.row_no): r.unique_id for r in documents.unique_doc_ids(new, existing, bucket_width=2).collect()}
    want, taken = {}, {"a", "a_2", "a_3", "c_1", "a_05", "zz"}  # no base here is another one's suffix form
    for base, no in sorted(got):
        n = 0
        while (name := base if n == 0 else f"{base}_{n}") in taken:
            n += 1
        taken.add(name)
        want[base, no] = name
    assert got == want


def test_rule_paths_agree(spark):
    rng = random.Random(5)
    rows = [dict(src_ip=f"10.0.0.{rng.randrange(4)}", dst_ip=f"192.0.2.{rng.randrange(4)}", src_port=rng.choice([1, 2, None]), dst_port=rng.choice([80, 8, None])) for _ in range(200)]
    flows = gen.make(spark, rows)
    rules = [
        ("10.0.0.1", None, None, None), ("10.0.0.2", "1", None, None), (None, None, "192.0.2.3", "8"),
        (None, "2", None, "80"), ("10.0.0.3", "2", "192.0.2.0", "80"), (None, None, None, "9999"),
    ]
    table = spark.createDataFrame(rules, "srcIP string, srcPort string, dstIP string, dstPort string")
    names = ("src_ip", "src_port", "dst_ip", "dst_port")
    want = {
        i for i, r in enumerate(rows)
        if any(all(w is None or (r[n] is not None and str(r[n]) == w) for w, n in zip(rule, names)) for rule in rules)
    }
    for bound in (1000, 0):
        got = rule_match.matches_any_rule(flows, table, broadcast_rows=bound)
        assert got.columns == flows.columns
        assert sorted(r.line_no for r in got.collect()) == sorted(want)
    everything = table.unionByName(spark.createDataFrame([(None,) * 4], table.schema))
    assert rule_match.matches_any_rule(flows, everything).count() == len(rows)
    assert rule_match.matches_any_rule(flows, table.limit(0)).count() == 0


def test_topk_blocks_agree(spark):
    rng = random.Random(2)
    vectors = [(str(i), [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    kb = spark.createDataFrame(vectors, "doc_id string, vector array<double>")
    queries = kb.limit(9).withColumnRenamed("doc_id", "query_id")
    whole = {tuple(r) for r in retrieval.vector_topk(queries, kb, 4).collect()}
    blocks = {tuple(r) for r in retrieval.vector_topk(queries, kb, 4, rows_per_block=4).collect()}
    assert whole == blocks and len(whole) == 36
    assert retrieval.vector_topk(queries.limit(0), kb, 4).count() == 0


def test_auc_in_ranges(spark):
    rng = random.Random(4)
    rows = [("m", rng.random() < 0.3, round(rng.gauss(0, 1), 3)) for _ in range(3000)]
    rows += [("tied", rng.random() < 0.5, float(rng.randrange(3))) for _ in range(300)] + [("one", True, 1.0)] * 3
    df = spark.createDataFrame(rows, "k string, label boolean, score double")
    got = {r.k: r.auc for r in metrics.roc_auc(df, ["k"]).collect()}
    for k in ("m", "tied"):
        pos = [s for g, y, s in rows if g == k and y]
        neg = [s for g, y, s in rows if g == k and not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[k] - want) < 1e-12
    assert got["one"] == 0.0
    overall = metrics.roc_auc(df.filter("k = 'm'")).collect()[0]
    assert overall.auc == got["m"]


def test_topk_of_copies_ties_and_filters_is_that_of_all_pairs(spark):
    draw = np.random.default_rng(8)
    vectors = np.round(draw.normal(size=(60, 4)), 1)
    # A third are copies of one vector, some differ from it by less than single precision tells.
    vectors[::3] = vectors[0]
    vectors[3:30:9] += 1e-9 * draw.normal(size=(3, 4))
    rows = [(f"d{i}", v.tolist(), {"label": str(i % 3)}) for i, v in enumerate(vectors)] + [("nan", [math.nan] * 4, {"label": "0"}), ("zero", [0.0] * 4, None)]
    kb = spark.createDataFrame(rows, "doc_id string, vector array<double>, meta map<string,string>").repartition(3)
    queries = kb.filter("doc_id <> 'nan'").select(F.col("doc_id").alias("query_id"), "vector", F.expr("if(doc_id like '%1', map('label', '1'), null)").alias("wanted"))
    unit = {d: np.array(v) / (np.linalg.norm(v) or 1.0) for d, v, _ in rows}
    labels = {d: (m or {}).get("label") for d, _, m in rows}
    for filtered in (False, True):
        want = set()
        for q in unit.keys() - {"nan"}:
            fits = [d for d in unit if d != "nan" and not (filtered and q.endswith("1") and labels[d] != "1")]
            scores = {d: round(float(unit[q] @ unit[d]), 9) for d in fits}
            want |= {(q, s) for s in sorted(scores.values(), reverse=True)[:5]}
        asked = queries if filtered else queries.drop("wanted")
        for few in (100, 0):
            found = retrieval.vector_topk(asked, kb, 5, rows_per_block=25, few=few).collect()
            assert {(r.query_id, round(r.similarity, 9)) for r in found} == want and len(found) == 61 * 5
            if not filtered:
                copies = sorted(r.doc_id for r in found if r.query_id == "d15")
                assert copies == sorted(d for d in unit if round(float(unit[d] @ unit["d15"]), 12) == 1)[:5]


def test_block_pairs_are_not_merged_into_few_tasks(spark):
    kb = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(40)], "doc_id string, vector array<double>")
    found = retrieval.vector_topk(kb.withColumnRenamed("doc_id", "query_id"), kb, 2, rows_per_block=10, few=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and found.count() == 80


def test_roc_points_of_more_scores_than_a_sketch_holds(spark):
    rows = spark.range(0, 300_000, 1, 16).select((F.col("id") % 3 == 0).alias("label"), (F.xxhash64("id") / 2**40).alias("score"), F.lit("k").alias("k"))
    points = metrics.roc_points(rows, ["k"])
    # Approximate cuts are found once, not again by each branch.
    assert "percentile_approx" not in points._jdf.queryExecution().optimizedPlan().toString()
    found = points.select("score", "tp", "fp").toPandas().sort_values("score", ascending=False)
    plain = rows.toPandas().sort_values("score", ascending=False)
    assert (found["tp"].to_numpy() == plain["label"].cumsum().to_numpy()).all()
    assert (found["fp"].to_numpy() == (~plain["label"]).cumsum().to_numpy()).all()
