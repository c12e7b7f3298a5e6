"""End-to-end jobs on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions.taxonomy import taxonomy_groups, taxonomy_prefixes
from flowspark.functions.text import all_tokens
from flowspark.operators import documents, evidence, retrieval
from flowspark.plans import pipelines
from flowspark.sources import conn_log
from tests import flows as gen


def _anomalies(spark):
    return spark.createDataFrame(
        [(0, "10.0.0.1", None, "192.0.2.1", 80, "ntscIC", 20, "suspicious"), (1, "10.0.0.9", 1, None, None, "nope", 10, None)],
        "row_no bigint, srcIP string, srcPort int, dstIP string, dstPort int, taxonomy string, heuristic int, label string",
    )


def test_filter_then_label(spark):
    rows = [dict(log_name="a", src_ip=f"10.0.0.{i % 4}", ts_us=i) for i in range(12)]
    rows += [dict(log_name="b", dst_ip="192.0.2.7", ts_us=i) for i in range(12)]
    rules = spark.createDataFrame([(None, None, "192.0.2.1", None)], "srcIP string, srcPort string, dstIP string, dstPort string")
    got = pipelines.filtered_and_labelled(gen.make(spark, rows), rules, _anomalies(spark)).collect()
    assert [(r.log_name, r.ping_flood_detected, r.matching_anomaly_rows, r.many_to_one) for r in got] == [("a", True, 12, 1)]
    assert got[0].detection_reason == [
        "≥5 rows have both ICMP echo and heuristic 20 IP (12 match)",
        "many-to-one ICMP ping flood detected (1 events)",
    ]


def test_prompt(spark):
    flows = gen.make(spark, [dict(proto="tcp", conn_state="S0", ts_us=1), dict(proto="icmp", ts_us=2)])
    flows = flows.withColumn("raw", conn_log.to_line(flows))
    docs = documents.anomaly_docs(_anomalies(spark))
    heuristics = spark.createDataFrame([("20", "Heuristic ID: 20"), ("10", "Heuristic ID: 10")], "code string, text string")
    prompt = pipelines.prompts(flows, docs, heuristics, taxonomy_prefixes(spark)).collect()[0].prompt
    assert prompt.count("\ttcp\t") == 1 and "\ticmp\t" not in prompt
    assert "Anomaly ID anomaly_0" in prompt and "anomaly_1:" not in prompt and "Heuristic ID: 20" in prompt
    assert "Category: NetworkScanICMP\nPrefix: ntscIC" in prompt
    bare = pipelines.prompts(flows, docs.limit(0), heuristics, taxonomy_prefixes(spark), "icmp").collect()[0].prompt
    assert evidence.NO_ANOMALIES in bare and evidence.NO_HEURISTICS in bare and "ping flood" in bare


def test_knowledge_rows(spark):
    heuristics = spark.createDataFrame([("20", "ping flood", None)], "code string, label string, category string")
    rows = pipelines.knowledge_rows(_anomalies(spark), heuristics, taxonomy_groups(spark)).collect()
    assert len(rows) == 2 + 1 + 11 and len({(r.collection, r.doc_id) for r in rows}) == 14
    assert "Heuristic ID: 20\nLabel: ping flood\nCategory: Suspicious" in [r.text for r in rows if r.doc_id == "heuristic_20"][0]


def test_text_case_ips(spark):
    cases = spark.createDataFrame([("c", "from 1.2.3.4 to 1.2.3.4 and 5.6.7.8")], "case_id string, text string")
    assert sorted(r.ip for r in evidence.text_ips(cases).collect()) == ["1.2.3.4", "5.6.7.8"]


def test_text_vectors_find_near_texts(spark):
    texts = ["syn flood on port 80", "syn flood on port 443", "ping sweep of hosts", "ping sweep of many hosts", "quiet night"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    vectors = retrieval.tfidf_vectors(docs, features=1 << 10)
    queries = vectors.select(F.col("doc_id").alias("query_id"), "vector")
    near = retrieval.approximate_topk(queries, vectors.select("doc_id", "vector"), 2, max_distance=1.4, bucket_length=4.0).collect()
    assert {(r.query_id, r.doc_id) for r in near} >= {("2", "2"), ("2", "3"), ("3", "2")}
    assert all(abs(r.similarity - 1) < 1e-6 for r in near if r.query_id == r.doc_id)
    lengths = retrieval.tfidf_terms(docs, all_tokens(F.col("text"))).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("l"))
    assert all(abs(r.l - 1) < 1e-9 for r in lengths.collect())


def test_words_are_counted_where_their_text_is(spark, monkeypatch):
    texts = {1: "a a b", 2: "b c. c.c c", 3: "", 4: None, None: "b a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(retrieval, "BYTES_PER_TASK", 1)
    terms = retrieval.tfidf_terms(docs, all_tokens(F.col("text")))
    idf = {"a": math.log(6 / 3), "b": math.log(6 / 4), "c": math.log(6 / 2), "c.c": math.log(6 / 2)}
    raw = {1: {"a": 2, "b": 1}, 2: {"b": 1, "c": 2, "c.c": 1}, None: {"a": 1, "b": 1}}
    wanted = {}
    for doc, counts in raw.items():
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        wanted |= {(doc, w): n * idf[w] / length for w, n in counts.items()}
    assert {(r.doc_id, r.token): r.weight for r in terms.collect()} == pytest.approx(wanted)
    # Counted rows are read, not split again, and never sorted to find their weights.
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_question_to_prompt_or_abstention(spark):
    docs = spark.createDataFrame(
        [
            ("a1", "first record", {"srcIP": "1.1.1.1", "dstPort": "443", "heuristic": "10"}, [1.0, 0.0]),
            ("a2", "second record", {"srcIP": "1.1.1.1", "dstPort": "443", "heuristic": "20"}, [0.9, 0.1]),
            ("a3", "other port", {"srcIP": "1.1.1.1", "dstPort": "80", "heuristic": "10"}, [1.0, 0.0]),
            ("a4", "far", {"srcIP": "9.9.9.9", "dstPort": "443", "heuristic": "10"}, [0.0, 1.0]),
        ],
        "doc_id string, text string, meta map<string,string>, vector array<double>",
    )
    heuristics = spark.createDataFrame([(10, "ten"), (20, "twenty")], "code int, text string")
    cases = spark.createDataFrame(
        [("q1", "Is 1.1.1.1 attacking port 443?", [1.0, 0.0]), ("q2", "What is going on?", [1.0, 0.0]), ("q3", "Is 2.2.2.2 on port 443 bad?", [-1.0, -1.0])],
        "case_id string, text string, vector array<double>",
    )
    got = {r.case_id: r for r in pipelines.query_prompts(cases, docs, heuristics).collect()}
    assert [got[k].abstain for k in ("q1", "q2", "q3")] == [False, True, True]
    prompt = got["q1"].prompt
    assert prompt.index("first record") < prompt.index("second record") and "other port" not in prompt and "far" not in prompt
    # The question's own words choose among the documents that were found.
    asked = cases.withColumn("text", F.concat("text", F.lit(" What is the second one?")))
    one = {r.case_id: r.prompt for r in pipelines.query_prompts(asked, docs, heuristics, anomalies_kept=1, heuristics_kept=1).collect()}["q1"]
    assert "second record" in one and "first record" not in one and ("ten" in one) != ("twenty" in one)
    assert prompt.index("ten") < prompt.index("twenty") and "UNDECIDABLE" in got["q2"].prompt and "2.2.2.2" in got["q3"].prompt


def test_evidence_fits_its_budget(spark):
    draw = random.Random(7)
    # One case holds a third of all evidence; texts repeat; some cases have none that fits.
    rows = [("hot" if k % 3 == 0 else f"log{k % 9}", f"{'x' * draw.randint(0, 30)}{k % 50}", float(k % 5)) for k in range(3_000)]
    rows += [("long", "y" * 400, 1.0), ("long", "z", 0.5), ("null", None, 1.0), ("empty", "", 1.0)]
    df = spark.createDataFrame(rows, "log_name string, text string, score double").repartition(6)

    def plain(budget, scored):
        out = set()
        for case in {r[0] for r in rows}:
            best = {}
            for c, t, s in rows:
                if c == case and t:
                    best[t] = max(best.get(t, 0.0), s if scored else 0.0)
            room = budget + 1
            for text in sorted(best, key=lambda t: (-best[t], t)):
                room -= len(text) + 1
                if room < 0:
                    break
                out.add((case, text))
        return out

    for budget in (1, 40, 300, 5_000):
        for scored in (True, False):
            given = df if scored else df.drop("score")
            found = evidence.within_budget(given, budget).select("log_name", "text").collect()
            assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == plain(budget, scored)
    # The rows are pruned to the budget before they are shuffled by case.
    plan = evidence.within_budget(df, 40)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    alerts = spark.createDataFrame([("hot", "a"), ("long", "b")], "log_name string, alerts string")
    none = df.limit(0)
    made = {r.log_name: r.prompt for r in evidence.case_prompts(alerts, df, none, template="%s|%s|%s|%s", max_chars=60).collect()}
    assert all(len(p.split("|")[2]) <= 60 for p in made.values()) and made["long"].split("|")[2] == evidence.NO_ANOMALIES
    whole = {r.log_name: r.prompt for r in evidence.case_prompts(alerts, df, none, template="%s|%s|%s|%s").collect()}
    assert len(whole["hot"].split("|")[2]) > 1_000
