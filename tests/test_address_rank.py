"""Evidence found by address gives the rows of all pairs of a case and a document."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions.text import tokens
from flowspark.operators import address_texts, evidence
from flowspark.operators.address_rank import best_by_address
from flowspark.plans import pipelines
from flowspark.operators.retrieval import lexical_rerank, term_weights


@pytest.fixture(scope="module")
def held(spark):
    """Cases and documents around two hot addresses; a document of both, of none, and cases without known words."""
    draw = random.Random(4)
    ips = {(f"log{c}", f"ip{min(draw.randrange(9), draw.randrange(9))}") for c in range(30) for _ in range(4)} | {("mute", "ip0"), ("alone", "ip99")}
    vocabulary = [f"w{i}" for i in range(40)]
    words = {(c, w) for c, _ in ips if c != "mute" for w in draw.choices(vocabulary, [1 / (1 + i) for i in range(40)], k=12)}
    docs = []
    for d in range(200):
        a, b = (f"ip{min(draw.randrange(12), draw.randrange(12))}" for _ in range(2))
        text = " ".join(draw.choices(vocabulary, [1 / (1 + i) for i in range(40)], k=draw.randrange(7)) + [str(100 + d % 30)])
        docs.append((f"d{d}", text, {"srcIP": a, "dstIP": b if d % 3 else "unknown", "heuristic": str(100 + d % 4), "taxonomy": "DoS" if d % 2 else "ptmp"}))
    return (
        spark.createDataFrame(sorted(ips), "log_name string, ip string"),
        spark.createDataFrame(sorted(words), "log_name string, word string"),
        spark.createDataFrame(docs, "doc_id string, text string, meta map<string,string>").repartition(3),
    )


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("common_words,common_pairs", [(64, 10_000), (3, 1), (64, 1)])
def test_best_by_address_is_that_of_all_pairs(held, common_words, common_pairs):
    ips, words, docs = held
    weights = term_weights(docs, tokens(F.col("text")))
    pairs = evidence.ip_evidence(ips, docs).withColumnRenamed("log_name", "query_id")
    queries = words.select(F.col("log_name").alias("query_id"), F.col("word").alias("token"))
    want = lexical_rerank(pairs, queries, weights, 4).select("query_id", "doc_id", F.round("score", 6))
    found = best_by_address(ips, words, evidence.address_index(docs), weights, 4, common_words, common_pairs)
    assert _rows(found.select("log_name", "doc_id", F.round("score", 6))) == _rows(want)


@pytest.mark.parametrize("budget", [1, 6, 7, 20, 21, 60, 1_000])
def test_budget_by_address_is_that_of_all_pairs(held, budget):
    ips, _, docs = held
    texts = docs.select("doc_id", F.regexp_replace("text", "w1? ?", "").alias("text"), F.col("meta.heuristic").cast("double").alias("score"))
    want = evidence.within_budget(evidence.ip_evidence(ips, docs).join(texts, "doc_id"), budget)
    found = evidence.within_budget(evidence.texts_of_addresses(ips, docs, texts, budget), budget)
    shown = ["log_name", "text", "score"]
    assert _rows(found.select(shown)) == _rows(want.select(shown))


@pytest.mark.parametrize("by_token", [False, True])
def test_heuristics_by_address_are_those_of_all_pairs(held, spark, by_token):
    ips, _, docs = held
    heuristics = spark.createDataFrame([(c, f"text {c % 7}") for c in range(100, 128)] + [(100, "second")], "code int, text string")
    want = evidence.heuristic_evidence(evidence.ip_evidence(ips, docs), docs, heuristics, by_token)
    found = evidence.heuristic_evidence(ips, docs, heuristics, by_token)
    assert found.columns == want.columns and _rows(found) == _rows(want)


def test_taxonomy_by_address_is_that_of_all_pairs(held, spark):
    ips, _, docs = held
    prefixes = spark.createDataFrame([("DoS", "DoS"), ("ptmp", "MultiPoints"), ("DoS", "again")], "taxonomy string, category string")
    want = evidence.taxonomy_evidence(evidence.ip_evidence(ips, docs), docs, prefixes)
    found = evidence.taxonomy_evidence(ips, docs, prefixes)
    assert found.columns == want.columns and _rows(found) == _rows(want)


def test_pairs_of_a_hot_address_are_dealt_in_cells(held, monkeypatch):
    ips, _, docs = held
    want = _rows(evidence.ip_evidence(ips, docs))
    monkeypatch.setattr(evidence, "CELL", 5)
    monkeypatch.setattr(evidence, "PAIRS_PER_TASK", 100)
    found = evidence.ip_evidence(ips, docs)
    assert _rows(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2


def test_texts_by_address_are_those_of_all_pairs(held):
    ips, _, docs = held
    texts = docs.select("doc_id", "text")
    want = evidence.ip_evidence(ips, docs).join(texts, "doc_id").select("log_name", "text").distinct()
    found = evidence.texts_of_addresses(ips, docs, texts).distinct()
    assert found.columns == want.columns and _rows(found) == _rows(want)


def _odd(spark):
    """Rows that come twice, names, ids and texts that are null, ids that stand for several documents, addresses that only one side has."""
    draw = random.Random(11)
    ips = [(draw.choice([None, *(f"log{c}" for c in range(12))]), draw.choice([None, *(f"ip{i}" for i in range(10))])) for _ in range(90)]
    docs = []
    for d in range(150):
        a, b = (f"ip{min(draw.randrange(14), draw.randrange(14))}" for _ in range(2))
        name = None if d % 29 == 0 else f"d{d % 9}" if d % 5 == 0 else f"d{d}"
        docs.append((name, draw.choice([None, "", "two\nlines", f"Text {d % 40} über", f"text {d}"]), {"srcIP": a, "dstIP": b if d % 3 else "unknown"}))
    docs += docs[:20]
    ips += [("bare", "ip50"), ("null", "ip40")]
    docs += [("null", None, {"srcIP": "ip40", "dstIP": "unknown"})]
    return (
        spark.createDataFrame(ips, "log_name string, ip string").repartition(3),
        spark.createDataFrame(docs, "doc_id string, text string, meta map<string,string>").repartition(3),
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cells", [False, True])
def test_pairs_come_once_where_ids_and_addresses_repeat(spark, monkeypatch, cells):
    if cells:
        monkeypatch.setattr(evidence, "CELL", 3)
        monkeypatch.setattr(evidence, "PAIRS_PER_TASK", 20)
    ips, docs = _odd(spark)
    places = {(r.doc_id, ip) for r in docs.collect() for ip in (r.meta["srcIP"], r.meta["dstIP"]) if ip != "unknown"}
    want = {(r.log_name, doc_id) for r in ips.collect() for doc_id, ip in places if r.ip == ip}
    found = [tuple(r) for r in evidence.ip_evidence(ips, docs).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_pairs_are_not_shuffled_to_be_distinct(held):
    ips, _, docs = held
    assert evidence.ip_evidence(ips, docs).count() > 1_000
    plan = _plan(evidence.ip_evidence(ips, docs))
    assert "Join" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("group_chars", [4_000, 1 << 20])
def test_sections_by_address_are_those_of_all_pairs(spark, monkeypatch, group_chars):
    for name, value in (("PACKED", 64), ("SENT", 100)):
        monkeypatch.setattr(address_texts, name, value)
    ips, docs = _odd(spark)
    texts = docs.select("doc_id", "text")
    pairs = evidence.texts_of_addresses(ips, docs, texts)
    cases = ips.select("log_name").distinct().unionByName(spark.createDataFrame([("bare",), ("nowhere",)], "log_name string"))
    want = cases.join(evidence._section(pairs, "text", "_anomalies"), "log_name", "left")
    found = evidence.add_sections(cases, ips, evidence.texts_of_addresses(ips, docs, texts, by_ip=True), "_anomalies", group_chars)
    rows = lambda df: sorted(map(repr, df.select("log_name", "_anomalies").collect()))
    assert rows(found) == rows(want)
    by_name = {r.log_name: r._anomalies for r in found.collect()}
    assert by_name["null"] == "" and by_name["bare"] is None and by_name["nowhere"] is None and by_name[None] is None
    # Nothing is found: no case has a section.
    none = evidence.add_sections(cases, ips, evidence.texts_of_addresses(ips, docs.limit(0), texts, by_ip=True), "_anomalies")
    assert none.count() == cases.count() and none.filter("_anomalies IS NOT NULL").isEmpty()


def test_prompts_are_made_without_pairs_of_a_case_and_a_text(held, spark):
    ips, _, docs = held
    flows = ips.select("log_name", F.lit(1).alias("line_no"), F.concat(F.lit("line of "), "ip").alias("raw"), F.col("ip").alias("src_ip"), F.lit("ip1").alias("dst_ip"), F.lit("tcp").alias("proto"))
    heuristics = spark.createDataFrame([(100, "ten"), (102, "twelve")], "code int, text string")
    prefixes = spark.createDataFrame([("DoS", "DoS")], "taxonomy string, category string")
    made = pipelines.prompts(flows, docs, heuristics, prefixes)
    # Sections of texts leave the task that makes them as rows of the result.
    plan = _plan(made)
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
    both = evidence.case_ips(flows)
    want = {}
    for log, text in evidence.ip_evidence(both, docs).join(docs, "doc_id").select("log_name", "text").distinct().collect():
        want.setdefault(log, []).append(text)
    got = {r.log_name: r.prompt for r in made.collect()}
    assert len(got) == flows.select("log_name").distinct().count()
    for log, prompt in got.items():
        assert prompt.split("Anomaly records:\n")[1].split("\n\nHeuristics and taxonomy:")[0] == "\n".join(sorted(want[log]))
