"""BM25 through impact-ordered blocks against the full sum; vector index against exact search."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.functions.text import all_tokens
from flowspark.operators import postings, retrieval, vector_index


def plain_scores(docs, queries, k):
    words = {d: (t or "").split() for d, t in docs}
    n, average = len(words), sum(map(len, words.values())) / max(1, len(words))
    known = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, asked in queries.items():
        scores = {}
        for d, ws in words.items():
            tf = Counter(ws)
            for w in set(asked) & set(tf):
                idf = math.log(1 + (n - known[w] + 0.5) / (known[w] + 0.5))
                weight = idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average))
                scores[d] = scores.get(d, 0) + math.floor(weight * 10_000 + 0.5)
        out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


@pytest.mark.parametrize("k,block", [(3, 4), (50, 16)])
def test_best_documents_are_those_of_the_full_sum(spark, k, block):
    draw = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (1 + i) for i in range(60)]
    docs = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 40)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, docs[7][1]), (403, "w59 " * 300), (404, "w0")]
    queries = {f"q{i}": draw.choices(vocabulary, weights, k=draw.randint(1, 9)) for i in range(25)}
    queries |= {"unknown": ["nowhere"], "one": ["w0", "w0"], "mixed": ["nowhere", "w59"]}
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws] + [("null", None)], "query_id string, token string")
    impacts = postings.impacts(table, all_tokens(F.col("text")))
    blocks = postings.impact_blocks(impacts, block)
    found = {}
    for r in postings.best_documents(asked, impacts, blocks, k).collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: rows for q, rows in plain_scores(docs, queries, k).items() if rows}
    assert {q: sorted(rows, key=lambda s: (-s[1], s[0])) for q, rows in found.items()} == want
    if k == 3:
        share = postings.share_opened(asked, blocks, k).first()
        assert 0 < share.opened < 0.5 * share.blocks


def test_blocks_hold_every_posting_by_falling_impact(spark):
    rows = [(d, w, (d * 7 + len(w)) % 50) for d in range(200) for w in ("a", "bb", "ccc") if (d + len(w)) % 3]
    blocks = postings.impact_blocks(spark.createDataFrame(rows, "doc_id bigint, token string, impact bigint").repartition(3), 8).collect()
    assert sorted((d, b.token, i) for b in blocks for d, i in zip(b.docs, b.impacts)) == sorted(rows)
    assert all(b.best == b.impacts[0] and list(b.impacts) == sorted(b.impacts, reverse=True) and b.size == len(b.docs) <= 8 for b in blocks)
    assert postings.impact_blocks(spark.createDataFrame([], "doc_id bigint, token string, impact bigint")).count() == 0


def _vectors(spark, n=1500, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 16))
    # A third of all vectors lies around one centre.
    at = np.where(draw.random(n) < 0.33, 0, draw.integers(0, 12, n))
    vectors = centres[at] + 0.35 * draw.normal(size=(n, 16))
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vectors)], "doc_id string, vector array<double>")


def test_index_finds_most_neighbours_in_few_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SEGMENT_ROWS", 20)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 60)
    kb = _vectors(spark)
    odd = spark.createDataFrame([("none", None), ("empty", []), ("zero", [0.0] * 16)], "doc_id string, vector array<double>")
    index = vector_index.VectorIndex.build(kb.unionByName(odd), str(tmp_path / "index"), lists=24, k=5)
    queries = kb.unionByName(odd).select(F.col("doc_id").alias("query_id"), "vector")
    found, exact = index.search(queries, k=5), retrieval.vector_topk(kb.select(F.col("doc_id").alias("query_id"), "vector"), kb, k=5)
    assert 0.9 <= vector_index.recall_of(found, exact).first().recall <= 1 and index.probes < 12
    assert max(index.segments.values()) > 3
    # Opened again, with all lists and a long shortlist: the exact rows.
    again = vector_index.VectorIndex(spark, str(tmp_path / "index"))
    whole = again.search(queries, k=5, probes=24, shortlist=40)
    assert vector_index.recall_of(whole, exact).first().recall == 1
    close = whole.join(exact.withColumnRenamed("similarity", "same"), ["query_id", "doc_id"])
    assert close.filter(F.abs(F.col("similarity") - F.col("same")) > 1e-9).count() == 0 and close.count() == 7500
    # Few queries open the folders of their lists alone.
    one = again._probed(queries.limit(1), 2)
    assert one.select("list").distinct().count() == 2
    assert again.search(queries.limit(0), k=5).count() == 0
    asked = queries.limit(3)
    assert sorted(retrieval.vector_topk(asked, kb, k=2, index=again).collect()) == sorted(again.search(asked, k=2).collect())
    with pytest.raises(ValueError):
        retrieval.vector_topk(asked.withColumn("wanted", F.lit(None)), kb, k=2, index=again)
    with pytest.raises(ValueError):
        vector_index.VectorIndex.build(odd, str(tmp_path / "nothing"))


def test_few_documents_are_scored_in_full_and_asked_words_alone_give_the_same(spark):
    draw = random.Random(9)
    vocabulary, weights = [f"w{i}" for i in range(60)], [1 / (1 + i) for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 40)))) for i in range(600)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(f"q{i}", w) for i in range(20) for w in set(draw.choices(vocabulary, weights, k=6))], "query_id string, token string")
    every = postings.impacts(docs, all_tokens(F.col("text")))
    some = postings.impacts(docs, all_tokens(F.col("text")), only=asked)
    assert 0 < some.count() < every.count() and some.exceptAll(every).count() == 0
    blocks = postings.impact_blocks(every, 4)
    found = sorted(map(tuple, postings.best_documents(asked, every, blocks, 3).collect()))
    assert found == sorted(map(tuple, postings.best_documents(asked, some, postings.impact_blocks(some, 4), 3).collect()))
    # Documents that share a word with an opened block are many, those that can be among the best few.
    opened = postings._opened(asked, blocks, 3).select("query_id", F.explode("docs").alias("doc_id")).distinct().count()
    assert len(found) <= postings._candidates(asked, blocks, 3).count() < 0.6 * opened


def test_a_query_is_sent_once_per_group_of_lists(spark, tmp_path):
    kb = _vectors(spark, 600)
    index = vector_index.VectorIndex.build(kb, str(tmp_path / "index"), lists=20, k=5)
    queries = kb.limit(50).withColumnRenamed("doc_id", "query_id")
    sent = index._by_group(queries, 12).collect()
    assert len(sent) == 50 and all(len(set(r.lists)) == 12 for r in sent)
    assert vector_index._groups({"0": 1, "2": 3, "5": 1, "7": 1, "8": 1}, {"0": 9, "2": 120_000, "5": 30_000, "7": 20_000, "8": 1}) == {0: 0, 2: 1, 5: 2, 7: 2, 8: 3}
