"""Similarity search over vectors held in a column."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import never_broadcast, top_per_group
from flowspark.functions.text import WORD, similarity_of
from flowspark.operators.filters import metadata_filter
from flowspark.session import cut_lineage

# The few functions that run in Python workers travel with the job, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Passages per address, over-fetch factor, diversity weight and the evidence threshold.
TOP_K = 6
FETCH_FACTOR = 3
DIVERSITY = 0.5
THRESHOLD = 0.3

ROWS_PER_BLOCK = 50_000
# Queries that are sent to all tasks; with 1,000 numbers each that is 160 MB at most.
FEW_QUERIES = 20_000
QUERIES_PER_STEP = 256
# Documents of a product, fewer in the first one, which finds the bounds; pairs that are scored exactly at a time.
FIRST_DOCS, DOCS_PER_STEP, PAIRS_PER_STEP = 1_024, 8_192, 100_000
MOST_TASKS = 4_000
# Texts whose words are counted in one task; their distinct words take about ten times as much memory.
BYTES_PER_TASK = 16_000_000
# Scores are compared at this precision, ties go to the smaller id; shown ones are rounded by the caller.
SCORE_DIGITS = 12
# Sums of many weights differ in their last digits with the order of the terms.
SUM_DIGITS = 9

_HITS = "query_id string, doc_id string, similarity double"


def _unit(vectors: Iterable) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _first_copies(matrix: np.ndarray, k: int) -> np.ndarray:
    """Which rows are finite and among the first `k` of their copies: of equal vectors, only those of the smallest ids can be hits."""
    copies = pd.Series([row.tobytes() for row in matrix], dtype=object)
    return np.isfinite(matrix).all(axis=1) & (copies.groupby(copies, sort=False).cumcount() < k).to_numpy()


def _exact(asked: np.ndarray, docs: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    scores = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS_PER_STEP):
        part = slice(at, at + PAIRS_PER_STEP)
        scores[part] = np.einsum("ij,ij->i", asked[rows[part]], docs[places[part]])
    return np.round(scores, SCORE_DIGITS)


def _nearest(asked: np.ndarray, docs: np.ndarray, single: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score): the k best rows of `docs` for each unit vector asked, earlier ones first among equal scores.

    Products in single precision (`single` is `docs`) only rule documents out:
    what may reach the k best within their error is scored in double precision.
    """
    error = (docs.shape[1] + 8) * 2.0**-22
    rows, places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least, quick = np.full(len(asked), -np.inf), asked.astype(np.float32)
    at, width = 0, FIRST_DOCS
    while at < len(docs):
        near = quick @ single[at : at + width].T
        if at == 0 and near.shape[1] > k:
            least = np.partition(near, -k, axis=1)[:, -k] - error
        row, place = np.nonzero(near >= (least - error).astype(np.float32)[:, None])
        if len(row):
            place = place + at
            rows, places = np.concatenate([rows, row]), np.concatenate([places, place])
            scores = np.concatenate([scores, _exact(asked, docs, row, place)])
            order = np.lexsort((places, -scores, rows))
            rows, places, scores = rows[order], places[order], scores[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = rank < k
            rows, places, scores, rank = rows[kept], places[kept], scores[kept], rank[kept]
            least[rows[rank == k - 1]] = scores[rank == k - 1]
        at, width = at + width, DOCS_PER_STEP
    return rows, places, scores


def _by_filter(wanted: list, metas: pd.Series) -> Iterator[tuple]:
    """Queries of each distinct filter and the documents that meet it, both as masks; None stands for all."""
    if not any(wanted):
        yield None, None
        return
    plain = [tuple(sorted(dict(m).items())) if m is not None else () for m in metas]
    kind, kinds = pd.factorize(pd.Series(plain, dtype=object))
    filters = [tuple(sorted(dict(w).items())) if w else () for w in wanted]
    asked, distinct = pd.factorize(pd.Series(filters, dtype=object))
    for n, each in enumerate(distinct):
        fits = np.array([all(dict(m).get(a) == b for a, b in each) for m in kinds], bool)
        yield asked == n, fits[kind] if each else None


def _hits(queries: pd.DataFrame, docs: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best of `docs` for each query, by steps of queries; equal scores by smaller id."""
    if not (len(queries) and len(docs)):
        return
    docs = docs.sort_values("doc_id", kind="stable")
    ids, matrix = docs["doc_id"].to_numpy(dtype=object), _unit(docs["vector"])
    for those, fits in _by_filter(list(queries["wanted"]), docs["meta"]):
        asked = queries if those is None else queries[those]
        names, some = (ids, matrix) if fits is None else (ids[fits], matrix[fits])
        kept = _first_copies(some, k)
        names, some = names[kept], some[kept]
        single = some.astype(np.float32)
        for at in range(0, len(asked), QUERIES_PER_STEP):
            part = asked.iloc[at : at + QUERIES_PER_STEP]
            rows, places, scores = _nearest(_unit(part["vector"]), some, single, k)
            yield pd.DataFrame({"query_id": part["query_id"].to_numpy(dtype=object)[rows], "doc_id": names[places], "similarity": scores})


def _block_top_k(k: int):
    """Top k of one block of documents for each query of one block of queries."""
    none = pd.DataFrame({"query_id": [], "doc_id": [], "similarity": []}).astype({"query_id": str, "doc_id": str, "similarity": float})

    def search(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        found = list(_hits(queries, docs, k))
        return pd.concat(found) if found else none

    return search


def _top_k_in_place(queries, k: int):
    """Top k of the documents of one task for a few queries that every task has."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, held, rows = [], [], 0

        def settled() -> list[pd.DataFrame]:
            found = [*best, *_hits(queries.value, pd.concat(held), k)]
            if not best or not found:
                return found
            whole = pd.concat(found).sort_values(["query_id", "similarity", "doc_id"], ascending=[True, False, True])
            return [whole.groupby("query_id", sort=False).head(k)]

        for docs in batches:
            held.append(docs)
            rows += len(docs)
            if rows >= ROWS_PER_BLOCK:
                best, held, rows = settled(), [], 0
        yield from settled() if rows else best

    return search


def _blocks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def _into_blocks(df: DataFrame, name: str, key: str, blocks: int) -> DataFrame:
    number = F.pmod(F.xxhash64(key), F.lit(blocks))
    return df.withColumn(name, number.cast("int"))


def _to_all_blocks(df: DataFrame, name: str, blocks: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _sides(queries: DataFrame, kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with their filters and documents with their metadata, where they have any."""
    none = F.lit(None).cast("map<string,string>")
    wanted = F.col("wanted") if "wanted" in queries.columns else none
    meta = F.col("meta") if "wanted" in queries.columns and "meta" in kb.columns else none
    return (
        queries.select(F.col("query_id").cast("string"), "vector", wanted.alias("wanted")),
        kb.select(F.col("doc_id").cast("string"), "vector", meta.alias("meta")),
    )


def vector_topk(
    queries: DataFrame, kb: DataFrame, k: int = TOP_K, rows_per_block: int = ROWS_PER_BLOCK, few: int = FEW_QUERIES, index=None
) -> DataFrame:
    """Exact k nearest documents of each query by cosine.

    Takes (query_id, vector) and (doc_id, vector). A query with a map `wanted`
    is only answered by documents whose `meta` has all its values. Up to `few`
    queries are counted and broadcast: documents stay in place and a task passes
    on k rows per query. Of more queries, both sides are cut into blocks of a
    bounded size and every pair of blocks meets in one task. Rows are the same.
    Where all pairs are too many, a `VectorIndex` of `kb` as `index` looks into
    a few lists per query and finds most neighbours; it takes no filters.
    """
    if index is not None:
        if "wanted" in queries.columns:
            raise ValueError("an index knows no filters")
        return index.search(queries, k)
    asked, docs = _sides(queries, kb)
    count = queries.count()
    if count <= few:
        held = queries.sparkSession.sparkContext.broadcast(asked.toPandas())
        per_task = docs.mapInPandas(_top_k_in_place(held, k), _HITS)
        return top_per_group(per_task, ["query_id"], [F.desc("similarity"), "doc_id"], k)
    query_blocks, doc_blocks = _blocks(count, rows_per_block), _blocks(kb.count(), rows_per_block)
    left, right = _into_blocks(asked, "_q", "query_id", query_blocks), _into_blocks(docs, "_d", "doc_id", doc_blocks)
    cell = ["_q", "_d"]
    # A given number of tasks: a pair of blocks is small in bytes and long in time, so none may be merged into one task by size.
    tasks = min(MOST_TASKS, 4 * query_blocks * doc_blocks)
    per_block = (
        _to_all_blocks(left, "_d", doc_blocks)
        .repartition(tasks, *cell)
        .groupBy(*cell)
        .cogroup(_to_all_blocks(right, "_q", query_blocks).repartition(tasks, *cell).groupBy(*cell))
        .applyInPandas(_block_top_k(k), _HITS)
    )
    return top_per_group(per_block, ["query_id"], [F.desc("similarity"), "doc_id"], k)


def vector_topk_filtered(
    queries: DataFrame, kb: DataFrame, wanted: Mapping[str, str], k: int = TOP_K, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """The same among documents whose metadata equals every given value."""
    return vector_topk(queries, metadata_filter(kb, wanted), k, rows_per_block)


def _pick_diverse(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy choice among candidates sorted by relevance, ids breaking ties."""
    between = np.round(vectors @ vectors.T, SCORE_DIGITS)
    nearest = np.full(len(relevance), -np.inf)
    picked: list[int] = []
    while len(picked) < min(k, len(relevance)):
        # The first pick is the most relevant one; there is nothing to differ from yet.
        gain = weight * relevance - (1 - weight) * nearest if picked else relevance.copy()
        gain = np.round(gain, SCORE_DIGITS)
        gain[picked] = -np.inf
        picked.append(int(np.argmax(gain)))
        nearest = np.maximum(nearest, between[picked[-1]])
    return picked


def _spread_out(k: int, weight: float):
    """Choose for a batch of queries, each with its few candidates in one row."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, candidates in zip(batch["query_id"], batch["candidates"]):
                found = sorted(candidates, key=lambda c: (-c["similarity"], c["doc_id"]))
                relevance = np.array([c["similarity"] for c in found])
                picked = _pick_diverse(relevance, _unit([c["vector"] for c in found]), k, weight)
                rows += [(query_id, found[i]["doc_id"], relevance[i], at) for at, i in enumerate(picked, 1)]
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "similarity", "position"])

    return choose


def vector_mmr(
    queries: DataFrame,
    kb: DataFrame,
    k: int = TOP_K,
    fetch_k: int | None = None,
    weight: float = DIVERSITY,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """k of the `fetch_k` nearest documents, each as unlike the ones before as it is relevant."""
    fetch_k = fetch_k or FETCH_FACTOR * k
    nearest = vector_topk(queries, kb, fetch_k, rows_per_block)
    vectors = kb.select(F.col("doc_id").cast("string"), "vector")
    # At most `fetch_k` candidates per query, so its list is short.
    candidates = (
        nearest.join(vectors, "doc_id")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("doc_id", "similarity", "vector")).alias("candidates"))
    )
    return candidates.mapInPandas(_spread_out(k, weight), _HITS + ", position int")


def lexical_rerank(pairs: DataFrame, queries: DataFrame, doc_terms: DataFrame, top_k: int) -> DataFrame:
    """Best documents of each query by the summed weight of shared words.

    Takes (query_id, doc_id), (query_id, token) and (doc_id, token, weight).
    Words meet one by one, so no row holds all words of a query, and sums are
    partial before their shuffle. A document that shares nothing has score 0.
    """
    same = (F.col("_q") == F.col("query_id")) & (F.col("_token") == F.col("token"))
    asked = queries.select(F.col("query_id").alias("_q"), F.col("token").alias("_token")).distinct()
    words = pairs.join(never_broadcast(doc_terms), "doc_id", "left").join(never_broadcast(asked), same, "left")
    shared = F.sum(F.when(F.col("_q").isNotNull(), F.col("weight")))
    scored = words.groupBy(*pairs.columns).agg(F.round(F.coalesce(shared, F.lit(0.0)), SUM_DIGITS).alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), "doc_id"], top_k)


def _word_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, token, _tf), one row per document and word; written once.

    Texts are dealt out by document, so words are counted where they are split
    and no row per word is sent. The number of tasks is given: tasks that are
    merged by the size of the texts would hold too many words each.
    """
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(_text_bytes(docs) / BYTES_PER_TASK))
    words = docs.repartition(min(MOST_TASKS, tasks), "doc_id").select("doc_id", F.explode(tokens).alias("token"))
    return cut_lineage(words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("_tf")), "word-counts")


def _text_bytes(docs: DataFrame) -> int:
    """Bytes of all string columns."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in docs.dtypes if kind == "string"]
    return docs.agg(F.sum(sum(texts, F.lit(0)).cast("bigint")).alias("n")).head()["n"] or 0


def _with_idf(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Word counts with `weight`: ln((documents + 1) / (documents with the word + 1)).

    A task looks its words up in the weights of the same words, at most one
    small row each, so the counts are not sorted.
    """
    total = docs.agg(F.count(F.lit(1)).alias("_docs"))
    frequency = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    weights = frequency.join(F.broadcast(total)).select(  # `total` is one row
        "token", F.ln((F.col("_docs") + 1) / (F.col("_df") + 1)).alias("weight")
    )
    return counts.join(weights.hint("shuffle_hash"), "token")


def term_weights(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, token, weight): each document's distinct words with their inverse document frequency."""
    return _with_idf(_word_counts(docs, tokens), docs).select("doc_id", "token", "weight")


def tfidf_terms(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, token, weight): TF-IDF vectors of unit length in long form, exact and free of collisions."""
    raw = F.col("_tf") * F.col("weight")
    # A window per document: its words, not the corpus.
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("doc_id")))
    weighted = _with_idf(_word_counts(docs, tokens), docs).withColumn("_length", length)
    return weighted.select("doc_id", "token", F.coalesce(F.try_divide(raw, F.col("_length")), F.lit(0.0)).alias("weight"))


def tfidf_vectors(docs: DataFrame, text: str = "text", features: int = 1 << 18) -> DataFrame:
    """The same as hashed ML vectors in column `vector`, as `approximate_topk` takes them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD, gaps=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="vector"),
    ]
    return Pipeline(stages=stages).fit(docs).transform(docs).drop("_words", "_counts", "_weights")


def approximate_topk(queries: DataFrame, kb: DataFrame, k: int, max_distance: float, bucket_length: float = 0.5) -> DataFrame:
    """Near neighbours by locality-sensitive hashing, where exact search is too dear.

    May miss neighbours; takes ML vectors. Candidates are pairs that share a hash bucket.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    lsh = BucketedRandomProjectionLSH(
        inputCol="vector", outputCol="_hashes", bucketLength=bucket_length, numHashTables=3, seed=42
    )
    pairs = lsh.fit(kb).approxSimilarityJoin(queries, kb, max_distance, distCol="_distance")
    scored = pairs.select(
        F.col("datasetA.query_id").alias("query_id"),
        F.col("datasetB.doc_id").alias("doc_id"),
        F.round(similarity_of(F.col("_distance") * F.col("_distance")), SCORE_DIGITS).alias("similarity"),
    )
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), "doc_id"], k)
