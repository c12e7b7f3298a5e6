"""BM25 over postings in the order of their impact, in blocks with upper bounds; most blocks are never opened.

An impact is a word's whole contribution to a document, length norm included,
as an integer, so sums do not depend on their order. Postings of a word are
sorted by impact and cut into blocks; a block is known by its largest impact.
A search first opens the best block of each asked word: the k-th best partial
sum is a score that the k best documents reach at least. With the query's words
in ascending order of their largest impacts, a document whose last word here is
word i has at most its impact there and the largest ones of the words before;
so only blocks that can reach that score this way are opened for candidates.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import never_broadcast, top_per_group, within_size
from flowspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the usual ranking: saturation of repeats and share of the length norm.
K1, B = 1.2, 0.75
# An impact of 1.0 as an integer; postings of a block.
SCALE, BLOCK = 10_000, 128
# Asked words, or pairs of a query and a word, that are sent to all tasks.
FEW_WORDS = 100_000


def impacts(docs: DataFrame, tokens: Column, k1: float = K1, b: float = B, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, token, impact): BM25 weight of each distinct word of a document, times SCALE, as a whole number.

    `tokens` gives the words of a row with their repeats. The weight is
    ln(1 + (N - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)).
    A document without words has no rows, and counts in N and the average.
    `only` (token) keeps these words' rows, for queries that are known before.
    """
    words = docs.select("doc_id", tokens.alias("words")).withColumn("length", F.coalesce(F.size(F.coalesce("words", F.array())), F.lit(0)))
    one = words.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("n_words"))
    each = words.select("doc_id", "length", F.explode("words").alias("token"))
    if only is not None:
        only = only.select("token").distinct()
        each = each.join(F.broadcast(only) if within_size(only, FEW_WORDS) else only, "token", "left_semi")
    counts = each.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    counts = cut_lineage(counts, "word-counts")
    known = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    joined = never_broadcast(counts).join(known, "token").join(F.broadcast(one))  # `one` is one row
    idf = F.ln(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    norm = 1 - b + b * F.col("length") * F.col("n_docs") / F.col("n_words")
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return joined.select("doc_id", "token", F.round(weight * SCALE).cast("bigint").alias("impact"))


def impact_blocks(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """(token, best, size, docs, impacts): postings in blocks, by falling impact within a word.

    Sorted over all partitions by (token, impact, document), so that a word that
    every document has is many ranges; a block never crosses one.
    """
    kind = dict(weights.dtypes)["doc_id"]
    schema = f"token string, best bigint, size int, docs array<{kind}>, impacts array<bigint>"

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                place = frame.groupby("token", sort=False).cumcount() // block
                cut = frame.groupby([frame["token"], place], sort=False)
                rows = [(token, int(part["impact"].iloc[0]), len(part), part["doc_id"].tolist(), part["impact"].tolist()) for (token, _), part in cut]
                yield pd.DataFrame(rows, columns=["token", "best", "size", "docs", "impacts"])

    order = [F.col("token"), F.desc("impact"), F.col("doc_id")]
    return weights.select("doc_id", "token", "impact").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, schema)


def best_documents(queries: DataFrame, weights: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score) of the `k` documents with the largest sums of impacts over a query's distinct words.

    `queries` is (query_id, token). Exact: the rows are those of a full sum,
    equal scores by the smaller document. Documents without an asked word, and
    queries without a known one, are not there.
    """
    candidates = _candidates(queries, blocks, k)
    asked = queries.select("query_id", "token").distinct()
    # Whole scores of the candidates only, from the documents' own words. A few asked words go to where these
    # are, else all words of all candidates would be shuffled.
    asked = F.broadcast(asked) if within_size(asked, FEW_WORDS) else never_broadcast(asked)
    pairs = weights.join(candidates, "doc_id").join(asked, ["query_id", "token"])
    scored = pairs.groupBy("query_id", "doc_id").agg(F.sum("impact").alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), "doc_id"], k)


def _candidates(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id) of the documents in opened blocks that may be among the `k` best.

    What a document has in opened blocks is known, and in closed ones of a word
    at most `rest`; the k-th best sum of what is known is reached at least.
    """
    opened = cut_lineage(_opened(queries, blocks, k), "opened-blocks")
    at_most = opened.select("query_id", "whole_rest").distinct()
    each = opened.select("query_id", "rest", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    known = each.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(
        F.sum("p.impacts").alias("score"), F.sum(F.col("p.impacts") - F.col("rest")).alias("gain")
    )
    known = cut_lineage(known, "known-scores")
    reached = top_per_group(known, ["query_id"], [F.desc("score"), "doc_id"], k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("least")
    )
    bounds = at_most.join(reached, "query_id")
    return known.join(bounds, "query_id").filter(F.col("whole_rest") + F.col("gain") >= F.col("least")).select("query_id", "doc_id")


def _opened(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, token, best, size, docs, impacts, rest, whole_rest): the blocks that may hold one of the `k` best documents.

    A document in no opened block of the word has at most `rest` there; `whole_rest` is the sum over the query's words.
    """
    asked = queries.select("query_id", "token").filter(F.col("token").isNotNull()).distinct()
    largest = blocks.groupBy("token").agg(F.max("best").alias("largest"))
    words = cut_lineage(asked.join(largest, "token"), "asked-words")
    # The best block of each word, of equal ones the fullest: partial scores are scores that are reached.
    first = top_per_group(blocks.join(words.select("token").distinct(), "token", "left_semi"), ["token"], [F.desc("best"), F.desc("size"), "docs"], 1)
    seen = words.join(first, "token").select("query_id", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    partial = seen.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(F.sum("p.impacts").alias("score"))
    reached = top_per_group(partial, ["query_id"], [F.desc("score"), "doc_id"], k).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"), F.min("score").alias("least")
    )
    before = Window.partitionBy("query_id").orderBy("largest", "token").rowsBetween(Window.unboundedPreceding, -1)
    bounded = words.withColumn("below", F.coalesce(F.sum("largest").over(before), F.lit(0))).join(
        reached.select("query_id", F.when(F.col("found") >= k, F.col("least")).otherwise(0).alias("least")), "query_id", "left"
    )
    least = F.coalesce("least", F.lit(0))
    rest = F.greatest(F.lit(0), F.least("largest", least - F.col("below") - 1)).cast("bigint")
    bounded = bounded.withColumn("rest", rest).withColumn("whole_rest", F.sum("rest").over(Window.partitionBy("query_id")))
    enough = F.col("best") + F.col("below") >= least
    return bounded.join(never_broadcast(blocks), "token").filter(enough).select("query_id", "token", "best", "size", "docs", "impacts", "rest", "whole_rest")


def share_opened(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """One row: postings blocks of the asked words, summed over queries, and how many of them a search opens."""
    whole = queries.select("query_id", "token").distinct().join(blocks.select("token"), "token").agg(F.count(F.lit(1)).alias("blocks"))
    return whole.join(_opened(queries, blocks, k).agg(F.count(F.lit(1)).alias("opened")))
