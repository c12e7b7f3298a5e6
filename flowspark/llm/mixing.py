"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-drawn copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.scale import join_groups
from flowspark.llm.common import free_names, ranked, table, word_count, written

WEIGHTS = (3, 1, 2)
# All targets together, as a multiple of all sizes; the most of one source, as a multiple of its size.
SHARE, MOST = 1.5, 2.0
SEED = 17


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, NULL last, weigh `weights` in turn and share `share`
    times all words. A target stops at `most` times its source; the excess goes
    to the others by weight until no target is above. Only sums over the
    sources reach the driver. A source without words has target 0.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = written(ranked(totals, order, "_rank", "sources").withColumn("_weight", weight), "weights")
    limit = F.col("source_size") * F.lit(most)
    everything = sources.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weights")).first()
    words = (everything["words"] or 0) * share
    level = words / everything["weights"] if everything["weights"] else 0.0
    while True:
        full = limit < F.lit(level) * F.col("_weight")
        sums = sources.agg(
            F.sum(F.when(full, limit)).alias("used"), F.sum(F.when(~full, F.col("_weight"))).alias("free")
        ).first()
        higher = (words - (sums["used"] or 0.0)) / sums["free"] if sums["free"] else level
        if higher <= level:
            break
        level = higher
    target = F.when(limit < F.lit(level) * F.col("_weight"), limit).otherwise(F.lit(level) * F.col("_weight"))
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text only."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(size: Column, source_size: Column, target: Column, drawn: Column) -> Column:
    """floor(rate) copies and one more with the probability of the rest."""
    rate = F.coalesce(F.try_divide(target, source_size), F.lit(0.0))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        draw(F.col(id_col), F.col(text_col), seed).alias("_drawn"),
    )


def mix_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **shares
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (words the mix takes).

    NULL text has size 0; NULL is a source of its own. Repeated rows draw alike,
    rows that differ in id or text draw apart; reruns agree. Texts are read once
    and not shuffled. An empty table gives no rows.
    """
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    return join_groups(sized, written(source_targets(sized, **shares), "targets"), ["source"]).select(
        F.col("_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies(F.col("size"), F.col("source_size"), F.col("target"), F.col("_drawn")).alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **shares
) -> DataFrame:
    """The mixture itself: each row of `docs`, all its columns, as often as the rates say.

    A NULL source is a source of its own; a NULL or empty text has no words and
    follows its source's rate; a source without words is left out. The draw
    depends on seed, id (NULL as '') and text, so rows that are equal in these
    come equally often, and reruns agree. Columns of any name pass through; an
    empty table gives no rows.
    """
    source, size, target, copy = free_names(docs, "_mix_source", "_mix_size", "_mix_target", "_mix_copy")
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    targets = written(source_targets(sized, **shares), "targets").withColumnsRenamed({"source": source, "source_size": size, "target": target})
    joined = docs.join(targets, F.equal_null(F.col(source_col), F.col(source)))
    times = copies(word_count(text_col), F.col(size), F.col(target), draw(F.col(id_col), F.col(text_col), seed))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_report(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS drawn
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
      FROM d GROUP BY source),
l AS (SELECT 0 AS k, (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 / sum(w) FROM s) AS lam
      UNION ALL
      SELECT k + 1, (SELECT CASE WHEN coalesce(sum(CASE WHEN source_size * 2.0 < lam * w THEN 0 ELSE w END), 0) = 0 THEN lam
                            ELSE greatest(lam, (CAST(sum(source_size) AS DOUBLE) * 1.5
                                                - coalesce(sum(CASE WHEN source_size * CAST(2.0 AS DOUBLE) < lam * w THEN source_size * CAST(2.0 AS DOUBLE) END), 0))
                                               / sum(CASE WHEN source_size * CAST(2.0 AS DOUBLE) < lam * w THEN 0 ELSE w END)) END FROM s)
      FROM l WHERE k < 200),
f AS (SELECT lam FROM l WHERE k = 200),
t AS (SELECT source, source_size, least(source_size * CAST(2.0 AS DOUBLE), lam * w) AS target FROM s, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, d.drawn,
             CASE WHEN t.source_size = 0 THEN CAST(0 AS DOUBLE) ELSE t.target / t.source_size END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       size * CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
