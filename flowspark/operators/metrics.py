"""Scoring predictions against labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import join_groups
from flowspark.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1_score")
SCORE_BUCKETS = 256


def join_reports(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labels with their verdicts and an outcome: TP/TN/FP/FN, `missing` or `undecided`.

    `verdicts` is (log_name, verdict); a log without a report stays in as missing.
    """
    given = verdicts.select("log_name", "verdict", F.lit(True).alias("_given"))
    outcome = (
        F.when(F.col("_given").isNull(), "missing")
        .when(F.col("verdict").isNull(), "undecided")
        .when(F.col("label") & F.col("verdict"), "TP")
        .when(F.col("label"), "FN")
        .when(F.col("verdict"), "FP")
        .otherwise("TN")
    )
    return labels.join(given, "log_name", "left").select(*labels.columns, "verdict", outcome.alias("outcome"))


def join_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels with predictions and scores; a log without one counts as 0 and 0.0."""
    return labels.join(predictions, "log_name", "left").select(
        *labels.columns,
        F.coalesce("prediction", F.lit(0)).alias("prediction"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and quality per group of (label, prediction); rows without a prediction do not count."""
    actual, said = F.col("label").cast("boolean"), F.col("prediction").cast("boolean")
    counted = rows.groupBy(*keys).agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
    )
    return _with_quality(counted)


def _with_quality(counted: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    sized = counted.withColumns(
        {
            "total": tp + tn + fp + fn,
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    return sized.withColumn("f1_score", _ratio(2 * precision * recall, precision + recall))


def poisson_limits(bits: int = 32) -> list[int]:
    """Upper ends of the draws of 0, 1, 2, ... events at mean 1, as whole numbers of `bits` bits."""
    total, term, limits = 0.0, math.exp(-1), []
    while int((total + term) * 2**bits) < 2**bits - 1:
        total += term
        limits.append(int(total * 2**bits))
        term /= len(limits)
    return limits


def metric_intervals(
    rows: DataFrame, keys: Sequence[str] = (), id_col: str = "log_name", replicates: int = 200, level: float = 0.95
) -> DataFrame:
    """Metrics of `confusion_metrics` with `_low` and `_high`: the middle `level` of their values over bootstrap replicates.

    In replicate r a row counts as often as its draw says: Poisson with mean 1,
    from the md5 of `id:r`. So one pass gives all replicates, whatever the
    partitions, and a rerun gives the same; rows are summed within tasks, four
    numbers per group and replicate leave one. Intervals need distinct ids.
    """
    drawn = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col("_r").cast("string"))), 1, 8), 16, 10).cast("bigint")
    limits = poisson_limits()
    weight = F.size(F.filter(F.array(*[F.lit(limit) for limit in limits]), lambda limit: limit <= drawn))
    actual, said = F.col("label").cast("boolean"), F.col("prediction").cast("boolean")
    outcome = F.when(actual & said, "tp").when(~actual & ~said, "tn").when(~actual & said, "fp").when(actual & ~said, "fn")
    each = rows.select(*keys, F.col(id_col), outcome.alias("_outcome")).filter("_outcome IS NOT NULL")
    replicated = each.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    sums = replicated.groupBy(*keys, "_r").agg(*[F.sum(F.when(F.col("_outcome") == c, F.col("_w")).otherwise(0)).alias(c) for c in ("tp", "tn", "fp", "fn")])
    tail = (1 - level) / 2
    ends = [
        F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in METRICS for name, q in (("low", tail), ("high", 1 - tail))
    ]
    spread = _with_quality(sums).groupBy(*keys).agg(*ends)
    whole = confusion_metrics(rows, keys)
    return join_groups(whole, spread, keys) if keys else whole.join(F.broadcast(spread))  # one row


def roc_points(rows: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Cumulative true and false positives at each distinct score, highest first.

    Equal scores form one point. Scores are cut into ranges of about equal size
    per group, so the running sums go over one range per task and only range
    totals are summed per group. Ranges are written once.
    """
    keys = list(keys)
    label = F.col("label").cast("int")
    groups = (
        rows.filter(F.col("label").isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.sum(label).alias("_pos"), F.sum(1 - label).alias("_neg"))
    )
    cuts = groups.groupBy(*keys).agg(
        F.percentile_approx("score", [i / SCORE_BUCKETS for i in range(1, SCORE_BUCKETS)]).alias("_cuts"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
    )
    # Without keys `cuts` is one row.
    ranged = (join_groups(groups, cuts, keys) if keys else groups.join(F.broadcast(cuts))).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c > F.col("score")))
    )
    # Both branches below must see the same ranges, and cuts of many scores differ from one evaluation to the next.
    ranged = cut_lineage(ranged.drop("_cuts"), "score-ranges")
    cells = [*keys, "_range"]
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(*cells)
        .agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
        .select(
            *cells,
            F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_tp_before"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_fp_before"),
        )
    )
    running = Window.partitionBy(*cells).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"_tp": F.sum("_pos").over(running), "_fp": F.sum("_neg").over(running)})
    return join_groups(local, totals, cells).select(
        *keys,
        "score",
        F.col("_pos").alias("positives_here"),
        F.col("_neg").alias("negatives_here"),
        (F.col("_tp") + F.col("_tp_before")).alias("tp"),
        (F.col("_fp") + F.col("_fp_before")).alias("fp"),
        "positives",
        "negatives",
        F.try_divide(F.col("_tp") + F.col("_tp_before"), F.col("positives")).alias("tpr"),
        F.try_divide(F.col("_fp") + F.col("_fp_before"), F.col("negatives")).alias("fpr"),
    )


def roc_auc(rows: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Area under the ROC curve per group; 0 where only one class occurs.

    Each score adds its negatives times the positives above it, ties counting
    half; the sum stays in whole numbers until the last division.
    """
    points = roc_points(rows, keys, score)
    doubled = F.sum((F.col("negatives_here") * (2 * F.col("tp") - F.col("positives_here"))).cast("decimal(38,0)"))
    positives, negatives = F.max("positives"), F.max("negatives")
    area = F.try_divide(doubled.cast("double"), 2.0 * positives * negatives)
    return points.groupBy(*keys).agg(
        positives.alias("positives"), negatives.alias("negatives"), F.coalesce(area, F.lit(0.0)).alias("auc")
    )


def evaluate(rows: DataFrame, keys: Sequence[str] = (), score: str | None = "score") -> DataFrame:
    """Confusion metrics with AUC; without a score column the prediction itself is the score.

    The rows are written first: three branches read them, and a model's rows cost a prediction each.
    """
    scored = rows.select(*keys, "label", "prediction", F.col(score or "prediction").cast("double").alias("_score"))
    scored = cut_lineage(scored, "scored")
    quality = confusion_metrics(scored, keys)
    auc = roc_auc(scored.filter(F.col("prediction").isNotNull()), keys, "_score")
    if not keys:
        return quality.join(F.broadcast(auc.select("auc")), None, "left")  # one row each
    joined = join_groups(quality, auc.select(*keys, "auc"), keys, "left")
    return joined.select(*quality.columns, F.coalesce("auc", F.lit(0.0)).alias("auc"))


def compare_models(quality: DataFrame, model: str = "model") -> DataFrame:
    """(metric, model, value, is_best) from one metric row per model."""
    long = quality.unpivot([model], [*METRICS, "auc"], "metric", "value")
    best = F.max("value").over(Window.partitionBy("metric"))  # as many rows as models
    return long.select("metric", model, F.round("value", 4).alias("value"), (F.col("value") == best).alias("is_best"))


def scenario_matrix(rows: DataFrame, sources: Sequence[str], attack: str = "attack", source: str = "label_source") -> DataFrame:
    """One row per attack; percent metrics of each label source as columns."""
    quality = confusion_metrics(rows, [attack, source])
    return (
        quality.groupBy(attack)
        .pivot(source, list(sources))
        .agg(*[F.round(F.first(m) * 100.0, 2).alias(f"{m}_pct") for m in METRICS])
    )
