"""Classifiers over the thirty flow features, as Spark ML pipelines."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators import metrics
from flowspark.operators.profile import FEATURES
from flowspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODELS = ("svm", "random_forest", "mlp")
SEED = 42
# Random cosines of the Gaussian kernel: its error falls with the root of their number.
COSINES = 512
# Models that are fitted at the same time. A fit is hundreds of short steps; more of them would hold more rows at once.
FITS = 2


class GaussianFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: vectors whose products approximate exp(-gamma * squared distance).

    The directions are drawn from the seed, so a saved stage is its parameters.
    gamma 0 stands for 1 / (number of components), the usual width for scaled ones.
    """

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", typeConverter=TypeConverters.toFloat)
    cosines = Param(Params._dummy(), "cosines", "number of features", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "cosines", gamma: float = 0.0, cosines: int = COSINES, seed: int = SEED):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=float(gamma), cosines=cosines, seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, cosines, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.cosines), self.getSeed()

        @F.pandas_udf("array<double>")
        def mapped(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return vectors
            return pd.Series(list(fourier_features(np.stack(vectors), gamma, cosines, seed)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


def fourier_features(vectors: np.ndarray, gamma: float, cosines: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    width = vectors.shape[1]
    directions = draw.normal(0.0, np.sqrt(2 * (gamma or 1 / width)), (width, cosines))
    return np.sqrt(2 / cosines) * np.cos(vectors @ directions + draw.uniform(0, 2 * np.pi, cosines))


def _preparation(columns: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def classifier(model: str):
    if model == "svm_rbf":
        return LinearSVC(featuresCol="cosines", maxIter=100, regParam=0.001)
    if model == "svm":
        return LinearSVC(maxIter=50, regParam=0.01)
    if model == "random_forest":
        # Each row keeps its node of every tree: a step neither walks down all trees again nor sends them to the tasks.
        # The trees are the same.
        return RandomForestClassifier(numTrees=100, maxDepth=20, minInstancesPerNode=2, cacheNodeIds=True, seed=SEED)
    if model == "mlp":
        return MultilayerPerceptronClassifier(layers=[len(FEATURES), 64, 2], maxIter=100, seed=SEED)
    raise ValueError(f"unknown model {model!r}")


def scaled_features(features: DataFrame) -> DataFrame:
    """Features with mean 0 and variance 1 over all logs (sample variance); constants become 0.

    The features are written first, so the flows behind them are read once.
    """
    features = cut_lineage(features, "features")
    stats = features.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"_s_{c}") for c in FEATURES]
    )
    scaled = {
        c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0))
        for c in FEATURES
    }
    return features.join(F.broadcast(stats)).withColumns(scaled).select(*features.columns)  # stats is one row


def train(dataset: DataFrame, model: str, columns: Sequence[str] = FEATURES) -> PipelineModel:
    """Fit a model on (log_name, label, thirty features), or on other `columns` (the perceptron takes the thirty only)."""
    mapped = [GaussianFeatures()] if model == "svm_rbf" else []
    return Pipeline(stages=[*_preparation(columns), *mapped, classifier(model)]).fit(dataset)


def predict(fitted: PipelineModel, features: DataFrame) -> DataFrame:
    """(log_name, prediction, score); the score is the attack probability, or the margin of the SVM."""
    out = fitted.transform(features)
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(
        "log_name", F.col("prediction").cast("int").alias("prediction"), vector_to_array(raw)[1].alias("score")
    )


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def held_out(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test logs by the md5 of the name: about four in five and the rest."""
    bucket = F.conv(F.substring(F.md5("log_name"), 1, 4), 16, 10).cast("int") % 10
    return dataset.filter(bucket < 8), dataset.filter(bucket >= 8)


def train_and_score(dataset: DataFrame, model: str, train_on_all: bool = False, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Test logs with label, prediction and score; `train_on_all` tests on the training logs."""
    training, test = (dataset, dataset) if train_on_all else held_out(dataset)
    return metrics.join_predictions(test.select("log_name", "label"), predict(train(training, model, columns), test))


def train_and_score_each(dataset: DataFrame, models: Iterable[str] = MODELS, train_on_all: bool = False) -> DataFrame:
    """`train_and_score` of every model, with the column `model`.

    Between the steps of a fit the executors wait for the driver, so one fit's
    steps run in another's pauses; the models are those of single fits.
    """
    models = list(models)
    # Each thread has its own copy of the job's properties.
    fits = [inheritable_thread_target(dataset.sparkSession)(partial(train_and_score, dataset, m, train_on_all)) for m in models]
    with ThreadPool(FITS) as pool:
        scored = pool.map(lambda fit: fit(), fits, chunksize=1)
    return reduce(DataFrame.unionByName, [rows.withColumn("model", F.lit(m)) for m, rows in zip(models, scored)])


def compare(dataset: DataFrame, models: Iterable[str] = MODELS, train_on_all: bool = False) -> DataFrame:
    """Metrics of every model, one row each."""
    # One row per log, read by each step of each model.
    dataset = cut_lineage(dataset, "dataset")
    return metrics.evaluate(train_and_score_each(dataset, models, train_on_all), ["model"])
