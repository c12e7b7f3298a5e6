"""Approximate nearest neighbours: inverted lists of trained centroids, residual codes, probed lists only.

A vector lies in the list of its nearest centroid as one byte per component:
what it differs from the centroid by. A query looks into the lists of its
nearest centroids, finds a shortlist by the codes and ranks that exactly by the
vectors themselves. Lists are folders, cut into segments of bounded size, so a
list that holds a third of all vectors is many tasks, and lists that nobody
probes are not opened.
"""

from __future__ import annotations

import json
import math
import os
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.scale import never_broadcast, top_per_group
from flowspark.operators.retrieval import SCORE_DIGITS, TOP_K, _unit
from flowspark.session import cut_lineage
from flowspark.sinks.commits import Commits

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors that centroids, code steps and the number of probes are fitted on, whatever the size of the table.
TRAINING_ROWS, CALIBRATION_QUERIES, MOST_LISTS = 50_000, 200, 4096
# Wanted recall on the training vectors, and how many candidates per wanted neighbour are ranked exactly.
RECALL, SHORTLIST = 0.95, 8
SEGMENT_ROWS, QUERY_ROWS, QUERIES_PER_STEP = 50_000, 10_000, 256
# Scores of a step at most, and tasks of a search.
SCORES_PER_STEP, MOST_TASKS = 4_000_000, 4_000


def lists_for(rows: int) -> int:
    """Number of lists: the root of the number of vectors, within bounds."""
    return max(1, min(MOST_LISTS, round(math.sqrt(rows))))


def _to_vectors(frame: pd.DataFrame) -> np.ndarray:
    return _unit(frame["vector"]) if len(frame) else np.zeros((0, 0))


def _sample(kb: DataFrame, count: int, rows: int) -> DataFrame:
    """About `rows` vectors, at most a tenth more, drawn by a hash of the id."""
    share = min(1.0, rows / max(1, count))
    return kb.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).limit(rows + rows // 10)


def _centroids(sample: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Centres of Spark's k-means over the sample's unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    units = sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(units)
    return np.array([c for c in model.clusterCenters()])


def _needed_probes(vectors: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """Fewest lists that give some of the training vectors `recall` of their k nearest ones."""
    asked = vectors[:: max(1, len(vectors) // CALIBRATION_QUERIES)][:CALIBRATION_QUERIES]
    nearest = np.argsort(-(asked @ vectors.T), axis=1, kind="stable")[:, :k]
    list_of = (vectors @ centroids.T).argmax(axis=1)
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), axis=0), axis=1)
    needed = np.sort(np.take_along_axis(place, list_of[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def _lookup(numbers: dict, key: str):
    return F.element_at(F.create_map(*[F.lit(int(v)) for pair in numbers.items() for v in pair]), F.col(key))


def _groups(segments: dict, sizes: dict) -> dict[int, int]:
    """Group of each list: neighbours in number share one up to `SEGMENT_ROWS` vectors, a list of several segments has its own."""
    group, rows, out = 0, 0, {}
    for at in sorted(segments, key=int):
        size = sizes.get(at, SEGMENT_ROWS) if segments[at] == 1 else SEGMENT_ROWS
        if rows and rows + size > SEGMENT_ROWS:
            group, rows = group + 1, 0
        out[int(at)], rows = group, rows + size
    return out


class VectorIndex:
    """An index in a folder; `build` makes it, `VectorIndex(spark, path)` opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        entry = json.loads(Commits(spark, f"{self.path}/index").read("index"))
        self.centroids, self.step = np.array(entry["centroids"]), np.array(entry["step"])
        self.probes, self.folder, self.segments = entry["probes"], entry["folder"], entry["segments"]
        self.groups = _groups(self.segments, entry.get("sizes", {}))

    @classmethod
    def build(
        cls, kb: DataFrame, path: str, lists: int | None = None, k: int = TOP_K, recall: float = RECALL, training_rows: int = TRAINING_ROWS, seed: int = 1
    ) -> VectorIndex:
        """Index all of `kb` (doc_id, vector); NULL, empty and zero vectors are in no list.

        Centroids, code steps and the number of probes for `recall` of the `k`
        nearest are fitted on at most about `training_rows` vectors; they reach
        the driver. The index counts once its entry is published.
        """
        spark = kb.sparkSession
        kb = kb.select(F.col("doc_id").cast("string").alias("doc_id"), "vector").filter(F.exists("vector", lambda x: x != 0))
        count = kb.count()
        sample = cut_lineage(_sample(kb, count, training_rows), "index-sample")
        vectors = _to_vectors(sample.select("vector").toPandas())
        if not len(vectors):
            raise ValueError("there is no vector to index")
        centroids = _unit(_centroids(sample, min(lists or lists_for(count), len(vectors)), seed))
        residuals = vectors - centroids[(vectors @ centroids.T).argmax(axis=1)]
        step = np.maximum(np.abs(residuals).max(axis=0), 1e-9) / 127
        probes = _needed_probes(vectors, centroids, k, recall)
        held = spark.sparkContext.broadcast((centroids, step))

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, width = held.value
            for frame in frames:
                if len(frame):
                    unit = _unit(frame["vector"])
                    at = (unit @ centres.T).argmax(axis=1)
                    codes = np.clip(np.round((unit - centres[at]) / width), -127, 127).astype(np.int8)
                    yield pd.DataFrame({"doc_id": frame["doc_id"], "code": [c.tobytes() for c in codes], "vector": list(unit), "list": at})

        coded = cut_lineage(kb.mapInPandas(encode, "doc_id string, code binary, vector array<double>, list int"), "index-codes")
        # One number per list; a list of many vectors is cut into segments.
        sizes = {row["list"]: row["count"] for row in coded.groupBy("list").count().collect()}
        segments = {str(at): max(1, -(-n // SEGMENT_ROWS)) for at, n in sizes.items()}
        cut = F.element_at(F.create_map(*[F.lit(int(v)) for pair in segments.items() for v in pair]), F.col("list"))
        placed = coded.withColumn("segment", F.pmod(F.xxhash64("doc_id"), cut).cast("int"))
        folder = f"lists-{os.urandom(6).hex()}"
        placed.repartition("list", "segment").sortWithinPartitions("list", "segment").write.partitionBy("list").parquet(f"{path}/{folder}")
        entry = {"centroids": centroids.tolist(), "step": step.tolist(), "probes": probes, "folder": folder, "segments": segments}
        entry["sizes"] = {str(at): n for at, n in sizes.items()}
        Commits(spark, f"{path}/index").publish("index", json.dumps(entry))
        return cls(spark, path)

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, vector, list, segment): each query with the segments of its nearest lists."""
        held = self.spark.sparkContext.broadcast(self.centroids)

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    unit = _unit(frame["vector"])
                    lists = np.argsort(-(unit @ held.value.T), axis=1, kind="stable")[:, :probes]
                    rows = np.repeat(np.arange(len(frame)), lists.shape[1])
                    yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[rows], "vector": list(unit[rows]), "list": lists.ravel()})

        asked = queries.select(F.col("query_id").cast("string"), "vector").filter(F.exists("vector", lambda x: x != 0))
        probed = asked.mapInPandas(probe, "query_id string, vector array<double>, list int")
        cut = F.element_at(F.create_map(*[F.lit(int(v)) for pair in self.segments.items() for v in pair]), F.col("list"))
        return probed.withColumn("segment", F.explode(F.sequence(F.lit(0), cut - 1)))

    def _by_group(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, vector, lists, group, segment): each query once per group of lists and segment, with its lists there."""
        held, group_of = self.spark.sparkContext.broadcast(self.centroids), self.groups

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    unit, rows = _unit(frame["vector"]), []
                    nearest = np.argsort(-(unit @ held.value.T), axis=1, kind="stable")[:, :probes]
                    for query, vector, lists in zip(frame["query_id"], unit, nearest):
                        by_group: dict[int, list[int]] = {}
                        for at in lists.tolist():
                            if at in group_of:
                                by_group.setdefault(group_of[at], []).append(at)
                        rows += [(query, vector, some, group) for group, some in by_group.items()]
                    yield pd.DataFrame(rows, columns=["query_id", "vector", "lists", "group"])

        asked = queries.select(F.col("query_id").cast("string"), "vector").filter(F.exists("vector", lambda x: x != 0))
        probed = asked.mapInPandas(probe, "query_id string, vector array<double>, lists array<int>, group int")
        cut = _lookup({self.groups[int(at)]: n for at, n in self.segments.items()}, "group")
        return probed.withColumn("segment", F.explode(F.sequence(F.lit(0), cut - 1)))

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int | None = None, shortlist: int = SHORTLIST) -> DataFrame:
        """(query_id, doc_id, similarity): k near neighbours by cosine, most of the nearest ones.

        `probes` lists are looked into (all of them find every neighbour that
        the shortlist of `shortlist * k` holds). A query without a non-zero
        vector finds nothing. Equal similarities are ranked by the smaller id.
        """
        wanted = shortlist * k
        probed = cut_lineage(self._by_group(queries, min(probes or self.probes, len(self.centroids))), "probed")
        # At most one number per group of lists.
        asked = {row["group"]: max(1, -(-row["n"] // QUERY_ROWS)) for row in probed.filter("segment = 0").groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            return self.spark.createDataFrame([], "query_id string, doc_id string, similarity double")
        lists = self.spark.read.parquet(f"{self.path}/{self.folder}").filter(F.col("list").isin(sorted(at for at, g in self.groups.items() if g in asked)))
        parts = _lookup(asked, "group")
        left = probed.withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int"))
        right = lists.select("doc_id", "code", "list", "segment").withColumn("group", _lookup(self.groups, "list"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        held = self.spark.sparkContext.broadcast((self.centroids, self.step))

        def find(key, asked_, docs: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"query_id": [], "doc_id": [], "list": [], "near": []}).astype({"query_id": str, "doc_id": str, "list": "int32", "near": float})]
            if len(asked_) and len(docs):
                centres, width = held.value
                docs = docs.sort_values("list", kind="stable")
                ids, at_list = docs["doc_id"].to_numpy(dtype=object), docs["list"].to_numpy()
                codes = np.frombuffer(b"".join(docs["code"]), np.int8).reshape(len(docs), -1)
                near = (centres[at_list] + codes * width).astype(np.float32)
                numbers, starts = np.unique(at_list, return_index=True)
                bounds = list(zip(numbers, starts, [*starts[1:], len(docs)]))
                names, step = asked_["query_id"].to_numpy(dtype=object), max(1, min(QUERIES_PER_STEP, SCORES_PER_STEP // len(docs)))
                for at in range(0, len(asked_), step):
                    part = asked_.iloc[at : at + step]
                    vectors, wants = np.stack(part["vector"]).astype(np.float32), np.zeros((len(part), len(centres)), bool)
                    for row, some in enumerate(part["lists"]):
                        wants[row, some] = True
                    scores = np.full((len(part), len(docs)), -np.inf, np.float32)
                    for number, start, end in bounds:
                        rows = np.flatnonzero(wants[:, number])
                        scores[rows, start:end] = vectors[rows] @ near[start:end].T
                    best = np.argpartition(-scores, min(wanted, scores.shape[1]) - 1, axis=1)[:, :wanted]
                    rows, best = np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()
                    kept = scores[rows, best] > -np.inf
                    rows, best = rows[kept], best[kept]
                    found.append(pd.DataFrame({"query_id": names[at + rows], "doc_id": ids[best], "list": at_list[best], "near": scores[rows, best].astype(float)}))
            return pd.concat(found)

        cell = ["group", "segment", "part"]
        # A given number of tasks, as cells are small in bytes and long in time.
        tasks = min(MOST_TASKS, 4 * sum(asked.values()) * max(self.segments.values()))
        left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)
        per_cell = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(find, "query_id string, doc_id string, list int, near double")
        short = top_per_group(per_cell, ["query_id"], [F.desc("near"), "doc_id"], wanted)
        return self._ranked(queries, short, lists, k)

    def _ranked(self, queries: DataFrame, short: DataFrame, lists: DataFrame, k: int) -> DataFrame:
        short = cut_lineage(short.select("query_id", "doc_id", "list"), "shortlist")
        vectors = lists.select("doc_id", F.col("vector").alias("theirs"), F.col("list").alias("_list"))
        asked = queries.select(F.col("query_id").cast("string").alias("_query"), F.col("vector").alias("mine"))
        same = (short["doc_id"] == vectors["doc_id"]) & (F.col("list") == F.col("_list"))
        pairs = short.join(never_broadcast(vectors), same).select("query_id", short["doc_id"], "theirs")
        whole = pairs.join(never_broadcast(asked), F.col("query_id") == F.col("_query")).select("query_id", "doc_id", "mine", "theirs")

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    cosine = np.einsum("ij,ij->i", _unit(frame["mine"]), _unit(frame["theirs"]))
                    yield pd.DataFrame({"query_id": frame["query_id"], "doc_id": frame["doc_id"], "similarity": np.round(cosine, SCORE_DIGITS)})

        scored = whole.mapInPandas(score, "query_id string, doc_id string, similarity double")
        return top_per_group(scored, ["query_id"], [F.desc("similarity"), "doc_id"], k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: `hits` of the `wanted` exact neighbours that were found, and their share `recall`."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("hit"))
    counts = exact.join(hit, ["query_id", "doc_id"], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))
    return counts.withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("wanted")))
