"""Centroid clustering: vectors in Hilbert order, blocks with boxes, candidate centroids per block, exact comparison.

Vectors are put in the order of a Hilbert curve once and cut into blocks of
neighbours, each with the box that holds it. A round reads the blocks where
they lie: the distances of the box to the centroids leave a few candidates, and
only those are compared with the block's vectors. Sums leave a task as one row
per cluster and component, so no cluster's vectors meet anywhere.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import arrow_schema, batch_of, prepared, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
# Vectors of a block; bits per component of the curve.
BLOCK, CURVE_BITS = 128, 3
# Components up to the first are compared in doubles without rounding, up to the second in longs.
DOUBLE_LIMIT, LONG_LIMIT = 1 << 20, 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Place on the Hilbert curve through a grid of 2^bits cells a side, as bytes that sort like the places."""
    x = cells.astype(np.int64).T.copy()
    step = 1 << (bits - 1)
    while step > 1:
        below = step - 1
        for axis in range(len(x)):
            turned = (x[axis] & step) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(turned, below, swapped)
            x[axis] ^= swapped
        step >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flips, step = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while step > 1:
        flips ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= flips
    by_bit = np.concatenate([(x >> k) & 1 for k in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(by_bit, axis=0).T]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be the nearest of some point of the box: none is farther at least than another at most."""
    below, above = low - centroids, centroids - high
    least = np.maximum(np.maximum(below, above), 0)
    most = np.maximum(np.abs(below), np.abs(above))
    nearest = (least * least).sum(axis=1)
    return np.flatnonzero(nearest <= (most * most).sum(axis=1).min())


def nearest(vectors: np.ndarray, centroids: np.ndarray, exact_doubles: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number of equal ones; no rounding."""
    if exact_doubles:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        distances = ((v * v).sum(axis=1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        distances = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = distances.argmin(axis=1)
    return at, distances[np.arange(len(at)), at]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): the vectors of `dimensions` finite components, as integers floor(scale * x)."""
    x = F.transform(vector_col, lambda value: value.cast("double"))
    fit = (F.size("v") == dimensions) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = vectors.select(F.col(id_col).alias("id"), x.alias("v")).filter(F.col("v").isNotNull() & fit)
    return scaled.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _extent(whole: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest and largest of each component; a row per component reaches the driver."""
    found = whole.select([F.min(F.col("v")[k]).alias(f"l{k}") for k in range(dimensions)] + [F.max(F.col("v")[k]).alias(f"h{k}") for k in range(dimensions)]).first()
    if found is None or found["l0"] is None:
        return None
    return np.array([found[f"l{k}"] for k in range(dimensions)]), np.array([found[f"h{k}"] for k in range(dimensions)])


def blocks_of(whole: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(ids, size, low, high, vectors): blocks of neighbours on the curve, each with its box."""
    id_type = dict(whole.dtypes)["id"]
    kind = np.result_type(np.min_scalar_type(int(low.min())), np.min_scalar_type(int(high.max())), np.int8)
    width = np.maximum(high - low + 1, 1)
    curve, packed = f"id {id_type}, v binary, place binary", f"ids array<{id_type}>, size int, low binary, high binary, vectors binary"
    curve_fields, fields = arrow_schema(whole, curve), arrow_schema(whole, packed)
    dimensions = len(low)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
                cells = np.minimum(((v - low).astype(np.float64) / width * (1 << CURVE_BITS)).astype(np.int64), (1 << CURVE_BITS) - 1)
                data = [row.tobytes() for row in v.astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(hilbert_keys(cells), pa.binary())], schema=curve_fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []

        def block():
            v = np.frombuffer(b"".join(data), kind).reshape(-1, dimensions)
            return ids, len(ids), v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), v.tobytes()

        for batch in batches:
            for id_, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(id_)
                data.append(v)
                if len(ids) == BLOCK:
                    yield batch_of([block()], fields)
                    ids, data = [], []
        if ids:
            yield batch_of([block()], fields)

    parts = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = whole.mapInArrow(place, curve).repartitionByRange(parts, "place").sortWithinPartitions("place")
    return placed.select("id", "v").mapInArrow(pack, packed), kind


def _assigner(kind: np.dtype, centroids: np.ndarray, exact_doubles: bool):
    def assign(low: bytes, high: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        box = [np.frombuffer(side, kind).astype(np.int64) for side in (low, high)]
        v = np.frombuffer(vectors, kind).astype(np.int64).reshape(-1, centroids.shape[1])
        able = candidates(*box, centroids)
        at, distance = nearest(v, centroids[able], exact_doubles)
        return v, able[at], distance

    return assign


def _round(blocks: DataFrame, kind: np.dtype, centroids: np.ndarray, exact_doubles: bool) -> np.ndarray:
    """The next centroids; a row per cluster and component reaches the driver."""
    schema = "cluster int, component int, total bigint, n bigint"
    fields = arrow_schema(blocks, schema)
    clusters, dimensions = centroids.shape
    assign = _assigner(kind, centroids, exact_doubles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            for low, high, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                v, at, _ = assign(low, high, vectors)
                for cluster in np.unique(at).tolist():
                    mine = at == cluster
                    totals[cluster] += v[mine].sum(axis=0)
                    counts[cluster] += int(mine.sum())
            used = np.flatnonzero(counts)
            rows = [(c, d, int(totals[c, d]), int(counts[c])) for c in used.tolist() for d in range(dimensions)]
            yield batch_of(rows, fields)
            totals[:], counts[:] = 0, 0

    summed = blocks.select("low", "high", "vectors").mapInArrow(run, schema).groupBy("cluster", "component")
    after = centroids.copy()
    for row in summed.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        after[row["cluster"], row["component"]] = int(row["total"]) // row["n"]
    return after


def first_centroids(whole: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, of equal ones the smaller vector; as many rows at most."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = whole.select("v", order.alias("hash")).orderBy(F.col("hash").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([row["v"] for row in found], np.int64)


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector, by k-means in whole numbers.

    Vectors with another number of components, or a NULL, NaN or infinite one,
    are left out; components become floor(scale * x). Centroids start as the
    vectors with the smallest hex sha256 of `seed:id`; with fewer vectors there
    are fewer. A vector goes to the nearest centroid, of equally near ones to
    the smaller number; a non-empty one then moves to floor(sum / count), an
    empty one stays. Repeated rows each count and each give a row; a NULL id is
    the last to start a centroid; other columns are not read; an empty table
    gives no rows. Scaled components beyond 2^27 raise a ValueError, since their
    distances may not fit a long.
    """
    prepared(vectors.sparkSession)
    whole = written(whole_vectors(vectors, id_col, vector_col, dimensions, scale), "vectors")
    id_type = dict(whole.dtypes)["id"]
    schema = f"id {id_type}, cluster int, distance bigint"
    extent = _extent(whole, dimensions)
    names = [F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if extent is None:
        kinds = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return whole.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    low, high = extent
    largest = max(-int(low.min()), int(high.max()))
    if largest > LONG_LIMIT:
        raise ValueError(f"a scaled component of {largest} is too large for distances in a long")
    blocks, kind = blocks_of(whole, low, high)
    blocks = written(blocks, "blocks")
    centroids, doubles = first_centroids(whole, clusters, seed), largest <= DOUBLE_LIMIT
    for _ in range(rounds):
        centroids = _round(blocks, kind, centroids, doubles)
    assign = _assigner(kind, centroids, doubles)
    fields = arrow_schema(whole, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, low_, high_, vectors_ in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                _, at, distance = assign(low_, high_, vectors_)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(at.astype(np.int32)), pa.array(distance)], schema=fields)

    assigned = written(blocks.select("ids", "low", "high", "vectors").mapInArrow(run, schema), "assigned")
    digests = [(k, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(centroids.tolist())]
    # A row per centroid, at most `clusters`.
    of_cluster = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string").join(
        assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")), "cluster"
    )
    whole_sum = of_cluster.agg(F.sum("sum").cast("bigint").alias("inertia"))
    totals = of_cluster.select("cluster", "centroid_sha256", F.col("sum").cast("bigint").alias("cluster_inertia")).join(F.broadcast(whole_sum))
    return assigned.join(F.broadcast(totals), "cluster").select(*names)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql(rounds: int = ROUNDS) -> str:
    distance = "list_sum(list_transform(generate_series(1, 64), lambda i: (k.v[i] - c.c[i]) * (k.v[i] - c.c[i])))::BIGINT"
    steps = []
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, v, min_by(j, (dist, j)) AS j, min(dist) AS dist FROM "
            f"(SELECT k.vec_id, k.v, c.j, {distance} AS dist FROM k, c{n} c) GROUP BY vec_id, v)"
        )
        if n < rounds:
            steps.append(
                f"s{n} AS (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY j, i), "
                f"m{n} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM s{n} GROUP BY j), "
                f"c{n + 1} AS (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m ON m.j = c.j)"
            )
    last = f"a{rounds}"
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
  FROM (SELECT v, sha256('1:' || vec_id) AS h FROM k ORDER BY h, v LIMIT 16)),
{", ".join(steps)}
SELECT {last}.vec_id, {last}.j::INTEGER AS cluster, {last}.dist AS distance, t.s::BIGINT AS cluster_inertia,
       (SELECT sum(dist) FROM {last})::BIGINT AS inertia, sha256(array_to_string(f.c, ',')) AS centroid_sha256
FROM {last} JOIN (SELECT j, sum(dist) AS s FROM {last} GROUP BY j) t ON t.j = {last}.j JOIN c{rounds} f ON f.j = {last}.j
"""


OP12_SQL = _sql()
