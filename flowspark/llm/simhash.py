"""SimHash near-duplicates: fingerprints, a grid over their segment popcounts, exact verification, groups.

A fingerprint's 64 bits are cut into segments; its vector of ones per segment
differs from another's by at most as much (Manhattan) as the fingerprints
differ in bits. So fingerprints that differ in at most LIMIT bits have a half
of their vectors within LIMIT / 2, and both halves lie within LIMIT / 4 of a
lattice point between them: the cells of the grid are these points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import arrow_schema, prepared, row_chunks, table, text_chunks, written
from flowspark.llm.near_copies import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, LIMIT, SEED = 4, 4, 42
# Bits of a segment; its count is 0, 1 or 2. Segments of a half and of a quarter.
SEGMENT, HALF, QUARTER = 2, 16, 8
# Fingerprints of a cell up to which all are compared at once, and beyond which the cell is cut by the other half.
SMALL_CELL, LARGE_CELL = 16, 8192
# Hashes whose bits are counted at a time, bytes of text and rows of cells taken at a time.
HASHES_AT_ONCE, CHUNK_BYTES, ROWS_AT_ONCE = 1 << 16, 8 << 20, 1 << 16

_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64 bits that are set in more than half the hashes of the text's shingles; 0 without words."""
    import xxhash

    words = text.translate(_SMALL).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    span = min(width, len(words))
    begins = np.r_[0, ends[: len(words) - span]].tolist()
    stops = (ends[span - 1 :] - 1).tolist()
    hash_, ones, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(stops)
    for at in range(0, held, HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        found = np.array([hash_(joined[a:b], SEED) for a, b in zip(begins[part], stops[part])], ">u8")
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > held).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, print) per document, the fingerprint as a signed number."""
    schema = f"id {dict(docs.dtypes)[id_col]}, print bigint"
    fields = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 1, CHUNK_BYTES):
            found = [fingerprint(text, width) for text in pc.cast(chunk.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column(0).cast(fields[0].type), pa.array(np.array(found, np.uint64).view(np.int64))], schema=fields)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# --- the grid -------------------------------------------------------------------


def popcounts(prints: np.ndarray) -> np.ndarray:
    """Ones per segment, a row per fingerprint."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(prints), -1, SEGMENT).sum(axis=2, dtype=np.int64)


def centres(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each lattice point within distance 1 of a row of counts: itself and its neighbours."""
    base = SEGMENT + 1
    weights = base ** np.arange(counts.shape[1], dtype=np.int64)
    own = counts @ weights
    rows, points = [np.arange(len(counts))], [own]
    for k, weight in enumerate(weights.tolist()):
        for step, able in ((1, counts[:, k] < SEGMENT), (-1, counts[:, k] > 0)):
            rows.append(np.flatnonzero(able))
            points.append(own[able] + step * weight)
    return np.concatenate(rows), np.concatenate(points)


def _cells(prints: DataFrame, of_open: bool) -> DataFrame:
    """(cell, print): the cells of each half of a fingerprint, or of each quarter of the other half of an open cell's."""
    fields = arrow_schema(prints, "cell bigint, print bigint")
    of_half, of_quarter = (SEGMENT + 1) ** HALF, (SEGMENT + 1) ** QUARTER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, ROWS_AT_ONCE // 16):
            signed = batch.column("print").to_numpy()
            counts = popcounts(signed.view(np.uint64))
            outer = batch.column("cell").to_numpy() if of_open else None
            for part in (0, 1):
                if of_open:
                    other = np.where((outer >= of_half)[:, None], counts[:, :HALF], counts[:, HALF:])
                    rows, points = centres(other[:, part * QUARTER : (part + 1) * QUARTER])
                    cells = (outer[rows] * 2 + part) * of_quarter + points
                else:
                    rows, points = centres(counts[:, part * HALF : (part + 1) * HALF])
                    cells = part * of_half + points
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(signed[rows])], schema=fields)

    return prints.mapInArrow(run, "cell bigint, print bigint")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _spread(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to join what is linked in one cell: from each reached fingerprint to those not reached yet."""
    ones = np.bitwise_count(prints).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    prints, ones = prints[order], ones[order]
    left, one, two = np.arange(len(prints)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            # Those whose popcounts alone do not rule them out lie in one stretch.
            low, high = np.searchsorted(ones[left], [ones[at] - limit, ones[at] + limit + 1])
            near = np.flatnonzero(_differing(prints[left[low:high]], prints[at]) <= limit) + low
            if len(near):
                found = left[near]
                one.append(np.full(len(found), prints[at]))
                two.append(prints[found])
                queue += found.tolist()
                left = np.delete(left, near)
    nothing = np.zeros(0, np.uint64)
    return np.concatenate([nothing, *one]), np.concatenate([nothing, *two])


def _cell_links(cells: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells, rows sorted by cell."""
    begins = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begins, len(cells)])
    one, two = [], []
    for k in np.flatnonzero(sizes > SMALL_CELL).tolist():
        found = _spread(prints[begins[k] : begins[k] + sizes[k]], limit)
        one.append(found[0])
        two.append(found[1])
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    cells, prints = cells[small], prints[small]
    for step in range(1, SMALL_CELL):
        near = np.flatnonzero(cells[step:] == cells[:-step])
        if not len(near):
            break
        near = near[_differing(prints[near], prints[near + step]) <= limit]
        one.append(prints[near])
        two.append(prints[near + step])
    nothing = np.zeros(0, np.uint64)
    return np.concatenate([nothing, *one]), np.concatenate([nothing, *two])


def _links(cells: DataFrame, limit: int, largest: int | None) -> DataFrame:
    """(cell, a, b): links found in the cells; of cells of more than `largest`, instead their rows with `b` NULL."""
    schema = "cell bigint, a bigint, b bigint"
    fields = arrow_schema(cells, schema)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(cell: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        one, two = _cell_links(cell, prints.view(np.uint64), limit)
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1).view(np.int64) if len(one) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])], schema=fields)

    def given_on(cell: int, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), cell)), pa.array(prints), pa.nulls(len(prints), pa.int64())], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, open_ = [], 0, None, False
        for batch in row_chunks(batches, ROWS_AT_ONCE):
            cell, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if open_ and cell[0] == last:
                mine = int(np.searchsorted(cell, last, "right"))
                yield given_on(last, prints[:mine])
                cell, prints = cell[mine:], prints[mine:]
                if not len(cell):
                    continue
            # The last cell may go on in the next batch; all before it are whole.
            start = int(np.searchsorted(cell, cell[-1], "left"))
            if start or (held and cell[0] != last):
                yield linked(*map(np.concatenate, zip(*held, (cell[:start], prints[:start]))))
                held, size = [], 0
            held.append((cell[start:], prints[start:]))
            size += len(cell) - start
            last, open_ = int(cell[-1]), False
            if largest is not None and size > largest:
                for _, part in held:
                    yield given_on(last, part)
                held, size, open_ = [], 0, True
        if held:
            yield linked(*map(np.concatenate, zip(*held)))

    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def print_links(prints: DataFrame, limit: int = LIMIT, largest: int = LARGE_CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that differ in at most `limit` bits (4 at most)."""
    if limit > LIMIT:
        raise ValueError(f"the cells hold pairs of up to {LIMIT} differing bits")
    found = written(_links(_cells(prints.select("print"), False), limit, largest), "cells")
    # A cell whose half vectors are shared by very many is cut by the quarters of the other half.
    open_ = found.filter("b IS NULL").select("cell", F.col("a").alias("print"))
    links = found.filter("b IS NOT NULL").select("a", "b")
    if not open_.isEmpty():
        links = links.unionByName(written(_links(_cells(open_, True), limit, None).select("a", "b"), "open-cells"))
    return links.distinct()


def group_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """(id, fingerprint, component_id) per document.

    Fingerprints (16 lowercase hex digits) link at `limit` or fewer differing
    bits; component_id is the smallest id reachable, its own included. NULL,
    empty and wordless texts have fingerprint zero and link like any other; a
    text of fewer words than a shingle is one shingle; texts are read whole.
    Repeated rows each give a row; a NULL id is never the smallest unless all of
    a group are NULL; other columns are not read; an empty table gives no rows.
    """
    prepared(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col, width), "prints")
    classes = written(rows.groupBy("print").agg(F.min("id").alias("least")), "classes")
    groups = components(written(print_links(classes, limit), "links"))
    named = written(
        classes.join(groups.withColumnRenamed("class", "print"), "print", "left").select(
            "print", "least", F.coalesce("component", "print").alias("component")
        ),
        "groups",
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = written(named.join(smallest, "component").select("print", "component_id"), "named")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(of_print, "print").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_simhash(table(spark, sf_dir, "documents").select("doc_id", "text"))
