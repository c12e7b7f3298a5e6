"""All texts of a case's addresses as one section, without its pairs of case and text.

A hot address brings its texts to many cases, so sections together grow with
the square of the tables, and pairs with texts are as large as all sections.
Cases are dealt to groups instead, a task each: the texts of an address are
packed once and sent to the groups that have a case with it. A task keeps the
texts of its group in their order, and makes the section of one case after
another from their places, which leave it as rows of the result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowspark.functions.scale import never_broadcast
from flowspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters of sections that a group is for, and groups at most: each copy of a hot address's texts is sent.
GROUP_CHARS, MOST_GROUPS = 64 << 20, 256
# Bytes of texts that a packed block has at least; smaller ones are left to the shuffle's own compression.
PACKED = 4_096
# Bytes of sections that leave a task together.
SENT = 2 << 20

_BLOCK = "ip string, texts int, size bigint, block binary"


def add_sections(cases: DataFrame, ips: DataFrame, texts: DataFrame, name: str, group_chars: int = GROUP_CHARS) -> DataFrame:
    """`cases` (log_name, ...) with `name`: the distinct texts of its addresses by their alphabet, a line break between two.

    Takes (log_name, ip) and (ip, text); repeats do not matter. A case without
    any text has NULL. A task holds the distinct texts of its cases' addresses.
    """
    asked = ips.groupBy("ip").agg(F.count(F.lit(1)).alias("_cases"))
    known = texts.select("ip", "text").distinct().join(asked.select("ip"), "ip", "left_semi")
    blocks = known.repartitionByRange("ip", "text").sortWithinPartitions("ip", "text").mapInArrow(_pack, _BLOCK)
    blocks = cut_lineage(blocks, "text-blocks")
    sizes = blocks.groupBy("ip").agg(F.sum("size").alias("_size")).join(asked, "ip")
    chars = sizes.agg(F.sum(F.col("_size") * F.col("_cases"))).first()[0] or 0
    groups = min(MOST_GROUPS, int(chars // group_chars) + 1)

    group = F.pmod(F.xxhash64(F.col("log_name").cast("string")), F.lit(groups)).cast("int")
    places = ips.groupBy("ip").agg(F.collect_set(group).alias("_groups"))
    sent = blocks.join(places, "ip").select(F.explode("_groups").alias("_group"), F.lit(0).alias("_row"), "ip", "texts", "size", "block")
    named = ips.groupBy("log_name").agg(F.collect_set("ip").alias("_ips"))
    asking = never_broadcast(cases).join(named, "log_name", "left").select(group.alias("_group"), F.lit(1).alias("_row"), "_ips", F.struct(*cases.columns).alias("_case"))
    dealt = sent.unionByName(asking, allowMissingColumns=True).repartitionById(groups, "_group").sortWithinPartitions("_group", "_row")
    schema = StructType([StructField("_case", cases.schema), StructField("_section", StringType())])
    made = dealt.mapInArrow(_put_together, schema)
    return made.select(*[F.col("_case")[c].alias(c) for c in cases.columns], F.col("_section").alias(name))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block for each address of a batch sorted by address: its texts one after another, behind where they begin."""
    codec = pa.Codec("zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        encoded, rows = batch.column("ip").dictionary_encode(), []
        ends = np.flatnonzero(np.diff(encoded.indices.to_numpy())) + 1
        for begin, end in zip([0, *ends], [*ends, batch.num_rows]):
            texts = [text.encode() for text in batch.column("text").slice(begin, end - begin).to_pylist() if text is not None]
            begins = np.cumsum([0, *map(len, texts)], dtype="int64")
            whole = begins.tobytes() + b"".join(texts)
            block = codec.compress(whole, asbytes=True) if len(whole) >= PACKED else whole
            rows.append((batch.column("ip")[begin].as_py(), len(texts), len(whole), block))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(values), kind) for values, kind in zip(zip(*rows), kinds)], ["ip", "texts", "size", "block"])


def _unpack(n: int, size: int, block: pa.Buffer) -> pa.Array:
    # Small ones are copied, as their begins may lie at odd addresses of the batch.
    whole = pa.py_buffer(block.to_pybytes()) if size < PACKED else pa.Codec("zstd").decompress(block, size)
    return pa.LargeStringArray.from_buffers(n, whole.slice(0, 8 * (n + 1)), whole.slice(8 * (n + 1)))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections of cases that come after the blocks of their group."""
    at, packed, places, texts = None, [], None, None
    for batch in batches:
        columns = [batch.column(c) for c in ("_group", "_row", "ip", "texts", "size", "_ips")]
        waiting, taken, held = [], [], 0
        for i, (group, row, ip, n, size, ips) in enumerate(zip(*[c.to_pylist() for c in columns])):
            if group != at:
                if waiting:
                    yield _sections(batch, waiting, taken, texts)
                at, packed, places, waiting, taken, held = group, [], None, [], [], 0
            if row == 0:
                packed.append((ip, _unpack(n, size, batch.column("block")[i].as_buffer())))
                continue
            if places is None:
                places, texts, lengths = _places(packed)
                packed = []
            found = [places[ip] for ip in ips or () if ip in places]
            waiting.append(i)
            taken.append(None if not found else found[0] if len(found) == 1 else np.unique(np.concatenate(found)))
            held += 0 if not found else int(lengths[taken[-1]].sum())
            if held >= SENT:
                yield _sections(batch, waiting, taken, texts)
                waiting, taken, held = [], [], 0
        if waiting:
            yield _sections(batch, waiting, taken, texts)


def _places(packed: list[tuple[str, pa.Array]]) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray]:
    """Where each address's texts are among all distinct ones in their order; these, and their lengths."""
    encoded = pa.concat_arrays([texts for _, texts in packed] or [pa.array([], pa.large_string())]).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), "int64")
    rank[order] = np.arange(len(order))
    rows, texts, places, begin = rank[encoded.indices.to_numpy()], encoded.dictionary.take(pa.array(order)), {}, 0
    for ip, own in packed:
        here = np.sort(rows[begin : begin + len(own)])
        places[ip] = np.sort(np.concatenate([places[ip], here])) if ip in places else here
        begin += len(own)
    return places, texts, pc.binary_length(texts).to_numpy()


def _sections(batch: pa.RecordBatch, rows: list[int], taken: list[np.ndarray | None], texts: pa.Array) -> pa.RecordBatch:
    """The cases of these rows with the texts at their places, one line each."""
    none = np.empty(0, "int64")
    lists = [none if places is None else places for places in taken]
    ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    values = texts.take(pa.array(np.concatenate(lists)))
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, values, mask=pa.array([places is None for places in taken])), pa.scalar("\n", pa.large_string()))
    return pa.RecordBatch.from_arrays([batch.column("_case").take(pa.array(rows)), joined.cast(pa.string())], ["_case", "_section"])
