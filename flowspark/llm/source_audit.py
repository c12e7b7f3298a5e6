"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Terms of at least MIN_DOCS documents are found by exact counting. They become
minimal perfect hashes of bounded shards with their stored keys; the second
pass over the texts turns each term into its slot, verifies it against the
stored key and increments dense counts per (language, source). Dense counts are
summed over the tasks in a tree, so no key meets all tasks at once.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import top_per_group
from flowspark.llm.common import arrow_schema, batch_of, prepared, table, text_chunks, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS, TOP_TERMS = 30, 50
ONE, SMOOTHING = 1_000_000_000, 5
# Terms of a shard on average; bytes of shards that one pass over the texts holds.
SHARD_TERMS, PASS_BYTES = 1 << 14, 32 << 20
# Bytes of text taken at a time, and of dense counts that a task holds.
CHUNK_BYTES, DENSE_BYTES = 8 << 20, 64 << 20
# Partial counts summed at a time, and sources compared with as many others in one task.
FAN_IN, BLOCK = 64, 64
# Bits per open key, and levels of a perfect hash; keys still open then have equal hashes.
BITS_PER_KEY, LEVELS = 2, 32

# Fixed by the contract: a term is a run of letters a-z and of all that is not ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15


# --- minimal perfect hashes -------------------------------------------------------


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    values = hashes + np.uint64((level + 1) * _M3 % (1 << 64))
    values = (values ^ (values >> np.uint64(33))) * _M1
    values = (values ^ (values >> np.uint64(33))) * _M2
    return ((values ^ (values >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit tables by level, and the slot 0, 1, ... of each key.

    At each level a key that has a bit to itself gets the next slot in the order
    of the bits; keys that meet there go on to the next level.
    """
    slots, left, levels, base = np.empty(len(hashes), np.int64), np.arange(len(hashes)), [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = BITS_PER_KEY * len(left)
        at = _place(hashes[left], level, size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        levels.append(bits)
        base += int(bits.sum())
        left = left[~alone]
    slots[left] = base + np.arange(len(left))
    return levels, slots


class Shard:
    """One shard as a task uses it: terms to slots, checked against the stored keys."""

    def __init__(self, bits: bytes, sizes: list[int], keys: bytes):
        self.levels, base, at = [], 0, 0
        for size in sizes:
            part = np.unpackbits(np.frombuffer(bits, np.uint8, -(-size // 8), at), count=size).astype(bool)
            ranks = base + np.cumsum(part, dtype=np.int32) - 1
            self.levels.append((part, ranks))
            base, at = base + int(part.sum()), at + -(-size // 8)
        names = keys.decode().split("\n")
        self.keys = pa.array(names, pa.string())
        # Different terms of equal hashes have no level; there are hardly ever any.
        self.equal = {name: base + k for k, name in enumerate(names[base:])}

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, hashes: np.ndarray, terms: pa.Array) -> np.ndarray:
        """The slot of each term, -1 for terms that are not stored."""
        found, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(self.levels):
            at = _place(hashes[left], level, len(bits))
            hit = bits[at]
            found[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        asked = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[asked])), terms.take(pa.array(asked)))
        found[asked[~np.asarray(same)]] = -1
        if self.equal:
            for k in np.flatnonzero(found < 0).tolist():
                found[k] = self.equal.get(terms[k].as_py(), -1)
        return found


def _hashes(terms: list[str]) -> np.ndarray:
    """The hash that Spark's xxhash64 gives a string."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(term, 42) for term in terms), np.uint64, len(terms))


# --- the texts' terms ---------------------------------------------------------------


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all terms in a row the code and the text they are in, and the distinct terms."""
    buffers = texts.buffers()
    data = pa.py_buffer(buffers[2].to_pybytes().translate(_TERM_BYTES) if buffers[2] else b"")
    small = pa.StringArray.from_buffers(len(texts), buffers[1], data, None, 0, texts.offset)
    lists = pc.ascii_split_whitespace(small)
    coded = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy()
    rows = np.repeat(np.arange(len(texts)), np.diff(ends))
    codes = coded.indices.to_numpy().astype(np.int64)
    real = np.asarray(pc.not_equal(coded.dictionary, ""))
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    return codes[keep], rows[keep], coded.dictionary


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of the terms in at least `min_docs` documents of the language."""
    fields = arrow_schema(docs, "lang string, term string, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, 2, CHUNK_BYTES):
            codes, rows, names = _terms(chunk.column(2))
            langs, lang_names = _coded(chunk.column(0))
            width = max(1, len(names))
            pairs = np.unique(rows * width + codes)
            found, n = np.unique(langs[pairs // width] * width + pairs % width, return_counts=True)
            lang = pa.array(lang_names, pa.string()).take(pa.array(found // width))
            yield pa.RecordBatch.from_arrays([lang, names.take(pa.array(found % width)), pa.array(n)], schema=fields)

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def term_shards(kept: DataFrame) -> DataFrame:
    """(lang, shard, shards, terms, sizes, bits, keys): perfect hashes of about SHARD_TERMS terms of a language."""
    of_lang = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).alias("shards"))
    named = kept.join(of_lang.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
    sharded = named.select("lang", "shards", F.expr("pmod(xxhash64(term), shards)").alias("shard"), "term")
    schema = "lang string, shard bigint, shards bigint, terms bigint, sizes array<bigint>, bits binary, keys binary"

    def build(rows):
        import pandas as pd

        terms = sorted(rows["term"])
        levels, slots = perfect_hash(_hashes(terms))
        stored = np.array(terms, object)[np.argsort(slots)]
        first = rows.iloc[0]
        row = {"lang": first["lang"], "shard": first["shard"], "shards": first["shards"], "terms": len(terms), "sizes": [len(bits) for bits in levels]}
        return pd.DataFrame([row | {"bits": b"".join(np.packbits(bits).tobytes() for bits in levels), "keys": "\n".join(stored).encode()}])

    return sharded.groupBy("lang", "shard").applyInPandas(build, schema)


# --- counting -----------------------------------------------------------------------


def _packed(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype("u1")
    return kind.str.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[3:]), np.dtype(data[:3].decode())).astype(np.int64)


def _slots_of(shards: dict[int, Shard], width: int, used: np.ndarray, hashes: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each term by its code, -1 where it is not one of the kept terms."""
    shard_of, slot_of = np.full(len(names), -1, np.int64), np.full(len(names), -1, np.int64)
    shard_of[used] = hashes[used].view(np.int64) % width
    for shard, stored in shards.items():
        mine = used[shard_of[used] == shard]
        slot_of[mine] = stored.slots(hashes[mine], names.take(pa.array(mine)))
    return shard_of, slot_of


def slot_counts(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(part, lang, source, shard, counts): what each task counted into the slots of one pass's shards."""
    held = [tuple(row) for row in shards.select("lang", "shard", "shards", "sizes", "bits", "keys").toLocalIterator()]
    tables = docs.sparkSession.sparkContext.broadcast(held)
    schema = "part bigint, lang string, source string, shard bigint, counts binary"
    fields = arrow_schema(docs, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: dict[str, dict[int, Shard]] = {}
        widths = {}
        for lang, shard, width, sizes, bits, keys in tables.value:
            stored.setdefault(lang, {})[shard] = Shard(bytes(bits), sizes, bytes(keys))
            widths[lang] = width
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def counted(part: int) -> pa.RecordBatch:
            rows = [(part, *key, _packed(counts)) for key, counts in dense.items()]
            dense.clear()
            return batch_of(rows, fields)

        size, part = 0, 0
        for chunk in text_chunks(batches, 2, CHUNK_BYTES):
            part = chunk.column(3)[0].as_py()
            codes, rows, names = _terms(chunk.column(2))
            langs, lang_names = _coded(chunk.column(0))
            sources, source_names = _coded(chunk.column(1))
            groups, group_of = np.unique(langs * len(source_names) + sources, return_inverse=True)
            of_term = group_of[rows]
            codes = codes[np.argsort(of_term, kind="stable")]
            ends = np.cumsum(np.bincount(of_term, minlength=len(groups)))
            hashes = _hashes(names.to_pylist())
            # Groups of one language follow each other: its terms are looked up once.
            for code in range(len(lang_names)):
                lang = lang_names[code]
                mine = np.flatnonzero(groups // len(source_names) == code)
                if lang not in stored or not len(mine):
                    continue
                begin = ends[mine[0] - 1] if mine[0] else 0
                used = np.unique(codes[begin : ends[mine[-1]]])
                shard_of, slot_of = _slots_of(stored[lang], widths[lang], used, hashes, names)
                for group in mine.tolist():
                    seen, begin = codes[begin : ends[group]], ends[group]
                    source = source_names[groups[group] % len(source_names)]
                    for shard, table_ in stored[lang].items():
                        slots = slot_of[seen[shard_of[seen] == shard]]
                        slots = slots[slots >= 0]
                        if not len(slots):
                            continue
                        key = (lang, source, shard)
                        if key not in dense:
                            if size >= DENSE_BYTES:
                                yield counted(part)
                                size = 0
                            dense[key] = np.zeros(len(table_), np.int64)
                            size += dense[key].nbytes
                        dense[key] += np.bincount(slots, minlength=len(table_))
        yield counted(part)

    numbered = docs.select("lang", "source", "text", F.spark_partition_id().cast("bigint").alias("part"))
    return numbered.mapInArrow(count, schema)


def summed(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, counts): the sum of the dense counts over `part`, at most FAN_IN parts of a key in a task at a time."""
    schema = ", ".join(f"`{n}` {t}" for n, t in counts.dtypes if n in keys) + ", part bigint, counts binary"
    names = [n for n, _ in counts.dtypes if n in keys]

    def add(rows):
        import pandas as pd

        total = sum(_unpacked(data) for data in rows["counts"])
        first = rows.iloc[0]
        return pd.DataFrame([{**{n: first[n] for n in names}, "part": first["part"], "counts": _packed(total)}])

    counts = written(counts.select(*names, "part", "counts"), name)
    most = counts.agg(F.max("part")).first()[0] or 0
    while True:
        above = counts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        counts = written(above.groupBy(*names, "part").applyInPandas(add, schema), name)
        most //= FAN_IN
        if not most:
            return counts.drop("part")


# --- comparing ----------------------------------------------------------------------


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(ONE * (count + SMOOTHING) / total), exact for totals below 9e15: three digits at a time."""
    quotient, rest = np.divmod((counts + SMOOTHING) * 1000, total)
    for _ in range(2):
        digit, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + digit
    return quotient + 1


def _compared(top: int):
    def compare(rows, shard):
        """Summands of the pairs of a block of sources with another, and the best terms of the block's own sources."""
        import pandas as pd

        shard = shard.iloc[0]
        width, out = int(shard["terms"]), []
        of_source = []
        for source, block, total, data in zip(rows["source"], rows["block"], rows["total"], rows["counts"]):
            counts = _unpacked(data) if data is not None else np.zeros(width, np.int64)
            of_source.append((source, block, counts, shares(counts, int(total)) if width else counts))
        lang, low, high = shard["lang"], shard["low"], shard["high"]
        for source, block, _, p in of_source:
            for other, other_block, _, q in of_source:
                if source != other and (low == high or block != other_block):
                    out.append((lang, source, "pair", other, int(np.abs(p - q).sum())))
        if low == high and width:
            names = np.array(bytes(shard["keys"]).decode().split("\n"), object)
            common = shares(_unpacked(shard["lang_counts"]), int(shard["lang_total"]))
            for source, _, counts, p in of_source:
                above = np.flatnonzero((counts > 0) & (p > common))
                value = (p - common)[above]
                if len(above) > top:
                    # Ties at the last place stay; their order by term is settled over all shards.
                    enough = value >= np.partition(value, -top)[-top]
                    above, value = above[enough], value[enough]
                out += [(lang, source, "term", names[k], int(v)) for k, v in zip(above.tolist(), value.tolist())]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    return compare


def audit_sources(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (language, source) of the documents.

    Terms are runs of letters, those beyond ASCII as they are, A-Z lower-cased;
    a language keeps those in at least `min_docs` of its documents (rows). With
    p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), part `pair` gives for each
    other source the sum of the differences of p over all kept terms, part
    `term` the `top` kept terms with a larger p in the source than in the whole
    language. Ranks count from 1 by value, largest first, equal ones by item.
    NULL in any of the three columns is ''; an empty text has no terms but its
    source is listed; a language without kept terms has value 0 for all pairs;
    repeated rows count as often as they come; other columns are not read; an
    empty table gives no rows. Exact for languages of fewer than 9e15 terms.
    """
    prepared(docs.sparkSession)
    given = (lang_col, "lang"), (source_col, "source"), (text_col, "text")
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in given])
    shards = written(term_shards(written(kept_terms(docs, min_docs), "kept")), "shards")
    # One pass over the texts for each PASS_BYTES of shards; a row per shard is numbered here.
    size = F.length("keys") + F.length("bits")
    before = F.sum(size).over(Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, -1))
    passes = written(
        shards.select("lang", "shard", F.floor(F.coalesce(before, F.lit(0)) / pass_bytes).cast("bigint").alias("pass")), "passes"
    )
    sums = None
    for row in passes.select("pass").distinct().orderBy("pass").toLocalIterator():
        mine = shards.join(passes.filter(F.col("pass") == row["pass"]), ["lang", "shard"])
        counts = summed(slot_counts(docs, mine), ["lang", "source", "shard"], "counts")
        sums = counts if sums is None else sums.unionByName(counts)
    groups = docs.select("lang", "source").distinct()
    langs = groups.select("lang").distinct()
    kept = langs.join(shards.groupBy("lang").agg(F.sum("terms").alias("kept")), "lang", "left").fillna(0, ["kept"])
    if sums is None:
        sums = groups.limit(0).select("lang", "source", F.lit(0).cast("bigint").alias("shard"), F.lit(None).cast("binary").alias("counts"))
    return _report(groups, kept, shards, sums, top)


def _report(groups: DataFrame, kept: DataFrame, shards: DataFrame, sums: DataFrame, top: int) -> DataFrame:
    fields = "lang string, source string, shard bigint, n bigint"

    def sizes(frames):
        for rows in frames:
            yield rows.assign(n=[int(_unpacked(data).sum()) for data in rows["counts"]])[["lang", "source", "shard", "n"]]

    n = sums.mapInPandas(sizes, fields).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint")
    of_lang = Window.partitionBy("lang")
    groups = written(
        groups.join(n, ["lang", "source"], "left")
        .fillna(0, ["n"])
        .join(kept, "lang")
        .select(
            "lang",
            "source",
            number.alias("number"),
            (F.col("n") + SMOOTHING * F.col("kept")).alias("total"),
            (F.sum("n").over(of_lang) + SMOOTHING * F.col("kept")).alias("lang_total"),
            F.ceil(F.count(F.lit(1)).over(of_lang) / BLOCK).alias("blocks"),
        ),
        "groups",
    )
    numbered = sums.join(groups.select("lang", "source", F.col("number").alias("part")), ["lang", "source"])
    whole = summed(numbered, ["lang", "shard"], "whole").withColumnRenamed("counts", "lang_counts")
    # A language without kept terms is compared in one shard of no terms.
    stored = (
        groups.select("lang", "lang_total", "blocks")
        .distinct()
        .join(shards.select("lang", "shard", "terms", "keys"), "lang", "left")
        .withColumn("shard", F.coalesce("shard", F.lit(0).cast("bigint")))
        .fillna(0, ["terms"])
        .join(whole, ["lang", "shard"], "left")
    )
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    pairs = stored.withColumn("low", F.explode(numbers)).withColumn("high", F.explode(F.sequence(F.col("low"), F.col("blocks") - 1)))
    alone = [F.when(F.col("low") == F.col("high"), F.col(c)).alias(c) for c in ("keys", "lang_counts")]
    pairs = written(pairs.select("lang", "shard", "low", "high", "terms", "lang_total", *alone), "pairs")
    block = F.floor(F.col("number") / BLOCK).cast("bigint")
    rows = (
        groups.withColumn("block", block)
        .join(stored.select("lang", "shard"), "lang")
        .join(sums, ["lang", "source", "shard"], "left")
        .withColumn("other", F.explode(numbers))
        .select("lang", "shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "block", "total", "counts")
    )
    key = ["lang", "shard", "low", "high"]
    found = written(
        rows.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInPandas(_compared(top), "lang string, source string, part string, item string, value bigint"),
        "found",
    )
    order = [F.col("value").desc(), "item"]
    whole_pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = top_per_group(found.filter("part = 'term'"), ["lang", "source"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    return whole_pairs.unionByName(terms).withColumn("rank", rank)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM gn GROUP BY 1),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS p
      FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang
      LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.n + 5)) // (ln.n + 5 * v.v) AS q
      FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT x.lang, x.source AS sx, y.source AS sy, sum(abs(x.p - y.p)) AS f
                  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
       ON s.lang = a.lang AND s.sx = a.source AND s.sy = b.source),
tm AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value
       FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
