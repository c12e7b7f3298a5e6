"""Benchmark passages in documents: a prefix-filtered join of shingles, then exact comparison of windows."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import arrow_schema, batch_of, prepared, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SHINGLE = 10, 3
# Pairs of a place and a window that are compared at once.
PAIRS_AT_ONCE = 1 << 19
# Items are joined in slices of about so many bytes of text: that bounds each broadcast.
SLICE_BYTES = 8_000_000

# ASCII letters become small, digits and everything beyond ASCII stay, the rest parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of `width` words; 0 where a word is not of the benchmark."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    value, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        part = ids[k : k + n]
        value = (value ^ (value >> np.uint64(31))) * _MIX + part.astype(np.uint64)
        whole &= part > 0
    return np.where(whole, value | np.uint64(1), np.uint64(0))


def _known(numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index in the sorted keys, place) of each number that is a key."""
    places = np.flatnonzero(numbers)
    first = np.minimum(np.searchsorted(keys, numbers[places]), len(keys) - 1)
    same = keys[first] == numbers[places]
    return first[same], places[same]


class Index:
    """Windows of a slice of items, each under its rarest shingle.

    `keys` are sorted shingle numbers; a key's entries name a window and where
    in it the shingle stands, which fixes the only place in a document where
    the window can begin.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, rarity: dict[int, int] | None = None):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        runs: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1) if ids else ():
                runs.setdefault(tuple(ids[start : start + size]), set()).add(item_id)
        self.runs = list(runs)
        self.items = [sorted(x for x in runs[run] if x is not None) for run in self.runs]
        self.lengths = np.array([len(run) for run in self.runs], np.int64)
        self.words = np.zeros((len(self.runs), window), np.int64)
        for row, run in enumerate(self.runs):
            self.words[row, : len(run)] = run
        entries: dict[int, list[tuple[int, int, int]]] = {w: [] for w in range(1, SHINGLE + 1)}
        all_keys: dict[int, set[int]] = {w: set() for w in range(1, SHINGLE + 1)}
        for row, run in enumerate(self.runs):
            width = min(SHINGLE, len(run))
            numbers = _shingles(np.array(run), width).tolist()
            all_keys[width].update(numbers)
            if rarity is not None:
                best = min(range(len(numbers)), key=lambda k: (rarity.get(numbers[k], 0), numbers[k], k))
                entries[width].append((numbers[best], row, best))
        self.all_keys = {w: np.array(sorted(k), np.uint64) for w, k in all_keys.items() if k}
        self.tables = {}
        for width, found in entries.items():
            if found:
                found.sort()
                self.tables[width] = (
                    np.array([f[0] for f in found], np.uint64),
                    np.array([f[1] for f in found], np.int64),
                    np.array([f[2] for f in found], np.int64),
                )

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def present(self, words: list[bytes]) -> list[int]:
        """The distinct benchmark shingles of a document."""
        ids, found = self.ids(words), []
        for width, keys in self.all_keys.items():
            numbers, _ = _known(_shingles(ids, width), keys)
            found.extend(set(keys[numbers].tolist()))
        return found

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(begin, end) of all windows in a document, and the items they belong to."""
        ids = self.ids(words)
        ranges, items = [], set()
        for width, (keys, rows, offsets) in self.tables.items():
            first, places = _known(_shingles(ids, width), keys)
            if not len(places):
                continue
            counts = np.searchsorted(keys, keys[first], "right") - first
            # A place with each entry of its key, PAIRS_AT_ONCE or those of one place at a time.
            upto = np.cumsum(counts)
            cuts = np.unique(np.searchsorted(upto, np.arange(PAIRS_AT_ONCE, int(upto[-1]), PAIRS_AT_ONCE), "left") + 1)
            for part in np.split(np.arange(len(places)), cuts):
                if len(part):
                    found = self._fitting(ids, places[part], first[part], counts[part], rows, offsets)
                    ranges.extend(found[0])
                    for r in found[1]:
                        items.update(self.items[r])
        return ranges, items

    def _fitting(self, ids, places, first, counts, rows, offsets) -> tuple[list[tuple[int, int]], list[int]]:
        """(begin, end) of the windows that stand at the places where their entries put them, and the windows' numbers."""
        at = np.repeat(places, counts)
        entry = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        row, begin = rows[entry], at - offsets[entry]
        length = self.lengths[row]
        fits = (begin >= 0) & (begin + length <= len(ids))
        row, begin, length = row[fits], begin[fits], length[fits]
        for k in range(self.window):
            inside = k < length
            same = ~inside | (ids[np.minimum(begin + k, len(ids) - 1)] == self.words[row, k])
            row, begin, length = row[same], begin[same], length[same]
        return list(zip(begin.tolist(), (begin + length).tolist())), np.unique(row).tolist()


def covered(ranges: list[tuple[int, int]]) -> int:
    """How many positions the ranges cover together."""
    total, done = 0, 0
    for begin, end in sorted(ranges):
        total += max(0, end - max(begin, done))
        done = max(done, end)
    return total


def _listed(items: set[str]) -> tuple[int, str]:
    return len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _each(docs: DataFrame, columns: list[Column], row, schema: str) -> DataFrame:
    """`row(key..., words)` for each document; the text, last of `columns`, arrives as UTF-8."""
    fields = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            out = []
            for values in zip(*(k.to_pylist() for k in keys), pc.cast(texts, pa.binary()).to_pylist()):
                out.extend(row(*values[:-1], words_of(values[-1])))
            yield batch_of(out, fields)

    return docs.select(*columns).mapInArrow(run, schema)


def _source(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_col).cast("string").alias("_id"), F.col(item_text).alias("_text")).filter(F.col("_text").isNotNull())


def _slice_count(source: DataFrame, slice_bytes: int) -> int:
    return max(1, -(-(source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // slice_bytes))


def _slices(source: DataFrame, count: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in `count` slices, one after the other."""
    dealt = source.withColumn("_slice", F.pmod(F.xxhash64("_text"), F.lit(count)))
    for number in range(count):
        rows = dealt.filter(F.col("_slice") == number).select("_id", "_text").collect()
        yield [(r["_id"], r["_text"].encode()) for r in rows]


def _rarity(docs: DataFrame, text_col: str, items: list, window: int) -> dict[int, int]:
    """In how many documents each shingle of the items occurs."""
    index = docs.sparkSession.sparkContext.broadcast(Index(items, window))
    fields = arrow_schema(docs, "shingle bigint, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for text in pc.cast(batch.column(0), pa.binary()).to_pylist():
                for number in index.value.present(words_of(text)):
                    found[number] = found.get(number, 0) + 1
        rows = [(int(np.uint64(k).astype(np.int64)), n) for k, n in found.items()]
        yield batch_of(rows, fields)

    counts = docs.select(text_col).mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    # One row per shingle of this slice at most, so its size is that of the slice.
    rarity = {int(np.int64(r["shingle"]).astype(np.uint64)): r["n"] for r in counts.toLocalIterator()}
    index.destroy()
    return rarity


def _index(docs: DataFrame, text_col: str, part: list, window: int):
    """The index of a slice of the items, broadcast."""
    return docs.sparkSession.sparkContext.broadcast(Index(part, window, _rarity(docs, text_col, part, window)))


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter
    one. Shingles of three words are ordered by the number of documents that
    hold them; a window must contain all of its shingles, so its necessary
    prefix is the rarest one. Documents are joined to windows on that shingle;
    its place in the window gives the one possible begin (positional bound),
    both ends must lie inside the document (length bound), and all words are
    compared.

    Items are taken in slices of bounded size; of several, each is collected,
    broadcast, its hits written, and dropped before the next, so a benchmark of
    any size gives the same rows. NULL or wordless documents have
    no words and no hits; NULL or wordless items have no windows; equal items
    under several ids count under each; an item with a NULL id is hit but not
    listed. Repeated documents each give a row. With no items nothing is hit.
    """
    id_type = dict(docs.dtypes)[id_col]
    prepared(docs.sparkSession)
    source = _source(items, item_col, item_text)
    count = _slice_count(source, slice_bytes)
    measures = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def result(key, n_words, ranges, found):
        n_hit = covered(ranges)
        return (key, n_words, n_hit, *_listed(found), n_hit > 0)

    if count == 1:
        index = _index(docs, text_col, next(_slices(source, 1)), window)

        def whole(key, words):
            yield result(key, len(words), *index.value.hits(words))

        return _each(docs, [F.col(id_col), F.col(text_col)], whole, f"`{id_col}` {id_type}, {measures}")
    return _in_slices(docs, id_col, text_col, _slices(source, count), window, result, measures)


def _text_key(text_col: str) -> Column:
    return F.sha1(F.coalesce(text_col, F.lit("")))


def _hits(docs: DataFrame, text_col: str, slices: Iterator[list], window: int) -> DataFrame:
    """(_key, begins, ends, items) of the texts that each slice hits; a slice's index is gone before the next is built."""
    key = _text_key(text_col)
    shape = "_key string, begins array<int>, ends array<int>, items array<string>"

    def in_slice(index):
        def row(key, words):
            ranges, found = index.value.hits(words)
            if ranges:
                yield key, [b for b, _ in ranges], [e for _, e in ranges], sorted(found)

        return row

    found = None
    for part in slices:
        index = _index(docs, text_col, part, window)
        hits = written(_each(docs, [key, F.col(text_col)], in_slice(index), shape).dropDuplicates(["_key"]), "hits")
        index.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def _in_slices(docs, id_col, text_col, slices, window, result, measures) -> DataFrame:
    """The same for several slices: hits of each slice, merged per text."""
    key = _text_key(text_col)
    merged = written(
        _hits(docs, text_col, slices, window).groupBy("_key").agg(
            F.flatten(F.collect_list("begins")).alias("_begins"),
            F.flatten(F.collect_list("ends")).alias("_ends"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"),
        ),
        "passages",
    )
    id_type = dict(docs.dtypes)[id_col]

    def counted(key, text_key, words):
        yield key, text_key, len(words)

    sizes = _each(docs, [F.col(id_col), key, F.col(text_col)], counted, f"_id {id_type}, _key string, _words bigint")
    joined = sizes.join(merged, "_key", "left")
    fields = arrow_schema(docs, f"`{id_col}` {id_type}, {measures}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield batch_of([result(k, n, list(zip(b or (), e or ())), set(i or ())) for k, n, b, e, i in rows], fields)

    return joined.select("_id", "_words", "_begins", "_ends", "_items").mapInArrow(
        finish, f"`{id_col}` {id_type}, {measures}"
    )


def without_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of an item.

    A NULL or empty text holds none and stays, as do all rows where there are no
    items; NULL items are left out; repeated rows stay or go together; columns
    of any name pass through; an empty table gives no rows.
    """
    prepared(docs.sparkSession)
    source = _source(items, item_col, item_text)
    count = _slice_count(source, slice_bytes)
    if count > 1:
        hit = written(_hits(docs, text_col, _slices(source, count), window).select(F.col("_key").alias("_hit_text")).distinct(), "hit-texts")
        return docs.join(hit, _text_key(text_col) == F.col("_hit_text"), "left_anti")
    at, index = docs.columns.index(text_col), _index(docs, text_col, next(_slices(source, 1)), window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.binary()).to_pylist()
            yield batch.filter(pa.array([not index.value.hits(words_of(t))[0] for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
it AS (SELECT item_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, ws[i:i + least(10, len(ws)) - 1] AS g, least(10, len(ws)) AS k
       FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM it WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, i, k, ws[i:i + k - 1] AS g
       FROM (SELECT r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT r, i, k, item_id FROM dw JOIN iw USING (g, k)),
pos AS (SELECT r, count(DISTINCT j) AS n_hit
        FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
