"""N-gram Jaccard join: signature trees over the documents that share a rare shingle, and groups of linked documents.

A pair can only reach the threshold if the prefixes of both documents, their
rarest shingles, meet. So each prefix shingle is the root of one tree: its
documents, split by size range, and below that leaves with OR-combined bitmaps.
Links to one document per shingle come first and join most copies; the trees
are then searched for pairs from groups that are still apart.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import arrow_schema, batch_of, free_names, prepared, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, PERCENT = 3, 90
# A bitmap's 64-bit words; classes per leaf, of one group and of several.
BITMAP_WORDS, LEAF, MIXED_LEAF = 64, 16, 2
# Shingles that a task counts at a time; a table of 2^RARITY_BITS bytes says how common a shingle is.
COUNTED_AT_ONCE, RARITY_BITS, SLICE_BITS = 4_000_000, 24, 20
CACHED_WORDS, CACHED_WORD_BYTES = 100_000, 64

_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * _M1
    values = (values ^ (values >> np.uint64(33))) * _M2
    return values ^ (values >> np.uint64(33))


def shingle_set(text: bytes | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; a shorter text is one shingle; none without words."""
    words = text.translate(_SMALL).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    value = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        value = _mixed(value * _M3 + found[k : len(words) - span + 1 + k])
    return np.unique(value)


def prefix_size(n: int, percent: int) -> int:
    """How many of its rarest shingles a document shows: one more than a partner may lack."""
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap(shingles: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[(shingles % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view(">i8").astype(np.int64)


# --- how common a shingle is ----------------------------------------------------


def rarity_table(docs: DataFrame, text_col: str, width: int) -> bytes:
    """A byte per slot of shingle hashes: the binary logarithm of how often shingles there were seen repeatedly.

    It only orders the shingles, so any table gives the same links; a good one
    keeps shared passages out of prefixes. Each task counts its own documents
    and passes on what occurs twice; the table's size is fixed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = _WordHashes(), set(), [], 0

        def repeated():
            values = np.concatenate(held)
            held.clear()
            values.sort()
            again, times = np.unique(values[1:][values[1:] == values[:-1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(times.astype(np.int64) + 1)], ["shingle", "n"])

        for batch in batches:
            for text in pc.cast(batch.column(0), pa.binary()).to_pylist():
                found = shingle_set(text, width, hashes)
                print_ = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                if print_ in seen:
                    continue
                seen.add(print_)
                held.append(found)
                size += len(found)
                if size >= COUNTED_AT_ONCE:
                    yield repeated()
                    seen, size = set(), 0
        if held:
            yield repeated()

    counted = docs.select(text_col).mapInArrow(count, "shingle bigint, n bigint")
    slot = F.shiftrightunsigned("shingle", 64 - RARITY_BITS).cast("int")
    slots = (
        counted.groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .groupBy(slot.alias("slot"))
        .agg(F.floor(F.log2(F.max("n"))).cast("int").alias("level"))
    )
    slices = slots.withColumn("slice", F.shiftright("slot", SLICE_BITS)).groupBy("slice")

    def fill(key, rows):
        import pandas as pd

        levels = np.zeros(1 << SLICE_BITS, np.uint8)
        levels[rows["slot"].to_numpy() & ((1 << SLICE_BITS) - 1)] = np.minimum(rows["level"], 63)
        return pd.DataFrame({"slice": [key[0]], "levels": [levels.tobytes()]})

    whole = bytearray(1 << RARITY_BITS)
    for row in slices.applyInPandas(fill, "slice int, levels binary").toLocalIterator():
        whole[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = row["levels"]
    return bytes(whole)


# --- documents, classes, prefixes -------------------------------------------------


def features(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, text_md5, n, set, prefix, bitmap) per document; equal sets have equal fingerprints `set`."""
    levels = docs.sparkSession.sparkContext.broadcast(rarity_table(docs, text_col, width))
    id_type = dict(docs.dtypes)[id_col]
    schema = f"id {id_type}, text_md5 string, n bigint, set binary, prefix array<bigint>, bitmap array<bigint>"
    fields = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table_ = _WordHashes(), np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            rows = []
            keys, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, print_, text in zip(keys, prints, pc.cast(batch.column(2), pa.binary()).to_pylist()):
                found = shingle_set(text, width, hashes)
                if not len(found):
                    rows.append((key, print_, 0, None, None, None))
                    continue
                level = table_[(found >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[: prefix_size(len(found), percent)]
                name = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((key, print_, len(found), name, found[order].view(np.int64), bitmap(found)))
            yield batch_of(rows, fields)

    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.md5(text).alias("text_md5"), text.alias("text")).mapInArrow(run, schema)


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def may_reach(both_bits: Column, slack_a: Column, slack_b: Column, least_a: Column, least_b: Column, percent: int) -> Column:
    """Whether the largest overlap that the bitmaps allow is enough for the smallest sizes.

    Common shingles set common bits; where shingles of one document fall on one
    bit, at most its slack (shingles less bits) of them are not told apart.
    """
    most = both_bits + F.least(slack_a, slack_b)
    return (100 + percent) * most >= percent * (least_a + least_b)


def common_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


# --- verification -------------------------------------------------------------------


def document_slot(id_: Column, text_md5: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_, text_md5), 64 - RARITY_BITS)


def slot_table(slots: DataFrame) -> bytes:
    """A bit per slot, set for those of the column `slot`; 2 MB whatever their number."""
    filled = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")
    )
    table_ = bytearray(1 << RARITY_BITS - 3)
    for row in filled.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        table_[at : at + 4096] = row["bits"]
    return bytes(table_)


def sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """(class, shingles) of the documents in `wanted` (class, id, text_md5), made again from their texts.

    Texts are not shuffled: a table of bits, of fixed size, tells each task
    which of its documents may be wanted, and the join drops the few others.
    """
    bits = docs.sparkSession.sparkContext.broadcast(slot_table(wanted.select(document_slot(F.col("id"), F.col("text_md5")).alias("slot"))))
    schema = f"_id {dict(docs.dtypes)[id_col]}, _md5 string, shingles binary"
    fields = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table_ = _WordHashes(), np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            slots = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((table_[slots >> 3] >> (slots & 7) & 1).astype(bool)))
            texts = pc.cast(batch.column(3), pa.binary()).to_pylist()
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts)
            yield batch_of([(k, m, shingle_set(t, width, hashes).tobytes()) for k, m, t in keys], fields)

    text = F.coalesce(text_col, F.lit(""))
    named = docs.select(F.col(id_col).alias("_id"), F.md5(text).alias("_md5"), text.alias("_text"))
    slot = document_slot(F.col("_id"), F.col("_md5")).alias("_slot")
    found = named.select("_id", "_md5", slot, "_text").mapInArrow(run, schema)
    sets = written(
        found.join(wanted, F.equal_null(F.col("_id"), F.col("id")) & (F.col("_md5") == F.col("text_md5"))).select("class", "shingles"), "sets"
    )
    # Only repeated rows can give a class twice.
    return sets if sets.count() == wanted.count() else written(sets.dropDuplicates(["class"]), "sets")


def linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, members: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold, compared shingle by shingle."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(members, "class"), "wanted")
    sets = sets_of(docs, id_col, text_col, wanted, width)
    left = pairs.join(sets.withColumnsRenamed({"class": "a", "shingles": "left"}), "a")
    both = left.join(sets.withColumnsRenamed({"class": "b", "shingles": "right"}), "b")
    found = arrow_schema(docs, "a bigint, b bigint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    rows.append((a, b))
            yield batch_of(rows, found)

    return both.select("a", "b", "left", "right").mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(class, component) of all classes with a link: the smallest class reachable.

    Labels shrink along links and are then replaced by their own labels, so
    chains halve each round; every round is written, which cuts the lineage.
    """
    both = written(links.union(links.select("b", "a")).toDF("class", "other").distinct(), "links")
    labels = both.groupBy("class").agg(F.min("other").alias("least")).select("class", F.least("class", "least").alias("component"))
    labels = written(labels, "labels")
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"class": "other", "component": "theirs"}), "other")
            .groupBy("class")
            .agg(F.min("theirs").alias("theirs"))
        )
        lower = written(
            labels.join(near, "class").select(
                "class", F.least("component", "theirs").alias("component"), (F.col("theirs") < F.col("component")).alias("moved")
            ),
            "labels",
        )
        if lower.filter("moved").isEmpty():
            return labels
        ahead = lower.select(F.col("class").alias("component"), F.col("component").alias("ahead"))
        labels = written(lower.join(ahead, "component").select("class", F.col("ahead").alias("component")), "labels")


# --- the join -----------------------------------------------------------------------


def _with_bitmaps(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave enough overlap possible."""
    for side in ("a", "b"):
        pairs = pairs.join(bitmaps.select(*[F.col(c).alias(side if c == "class" else f"{side}_{c}") for c in bitmaps.columns]), side)
    col = F.col
    bits = common_bits(col("a_bitmap"), col("b_bitmap"))
    return pairs.filter(may_reach(bits, col("a_slack"), col("b_slack"), col("a_n"), col("b_n"), percent)).select("a", "b")


def first_pairs(held: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Each class with one class of each shingle that it shares: as many pairs as postings, not their square.

    That one is the class whose shingles are shared most: of near copies, the
    one with the fewest changes, which most others link to.
    """
    shared = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("shared"))
    known = held.join(shared, "shingle").groupBy("class").agg((F.sum("shared") / F.first("n")).alias("known"))
    ranked = held.join(written(known, "known"), "class")
    first = ranked.groupBy("shingle").agg(F.max(F.struct("known", "class", "n")).alias("first"))
    apart = (F.col("class") != F.col("first.class")) & similar_sizes(F.col("n"), F.col("first.n"), percent)
    pairs = held.join(first, "shingle").filter(apart).select(F.col("class").alias("a"), F.col("first.class").alias("b"))
    return _with_bitmaps(pairs.distinct(), bitmaps, percent)


def _ranges(postings: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Postings by (shingle, range), of the ranges whose classes lie in several groups.

    A range is as wide as the threshold and holds the next smaller one as well,
    so partners meet in one. Of ranges above the same classes the one under the
    rarest shingle is enough: it comes first in all their prefixes.
    """
    grouped = postings.join(groups, "class", "left").withColumn("group", F.coalesce("component", "class")).drop("component")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    ranges = grouped.withColumn("band", band).withColumn("range", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    prints = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"print{k}") for k in (1, 2)]
    apart = (
        ranges.groupBy("shingle", "range")
        .agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("band").alias("top"), F.count(F.lit(1)).alias("size"), F.sum("place").alias("places"), *prints)
        .filter((F.col("low") != F.col("high")) & (F.col("top") == F.col("range")))
        .groupBy("range", "size", "print1", "print2")
        .agg(F.min_by("shingle", "places").alias("shingle"))
        .select("shingle", "range")
    )
    return ranges.join(written(apart, "ranges"), ["shingle", "range"])


def _leaf_pairs(placed: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves of one range that their nodes cannot rule out: (shingle, range, a_leaf, b_leaf).

    A range of one leaf has nothing to rule out, so only the others get nodes.
    """
    root = ["shingle", "range"]
    single = placed.filter(F.col("of_range") <= LEAF).select(*root, F.col("leaf").alias("a_leaf"), F.col("leaf").alias("b_leaf")).distinct()
    bits = [F.bit_or(F.col("bitmap")[k]).alias(f"w{k}") for k in range(BITMAP_WORDS)]
    nodes = written(
        placed.filter(F.col("of_range") > LEAF)
        .join(bitmaps.drop("n"), "class")
        .groupBy(*root, "leaf")
        .agg(
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.max("slack").alias("slack"),
            F.max(F.col("n") - F.col("place")).alias("behind"),
            F.min("group").alias("low"),
            F.max("group").alias("high"),
            *bits,
        )
        .select(*root, "leaf", "least", "most", "slack", "behind", "low", "high", F.array(*[f"w{k}" for k in range(BITMAP_WORDS)]).alias("bits")),
        "nodes",
    )
    one, two = _side(nodes, root, "a"), _side(nodes, root, "b")
    col = F.col
    one_group = (col("a_low") == col("a_high")) & (col("b_low") == col("b_high")) & (col("a_low") == col("b_low"))
    sizes_fit = (100 * col("a_most") >= percent * col("b_least")) & (100 * col("b_most") >= percent * col("a_least"))
    bits_fit = may_reach(common_bits(col("a_bits"), col("b_bits")), col("a_slack"), col("b_slack"), col("a_least"), col("b_least"), percent)
    behind_fits = (100 + percent) * F.least("a_behind", "b_behind") >= percent * (col("a_least") + col("b_least"))
    several = one.join(two, root).filter((col("a_leaf") <= col("b_leaf")) & ~one_group & sizes_fit & behind_fits & bits_fit)
    return several.select(*root, "a_leaf", "b_leaf").unionByName(single)


def _side(df: DataFrame, root: list[str], name: str) -> DataFrame:
    return df.select(*root, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in root])


def tree_pairs(postings: DataFrame, groups: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes from different groups that the signature trees cannot rule out.

    Root: a shingle. Below it: size ranges. Below that: leaves, those of a
    large group apart: its classes are much alike, so that sixteen have little
    more shingles than one, while unlike ones are held in twos. A node has the OR
    of its bitmaps, its size range, its largest slack, what can be common behind
    the shingle at most, and its group if it is a single one. Pairs of
    leaves, then of classes are followed down as long as both are not of one
    group, their sizes fit and their possible overlap is enough. Of classes the
    place of the shared shingle counts first: what can still be common behind it.
    """
    root = ["shingle", "range"]
    members = written(_ranges(postings, groups, percent), "members")
    in_group = members.groupBy(*root, "group").agg(F.count(F.lit(1)).alias("of_group"))
    in_range = in_group.groupBy(*root).agg(F.sum("of_group").alias("of_range"))
    # A group that fills leaves of its own is parted by class, the others share leaves by group.
    leaf = F.when(
        F.col("of_group") >= LEAF,
        F.concat_ws(":", F.col("group").cast("string"), F.pmod(F.xxhash64("class"), F.ceil(F.col("of_group") / LEAF))),
    ).otherwise(F.pmod(F.xxhash64("group"), F.ceil(F.col("of_range") / MIXED_LEAF)).cast("string"))
    leaf = F.when(F.col("of_range") <= LEAF, "0").otherwise(leaf)
    placed = written(
        members.join(in_group, [*root, "group"])
        .join(in_range, root)
        .select(*root, "band", leaf.alias("leaf"), "group", "class", "n", "place", "of_range"),
        "leaves",
    )
    col = F.col
    # Two classes meet in the range of the larger one; those of one leaf are a pair once.
    meets = (col("a_band") == col("range")) | (col("b_band") == col("range"))
    once = (col("a_leaf") != col("b_leaf")) | (col("a_class") < col("b_class"))
    behind = F.least(col("a_n") - col("a_place"), col("b_n") - col("b_place"))
    enough = (100 + percent) * behind >= percent * (col("a_n") + col("b_n"))
    narrow = placed.drop("of_range")
    found = (
        written(_leaf_pairs(placed, bitmaps, percent), "leaf-pairs")
        .join(_side(narrow, root, "a"), [*root, "a_leaf"])
        .join(_side(narrow, root, "b"), [*root, "b_leaf"])
        .filter((col("a_group") != col("b_group")) & once & meets & similar_sizes(col("a_n"), col("b_n"), percent) & enough)
        .select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))
    )
    return _with_bitmaps(found.distinct(), bitmaps, percent)


def group_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, text_md5, n, component) per document; NULL without words."""
    prepared(docs.sparkSession)
    rows = written(
        features(docs, id_col, text_col, width, percent).withColumn("row", F.monotonically_increasing_id()), "features"
    )
    sets = rows.filter("n > 0")
    # One document stands for all that have its set; from here on a class is a number.
    least = F.min(F.struct("id", "text_md5", "row")).alias("_one")
    members = written(
        sets.groupBy("set").agg(least).select("set", "_one.*").withColumn("class", F.monotonically_increasing_id()), "classes"
    )
    slack = F.col("n") - F.aggregate("bitmap", F.lit(0), lambda s, x: s + F.bit_count(x))
    shown = written(
        sets.select("row", "n", "prefix", "bitmap").join(members.select("row", "class"), "row").select(
            "class", "n", "prefix", "bitmap", slack.alias("slack")
        ),
        "prefixes",
    )
    classes, members = members.select("set", "class"), members.select("class", "id", "text_md5")
    bitmaps = shown.select("class", "n", "bitmap", "slack")
    postings = shown.select(F.posexplode("prefix").alias("place", "shingle"), "class", "n")
    shared = written(
        postings.groupBy("shingle")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("shingle"),
        "shared",
    )
    held = written(postings.join(shared, "shingle").select("shingle", "class", "n", "place"), "postings")
    links = written(linked(written(first_pairs(held, bitmaps, percent), "pairs"), docs, id_col, text_col, members, width, percent), "found")
    groups = components(links)
    more = written(tree_pairs(held, groups, bitmaps, percent), "pairs")
    if not more.isEmpty():
        found = written(linked(more, docs, id_col, text_col, members, width, percent), "found")
        groups = components(links.unionByName(found))
    named = rows.select("id", "text_md5", "n", "set").join(written(classes.join(groups, "class", "left"), "named"), "set", "left")
    return named.select("id", "text_md5", "n", F.coalesce("component", "class").alias("component"))


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Documents link when 100 * common >= percent * all distinct shingles of
    both; component_id is the smallest id reachable. NULL, empty and wordless
    texts have no shingles, link with nothing and are their own component.
    Equal texts link whatever their ids; a NULL id is never the smallest unless
    all of a component are NULL. Repeated rows each give a row; other columns
    are not read; an empty table gives no rows.
    """
    rows = written(group_rows(docs, id_col, text_col, width, percent), "groups")
    smallest = rows.filter("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(written(smallest, "components"), "component", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all their columns, that stay when each component keeps its row with the smallest id.

    Rows without words (NULL and empty texts too) all stay. Of repeated rows of
    the smallest id one stays; of different texts under one id the one with the
    smaller md5. A NULL id is kept only where all of a component are NULL.
    Columns of any name pass through; an empty table gives no rows.
    """
    rows = written(group_rows(docs, id_col, text_col, width, percent), "groups")
    kept_id, kept_text = free_names(docs, "_kept_id", "_kept_text")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_md5")
    kept = rows.filter("n > 0").groupBy("component").agg(F.min(order).alias("_keep"))
    names = written(kept.select(F.col("_keep.id").alias(kept_id), F.col("_keep.text_md5").alias(kept_text)), "kept")
    text = F.coalesce(text_col, F.lit(""))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    same = F.equal_null(F.col(id_col), F.col(kept_id)) & (F.md5(text) == F.col(kept_text))
    stay = docs.filter(~wordless).join(names, same, "left_semi")
    repeated = written(
        rows.filter("n > 0").groupBy("id", "text_md5").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(
            F.col("id").alias(kept_id), F.col("text_md5").alias(kept_text)
        ),
        "repeated",
    )
    if not repeated.isEmpty():
        once = stay.join(repeated, same, "left_anti")
        stay = once.unionByName(stay.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
    return stay.unionByName(docs.filter(wordless))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
       FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
"""
