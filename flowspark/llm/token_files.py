"""Token ids in binary files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints."""

from __future__ import annotations

import io
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import (
    arrow_schema,
    batch_of,
    file_system,
    new_folder,
    prepared,
    range_sorted,
    sizes_before,
    table,
    text_chunks,
    written,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 1
# Tokens of a row of whole documents, of a block, between two checkpoints.
ROW_TOKENS, BLOCK_TOKENS, STEP = 1 << 16, 1 << 16, 64
FILE_BYTES = 64 << 20
LONGEST_CODE = 18
MAGIC = b"FLOWTOK1"
# Bytes of text that are encoded at a time.
CHUNK_BYTES = 8 << 20
# What a worker process remembers of words, at most, between two chunks.
REMEMBERED_BYTES = 64 << 20

# Fixed by the vocabulary file: how it parts words of printable ASCII and Latin-1 letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall
# Words of which they leave out nothing, and which have as many small letters as letters.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Texts (UTF-8) to their ids, as arrays of little-endian numbers.

    White space never lies inside a token of the vocabulary, so a text's ids
    are those of its words in a row, and a word that comes often in a chunk of
    texts is looked at once. Plain Latin words go to the model piece by piece,
    all others through the whole tokenizer. Pieces and words of any length are
    encoded; `keys` and `ids` (of key i those up to `ends[i]`) remember them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        state = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (state["normalizer"] or {}).get("normalizers", [])]
        # The piecewise way holds for this chain of steps only.
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and state["model"].get("end_of_word_suffix") == "</w>"
        self._forget()

    def _forget(self) -> None:
        self.keys, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    @staticmethod
    def of_process(path: str) -> WordIds:
        """One per worker process and vocabulary, kept from task to task.

        This module reaches workers by value, anew with each task, so the place
        to keep it is a module that the process has imported itself.
        """
        kept = vars(sys).setdefault("_flowspark_word_ids", {})
        if path not in kept:
            kept[path] = WordIds(path)
        return kept[path]

    def _piece(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.tokenizer.model.tokenize(mapped)]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _places(self, keys: pa.Array, find: Callable[[str], list[int]]) -> np.ndarray:
        """Where each of the distinct keys is remembered, new ones after `find`."""
        places = pc.index_in(keys, value_set=self.keys)
        unknown = places.is_null()
        new = keys.filter(unknown)
        found = [find(key) for key in new.to_pylist()]
        places = places.fill_null(0).to_numpy().astype(np.int64)
        if found:
            places[np.asarray(unknown)] = len(self.keys) + np.arange(len(found))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.dtype, sizes.sum())])
            self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(sizes)])
            self.keys = pa.concat_arrays([self.keys, new])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many are of each text; none of a NULL."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            each = [np.array(self._whole(text), self.dtype) for text in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(ids) for ids in each], np.int64)
        if self.keys.nbytes + self.ids.nbytes + self.ends.nbytes > REMEMBERED_BYTES:
            self._forget()
        words = pc.ascii_split_whitespace(texts)
        until = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        # Of each distinct word the places of its keys: its pieces, or itself.
        plain = pc.and_not(pc.match_substring_regex(coded.dictionary, _PLAIN), pc.match_substring(coded.dictionary, "<|"))
        pieces = [_PIECES(word) for word in pc.utf8_lower(coded.dictionary.filter(plain)).to_pylist()]
        parts = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
        others = self._places(coded.dictionary.filter(pc.invert(plain)), self._whole)
        places = self._places(parts.dictionary, self._piece)[parts.indices.to_numpy()]
        plain = np.asarray(plain)
        counts = np.ones(len(plain), np.int64)
        counts[plain] = np.fromiter(map(len, pieces), np.int64, len(pieces))
        of_words = np.empty(len(places) + len(others), np.int64)
        is_piece = np.repeat(plain, counts)
        of_words[is_piece], of_words[~is_piece] = places, others
        # Words in a row, their keys in a row, the keys' ids in a row.
        keys, key_ends = _rows_of(of_words, np.cumsum(counts), coded.indices.to_numpy())
        ids, id_ends = _rows_of(self.ids, self.ends, keys)
        stops = np.r_[0, id_ends][np.r_[0, key_ends][until]]
        return ids, np.diff(stops, prepend=0)


def _rows_of(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows in a row, and where each ends; row i has the values up to ends[i]."""
    begins = np.r_[0, ends[:-1]]
    sizes = (ends - begins)[rows] if len(rows) else np.zeros(0, np.int64)
    stops = np.cumsum(sizes)
    if not len(stops):
        return values[:0], stops
    return values[np.repeat(begins[rows] - stops + sizes, sizes) + np.arange(stops[-1])], stops


# --- the code ---------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    merged, leaf_flags = weights, []
    for _ in range(longest):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1) if leaf_flags else np.zeros(0)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        leaf_flags.append(order < len(weights))
        merged = both[order]
    take, result = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        result[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = result
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each possible next bits, the id and length of the code they begin with: id * 32 + length."""
    wide = int(lengths.max()) if len(lengths) else 0
    found = np.zeros(1 << wide, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.uint64(1) << (np.uint64(wide) - lengths[order].astype(np.uint64))
    entries = np.repeat(order.astype(np.uint32) * np.uint32(32) + lengths[order], spans.astype(np.int64))
    found[: len(entries)] = entries
    return found, wide


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The block's bits, padded to 4 bytes, and the bit offset of every STEP-th id."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n_words = (int(ends[-1]) + 31) // 32 if len(ids) else 0
    word, inside = begins >> 5, begins & 31
    shifted = codes[ids] << (64 - inside - sizes).astype(np.uint64)
    out = np.zeros(n_words + 1, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.add.reduceat(shifted, first)
        out[word[first]] += sums >> np.uint64(32)
        out[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)
    return out[:n_words].astype(">u4").tobytes(), begins[::STEP].astype("<u4")


def decode_block(data: bytes, count: int, checkpoints: np.ndarray, lookup: np.ndarray, wide: int) -> np.ndarray:
    """All stretches between checkpoints at once, one id of each per step."""
    if not count:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(data + bytes(8), ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = checkpoints.astype(np.int64)
    out = np.empty((STEP, len(at)), np.uint32)
    mask, last = np.uint64((1 << wide) - 1), len(pairs) - 1
    for step in range(STEP):
        bits = (pairs[np.minimum(at >> 5, last)] >> (64 - wide - (at & 31)).astype(np.uint64)) & mask
        entry = lookup[bits]
        out[step] = entry >> np.uint32(5)
        at += entry & np.uint32(31)
    return out.T.ravel()[:count]


# --- files ------------------------------------------------------------------


def _packed(table_: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table_.schema) as stream:
        stream.write_table(table_)
    return sink.getvalue()


class FileWriter:
    """One file: magic, code lengths, blocks, an index of documents and blocks, its place, magic."""

    def __init__(self, place: str, lengths: np.ndarray, id_type: pa.DataType):
        self.place, self.lengths, self.codes, self.id_type = place, lengths, canonical(lengths), id_type
        fs, path = file_system(place)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        table_bytes = zlib.compress(lengths.tobytes())
        self.written = 0
        self._put(MAGIC + len(table_bytes).to_bytes(8, "little") + table_bytes)
        self.docs: list = []
        self.sizes: list[int] = []
        self.blocks: list[tuple[int, int, int, bytes]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, docs: list, sizes: list[int], ids: np.ndarray) -> None:
        self.docs += docs
        self.sizes += sizes
        for start in range(0, len(ids), BLOCK_TOKENS):
            part = ids[start : start + BLOCK_TOKENS]
            data, checkpoints = encode_block(part, self.lengths, self.codes)
            self.blocks.append((self.written, len(data), len(part), zlib.compress(np.diff(checkpoints, prepend=0).astype("<u4").tobytes())))
            self._put(data)

    def close(self) -> tuple[str, int, int, int]:
        docs = pa.table({"doc": pa.array(self.docs, self.id_type), "size": pa.array(self.sizes, pa.int64())})
        names = ("at", "bytes", "tokens", "checkpoints")
        blocks = pa.table({n: list(c) for n, c in zip(names, zip(*self.blocks))} if self.blocks else {n: pa.array([], pa.int64()) for n in names})
        first, second = _packed(docs), _packed(blocks)
        place = self.written
        self._put(first + second + place.to_bytes(8, "little") + len(first).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.place, len(self.docs), int(sum(self.sizes)), self.written


def read_file(place: str) -> Iterator[tuple[object, np.ndarray]]:
    """(document, its ids) in file order; one block is in memory at a time."""
    fs, path = file_system(place)
    with fs.open_input_file(path) as source:
        size = source.size()
        tail = source.read_at(24, size - 24)
        if source.read_at(8, 0) != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{place} is no whole token file")
        index, first = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        table_size = int.from_bytes(source.read_at(8, 8), "little")
        lengths = np.frombuffer(zlib.decompress(source.read_at(table_size, 16)), np.uint8)
        lookup, wide = decode_table(lengths)
        docs = pa.ipc.open_stream(source.read_at(first, index)).read_all()
        blocks = pa.ipc.open_stream(source.read_at(size - 24 - index - first, index + first)).read_all()
        left: list[np.ndarray] = []
        have = 0
        feed = iter(blocks.to_pylist())
        for doc, wanted in zip(docs["doc"].to_pylist(), docs["size"].to_pylist()):
            while have < wanted:
                block = next(feed)
                checkpoints = np.cumsum(np.frombuffer(zlib.decompress(block["checkpoints"]), "<u4"))
                left.append(decode_block(source.read_at(block["bytes"], block["at"]), block["tokens"], checkpoints, lookup, wide))
                have += block["tokens"]
            whole = left[0] if len(left) == 1 else np.concatenate(left) if left else np.zeros(0, np.uint32)
            yield doc, whole[:wanted]
            left, have = [whole[wanted:]], len(whole) - wanted


# --- jobs -------------------------------------------------------------------


def token_rows(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int = END_ID) -> DataFrame:
    """Rows of whole documents in ascending id order: part, seq, docs, sizes, ids (little-endian numbers)."""
    id_type = dict(docs.dtypes)[id_col]
    # Equal ids are put in order by their texts, so that reruns agree.
    ordered = range_sorted(docs.select(id_col, text_col), [id_col, F.md5(text_col)])
    schema = f"part int, seq bigint, docs array<{id_type}>, sizes array<bigint>, ids binary, tokens bigint"
    fields = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of_process(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        part, seq, keys, sizes, parts, total = None, 0, [], [], [], 0
        for chunk in text_chunks(batches, 1, CHUNK_BYTES):
            ids, counts = words.encode(chunk.column(1))
            stops = np.cumsum(counts).tolist()
            for key, part, size, stop in zip(chunk.column(0).to_pylist(), chunk.column(2).to_pylist(), counts.tolist(), stops):
                keys.append(key)
                sizes.append(size + 1)
                parts.append(ids[stop - size : stop].tobytes() + end)
                total += size + 1
                if total >= ROW_TOKENS:
                    yield batch_of([(part, seq, keys, sizes, b"".join(parts), total)], fields)
                    seq, keys, sizes, parts, total = seq + 1, [], [], [], 0
        if keys:
            yield batch_of([(part, seq, keys, sizes, b"".join(parts), total)], fields)

    return ordered.select(id_col, text_col, "_part").mapInArrow(run, schema)


def id_counts(rows: DataFrame, vocabulary: int, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs; as many numbers as the vocabulary has ids."""
    fields = arrow_schema(rows, "id bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield batch_of(list(zip(used.tolist(), total[used].tolist())), fields)

    counts = np.zeros(vocabulary, np.int64)
    summed = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write all documents' ids to token files and return the manifest: file, docs, tokens, bytes, start.

    `start` counts the ids of all files before. Files hold whole documents in
    ascending id order (NULL ids first, equal ids by text) and are named only in
    the manifest, which is written by a Spark job after them: files of lost or
    repeated tasks are in no manifest. NULL or empty text: the end id alone. An
    empty table gives no file.
    """
    spark = prepared(docs.sparkSession)
    ids_of = WordIds.of_process(tokenizer)
    vocabulary, dtype = max(ids_of.tokenizer.get_vocab_size(), end_id + 1), ids_of.dtype
    rows = written(token_rows(docs, tokenizer, id_col, text_col, end_id), "ids")
    lengths = spark.sparkContext.broadcast(code_lengths(id_counts(rows, vocabulary, dtype)))
    folder = new_folder(spark, "tokens")
    id_field = arrow_schema(docs, f"`{id_col}` {dict(docs.dtypes)[id_col]}").field(0).type
    schema = "file string, part int, seq bigint, docs bigint, tokens bigint, bytes bigint"
    fields = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, last = None, None, None
        for batch in batches:
            for part, seq, keys, sizes, ids in zip(*(c.to_pylist() for c in batch.columns)):
                # A task may read several stretches of the ordered rows: each is a file of its own.
                if writer and (last != (part, seq - 1) or writer.written >= file_bytes):
                    yield batch_of([_listed(writer, first)], fields)
                    writer = None
                if not writer:
                    first = (part, seq)
                    name = f"{part:06d}-{seq:09d}-{uuid.uuid4().hex}.tok"
                    writer = FileWriter(f"{folder}/{name}", lengths.value, id_field)
                writer.add(keys, sizes, np.frombuffer(ids, dtype))
                last = (part, seq)
        if writer:
            yield batch_of([_listed(writer, first)], fields)

    def _listed(writer, first):
        place, n_docs, tokens, size = writer.close()
        return place, *first, n_docs, tokens, size

    files = written(rows.select("part", "seq", "docs", "sizes", "ids").mapInArrow(run, schema), "manifest")
    # Files come in the order of (part, seq); both are narrow, a row per file.
    key = F.col("part") * F.lit(1 << 32) + F.col("seq")
    keyed = files.withColumn("_key", key)
    return keyed.join(sizes_before(keyed, "_key", "tokens", "start"), "_key").drop("_key", "part", "seq")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files.

    Repeated and NULL ids come as they were written, a NULL or empty text as its
    end id alone; a file that is not whole raises a ValueError; an empty
    manifest gives no rows.
    """
    schema = f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    fields = arrow_schema(manifest, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, at in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for doc, ids in read_file(place):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield batch_of(rows, fields)
                        rows = []
                yield batch_of(rows, fields)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(spread, "file").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, default_tokenizer()))
