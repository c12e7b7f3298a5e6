"""WARC archives: range-sorted records, files rolled by compressed size, fresh headers and digests, committed by manifest."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import os
import sys
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.llm.common import (
    arrow_schema,
    batch_of,
    file_system,
    new_folder,
    prepared,
    range_sorted,
    sizes_before,
    table,
    written,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_BYTES = 16 << 20
KEY = ("page_id", "url", "_sha1")
# A range holds so much html at least; so many ranges are named to all tasks at most.
RANGE_BYTES, MOST_RANGES = 1 << 20, 10_000
MIN_PAYLOAD = 0
# Pages carry no fetch time, and reruns must agree.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6f2c4a1e-3f0b-5b52-9d0c-2f1f7a1f9b11")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id, url: str | None, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, repr((page_id, url, digest, repeat)))}>"


def _line_safe(value: str) -> str:
    """One header line: white space and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str | None, payload: bytes, repeat: int, revisited: tuple | None) -> bytes:
    """One gzip member: a response, or a revisit of (page_id, url) without its payload."""
    digest = base32(hashlib.sha1(payload).digest())
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisited else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisited else "response"),
        ("WARC-Record-ID", record_id(page_id, url, digest, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line_safe(url) if url else None),
        ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", None if page_id is None else str(page_id)),
    ]
    if revisited:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(*revisited, digest, 0)),
            ("WARC-Refers-To-Target-URI", _line_safe(revisited[1]) if revisited[1] else None),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-ID", None if revisited[0] is None else str(revisited[0])),
        ]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def records_in(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; `source` reads like a binary file. One member is in memory at a time."""
    data = b""
    while True:
        inflate, plain = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                data = source.read(1 << 20)
                if not data:
                    if plain and any(plain):
                        raise ValueError("the archive ends inside a record")
                    return
            plain.append(inflate.decompress(data))
            data = inflate.unused_data
        whole = b"".join(plain)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record: {lines[0]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def responses(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_payload: int) -> DataFrame:
    """(_sha1, _first): for payloads of several rows, the row that all others revisit.

    Only narrow rows are shuffled, and summed up before: a payload may be that
    of a third of all pages.
    """
    payload = F.coalesce(html_col, F.lit(""))
    row = F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return (
        pages.filter(F.octet_length(payload) >= min_payload)
        .groupBy(F.sha1(payload).alias("_sha1"))
        .agg(F.max(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )


def sort_key(page_id: str | None, url: str | None, sha1: str, numeric: bool) -> tuple:
    """Orders as Spark does: NULL first, ids by value if their column is `numeric`, text by code point."""
    held = Decimal(page_id or 0) if numeric else page_id or ""
    return page_id is not None, held, url is not None, url or "", sha1


def range_begins(keys: DataFrame, range_bytes: int, numeric: bool) -> list[tuple]:
    """The first key of each range but the first, from (page_id, url, _sha1, size); at most MOST_RANGES of them."""
    parts = written(range_sorted(keys, KEY), "keys")
    before = sizes_before(parts, "_part", "size", "_before")
    inside = F.sum("size").over(Window.partitionBy("_part").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1))
    # One row per range of the sort, so at most as many as there are shuffle partitions.
    placed = parts.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.coalesce(inside, F.lit(0)))
    whole = placed.agg(F.sum("size")).first()[0] or 0
    width = max(range_bytes, -(-whole // MOST_RANGES))
    named = [F.col("page_id").cast("string").alias("id"), "url", "_sha1"]
    firsts = placed.groupBy(F.floor(F.col("_at") / width).alias("range")).agg(F.min_by(F.struct(*named), F.col("_at")).alias("key"))
    return sorted(sort_key(*r["key"], numeric) for r in firsts.filter("range > 0").collect())


class ArchiveFile:
    """A file under a temporary name, and what a table says of it."""

    def __init__(self, folder: str, name: str):
        self.file = f"{folder}/{name}.warc.gz"
        self.temporary = f"{folder}/.{name}-{uuid.uuid4().hex}.tmp"
        fs, path = file_system(self.temporary)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.records = self.bytes = 0
        self.sizes: list[int] = []
        self.digest = hashlib.sha256()

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.records += 1
        self.bytes += len(member)
        self.sizes.append(len(member))

    def copy(self, source: str, begin: int, size: int, records: int) -> None:
        fs, path = file_system(source)
        with fs.open_input_file(path) as data:
            data.seek(begin)
            left = size
            while left:
                part = data.read(min(left, 1 << 20))
                if not part:
                    raise ValueError(f"{source} ends too early")
                self.out.write(part)
                self.digest.update(part)
                left -= len(part)
        self.records += records
        self.bytes += size


def write_warc(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = FILE_BYTES,
    min_payload: int = MIN_PAYLOAD,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Write every row as a record and return the manifest: file, records, bytes, sha256.

    Records are sorted by id, url and payload and cut into ranges of about
    `range_bytes` of html, more where they would be too many. Ranges are
    compressed apart, into segments; their compressed sizes, summed up exactly,
    then roll the files: a record is of the file in whose `file_bytes` of the
    whole archive it begins, so files span ranges and all but the last have
    `file_bytes`, give or take a record. `range` and `number` name a file's
    first segment. Files, names and bytes do not depend on partitions or
    reruns. Segments are deleted once the files are there. Each file is written
    under a temporary name; the manifest row of the attempt that Spark kept
    names it, and a second job renames it; readers go by the manifest.

    Rows with equal payloads of at least `min_payload` bytes: that with the
    largest (id, url), NULL smallest, is the response, also the first of fully
    equal rows; the others revisit it. NULL html is an empty payload, NULL ids
    and urls are left out of the headers. An empty table gives no file.
    """
    spark = prepared(pages.sparkSession)
    first = written(responses(pages, id_col, url_col, html_col, min_payload), "responses")
    payload = F.coalesce(html_col, F.lit(""))
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha1(payload).alias("_sha1"), payload.alias("html"))
    numeric = dict(named.dtypes)["page_id"] != "string"
    begins = spark.sparkContext.broadcast(range_begins(named.select(*KEY, F.octet_length("html").alias("size")), range_bytes, numeric))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, urls: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(begins.value, sort_key(*key, numeric)) for key in zip(ids, urls, digests)], dtype="int32")

    # A whole number would become a float, and so lose digits, where ids are missing.
    ranges = range_of(F.col("page_id").cast("string"), "url", "_sha1").alias("range")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = named.join(first, "_sha1", "left").select(*KEY, "html", "_first", ranges)
    ordered = placed.repartition(spread, "range").sortWithinPartitions("range", *KEY)
    folder = new_folder(spark, "warc")
    segment = "range int, number int, temporary string, bytes bigint, sizes array<bigint>"
    segment_fields = arrow_schema(pages, segment)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, before, repeat, place = None, None, 0, (None, 0)
        done = lambda: (out.out.close(), batch_of([(*place, out.temporary, out.bytes, out.sizes)], segment_fields))[1]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            htmls = pc.cast(batch.column(3), pa.binary()).to_pylist()
            for page_id, url, sha1, html, chosen, part in zip(*columns, htmls, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                # Fully equal rows follow each other.
                repeat = repeat + 1 if (page_id, url, sha1) == before else 0
                before = (page_id, url, sha1)
                revisited = None
                if chosen and ((chosen["page_id"], chosen["url"]) != (page_id, url) or repeat):
                    revisited = (chosen["page_id"], chosen["url"])
                if out and (part != place[0] or out.bytes >= file_bytes):
                    yield done()
                    out = None
                if not out:
                    place = (part, place[1] + 1 if part == place[0] else 0)
                    out = ArchiveFile(f"{folder}/segments", f"{part:06d}-{place[1]:05d}")
                out.add(record(page_id, url, html, repeat, revisited))
        if out:
            yield done()

    segments = written(ordered.mapInArrow(write, segment), "segments")
    # Both sides have a row per segment, and Spark picks the join.
    sums = segments.withColumn("_at", F.struct("range", "number"))
    starts = sums.join(sizes_before(sums, "_at", "bytes", "_before"), "_at").select("range", "number", "temporary", "_before", "sizes")
    piece = "file bigint, range int, number int, temporary string, begin bigint, bytes bigint, records bigint"
    piece_fields = arrow_schema(pages, piece)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for range_, number, temporary, before, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for file, members in itertools.groupby(zip(itertools.accumulate(sizes, initial=before), sizes), lambda m: m[0] // file_bytes):
                    members = [size for _, size in members]
                    rows.append((file, range_, number, temporary, at, sum(members), len(members)))
                    at += sum(members)
            yield batch_of(rows, piece_fields)

    listed = "range int, number int, temporary string, file string, records bigint, bytes bigint, sha256 string"
    list_fields = arrow_schema(pages, listed)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, current = None, None, None
        done = lambda: (out.out.close(), batch_of([(*place, out.temporary, out.file, out.records, out.bytes, out.digest.hexdigest())], list_fields))[1]
        for batch in batches:
            for file, range_, number, source, begin, size, records in zip(*(c.to_pylist() for c in batch.columns)):
                if out and file != current:
                    yield done()
                    out = None
                if not out:
                    current, place = file, (range_, number)
                    out = ArchiveFile(folder, f"pages-{file:09d}")
                out.copy(source, begin, size, records)
        if out:
            yield done()

    pieces = starts.mapInArrow(cut, piece).repartition(spread, "file").sortWithinPartitions("file", "range", "number", "begin")
    files = written(pieces.mapInArrow(join, listed), "attempts")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, temporary = file_system(row["temporary"])
                final = file_system(row["file"])[1]
                if fs.get_file_info(temporary).type.name != "NotFound":
                    fs.move(temporary, final)
                if fs.get_file_info(final).size != row["bytes"]:
                    raise ValueError(f"{final} is not the file of its manifest row")
            yield batch.select(["range", "number", "file", "records", "bytes", "sha256"])

    kept = "range int, number int, file string, records bigint, bytes bigint, sha256 string"
    archive = written(files.repartition(spread, "file").mapInArrow(commit, kept), "archive")
    fs, path = file_system(f"{folder}/segments")
    if fs.get_file_info(path).type.name != "NotFound":
        fs.delete_dir(path)
    return archive


def read_warc(manifest: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """The records of all files of the manifest; the digest of each response is computed again from its block.

    A missing id or url is NULL, an empty payload has 0 bytes, a revisit has the
    digest and size of what it revisits; a damaged record raises a ValueError;
    an empty manifest gives no rows.
    """
    schema = (
        f"page_id {id_type}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}"
        + ", payload binary" * with_payload
    )
    fields = arrow_schema(manifest, schema)
    number = (lambda v: None if v is None else int(v)) if id_type in ("bigint", "int") else (lambda v: v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                fs, path = file_system(place)
                rows = []
                with fs.open_input_stream(path, compression=None) as source:
                    for head, block in records_in(source):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (
                            len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest
                        ):
                            raise ValueError(f"{place}: {head['WARC-Record-ID']} is damaged")
                        values = (
                            number(head.get("X-Page-ID")),
                            head.get("WARC-Target-URI"),
                            size,
                            digest,
                            head["WARC-Type"],
                            number(head.get("X-Refers-To-Page-ID")),
                        )
                        rows.append((*values, payload) if with_payload else values)
                        if len(rows) == (100 if with_payload else 5_000):
                            yield batch_of(rows, fields)
                            rows = []
                yield batch_of(rows, fields)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(spread, "file").mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write_warc(pages, min_payload=0)
    return read_warc(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT s, max(page_id) AS first, count(*) AS n FROM p GROUP BY s),
b AS (SELECT DISTINCT s, concat(list_aggregate(list_transform(generate_series(1, 40), lambda i:
        lpad(bin(CAST('0x' || s[i] AS BIGINT)), 4, '0')), 'string_agg', '')) AS bits FROM p),
e AS (SELECT s, list_aggregate(list_transform(generate_series(0, 31), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST(list_sum(list_transform(generate_series(1, 5), lambda j: CAST(bits[5 * i + j] AS INT) * (1 << (5 - j)))) AS INT), 1)),
        'string_agg', '') AS digest FROM b)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN g USING (s) JOIN e USING (s)
"""
