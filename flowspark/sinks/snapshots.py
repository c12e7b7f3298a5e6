"""A table of snapshots: bucket files, a manifest per version, one atomic rename per commit.

    path/data/<run>/bucket=<b>/*.parquet   files of a bucket, never changed
    path/versions/00000007                 version 7: the files of every bucket

A writer merges only the buckets that its rows fall into, writes their new files
and then renames a finished manifest to the next version's name. Readers take
the newest manifest, so they see a version whole or not at all. Of two writers
that began with the same version one gets the name, the other fails and changes
nothing. The manifest has an entry per file, not per row, and may hold a Bloom
filter per bucket over one column, so that a search opens few files.
"""

from __future__ import annotations

import base64
import json
import os
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.scale import top_per_group
from flowspark.session import cut_lineage
from flowspark.sinks.commits import Commits, Taken

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
# Bits of a bucket's filter, and how many of them a value sets.
FILTER_BITS, FILTER_HASHES = 1 << 16, 4
# Bits of one row of Spark's bitmap aggregates.
_BITMAP_BITS = 32768


class Conflict(RuntimeError):
    """Another writer has committed the version that this one meant to."""


class SnapshotTable:
    """Rows with a unique `key`, in `buckets` by its hash.

    `indexed` gives an array of texts per row; with it every bucket has a filter
    over them. Both, and the number of buckets, are fixed by the first commit.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: Sequence[str] = ("collection", "doc_id"),
        buckets: int = BUCKETS,
        indexed: Callable[[], Column] | None = None,
        filter_bits: int = FILTER_BITS,
    ):
        if filter_bits % _BITMAP_BITS:
            raise ValueError(f"filter_bits must be a multiple of {_BITMAP_BITS}")
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.buckets, self.indexed, self.filter_bits = buckets, indexed, filter_bits
        self._versions = Commits(spark, f"{self.path}/versions")
        self._data = Commits(spark, f"{self.path}/data")

    # --- versions -------------------------------------------------------------

    def versions(self) -> list[int]:
        """Committed versions, the newest last."""
        return sorted(map(int, self._versions.names()))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of `version`; an empty one before the first commit."""
        versions = self.versions()
        if not versions:
            return {"version": 0, "key": self.key, "buckets": self.buckets, "schema": None, "files": {}, "filters": {}, "marks": {}}
        return json.loads(self._versions.read(f"{versions[-1] if version is None else version:08d}"))

    def _commit(self, manifest: dict) -> None:
        try:
            self._versions.publish(f"{manifest['version']:08d}", json.dumps(manifest))
        except Taken as error:
            raise Conflict(f"{self.path}: version {manifest['version']} belongs to another writer") from error

    # --- reading --------------------------------------------------------------

    def read(self, version: int | None = None, values: DataFrame | None = None) -> DataFrame:
        """The rows of the newest or the given version.

        With `values` (one text column) only the files of buckets that may hold
        one of them are opened: all rows with such a value and some others.
        """
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no committed version")
        buckets = manifest["files"] if values is None else [str(b) for b in self.buckets_of(values, manifest)]
        return self._rows(manifest, buckets)

    def files(self, manifest: dict, buckets) -> list[str]:
        return [f"{self.path}/data/{name}" for b in buckets for name in manifest["files"].get(b, [])]

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        files = self.files(manifest, buckets)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def buckets_of(self, values: DataFrame, manifest: dict) -> list[int]:
        """Buckets that may hold one of the values; all of a table without filters."""
        if not manifest["filters"]:
            return sorted(map(int, manifest["files"]))
        numbers = sorted(map(int, manifest["filters"]))
        # A fixed number of bits for each bucket.
        bits = np.stack([np.unpackbits(np.frombuffer(base64.b64decode(manifest["filters"][str(b)]), np.uint8), bitorder="little") for b in numbers])
        held = self.spark.sparkContext.broadcast(bits.astype(bool))

        def may_hold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filters, found = held.value, np.zeros(len(numbers), bool)
            for frame in frames:
                if len(frame) and not found.all():
                    places = np.stack([frame[f"p{k}"].to_numpy(np.int64) for k in range(FILTER_HASHES)])
                    for at in range(0, places.shape[1], 4096):
                        found |= filters[:, places[:, at : at + 4096]].all(axis=1).any(axis=1)
            yield pd.DataFrame({"bucket": np.asarray(numbers)[found]})

        value = F.col(values.columns[0])
        places = [_filter_place(value, k, 8 * len(base64.b64decode(manifest["filters"][str(numbers[0])]))).alias(f"p{k}") for k in range(FILTER_HASHES)]
        asked = values.filter(value.isNotNull()).select(*places)
        return sorted(row["bucket"] for row in asked.mapInPandas(may_hold, "bucket bigint").distinct().collect())

    # --- writing --------------------------------------------------------------

    def upsert(self, rows: DataFrame, order: str | Sequence[str], mark: tuple[str, int] | None = None) -> int:
        """Put `rows` in place of those with the same key and commit; returns the version.

        Of several new rows with one key the last by `order` (columns of `rows`,
        not stored) stays. A key with a NULL is a key like any other. `mark` is
        a name and a number, such as a stream and its batch: rows that come with
        a number already reached are a repeat and change nothing.
        """
        manifest = self.manifest()
        if mark and manifest["marks"].get(mark[0], -1) >= mark[1]:
            return manifest["version"]
        order = [order] if isinstance(order, str) else list(order)
        stored = [c for c in rows.columns if c not in order]
        bucket = F.pmod(F.xxhash64(*manifest["key"]), F.lit(manifest["buckets"])).cast("int").alias("bucket")
        newest = top_per_group(rows, manifest["key"], [F.desc(c) for c in order], 1).select(*stored, bucket)
        newest = cut_lineage(newest, "snapshot-rows")
        touched = sorted(row["bucket"] for row in newest.select("bucket").distinct().collect())
        schema = newest.drop("bucket").schema
        merged = newest
        if manifest["schema"] is not None:
            held = T.StructType.fromJson(manifest["schema"])
            if [(f.name, f.dataType) for f in held] != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"{self.path} has the columns {held.simpleString()}, not {schema.simpleString()}")
            same = [F.equal_null(F.col(c), F.col(f"_new_{c}")) for c in manifest["key"]]
            keys = newest.select(*[F.col(c).alias(f"_new_{c}") for c in manifest["key"]])
            kept = self._rows(manifest, [str(b) for b in touched]).join(keys, same, "left_anti")
            merged = kept.select(*stored, bucket).unionByName(newest)
        return self._replace(manifest, merged, touched, schema, mark)

    def _replace(self, manifest: dict, rows: DataFrame, touched: list[int], schema: T.StructType, mark) -> int:
        run = f"{manifest['version'] + 1:08d}-{os.urandom(6).hex()}"
        if touched:
            parts = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
            rows.repartition(parts, "bucket").sortWithinPartitions("bucket", *manifest["key"]).write.partitionBy("bucket").parquet(f"{self.path}/data/{run}")
        after = dict(manifest, version=manifest["version"] + 1, schema=schema.jsonValue(), files=dict(manifest["files"]), filters=dict(manifest["filters"]))
        after["marks"] = {**manifest["marks"], **({mark[0]: mark[1]} if mark else {})}
        for b in touched:
            found = self._data.fs.listStatus(self._data.path(run, f"bucket={b}"))
            names = [status.getPath().getName() for status in found]
            after["files"][str(b)] = [f"{run}/bucket={b}/{name}" for name in names if name.endswith(".parquet")]
        if self.indexed is not None and touched:
            after["filters"].update(self._filters(self._rows(after, [str(b) for b in touched]), after, touched))
        self._commit(after)
        return after["version"]

    def _filters(self, rows: DataFrame, manifest: dict, touched: list[int]) -> dict[str, str]:
        """Filters of the touched buckets; `filter_bits` for each reach the driver."""
        bucket = F.pmod(F.xxhash64(*manifest["key"]), F.lit(manifest["buckets"])).cast("int").alias("bucket")
        values = rows.select(bucket, F.explode(self.indexed()).alias("value")).filter("value IS NOT NULL").distinct()
        places = F.explode(F.array(*[_filter_place(F.col("value"), k, self.filter_bits) for k in range(FILTER_HASHES)]))
        bits = values.select("bucket", places.alias("place")).groupBy("bucket", F.floor(F.col("place") / _BITMAP_BITS).alias("part"))
        packed = bits.agg(F.bitmap_construct_agg(F.col("place") % _BITMAP_BITS).alias("bits"))
        found = {b: bytearray(self.filter_bits // 8) for b in touched}
        for row in packed.toLocalIterator():
            at = row["part"] * (_BITMAP_BITS // 8)
            found[row["bucket"]][at : at + len(row["bits"])] = row["bits"]
        return {str(b): base64.b64encode(bytes(held)).decode() for b, held in found.items()}

    def clean(self, keep: int = 1) -> int:
        """Delete data that none of the newest `keep` versions names, and older manifests; returns the folders deleted.

        For a time without writers: a running one's files are not named yet.
        """
        versions = self.versions()[-keep:]
        named = {name.split("/")[0] for v in versions for names in self.manifest(v)["files"].values() for name in names}
        gone = 0
        if self._data.fs.exists(self._data.path()):
            for status in self._data.fs.listStatus(self._data.path()):
                if status.getPath().getName() not in named:
                    self._data.fs.delete(status.getPath(), True)
                    gone += 1
        for v in set(self.versions()) - set(versions):
            self._versions.delete(f"{v:08d}")
        return gone


def _filter_place(value: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), value), F.lit(bits))
