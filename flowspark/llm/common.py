"""What the operators share: sessions, written intermediates, batches of texts, row numbers."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.session import checkpoint_dir, configure, cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts run to 100,000 characters and more, so batches to Python hold few rows and, where these are long, fewer.
ROWS_PER_BATCH, BYTES_PER_BATCH = 500, 4 << 20

# The words of every contract: runs of anything but ASCII white space. Splitting
# UTF-8 bytes at white space gives the same words.
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: later jobs read it, lost executors cost a re-read."""
    return cut_lineage(df, f"llm-{name}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one, as a URI or path that pyarrow.fs opens."""
    return os.path.join(checkpoint_dir(spark), f"llm-{name}-{os.urandom(6).hex()}")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of `df` has it (in any case of its letters)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def map_rows(
    df: DataFrame, columns: Sequence[str], function: Callable[..., Iterable[tuple]], schema: str
) -> DataFrame:
    """Rows that `function` yields for each row's `columns`; text columns arrive as they are."""
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [column.to_pylist() for column in batch.columns]
            rows = [row for row_in in zip(*values) for row in function(*row_in)]
            yield batch_of(rows, fields)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    return _arrow_schema(df.sparkSession, schema)


def arrow_schema_of(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def batch_of(rows: Sequence[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(column, type=field.type) for column, field in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


def text_chunks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in the same order, in batches of about `size` bytes of the text column."""
    held, have = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        at = before = 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, before + size - have, "right")))
            held.append(batch.slice(at, upto - at))
            have += int(ends[upto - 1]) - before
            at, before = upto, int(ends[upto - 1])
            if have >= size or at < len(ends):
                yield pa.concat_batches(held)
                held, have = [], 0
    if held:
        yield pa.concat_batches(held)


def row_chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in the same order, in batches of at least `least` narrow rows; none is empty."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += len(batch)
        if have >= least:
            yield pa.concat_batches(held)
            held, have = [], 0
    if have:
        yield pa.concat_batches(held)


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def sizes_before(parts: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """(key, name): the sum of `size` over the smaller keys.

    For parts of a range-sorted table: one narrow row per part, however many
    rows a part has.
    """
    totals = parts.groupBy(key).agg(F.sum(size).alias("_size"))
    earlier = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).cast("bigint").alias(name))


def range_sorted(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """`df` sorted over all partitions, with `_part` rising along the order."""
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())


def ranked(df: DataFrame, order: Sequence[Column | str], name: str, label: str) -> DataFrame:
    """`df` with a 0-based number along `order`; no task holds more than one range."""
    parts = written(range_sorted(df, order), label)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    before = sizes_before(parts.withColumn("_one", F.lit(1)), "_part", "_one", "_before")
    return (
        parts.withColumn("_local", local)
        .join(before, "_part")
        .select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name))
    )



def file_system(place: str):
    """The pyarrow file system of a path or URI of the shared folder, and the path in it."""
    from pyarrow import fs

    if "://" in place or place.startswith("file:"):
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), place
