"""Building blocks that keep a hot key from landing in one task.

Every helper assumes that a single key may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First `n` rows of each group in `order`.

    Spark prunes `row_number() <= n` before the shuffle, so each map task sends
    at most `n` rows per group however large the group is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def bucketed_row_number(
    df: DataFrame,
    name: str,
    bucket: Column,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact 1-based row number over `keys`, without one task per key.

    `bucket` must not decrease along `order`, e.g. a line position divided by a
    fixed width. Rows are numbered inside (keys, bucket) and shifted by the
    size of the earlier buckets, so a task sees one bucket, and only the bucket
    sizes (one small row each) are summed per key.
    """
    cells = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*cells)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*cells, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy(*cells).orderBy(*order))
    return join_groups(rows.withColumn("_local", local), offsets, cells).select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name)
    )


def bucketed_running_sum(df: DataFrame, name: str, value: Column, bucket: Column, order: Sequence[Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """`df` with `name`: the sum of `value` over all earlier rows of `keys`, its own row left out.

    As `bucketed_row_number`: a task sees one bucket, and one number per bucket is
    summed per key. `bucket` must not decrease along `order`, which is total.
    """
    cells = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*cells).agg(F.sum("_value").alias("_size")).select(*cells, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return join_groups(rows.withColumn("_local", local), offsets, cells).select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name)
    )


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, NULL matching NULL as in grouping; other column names must differ."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.equal_null(F.col(k), F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def never_broadcast(df: DataFrame) -> DataFrame:
    """Keep `df` out of broadcasts: sort-merge, which also splits skewed keys.

    For rows made by exploding or by building long texts, whose size Spark
    estimates from the narrow columns they came from.
    """
    return df.hint("merge")


def hash_bucket(col: Column | str, width: int = 3) -> Column:
    """Even, engine-independent bucket of a name: the first hex digits of its md5."""
    return F.substring(F.md5(F.col(col) if isinstance(col, str) else col), 1, width)


def within_size(df: DataFrame, max_rows: int) -> bool:
    """Whether `df` has at most `max_rows` rows; reads no more than it must."""
    return df.limit(max_rows + 1).count() <= max_rows
