"""Microsecond time helpers."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE

# Fixed value: the display format of alert times.
DISPLAY_FORMAT = "yyyy-MM-dd HH:mm:ss"


def display_time(ts_us: Column) -> Column:
    """UTC display text of a microsecond time (session time zone must be UTC)."""
    return F.date_format(F.timestamp_micros(ts_us), DISPLAY_FORMAT)


def cell_of(column: str, width: int) -> Column:
    """Number of the half-open cell of `width` holding an integer, exact for negatives too."""
    return F.expr(f"({column} - pmod({column}, {int(width)}L)) div {int(width)}L")


def record_order(columns: Sequence[str]) -> Column:
    """Place of a record in its log: its line, or (time, uid) behind all lines where it has none.

    Line and time are one number of fixed width, so that `min_by` can aggregate
    by hash where there is no uid to tell equal times apart.
    """
    line = F.col("line_no") if "line_no" in columns else F.lit(None).cast("bigint")
    behind = F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("ts_us").cast("decimal(19,0)")
    place = F.coalesce(line.cast("decimal(38,0)"), behind.cast("decimal(38,0)"))
    return F.struct(place.alias("place"), F.when(line.isNull(), F.col("uid")).alias("uid")) if "uid" in columns else place
