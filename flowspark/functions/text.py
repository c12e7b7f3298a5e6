"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import top_per_group

# Fixed value: an IPv4-shaped token; octets are not range-checked.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
WORD = r"[\p{L}\p{M}\p{N}_]+(?:\.[\p{L}\p{M}\p{N}_]+)*"


def extract_ips(text: Column) -> Column:
    """All IPv4-shaped tokens in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(0))


def stem(name: Column) -> Column:
    """File name without its last extension."""
    extension = F.length(F.substring_index(name, ".", -1))
    return F.when(name.contains("."), F.substring(name, F.lit(1), F.length(name) - extension - 1)).otherwise(name)


def similarity_of(distance: Column) -> Column:
    """Similarity of a squared L2 distance between unit vectors (their cosine)."""
    return 1.0 - distance / 2.0


def all_tokens(text: Column) -> Column:
    """Lower-case words and numbers of any language in order, repeats kept; dotted addresses stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """The distinct tokens."""
    return F.array_distinct(all_tokens(text))


def cap_text(text: Column, max_chars: int = 2500) -> Column:
    """The text if it fits, else its longest run of whole first lines that does.

    Each line counts with its line break.
    """
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"))

    def step(acc: Column, line: Column) -> Column:
        # Once a line does not fit the sum stays above the cap, so no later one does.
        chars = acc["chars"] + F.length(line) + 1
        return F.struct(chars.alias("chars"), (acc["lines"] + (chars <= max_chars).cast("int")).alias("lines"))

    lines = F.split(text, "\n")
    kept = F.aggregate(lines, start, step, lambda acc: acc["lines"])
    capped = F.array_join(F.slice(lines, F.lit(1), kept), "\n")
    return F.when(F.length(text) <= max_chars, text).otherwise(capped)


def cap_lines(lines: DataFrame, max_chars: int = 2500, key: str = "log_name", text: str = "raw") -> DataFrame:
    """The same cap for a text held as one row per line, ordered by `line_no`.

    A line takes at least one character of the cap, so `max_chars` lines and the
    two that tell whether the text goes on decide it, however long the log is.
    """
    head = top_per_group(lines, [key], ["line_no"], max_chars + 2)
    group = Window.partitionBy(key)
    upto = group.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = head.withColumn("_upto", F.sum(F.length(text) + 1).over(upto)).withColumn(
        "_total", F.max("_upto").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    fits = (F.col("_upto") <= max_chars) | (F.col("_total") - 1 <= max_chars)
    return sized.filter(fits).select(*lines.columns)
