"""Line-first cleaning: judge every line, drop the failing ones, reject documents that lose too much."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from flowspark.llm.common import arrow_schema_of, map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LINE_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")
BOILERPLATE = (
    b"all rights reserved",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"cookie policy",
    b"use of cookies",
    b"accept cookies",
    b"enable javascript",
    b"javascript is disabled",
    b"skip to content",
    b"subscribe to our newsletter",
    b"sign up for our newsletter",
    b"share on facebook",
    b"share on twitter",
    b"click here to",
    b"lorem ipsum",
)
WINDOW = 8
MIN_WORDS = 20
# Of 100 words.
MAX_SYMBOLS, MAX_BARS, MAX_BANGS, MAX_ECHOES, MAX_LOST = 30, 30, 50, 30, 50
# A line of up to so many words and without an end mark is navigation.
SHORT_LINE = 3

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, lost_chars bigint, n_lines_removed bigint, clean_text string"
)


def _without(text: bytes, unwanted: bytes) -> int:
    """How many bytes of `text` are among `unwanted`."""
    return len(text) - len(text.translate(None, unwanted))


def line_fails(line: bytes) -> str | None:
    """The first rule that a line with words fails: punctuation, navigation, boilerplate; None if it passes."""
    words = line.split()
    n = len(words)
    if 100 * _without(line, SYMBOLS) > MAX_SYMBOLS * n:
        return "navigation" if 100 * line.count(b"|") > MAX_BARS * n else "punctuation"
    if 100 * line.count(b"!!") > MAX_BANGS * n:
        return "punctuation"
    if n <= SHORT_LINE and not words[-1].endswith(LINE_ENDS):
        return "navigation"
    if 100 * sum(map(bytes.__eq__, words, words[1:])) > MAX_ECHOES * n:
        return "boilerplate"
    lowered = line.lower()
    if any(phrase in lowered for phrase in BOILERPLATE):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Equal hashes are only a hint: number the windows exactly, by doubling where possible.
    rank, width = ids.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        pairs = rank[: len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width += step
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None) -> tuple:
    """The values of FIELDS for one text."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - _without(raw, WHITE)
    seen: set[bytes] = set()
    kept, duplicates, lost, removed = [], 0, 0, 0
    for line in raw.split(b"\n"):
        if line.isspace() or not line:
            kept.append(line)
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        if line_fails(line):
            lost += len(line.decode()) - _without(line, WHITE)
            removed += 1
        else:
            kept.append(line)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > 30 * len(words)
    stays = not failed and 100 * lost <= MAX_LOST * chars
    clean = b"\n".join(kept).decode() if removed else text
    return len(words), chars, _without(raw, SYMBOLS), duplicates, repeats, failed, stays, lost, removed, clean


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measures, the verdict `kept`, and its text without the failing lines.

    NULL or empty text: no words, so `base_failed` and not kept. Repeated rows
    are judged alike, row by row; lines without a word pass every rule; other
    columns of `docs` are not read. An empty table gives no rows.
    """
    id_type = dict(docs.dtypes)[id_col]

    def rows(key, text):
        yield (key, *judge(text))

    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` {id_type}, {FIELDS}")


def kept_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of `docs` that are kept, all columns, with the cleaned text and its size in `size_col` if there is one.

    Rejected rows go; the texts of the others lose their failing lines. A NULL,
    empty or wordless text is rejected; repeated rows are judged alike; columns
    of any name pass through; an empty table gives no rows.
    """
    fields = pa.schema([(f.name, f.type) for f in arrow_schema_of(docs)])
    at, size_at = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(text) for text in batch.column(at).to_pylist()]
            stays = pa.array([j[6] for j in judged], pa.bool_())
            columns = list(batch.columns)
            columns[at] = pa.array([j[-1] for j in judged], fields.field(at).type)
            if size_at is not None:
                changed = pa.array([len(j[-1]) if j[8] else None for j in judged], fields.field(size_at).type)
                columns[size_at] = pc.coalesce(changed, columns[size_at])
            yield pa.RecordBatch.from_arrays(columns, schema=fields).filter(stays)

    return docs.mapInArrow(run, docs.schema)


RESULT = [
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
    "lost_chars",
    "n_lines_removed",
]


def op5_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*RESULT)


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i:i+7] AS g
        FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
repw AS (SELECT r, count(DISTINCT j) AS n
         FROM (SELECT r, unnest(generate_series(i, i + 7)) AS j FROM rep) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
lw AS (SELECT r, k, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws FROM ln),
lm AS (SELECT r, k, l, len(ws) AS n, ws,
              length(l) - length(translate(l, '#*$%&|<>', '')) AS sym,
              (length(l) - length(replace(l, '!!', ''))) / 2 AS bangs,
              len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) AS echoes,
              list_sum(list_transform(ws, lambda x: length(x))) AS chars
       FROM lw WHERE len(ws) > 0),
lf AS (SELECT *, 100 * sym > 30 * n OR 100 * bangs > 50 * n
                 OR (n <= 3 AND NOT regexp_matches(ws[len(ws)], '[.!?:;"'')]$'))
                 OR 100 * echoes > 30 * n
                 OR regexp_matches(l, '(?i)all rights reserved|privacy policy|terms of use|terms of service|cookie policy|use of cookies|accept cookies|enable javascript|javascript is disabled|skip to content|subscribe to our newsletter|sign up for our newsletter|share on facebook|share on twitter|click here to|lorem ipsum') AS bad,
              row_number() OVER (PARTITION BY r, l ORDER BY k) > 1 AS dup
       FROM lm),
ls AS (SELECT r, count(*) FILTER (dup) AS dups, coalesce(sum(chars) FILTER (bad), 0) AS lost, count(*) FILTER (bad) AS bad
       FROM lf GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars,
             CAST(coalesce(bad, 0) AS BIGINT) AS n_lines_removed
      FROM w LEFT JOIN ls USING (r) LEFT JOIN repw USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
FROM m
"""
