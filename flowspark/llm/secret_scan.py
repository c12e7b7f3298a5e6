"""Secret scans over a trigram index: Boolean trigram queries per rule, intersected postings, verified candidates.

Everything that touches texts is a DataFrame expression; Python only reads the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import table, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and how long a group of the match must be.

    `scan` is the expression run over texts where it differs: one that yields
    the same spans without the matches that are too short.
    """

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1
    scan: str | None = None

    @property
    def java(self) -> str:
        return "(?i)" * self.any_case + (self.scan or self.pattern)


# Matches that are placed one after the other in one array.
BLOCK = 64

BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        any_case=True,
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # Runs of hex digits are maximal, so those of 16 and more are the same spans.
    Rule("hex", r"[0-9a-f]+", least=16, scan=r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

# Alternatives of a rule that are told apart, and letters of a class that count as alternatives.
MOST_ALTERNATIVES, SMALL_CLASS = 64, 6
# Stands for text of which nothing is known.
GAP = "\0"


# --- Boolean trigram queries --------------------------------------------------


def _strings(parsed) -> list[str]:
    """Strings, with gaps, one of which any match follows."""
    found = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [chr(value)]
        elif name == "IN" and len(value) <= SMALL_CLASS and all(str(o) == "LITERAL" for o, _ in value):
            options = [chr(v) for _, v in value]
        elif name == "SUBPATTERN":
            options = _strings(value[3])
        elif name == "BRANCH":
            options = [s for branch in value[1] for s in _strings(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            once = _strings(inner)
            if (low, high) == (0, 1):
                options = ["", *once]
            elif low == high == 1:
                options = once
            else:
                options = [s + GAP for s in once] if low else [GAP]
        elif name == "AT":
            options = [""]
        else:
            options = [GAP]
        if len(found) * len(options) > MOST_ALTERNATIVES:
            options = [GAP]
        found = [a + b for a, b in product(found, options)]
    return list(dict.fromkeys(found))


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """The rule's query: any of the lists, all trigrams of a list; None if some match needs no trigram.

    Trigrams are of lower-cased text, which can only widen the query.
    """
    clauses = []
    for string in _strings(regex_parser.parse(rule.pattern)):
        runs = string.lower().split(GAP)
        trigrams = sorted({run[k : k + 3] for run in runs for k in range(len(run) - 2)})
        if not trigrams:
            return None
        if trigrams not in clauses:
            clauses.append(trigrams)
    # A clause that asks for more than another one adds nothing.
    return [c for c in clauses if not any(set(d) < set(c) for d in clauses)]


# --- the index ------------------------------------------------------------------


def text_key(text: Column) -> Column:
    """Equal texts share postings, however many rows hold them."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, text_col: str, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index (trigram, text_key) over whole texts, for the trigrams that queries ask for.

    Each pair once, however many rows have the text; NULL and empty texts have
    none; an empty table or no trigrams give no rows.
    """
    lowered = docs.select(text_key(F.col(text_col)).alias("text_key"), F.lower(text_col).alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("text_key", F.explode(present).alias("trigram")).dropDuplicates()


def candidates(index: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """(text_key, rules): a bit for each rule whose query the text's postings meet."""
    spark = index.sparkSession
    asked = [
        (trigram, number, clause, len(trigrams))
        for number, clauses in queries.items()
        for clause, trigrams in enumerate(clauses)
        for trigram in trigrams
    ]
    clauses = spark.createDataFrame(asked, "trigram string, rule int, clause int, needed int")
    met = (
        index.join(F.broadcast(clauses), "trigram")  # a row per trigram of the rules, whatever the data
        .groupBy("text_key", "rule", "clause")
        .agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        .filter(F.col("n") == F.col("needed"))
    )
    bit = F.expr("shiftleft(1L, rule)")
    return met.groupBy("text_key").agg(F.bit_or(bit).alias("rules"))


# --- verification -----------------------------------------------------------------


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches that are long enough, as (start, order, kind, end) in code points.

    Matches have no positions, so they follow from the lengths of what lies
    between them and their own. An array that grows match by match is copied
    each time, so matches are taken in blocks, each from its own offset: time is
    in proportion to the matches also in a text that consists of them.
    """
    between = F.split(text, rule.java, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else whole
    lengths = F.zip_with(
        F.zip_with(between, whole, lambda gap, match: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("whole"))),
        part,
        lambda both, match: F.struct(both["gap"].alias("gap"), both["whole"].alias("whole"), F.length(match).alias("part")),
    )
    span = "struct<start:bigint,`order`:int,kind:string,`end`:bigint>"

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["whole"], F.lit(0))
        found = F.struct(
            begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")
        ).cast(span)
        # Behind the last gap comes no match.
        out = F.when(x["part"] >= rule.least, F.concat(state["out"], F.array(found))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def of_block(block: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("at"), F.array().cast(f"array<{span}>").alias("out"))
        return F.aggregate(block, start, step, lambda state: state["out"])

    def offsets(blocks: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        sizes = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda total, x: total + x["gap"] + F.coalesce(x["whole"], F.lit(0))))
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(sizes, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def cut(matches: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda k: F.slice(matches, k * BLOCK + 1, BLOCK))

    # A variable is worked out once, where an expression would be for each use.
    return _once(_once(lengths, cut), lambda blocks: F.flatten(F.zip_with(blocks, offsets(blocks), of_block)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """One row per document with all spans (start, order, kind, end), by start, then rule.

    Rules whose query is known are verified on the texts that the index names;
    rules without mandatory trigrams scan all texts. NULL or empty text has no
    spans; repeated rows each give a row and share postings; overlapping spans
    of different rules are all reported; other columns are not read; an empty
    table gives no rows.
    """
    queries = {n: q for n, q in enumerate(map(trigram_query, rules)) if q}
    trigrams = sorted({t for clauses in queries.values() for clause in clauses for t in clause})
    index = written(postings(docs, text_col, trigrams), "postings")
    named = written(candidates(index, queries), "candidates")
    texts = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
        text_key(F.col(text_col)).alias("text_key"),
    ).join(named, "text_key", "left")
    none = F.array().cast("array<struct<start:bigint,`order`:int,kind:string,`end`:bigint>>")
    found = []
    for number, rule in enumerate(rules):
        asked = F.col("rules").bitwiseAND(F.lit(1 << number).cast("bigint")) != 0
        scanned = F.col("_text").rlike(rule.java)
        found.append(F.when(asked if number in queries else scanned, rule_spans(F.col("_text"), rule, number)).otherwise(none))
    return texts.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*found)).alias("spans"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in BASE_RULES]
    counts = [
        count_of("spans", kind).alias(f"n_{kind}") for kind in base
    ]
    digest = F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_SQL_SPANS = """
SELECT r, {order} AS o, '{kind}' AS kind,
       list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
       length(m[i]) AS n, length(v[i]) AS k, {least} AS least
FROM (SELECT r, g, m, v, unnest(generate_series(1, len(m))) AS i
      FROM (SELECT r, regexp_split_to_array(t, '{re}') AS g, regexp_extract_all(t, '{re}') AS m,
                   regexp_extract_all(t, '{re}', {group}) AS v FROM d))
"""


def _sql() -> str:
    parts = [
        _SQL_SPANS.format(order=n, kind=r.kind, least=r.least, group=r.group, re=r.java.replace("'", "''"))
        for n, r in enumerate(RULES)
    ]
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(
        f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE_RULES
    )
    named = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
sp AS (SELECT r, o, kind, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)) AS x, s
       FROM ({" UNION ALL ".join(parts)}) WHERE k >= least),
a AS (SELECT r, {counts}, string_agg(x, ',' ORDER BY s, o) FILTER (kind IN ({base})) AS base,
             string_agg(x, ',' ORDER BY s, o) AS everything FROM sp GROUP BY r)
SELECT doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(everything, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


OP1_SQL = _sql()
