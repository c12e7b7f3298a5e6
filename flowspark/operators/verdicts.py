"""Reading verdicts out of written reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.text import extract_ips
from flowspark.functions.time import record_order

# States that settle a verdict when found in the log, and in a raw row quoted by the report.
ATTACK_STATE = "S0"
LOG_NORMAL_STATES = ("SH", "SF", "RSTR", "RSTO", "OTH", "REJ", "RSTOS0", "RSTRH")
QUOTED_NORMAL_STATES = ("SH", "SF", "RSTR", "RSTO", "OTH", "REJ")

# Fixed pattern: a raw row quoted in a report; its group is the connection state.
QUOTED_ROW = r"tcp\s+[-\w]+\s+[-\w]+\s+[-\w]+\s+[-\w]+\s+(\w+)\s+F\s+F"

# Phrases of normal traffic, of denial, of the attack state and of confirmation.
NORMAL_PHRASES = (
    "sh flag", "sh flags", " sh f ", "sf flag", "sf flags", "rstr", "rsto", "reset received",
    "oth flag", "oth flags", "showing oth", "rej flag",
)
DENIAL_PHRASES = (
    "do not treat as", "not a syn flood", "no syn flood", "inconsistent with", "not icmp ping traffic",
    "cannot be classified as a ping flood", "this cannot be confirmed as a ping flood",
)
ATTACK_STATE_PHRASES = (
    "s0 flag", "s0 state", "flag s0", "s0)", "(s0", "showing s0", "with s0", "state s0",
)
CONFIRMATION_PHRASES = (
    "tcp syn flood detected", "syn flood attack confirmed", "classic indicators of a syn flood",
)
ABSTENTION = "UNDECIDABLE"

# White space at either end of a text, Unicode spaces and separator characters included.
_EDGES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(_EDGES))


def report_fields(text: Column) -> dict[str, Column]:
    """Parts of a report: alert, justification, action, abstention, addresses, port and state."""

    def part(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))

    return {
        "alert": part(r"(?i)flood alert:[ \t]*([^\n]*)"),
        "justification": part(r"(?i)justified by anomaly:[ \t]*([^\n]*)"),
        "action": part(r"(?i)action:[ \t]*([^\n]*)"),
        "abstained": text.contains(ABSTENTION),
        "ips": F.array_join(extract_ips(text), ","),
        "port": part(r"(?i)\bport\s+(\d+)").cast("int"),
        "state": part(r"\b(S0|S1|SF|REJ|S2|S3|RSTO|RSTR|RSTOS0|RSTRH|SH|SHR|OTH)\b"),
    }


def first_sentence_verdict(text: Column) -> Column:
    """NULL for an empty report; otherwise no attack exactly if the first sentence contains "no".

    The substring counts anywhere, so "anomaly" and "unknown" read as a denial.
    The dot of "conn.log" does not end a sentence.
    """
    sentence = F.lower(F.split_part(F.replace(stripped(text), F.lit("conn.log"), F.lit("conn_log")), F.lit("."), F.lit(1)))
    return F.when(stripped(text) == "", None).otherwise(~sentence.contains("no"))


def decisive_states(flows: DataFrame) -> DataFrame:
    """Per log the first state, in record order, that settles the verdict."""
    state = F.upper("conn_state")
    known = F.array(*[F.lit(s) for s in (ATTACK_STATE, *LOG_NORMAL_STATES)])
    # States go through the aggregation as numbers: of fixed width, so by hash.
    first = F.min_by(F.array_position(known, state), record_order(flows.columns))
    return (
        flows.filter(state.isin(ATTACK_STATE, *LOG_NORMAL_STATES))
        .groupBy("log_name")
        .agg(first.cast("int").alias("_state"))
        .select("log_name", F.element_at(known, F.col("_state")).alias("decisive_state"))
    )


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def syn_verdict(text: Column, log_state: Column) -> Column:
    """SYN verdict of a report: the log's own state first, then quoted rows, then the wording."""
    lowered = F.lower(stripped(text))
    quoted = F.upper(F.regexp_extract(text, QUOTED_ROW, 1))
    return (
        F.when(stripped(text) == "", None)
        .when(log_state == ATTACK_STATE, True)
        .when(log_state.isNotNull(), False)
        .when(quoted == ATTACK_STATE, True)
        .when(quoted.isin(*QUOTED_NORMAL_STATES), False)
        .when(_any_of(lowered, NORMAL_PHRASES), False)
        .when(_any_of(lowered, DENIAL_PHRASES), False)
        .when(_any_of(lowered, ATTACK_STATE_PHRASES), True)
        .when(_any_of(lowered, CONFIRMATION_PHRASES), True)
        .otherwise(False)
    )


def strict_verdict(text: Column, verdict: Column) -> Column:
    """The verdict, but none for a report that abstains."""
    return F.when(text.contains(ABSTENTION), None).otherwise(verdict)


def syn_verdicts(reports: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(log_name, verdict) of each report; with `flows` the log's state decides first."""
    if flows is None:
        with_state = reports.withColumn("decisive_state", F.lit(None).cast("string"))
    else:
        with_state = reports.join(decisive_states(flows), "log_name", "left")
    return with_state.select("log_name", syn_verdict(F.col("text"), F.col("decisive_state")).alias("verdict"))
