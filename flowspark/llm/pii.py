"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "birth", "passport", "account")

# Fixed expressions. A look-behind or a possessive repeat keeps them linear on
# texts that are one long run of digits; the matches are those of the plain forms.
_MAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9./-])(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})([./])([0-9]{1,2})\5([0-9]{4}))(?![0-9/-]|\.[0-9])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9.-])[0-9]{6,12}(?![A-Za-z0-9-]|\.[0-9])")

# What a confirmed span is worth, what a word of its context adds, what it must reach. Kinds without a checksum
# are worth too little without one: context decides them.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "birth": 0.3, "passport": 0.3, "account": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security"),
    "birth": ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento"),
    "passport": ("passport", "reisepass", "passeport", "pasaporte"),
    "account": ("account", "acct", "konto", "kontonummer", "compte", "cuenta"),
}
CONTEXT_BONUS, CONTEXT_CHARS, MIN_SCORE = 0.2, 40, 0.5
# Whole words only: neither "hotel" nor "recipe" is a word of a context.
_CONTEXT = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)") for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number in international form has a right check number."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _MAIL_CHARS:
            start -= 1
        found = _MAIL_TAIL.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        # Leading zeros count for nothing, and few digits are cheap to read as a number.
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found[0].split(".")):
            yield found.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, found[0])) <= 15:
            yield found.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers; words in capitals behind a number are given up group by group."""
    for found in _IBAN.finditer(text):
        groups = found[0].split(" ")
        while groups and len("".join(groups)) >= 15:
            if mod97("".join(groups)):
                yield found.start(), found.start() + len(" ".join(groups))
                break
            groups.pop()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for found in _SSN.finditer(text):
        area, group, serial = found[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield found.span()


def births(text: str) -> Iterator[tuple[int, int]]:
    """Dates that are in the calendar, of this or the last century; day and month in either order."""
    for found in _DATE.finditer(text):
        year, *parts = map(int, (found[1], found[2], found[3]) if found[1] else (found[7], found[4], found[6]))
        if 1900 <= year <= 2099 and 1 <= min(parts) and min(parts) <= 12 and max(parts) <= 31 and (not found[1] or parts[0] <= 12):
            yield found.span()


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (found.span() for found in pattern.finditer(text))


_PROPOSE = {
    "email": emails,
    "ip": addresses,
    "card": cards,
    "phone": phones,
    "iban": accounts,
    "ssn": ssns,
    "birth": births,
    "passport": _matches(_PASSPORT),
    "account": _matches(_ACCOUNT),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's worth, and more if a whole word of its context lies within CONTEXT_CHARS on either side."""
    low, high = max(0, start - CONTEXT_CHARS), end + CONTEXT_CHARS
    # A character more tells whether a word goes on beyond the context.
    before, behind = text[max(0, low - 1) : start].lower(), text[end : high + 1].lower()
    near = _found(_CONTEXT[kind], before, low > 0, False) or _found(_CONTEXT[kind], behind, False, len(text) > high)
    return round(SCORES[kind] + CONTEXT_BONUS * near, 2)


def _found(words: re.Pattern, text: str, skips_first: bool, skips_last: bool) -> bool:
    return any(f.start() >= skips_first and f.end() <= len(text) - skips_last for f in words.finditer(text))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; positions in code points, end exclusive.

    The four base kinds stay whatever their score; the others must reach MIN_SCORE.
    """
    found = []
    for order, kind in enumerate(KINDS if text else ()):
        for start, end in _PROPOSE[kind](text):
            points = score(text, kind, start, end)
            if kind in BASE_KINDS or points >= MIN_SCORE:
                found.append((start, order, kind, end, points))
    return [(kind, start, end, points) for start, _, kind, end, points in sorted(found)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all its spans and their scores.

    NULL or empty text: an empty list. Spans of different kinds may overlap and
    are all reported. Repeated rows each give a row; other columns are not read;
    an empty table gives no rows.
    """

    def rows(key, text):
        yield key, [dict(zip(("kind", "start", "end", "score"), span)) for span in spans(text)]

    shape = "array<struct<kind:string, start:bigint, `end`:bigint, score:double>>"
    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, spans {shape}")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans_col: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [
        count_of("spans", kind).alias(f"n_{kind}")
        for kind in BASE_KINDS
    ]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
