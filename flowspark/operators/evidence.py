"""Evidence for a case: anomalies by address, heuristics by code, the gate and the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowspark.functions.scale import join_groups, never_broadcast, top_per_group
from flowspark.functions.text import cap_lines, extract_ips, tokens
from flowspark.operators.address_texts import add_sections
from flowspark.operators.retrieval import THRESHOLD
from flowspark.session import cut_lineage

# Passages after reranking, and the length of the alert section.
ANOMALY_DOCS = 6
HEURISTIC_DOCS = 5
ALERT_CHARS = 2500
# Cases or documents of one address that meet in a cell, pairs of a task, and tasks at most.
CELL, PAIRS_PER_TASK, MOST_TASKS = 2_000, 2_000_000, 10_000

# What a section says when it is empty.
NO_ANOMALIES = "No anomaly data found."
NO_HEURISTICS = "No heuristic context available."

# Fixed pattern: what counts as a heuristic code in a text.
CODE_TOKEN = r"\b\d{3,4}\b"

# A caller may pass any text with the three %s in this order.
PROMPT = (
    "Decide whether the log below shows a %s attack. Use only the evidence given.\n"
    "Name the alert, the anomaly records and heuristics that justify it, and one action.\n\n"
    "Alerts:\n%s\n\nAnomaly records:\n%s\n\nHeuristics and taxonomy:\n%s\n"
)


def case_ips(flows: DataFrame) -> DataFrame:
    """Distinct (log_name, ip) over both ends of every flow."""
    return flows.select("log_name", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def text_ips(cases: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """Distinct (case, ip) found in free text."""
    return cases.select(key, F.explode(extract_ips(F.col(text))).alias("ip")).distinct()


def address_index(anomaly_docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, ip): the addresses of each anomaly document."""
    named = F.explode(F.array(F.col("meta.srcIP"), F.col("meta.dstIP")))
    return anomaly_docs.select("doc_id", named.alias("ip")).filter(F.col("ip") != "unknown").distinct()


def _met(ips: DataFrame, index: DataFrame, case: list[str]) -> DataFrame:
    """`ips` joined with the documents of each address, its pairs dealt evenly.

    Pairs are counted by address first. Where they are many, cases and documents
    of an address are cut into cells of at most `CELL` by `CELL`, and the number
    of tasks follows from the pairs, as both sides are small in bytes.
    """
    sizes = ips.groupBy("ip").agg(F.count(F.lit(1)).alias("_cases")).join(index.groupBy("ip").agg(F.count(F.lit(1)).alias("_docs")), "ip")
    sizes = cut_lineage(sizes, "address-sizes")
    pairs = sizes.agg(F.sum(F.col("_cases") * F.col("_docs"))).first()[0] or 0
    if pairs <= PAIRS_PER_TASK:
        return ips.join(index, "ip")
    parts = sizes.select("ip", F.ceil(F.col("_cases") / CELL).cast("int").alias("_as"), F.ceil(F.col("_docs") / CELL).cast("int").alias("_bs"))
    tasks = min(MOST_TASKS, int(pairs // PAIRS_PER_TASK) + 1)
    cell = ["ip", "_a", "_b"]
    left = ips.join(parts, "ip").withColumn("_a", F.pmod(F.xxhash64(*case), "_as").cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1)))
    right = index.join(parts, "ip").withColumn("_b", F.pmod(F.xxhash64("doc_id"), "_bs").cast("int")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_as") - 1)))
    left, right = left.drop("_as", "_bs").repartition(tasks, *cell), right.drop("_as", "_bs").repartition(tasks, *cell)
    return never_broadcast(left).join(never_broadcast(right), cell).drop("_a", "_b")


def ip_evidence(ips: DataFrame, anomaly_docs: DataFrame, k: int | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Anomaly documents that name one of a case's addresses, whole tokens only.

    `ips` is (case columns..., ip). By default an address brings all its
    documents. With `k` and `scores` (case columns..., doc_id, similarity) it
    brings the `k` most similar ones to the case.
    """
    index = address_index(anomaly_docs)
    case = [c for c in ips.columns if c != "ip"]
    if k is None:
        return _pairs(ips, index, case)
    if scores is None:
        raise ValueError("the best k documents of an address need scores")
    ranked = _met(ips, index, case).join(scores, [*case, "doc_id"])
    found = top_per_group(ranked, [*case, "ip"], [F.desc("similarity"), "doc_id"], k)
    return found.select(*case, "doc_id").distinct()


def _pairs(ips: DataFrame, index: DataFrame, case: list[str]) -> DataFrame:
    """Distinct (case columns..., doc_id) of `ips` and the documents of each address, pairs not shuffled.

    A document of one known address meets each case once. One of two meets a
    case at the address that more cases have, and at its rarer one only cases
    without that: these are told by the pairs of addresses that a case has
    whole, few, as the rarer address finds them. Only ids that stand for three
    known addresses or more are made distinct pair by pair.
    """
    ips = ips.select(*case, "ip")
    known = index.join(ips.groupBy("ip").agg(F.count(F.lit(1)).alias("_cases")), "ip")
    by_id = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_places"), F.max(F.struct("_cases", "ip")).alias("_most"))
    several = by_id.filter(F.col("_places") > 1)
    other = F.when((F.col("_places") == 2) & (F.col("ip") != F.col("_most.ip")), F.col("_most.ip"))
    placed = join_groups(known.select("doc_id", "ip"), several, ["doc_id"], "left").select("doc_id", "ip", "_places", other.alias("_other"))
    placed = cut_lineage(placed, "places")

    rarer = cut_lineage(placed.filter(F.col("_other").isNotNull()).select("ip", "_other").distinct(), "address-pairs")
    others = ips.join(rarer.select(F.col("_other").alias("ip")).distinct(), "ip", "left_semi").withColumnRenamed("ip", "_other")
    both = join_groups(ips.join(rarer, "ip"), others, [*case, "_other"])
    held = both.groupBy(*case, "ip").agg(F.collect_set("_other").alias("_held"))
    cases = ips.withColumn("_held", F.lit(None).cast("array<string>")).unionByName(held).groupBy(*case, "ip").agg(F.max("_held").alias("_held"))
    cases = cut_lineage(cases, "cases-held")
    once = placed.filter(F.coalesce("_places", F.lit(1)) <= 2).drop("_places")
    again = F.coalesce(F.array_contains("_held", F.col("_other")), F.lit(False))
    found = _met(cases, once, case).filter(~again).select(*case, "doc_id")
    many = placed.filter(F.col("_places") > 2).select("doc_id", "ip")
    if many.isEmpty():
        return found
    return found.unionByName(_met(ips, many, case).select(*case, "doc_id").distinct())


def heuristic_evidence(evidence: DataFrame, anomaly_docs: DataFrame, heuristics: DataFrame, by_token: bool = False) -> DataFrame:
    """Heuristics behind a case's anomalies, by the anomaly's code.

    `by_token=True` takes every three- or four-digit number in the anomaly text
    for a code instead, ports and address parts included; two-digit codes are
    then never found. `evidence` is (case columns..., doc_id), or (case
    columns..., ip) for all documents of the case's addresses.
    """
    if by_token:
        coded = anomaly_docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CODE_TOKEN), F.lit(0))).alias("code"))
    else:
        coded = anomaly_docs.select("doc_id", F.col("meta.heuristic").alias("code"))
    known = heuristics.select(F.col("code").cast("string").alias("code"), F.col("text").alias("heuristic_text")).distinct()
    # Codes that are known first: a few, whatever the number of documents and cases; texts come in last.
    codes = coded.distinct().join(known.select("code").distinct(), "code", "left_semi")
    cited = _known_of(evidence, anomaly_docs, codes)
    return cited.join(known, "code").select(*[c for c in cited.columns if c != "code"], "code", "heuristic_text")


def taxonomy_evidence(evidence: DataFrame, anomaly_docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Taxonomy category of the case's anomalies (39 fixed prefixes, broadcast); `evidence` as in `heuristic_evidence`."""
    entry = F.format_string("Category: %s\nPrefix: %s", "category", "taxonomy")
    per_doc = anomaly_docs.select("doc_id", F.col("meta.taxonomy").alias("taxonomy")).join(
        F.broadcast(prefixes), "taxonomy"
    )
    cited = _known_of(evidence, anomaly_docs, per_doc.select("doc_id", "taxonomy", "category").distinct())
    return cited.withColumn("entry", entry)


def _known_of(evidence: DataFrame, anomaly_docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (case columns..., facts) of (doc_id, facts...) over a case's documents.

    Where a case is given by its addresses, each address has its distinct facts
    before it meets the cases, so pairs of a case and a document are not made.
    """
    key = "ip" if "ip" in evidence.columns else "doc_id"
    if key == "ip":
        facts = address_index(anomaly_docs).join(facts, "doc_id").drop("doc_id").distinct()
    return evidence.join(facts, key).drop(key).distinct()


def _filters_text(filters: Column) -> Column:
    """Filters as shown in the abstention text: {'dstPort': '443', ...}."""
    named = F.transform(F.map_entries(filters), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(named, ", "), F.lit("}"))


def evidence_gate(cases: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Whether a case has enough evidence, and the abstention text if not.

    `cases` is (case_id, ips, filters): all addresses in text order and a map or
    NULL. `scored` is (case_id, similarity, names_ip). A document counts if it
    is similar enough and names an address; the best similarity counts anyway.
    A case without addresses always abstains.
    """
    best = scored.groupBy("case_id").agg(
        F.max("similarity").alias("_best"),
        F.count_if((F.col("similarity") >= threshold) & F.col("names_ip")).alias("_kept"),
    )
    has_ip = F.size("ips") > 0
    joined = cases.join(best, "case_id", "left")
    score = F.when(has_ip, F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    kept = F.when(has_ip, F.coalesce("_kept", F.lit(0))).otherwise(F.lit(0))
    # The wording of an abstention.
    missing = F.concat_ws(
        "; ",
        F.when(~has_ip, F.lit("no specific IP addresses identified")).otherwise(
            F.concat(F.lit("no anomaly records found for IPs: "), F.array_join("ips", ", "))
        ),
        F.when(F.col("filters").isNotNull(), F.concat(F.lit("with filters: "), _filters_text(F.col("filters")))),
    )
    message = F.format_string(
        "⚠️ **UNDECIDABLE** - Insufficient evidence to provide reliable analysis.\n\n"
        f"**Reason:** Maximum similarity score (%.2f) is below threshold ({threshold}).\n"
        "**Missing context:** %s.\n\n"
        "**Recommendation:** Please provide:\n"
        "  - More specific IP addresses or timestamps\n"
        "  - Additional context about the suspicious activity\n"
        "  - Relevant log entries or anomaly records\n",
        "max_similarity",
        missing,
    )
    gated = joined.withColumns({"max_similarity": score, "kept_docs": kept})
    abstain = (F.col("max_similarity") < threshold) & (F.col("kept_docs") == 0)
    return gated.select(
        "case_id", "max_similarity", "kept_docs", abstain.alias("abstain"), F.when(abstain, message).alias("message")
    )


def case_words(lines: DataFrame) -> DataFrame:
    """(log_name, word): the distinct words of all lines of each log."""
    return lines.select("log_name", F.explode(tokens(F.col("raw"))).alias("word")).distinct()


def alert_sections(lines: DataFrame, max_chars: int = ALERT_CHARS) -> DataFrame:
    """(log_name, alerts): the first whole lines of each log that fit; at most `max_chars` of them."""
    capped = cap_lines(lines.select("log_name", "line_no", "raw"), max_chars)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    return capped.groupBy("log_name").agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("alerts"))


def within_budget(evidence: DataFrame, max_chars: int, text: str = "text", key: str = "log_name") -> DataFrame:
    """The best distinct texts of each case that fit into `max_chars` together, a line break between two.

    Best first: by `score` where there is one, then by the text; the first text
    that does not fit ends the case. A text takes at least a character and its
    line break, so the best `max_chars` texts decide it: each task passes on as
    many per case at most, and the running sum sees no more, however much
    evidence a case has.
    """
    fits = F.col("_upto") - 1 <= max_chars
    return _by_budget(evidence, max_chars, text, key).filter(fits).drop("_upto")


def _by_budget(evidence: DataFrame, max_chars: int, text: str, key: str) -> DataFrame:
    """The best distinct texts of each `key`, more than fit, with `_upto`: the characters up to their end, a line break after each."""
    best = evidence.groupBy(key, text).agg((F.max("score") if "score" in evidence.columns else F.lit(0.0)).alias("score"))
    order = [F.desc("score"), F.col(text)]
    head = top_per_group(best.filter(F.length(text) > 0), [key], order, max_chars // 2 + 2)
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return head.withColumn("_upto", F.sum(F.length(text) + 1).over(upto))


def texts_of_addresses(
    ips: DataFrame, anomaly_docs: DataFrame, texts: DataFrame, max_chars: int | None = None, by_ip: bool = False
) -> DataFrame:
    """(case columns..., text, score) for the (doc_id, text[, score]) of the documents of a case's addresses.

    With `by_ip` they stay (ip, text[, score]), for `case_prompts` to put
    together. With `max_chars` as many as `within_budget` needs to choose those that fit
    for the case: each address brings its best texts that fit and the first one
    that does not, as a text that is not among these ends no case and is in none.
    """
    named = address_index(anomaly_docs).join(texts, "doc_id").drop("doc_id")
    if by_ip:
        return named
    case = [c for c in ips.columns if c != "ip"]
    if max_chars is None:
        return _met(ips, named.withColumnRenamed("text", "doc_id"), case).drop("ip").withColumnRenamed("doc_id", "text")
    first = _by_budget(named, max_chars, "text", "ip").filter(F.col("_upto") - F.length("text") - 2 <= max_chars).drop("_upto")
    return ips.join(first, "ip").drop("ip")


def _section(evidence: DataFrame, text: str, name: str, max_chars: int | None = None) -> DataFrame:
    """Texts of a case as one section, best first where they have a score, else by their alphabet; None holds all of them."""
    if max_chars is not None:
        evidence = within_budget(evidence, max_chars, text)
    score = -F.col("score") if "score" in evidence.columns else F.lit(0.0)
    best = evidence.groupBy("log_name", text).agg(F.min(score).alias("_order"))
    parts = F.array_sort(F.collect_list(F.struct("_order", text)))
    return best.groupBy("log_name").agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias(name))


def case_prompts(
    alerts: DataFrame,
    anomaly_docs: DataFrame,
    heuristic_docs: DataFrame,
    attack: str = "SYN flood",
    template: str = PROMPT,
    max_chars: int | None = None,
    ips: DataFrame | None = None,
) -> DataFrame:
    """One prompt per case from its alert section and its ranked evidence (log_name, text).

    With `max_chars` each of both evidence sections holds the best texts that
    fit; without, all of a case's evidence comes into one row. With `ips`
    (log_name, ip) the anomaly texts are (ip, text), and a case has all those
    of its addresses: they come in last, so that sections are not shuffled.
    """
    if ips is not None and (max_chars is not None or "score" in anomaly_docs.columns):
        raise ValueError("texts by address have neither a budget nor a score")
    made = alerts.select("log_name", "alerts").join(_section(heuristic_docs, "text", "_heuristics", max_chars), "log_name", "left")
    if ips is None:
        made = made.join(_section(anomaly_docs, "text", "_anomalies", max_chars), "log_name", "left")
    else:
        made = add_sections(made, ips, anomaly_docs, "_anomalies")
    return made.select(
        "log_name",
        F.format_string(
            template,
            F.lit(attack),
            "alerts",
            F.coalesce("_anomalies", F.lit(NO_ANOMALIES)),
            F.coalesce("_heuristics", F.lit(NO_HEURISTICS)),
        ).alias("prompt"),
    )
