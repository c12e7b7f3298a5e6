"""The four jobs a user runs end to end, as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.scale import bucketed_row_number, hash_bucket
from flowspark.functions.text import cap_text, extract_ips, tokens
from flowspark.functions.time import SECOND
from flowspark.operators import bursts, documents, evidence, filters, labelling, metrics, ml, profile, retrieval
from flowspark.operators import rule_match, rule_scores
from flowspark.operators.address_rank import best_by_address
from flowspark.session import cut_lineage

# Fixed value: cases per batch.
BATCH_SIZE = 500


def alert_rows(flows: DataFrame, ping_window_us: int = 5 * SECOND, syn_window_us: int = 20 * SECOND) -> DataFrame:
    """Log to knowledge: every ping and SYN alert as a knowledge row."""
    ping = documents.ping_alert_docs(documents.ping_alerts_with_totals(flows, window_us=ping_window_us))
    syn = documents.syn_alert_docs(bursts.syn_alerts(flows, window_us=syn_window_us))
    return ping.unionByName(syn)


def knowledge_rows(anomalies: DataFrame, heuristics: DataFrame, groups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Anomalies, heuristics and taxonomy groups as knowledge rows."""
    return (
        documents.anomaly_docs(anomalies, existing)
        .unionByName(documents.heuristic_docs(heuristics))
        .unionByName(documents.taxonomy_docs(groups))
    )


def prompts(
    flows: DataFrame, anomaly_docs: DataFrame, heuristics: DataFrame, prefixes: DataFrame, proto: str = "tcp", max_chars: int | None = None
) -> DataFrame:
    """Log to prompt: one prompt per case with its lines and all its evidence, or as much as `max_chars` a section hold.

    `flows` needs `raw`; `heuristics` is (code, text). Texts and codes are
    found by address, so a case meets them once, without ids of documents between.
    """
    lines = cut_lineage(filters.protocol_or_all(flows, proto).select("log_name", "line_no", "raw", "src_ip", "dst_ip"), "lines")
    anomaly_docs = cut_lineage(anomaly_docs.select("doc_id", "text", "meta"), "anomalies")
    ips = cut_lineage(evidence.case_ips(lines), "addresses")
    whole = max_chars is None
    records = evidence.texts_of_addresses(ips, anomaly_docs, anomaly_docs.select("doc_id", "text"), max_chars, by_ip=whole)
    context = evidence.heuristic_evidence(ips, anomaly_docs, heuristics).select(
        "log_name", F.col("heuristic_text").alias("text")
    )
    taxonomy = evidence.taxonomy_evidence(ips, anomaly_docs, prefixes).select("log_name", F.col("entry").alias("text"))
    attack = "SYN flood" if proto == "tcp" else "ping flood"
    alerts = evidence.alert_sections(lines)
    return evidence.case_prompts(alerts, records, context.unionByName(taxonomy), attack, max_chars=max_chars, ips=ips if whole else None)


def query_prompts(
    cases: DataFrame,
    anomaly_docs: DataFrame,
    heuristics: DataFrame,
    k: int = retrieval.TOP_K,
    fetch_k: int | None = None,
    threshold: float = retrieval.THRESHOLD,
    attack: str = "SYN flood",
    anomalies_kept: int = evidence.ANOMALY_DOCS,
    heuristics_kept: int = evidence.HEURISTIC_DOCS,
) -> DataFrame:
    """Question to prompt or abstention: (case_id, abstain, prompt) of (case_id, text, vector).

    Addresses and filters come from the text. For each case the filter is
    applied before the search among `anomaly_docs` (doc_id, text, meta, vector);
    of the `fetch_k` nearest, k diverse ones stay, and of these the documents
    that name an address and are similar enough. The gate decides; heuristics
    are those of the documents' codes. Both are ranked anew by the words they
    share with the question, and the best `anomalies_kept` and `heuristics_kept`
    make the sections, in rank order.
    """
    cases = cut_lineage(cases.select("case_id", "text", "vector"), "cases")
    asked = cases.select(
        "case_id", extract_ips(F.col("text")).alias("ips"), filters.query_filter_map(F.col("text")).alias("filters")
    )
    queries = cases.join(asked, "case_id").filter(F.size("ips") > 0)
    near = retrieval.vector_mmr(
        queries.select(F.col("case_id").alias("query_id"), "vector", F.col("filters").alias("wanted")), anomaly_docs, k, fetch_k
    )
    docs = anomaly_docs.select(F.col("doc_id").cast("string"), "text", "meta")
    named = F.arrays_overlap("ips", F.array(F.col("meta.srcIP"), F.col("meta.dstIP")))
    hits = near.withColumnRenamed("query_id", "case_id").join(docs, "doc_id").join(asked, "case_id")
    scored = cut_lineage(hits.select("case_id", "doc_id", "similarity", named.alias("names_ip"), "text", "meta"), "scored")
    gate = evidence.evidence_gate(asked, scored, threshold)
    kept = scored.filter(F.col("names_ip") & (F.col("similarity") >= threshold))
    known = heuristics.select(F.col("code").cast("string").alias("code"), F.col("text").alias("heuristic_text"))
    coded = kept.join(known, F.col("meta.heuristic") == F.col("code"))
    records = _reranked(cases, kept.select("case_id", F.col("doc_id").alias("doc_id"), "text"), anomalies_kept)
    context = _reranked(cases, coded.select("case_id", F.col("code").alias("doc_id"), F.col("heuristic_text").alias("text")), heuristics_kept)
    alerts = cases.select(F.col("case_id").alias("log_name"), cap_text(F.col("text"), evidence.ALERT_CHARS).alias("alerts"))
    made = evidence.case_prompts(alerts, records, context, attack).withColumnRenamed("log_name", "case_id")
    return gate.join(made, "case_id").select(
        "case_id", "abstain", F.when(F.col("abstain"), F.col("message")).otherwise(F.col("prompt")).alias("prompt")
    )


def _reranked(cases: DataFrame, found: DataFrame, top_k: int) -> DataFrame:
    """(log_name, text, score): the `top_k` texts of each case that share most with its question, by weighted words."""
    found = cut_lineage(found.distinct(), "found")
    words = cases.select(F.col("case_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("token"))
    texts = found.select("doc_id", "text").distinct()
    best = retrieval.lexical_rerank(
        found.select(F.col("case_id").alias("query_id"), "doc_id").distinct(), words, retrieval.term_weights(texts, tokens(F.col("text"))), top_k
    )
    return best.join(texts, "doc_id").select(F.col("query_id").alias("log_name"), "text", "score")


def ranked_anomalies(words: DataFrame, found: DataFrame, anomaly_docs: DataFrame, top_k: int = evidence.ANOMALY_DOCS) -> DataFrame:
    """Best anomaly documents of each case by shared words; `words` is (log_name, word) over the case's whole text."""
    weights = retrieval.term_weights(anomaly_docs, tokens(F.col("text")))
    queries = words.select(F.col("log_name").alias("query_id"), F.col("word").alias("token"))
    pairs = found.withColumnRenamed("log_name", "query_id")
    best = retrieval.lexical_rerank(pairs, queries, weights, top_k)
    return best.join(anomaly_docs.select("doc_id", "text"), "doc_id").select(
        F.col("query_id").alias("log_name"), "doc_id", "text", "score"
    )


def anomalies_by_address(words: DataFrame, ips: DataFrame, anomaly_docs: DataFrame, top_k: int = evidence.ANOMALY_DOCS) -> DataFrame:
    """`ranked_anomalies` over all documents of a case's addresses (log_name, ip), without the pairs; (log_name, doc_id, score)."""
    weights = retrieval.term_weights(anomaly_docs, tokens(F.col("text")))
    return best_by_address(ips, words, evidence.address_index(anomaly_docs), weights, top_k)


def case_batches(cases: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """(log_name, batch): cases in batches of `size`, numbered from 1, in a fixed even order."""
    numbered = bucketed_row_number(cases.select("log_name"), "_rn", hash_bucket("log_name"), ["log_name"])
    return numbered.select("log_name", (F.floor((F.col("_rn") - 1) / size).cast("bigint") + 1).alias("batch"))


def baselines(flows: DataFrame, labels: DataFrame, attack: str = "syn", train_on_all: bool = False) -> DataFrame:
    """Rule score and classifiers against the labels, one metric row per model."""
    rule = rule_scores.syn_rule_score if attack == "syn" else rule_scores.ping_rule_score
    by_rule = metrics.join_predictions(labels, rule_scores.predictions(rule(flows)))
    dataset = profile.feature_dataset(profile.flow_features(flows), labels)
    by_model = ml.compare(dataset, train_on_all=train_on_all)
    return metrics.evaluate(by_rule.withColumn("model", F.lit("rule_based")), ["model"]).unionByName(by_model)


def filtered_and_labelled(flows: DataFrame, rules: DataFrame, anomalies: DataFrame, **window) -> DataFrame:
    """Filter by rules, then label what is left of each log."""
    kept = rule_match.matches_any_rule(flows, rules)
    return labelling.ping_flood_labels(kept, rule_match.anomaly_ip_set(anomalies), **window)
