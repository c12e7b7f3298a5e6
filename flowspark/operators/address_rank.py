"""The documents of a case's addresses that share most with the case's words, without its pairs of case and document.

A hot address joins many cases to many documents, so pairs grow with the square
of the tables. Two things decide a score instead. Words that many cases and
many documents have are the common ones, a few: documents with the same common
words are a class, cases with the same ones a kind, and a kind's best documents
of an address are found once. The other words are rare and meet one by one,
within the address. The best of a case are among those of its kind and those
that share a rare word; any choice of common words gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.scale import never_broadcast, top_per_group
from flowspark.operators.retrieval import SUM_DIGITS
from flowspark.session import cut_lineage

# At most so many words are common, and only those with this many pairs of a case and a document.
COMMON_WORDS, COMMON_PAIRS = 64, 10_000


def best_by_address(
    ips: DataFrame, words: DataFrame, index: DataFrame, weights: DataFrame, top_k: int, common_words: int = COMMON_WORDS, common_pairs: int = COMMON_PAIRS
) -> DataFrame:
    """(log_name, doc_id, score): the rows that `lexical_rerank` has over all pairs that `ip_evidence` makes.

    Takes (log_name, ip), (log_name, word), (doc_id, ip) and (doc_id, token,
    weight), each without repeats; weights are not negative. A document that
    shares nothing has score 0.
    """
    index = cut_lineage(index.join(ips.select("ip").distinct(), "ip", "left_semi"), "address-index")
    terms = weights.filter("weight > 0").join(index.select("doc_id").distinct(), "doc_id", "left_semi")
    terms = cut_lineage(terms.select("doc_id", "token", "weight"), "address-terms")
    in_docs = terms.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    words = cut_lineage(words.withColumnRenamed("word", "token").join(in_docs, "token", "left_semi"), "address-words")
    in_cases = words.groupBy("token").agg(F.count(F.lit(1)).alias("cases"))
    pairs = in_docs.join(in_cases, "token").select("token", (F.col("docs") * F.col("cases")).alias("pairs"))
    frequent = pairs.filter(F.col("pairs") >= common_pairs).orderBy(F.desc("pairs"), "token").limit(common_words)
    is_common = F.col("token").isin([row["token"] for row in frequent.collect()])

    shown = terms.filter(is_common).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("class"))
    none = F.array().cast("array<struct<token:string,weight:double>>")
    classes = cut_lineage(index.select("doc_id").distinct().join(shown, "doc_id", "left").select("doc_id", F.coalesce("class", none).alias("class")), "classes")
    said = words.filter(is_common).groupBy("log_name").agg(F.sort_array(F.collect_set("token")).alias("kind"))
    named = ips.join(said, "log_name", "left").withColumn("kind", F.coalesce("kind", F.array().cast("array<string>")))
    cases = cut_lineage(named.join(index.select("ip").distinct(), "ip", "left_semi").select("log_name", "ip", "kind"), "kinds")

    firsts = top_per_group(index.join(classes, "doc_id"), ["ip", "class"], ["doc_id"], top_k)
    firsts = firsts.groupBy("ip", "class").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    kinds = cases.select("kind", "ip").distinct().join(never_broadcast(firsts), "ip")
    # Classes by their first document: the best `top_k` documents are of the best `top_k` classes.
    scored = kinds.select("kind", "ip", "docs", F.round(_shared("class", "kind"), SUM_DIGITS).alias("score"))
    best = top_per_group(scored, ["kind", "ip"], [F.desc("score"), F.col("docs")[0]], top_k)
    best = best.select("kind", "ip", F.explode("docs").alias("doc_id"), "score")
    best = top_per_group(best, ["kind", "ip"], [F.desc("score"), "doc_id"], top_k)
    by_kind = never_broadcast(cases).join(best, ["kind", "ip"]).select("log_name", "doc_id", "score")

    rare = cut_lineage(terms.filter(~is_common).join(in_cases, "token", "left_semi").join(index, "doc_id"), "rare-terms")
    met = never_broadcast(words.filter(~is_common)).join(rare.select("token", "ip").distinct(), "token")
    met = met.join(never_broadcast(cases), ["log_name", "ip"])
    met = met.join(never_broadcast(rare), ["token", "ip"]).groupBy("log_name", "doc_id", "token").agg(F.max("weight").alias("weight"), F.first("kind").alias("kind"))
    sums = met.groupBy("log_name", "doc_id").agg(F.sum("weight").alias("rare"), F.first("kind").alias("kind")).join(classes, "doc_id")
    by_word = sums.select("log_name", "doc_id", F.round(F.col("rare") + _shared("class", "kind"), SUM_DIGITS).alias("score"))

    # A document that is in both has its whole score by its rare words, which only add to it.
    whole = by_kind.unionByName(by_word).groupBy("log_name", "doc_id").agg(F.max("score").alias("score"))
    return top_per_group(whole, ["log_name"], [F.desc("score"), "doc_id"], top_k)


def _shared(words: str, kind: str) -> Column:
    """Summed weight of the words that the kind has."""
    return F.aggregate(
        F.filter(words, lambda w: F.array_contains(F.col(kind), w["token"])), F.lit(0.0), lambda total, w: total + w["weight"]
    )
