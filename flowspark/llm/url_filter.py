"""URL filters: listed rules first, then trust and distrust spread over the links between hosts.

Everything is a DataFrame expression; the rule list is the only thing that Python holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import table, written

# (verdict, host and the begin of the path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Rounds end by SMALL_CHANGE: what still moves shrinks by DAMPING a round, so 1e9 seeds need 212 at most. MOST_ROUNDS only guards that.
DAMPING, MOST_ROUNDS, SMALL_CHANGE = 0.85, 1_000, 1e-6
# A host is blocked from this much of the distrust that a wholly blocked host without links has.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
_RULE = "struct<size:int,verdict:string,rule:string,path:string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters, and path; both empty for NULL or a url without `://`."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, NULL if none does; of equal rules block wins.

    The rules lie in a map from their host; a page looks up its host and each
    of its parent domains.
    """
    by_host: dict[str, list[Column]] = {}
    for verdict, rule in rules:
        name, slash, path_begin = rule.partition("/")
        entry = F.struct(*map(F.lit, (len(rule), verdict, rule, slash + path_begin))).cast(_RULE)
        by_host.setdefault(name, []).append(entry)
    if not by_host:
        return F.lit(None).cast(_RULE)
    listed = F.create_map(*[c for name, found in by_host.items() for c in (F.lit(name), F.array(*found))])
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    none = F.array().cast(f"array<{_RULE}>")
    fitting = F.filter(
        F.flatten(F.transform(parents, lambda p: F.coalesce(F.try_element_at(listed, p), none))),
        lambda r: F.startswith(path, r["path"]),
    )
    return F.array_max(fitting)


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, links): links from pages of one host to another host, summed up before they are shuffled."""
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("dst"))
    lowered = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return (
        lowered.filter((F.col("src") != F.col("dst")) & (F.col("src") != ""))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def spread(seeds: DataFrame, edges: DataFrame, damping: float, most_rounds: int, small_change: float) -> DataFrame:
    """Personalised PageRank (kind, host, score) from (kind, host, seed) over (kind, src, dst, share).

    Seeds are not scaled to one, so a score keeps its meaning however many
    seeds there are. Each round is written to the shared folder, which also
    cuts the lineage. What all scores together changed by bounds what any one
    of them, a hub as well, can still change by; it ends when that is at most
    `small_change`, and fails if `most_rounds` do not get there.
    """
    if edges.isEmpty():
        return seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("base"))
    scores = written(start.withColumn("score", F.col("base")).withColumn("change", F.col("base")), "rank")
    moved = None
    for _ in range(most_rounds):
        flow = (
            scores.join(edges.withColumnRenamed("src", "host"), ["kind", "host"])
            .groupBy("kind", F.col("dst").alias("host"))
            .agg((F.sum(F.col("score") * F.col("share")) * damping).alias("flow"))
        )
        new = F.round(F.col("base") + F.coalesce("flow", F.lit(0.0)), 12)
        scores = written(
            scores.join(flow, ["kind", "host"], "left").select(
                "kind", "host", "base", new.alias("score"), F.abs(new - F.col("score")).alias("change")
            ),
            "rank",
        )
        moved = scores.groupBy("kind").agg(F.sum("change").alias("moved")).agg(F.max("moved")).first()[0] or 0.0
        if moved * damping <= small_change * (1 - damping):
            return scores.select("kind", "host", "score")
    raise RuntimeError(f"scores still move by {moved} after {most_rounds} rounds")


def judge_hosts(
    judged: DataFrame,
    edges: DataFrame,
    damping: float = DAMPING,
    most_rounds: int = MOST_ROUNDS,
    small_change: float = SMALL_CHANGE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(host, trust, distrust, blocked) from (host, verdict of its rule or NULL) and host edges.

    A host is as much of a trusted (blocked) seed as rules allow (block) of its
    pages. Trust follows links, distrust goes against them: who links to
    blocked hosts is distrusted.
    """
    seeds = judged.groupBy("host").agg(
        (F.count_if(F.col("verdict") == "allow") / F.count(F.lit(1))).alias("trust"),
        (F.count_if(F.col("verdict") == "block") / F.count(F.lit(1))).alias("distrust"),
    )
    edges = written(edges, "edges")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = seeds.join(linked, "host", "full").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])
    # One row per host and kind, one per edge and kind: both kinds go through the same rounds.
    seeds_of_both = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
    sent = edges.groupBy("src").agg(F.sum("links").alias("sent"))
    got = edges.groupBy("dst").agg(F.sum("links").alias("got"))
    forward = edges.join(sent, "src").select(
        F.lit("trust").alias("kind"), "src", "dst", (F.col("links") / F.col("sent")).alias("share")
    )
    backward = edges.join(got, "dst").select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("got")).alias("share")
    )
    scores = spread(written(seeds_of_both, "seeds"), written(forward.unionByName(backward), "shares"), damping, most_rounds, small_change)
    both = scores.groupBy("host").agg(
        F.max(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
        F.max(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"),
    )
    blocked = (F.col("distrust") >= threshold * (1 - damping)) & (F.col("distrust") > F.col("trust"))
    return both.withColumn("blocked", blocked)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    **settings,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and its host's trust and distrust.

    A page that no rule fits gets the verdict of its host: block if distrust
    reaches the threshold and exceeds trust, else allow. NULL urls and urls
    without `://` have an empty host, which no link reaches. NULL html has no
    links. Repeated pages each give a row and count as pages of their host; an
    empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    judged = named.withColumn("_rule", rule).select(
        "_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("listed")
    )
    hosts = judge_hosts(
        judged.select("host", F.col("listed").alias("verdict")), host_edges(pages, host, F.col(html_col)), **settings
    )
    verdicts = written(hosts, "hosts")
    verdict = F.coalesce("listed", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.join(verdicts, "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
