"""URL rules, and link-graph propagation for hosts that no rule decides, with DataFrame functions only.

Host edges are pages' absolute links to other hosts. Trust flows along edges from hosts whose pages
rules allow, distrust against them from hosts whose pages rules block; both are
personalised PageRank, iterated a fixed number of rounds. A host is blocked if
its distrust reaches ``threshold`` times its trust, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, cut, drop_cut, table

#: The rules of the query, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null; of equal lengths the first given."""
    found = [
        (len(h) + len(p), F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
        for v, h, p in rules
    ]
    return F.coalesce(*[c for _, c in sorted(found, key=lambda x: -x[0])])


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: pages of one host that link to another."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.lower(F.regexp_replace(h, r"^.*@|:\d*$", ""))))
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("dst != src and dst != ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = 0.85) -> DataFrame:
    """``host, score`` of personalised PageRank: (src, dst, weight) edges, (host, weight) seeds.

    A host without outgoing edges gives its score back to the seeds by dropping
    it. Scores of hosts out of reach are left out. No seeds, no rows.
    """
    spark = edges.sparkSession
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = cut(seeds.select("host", (F.col("weight") / F.lit(total)).alias("base")))
    if edges.isEmpty():
        return start.select("host", (F.col("base") * (1 - damping)).alias("score"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    score, written = start.select("host", F.col("base").alias("score")), None
    for i in range(rounds):
        flow = share.join(score, share["src"] == score["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("in"))
        new = start.join(flow, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) * (1 - damping) + F.coalesce("in", F.lit(0.0)) * damping).alias("score"))
        # Lineage is cut every few rounds, as rounds nest.
        if i % 4 == 3 or i == rounds - 1:
            new = cut(new)
            if written is not None:
                drop_cut(spark, written)
            written = new
        score = new
    return score


def host_verdicts(pages: DataFrame, threshold: float = 1.0, rounds: int = 12) -> DataFrame:
    """``host, trust, distrust, blocked`` for hosts that trust or distrust reaches; ``pages`` has host, html and verdict (null: none)."""
    edges = cut(host_edges(pages))
    seeds = pages.where("verdict is not null and host != ''").groupBy("verdict", "host").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    seeds = cut(seeds)
    trust = pagerank(edges, seeds.where("verdict = 'allow'").select("host", "weight"), rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = pagerank(back, seeds.where("verdict = 'block'").select("host", "weight"), rounds)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full").fillna(0.0, ["trust", "distrust"])
    return both.withColumn("blocked", (F.col("distrust") > 0) & (F.col("distrust") >= threshold * F.col("trust")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 1.0, rounds: int = 12) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict and ``by`` (rule or graph).

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest decides. Otherwise the host's verdict from the link graph
    does; a host that neither trust nor distrust reaches, and an empty one, is
    allowed. Null urls have no host, null html no links; equal rows get equal
    verdicts, long pages are read whole. Columns with the names of the results are
    replaced; an empty table gives no rows.
    """
    new = ["host", "path", "rule", "verdict", "by"]
    rows, at, kept = by_place(pages, ("url", "html"), set(new))
    url = F.col(at["url"]).cast("string")
    parsed = rows.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    graph = host_verdicts(parsed.select("host", F.col(at["html"]).cast("string").alias("html"), F.col("__r.verdict").alias("verdict")), threshold, rounds).where("blocked").select("host", "blocked")
    verdict = F.coalesce("__r.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    out = parsed.join(graph, "host", "left").select(*[at[c] for c in kept], "host", "path", F.col("__r.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("__r").isNotNull(), "rule").otherwise("graph").alias("by"))
    return out.toDF(*kept, *new)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged by the rules or, without one, by its host's place in the link graph."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "by")
