"""URL filter: rules first, then trust and distrust spread over the host graph.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a
rule blocks are distrusted ones. Trust is a personalised PageRank along links;
distrust runs along reversed links, so a host that links to bad hosts earns
some. Edges are hyperlinks between hosts, and both ways between a domain and its
parent domain of two labels or more, whether that has pages or not. A host is blocked when its share of distrust reaches
the threshold.

Defined results for odd input: a null url, or one without ``://``, has empty
host and path and is allowed unless a rule for the empty host says otherwise;
null html has no links; repeated pages count each time as seeds; of rules that
fit equally long the one that blocks wins, and equal trust and distrust block; a
url or html of any length is read whole; other columns are ignored; an empty
table gives an empty result. Trust and distrust are defined by ``ROUNDS`` steps,
so a host further than that from every seed has neither and is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import cut

ROUNDS = 8
DAMPING = 0.85
THRESHOLD = 0.5
#: So many rules are compared in one expression; a longer list is joined as a table.
MOST_RULES = 500
_AFTER = r"://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", False), Rule("example.com", "/en/7", True), Rule("net", "/de/", True),
    Rule("example.net", "/de/8", False), Rule("org", "/es/", False),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Longest fitting rule as struct(size, strict, name, allow), or null; of equal ones, the one that blocks."""
    none = F.lit(None).cast("struct<size:int,strict:boolean,name:string,allow:boolean>")
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.name)).alias("size"), F.lit(not r.allow).alias("strict"), F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))).otherwise(none)
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else none


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.allow) for r in rules], "rule_host string, rule_path string, allow boolean")


def with_rules(located: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """``located`` (host, path, ...) with ``hit``; a long list, or a table (rule_host, rule_path, allow), is joined.

    Each distinct host and path meets the rules of the host and of its parent domains.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            return located.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
        rules = rule_table(located.sparkSession, rules)
    labels = F.split("host", r"\.", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    met = located.select("host", "path").distinct().withColumn("rule_host", F.explode(up)).join(rules, "rule_host").where("startswith(path, rule_path)")
    name = F.concat("rule_host", "rule_path")
    hit = F.max(F.struct(F.length(name).alias("size"), (~F.col("allow")).alias("strict"), name.alias("name"), "allow")).alias("hit")
    return located.join(met.groupBy("host", "path").agg(hit), ["host", "path"], "left")


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) from absolute links and from the domain hierarchy."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?https?://([^/?#"'\s>]*)"""), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    out = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst")).where("src <> dst and dst <> ''")
    labels = F.split("host", r"\.")
    named = hosts.where(F.size(labels) > 2).where("not host rlike '^[0-9.]+$'")
    level = F.explode(F.sequence(F.lit(1), F.size(labels) - 2)).alias("i")
    suffix = lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    up = named.select("host", level).select(suffix(F.col("i")).alias("src"), suffix(F.col("i") + 1).alias("dst")).distinct()
    return out.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, name: str = "urls") -> DataFrame:
    """(host, score): PageRank that restarts at ``seeds`` (host, weight) along ``edges`` (src, dst)."""
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    seeds = cut(seeds.where("weight > 0").select("host", (F.col("weight") / total).alias("weight")), f"{name}-seeds")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    walks = cut(edges.join(degree, "src"), f"{name}-walks")
    rank = seeds.select("host", F.col("weight").alias("score"))
    if walks.isEmpty():
        return rank.withColumn("score", F.col("score") * (1 - damping))
    for _ in range(rounds):
        moved = walks.join(rank, walks.src == rank.host).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("flow"))
        restart = seeds.select("host", (F.col("weight") * (1 - damping)).alias("score"))
        rank = cut(restart.unionByName(moved.select(F.col("dst").alias("host"), (F.col("flow") * damping).alias("score"))).groupBy("host").agg(F.sum("score").alias("score")), f"{name}-rank")
    return rank


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, per page."""
    url = F.col(url_col).cast("string")
    located = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    ruled = with_rules(located, rules)
    per_host = cut(ruled.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("hit.allow")).alias("allowed"), F.count_if(~F.col("hit.allow")).alias("blocked")), "urls-hosts")
    edges = cut(host_edges(located, per_host), "urls-edges")
    trust = spread(per_host.select("host", F.col("allowed").cast("double").alias("weight")), edges, rounds, name="urls-trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(per_host.select("host", F.col("blocked").cast("double").alias("weight")), back, rounds, name="urls-distrust")
    scores = per_host.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0)
    scores = cut(scores.withColumn("bad", (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))), "urls-scores")
    blocked = F.when(F.col("hit").isNotNull(), ~F.col("hit.allow")).otherwise(F.coalesce("bad", F.lit(False)))
    return (
        ruled.drop("html").join(scores, "host", "left")
        .select("page_id", "host", "path", F.col("hit.name").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), "trust", "distrust")
    )
