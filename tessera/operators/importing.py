"""Import statistics: counters of names and paths, priors, co-occurrence, and the two ranking queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.imports_text import go_imports, go_package_names, go_references, own_package
from tessera.operators.ranks import top_per
from tessera.sources.storage import cut

#: Steps per nat of stored weights, and their bounds.
STEPS, MOST_PRIOR, MOST_PMI = 16, 255, 127
#: Present imports whose partners a task sums up; each has a few dozen at most.
PART_PRESENT = 100_000


def q_logp(p: Column) -> Column:
    """-ln p in sixteenths of a nat, 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(MOST_PRIOR), F.bround(-F.log(p) * STEPS).cast("int")))


def q_pmi(x: Column) -> Column:
    return F.greatest(F.lit(-MOST_PMI), F.least(F.lit(MOST_PMI), F.bround(x * STEPS).cast("int")))


def go_references_resolved(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """imports (doc, repo, path) and uses (doc, path, name, pkg) of Go files (doc, repo, text).

    A qualifier stands for an alias first, then for a path's likeliest package
    name, then for other spellings; among equals the first import wins.
    """
    parsed = files.select("doc", "repo", go_imports(F.col("text")).alias("imports"), go_references(F.col("text")).alias("refs"))
    each = parsed.select("doc", "repo", F.posexplode("imports").alias("i", "x")).select("doc", "repo", "i", "x.alias", "x.path").where(~own_package(F.col("path"), F.col("repo")))
    named = F.when(F.col("alias").isin("_", "."), F.array().cast("array<string>")).when(F.col("alias") != "", F.array("alias")).otherwise(go_package_names(F.col("path")))
    spelled = each.select("doc", "path", "i", "alias", F.posexplode(named).alias("k", "pkg"))
    level = F.when(F.col("alias") != "", 0).when(F.col("k") == 0, 1).otherwise(2)
    resolved = spelled.groupBy("doc", "pkg").agg(F.min_by("path", F.struct(level, "i", "k")).alias("path"))
    refs = parsed.select("doc", F.explode("refs").alias("r")).select("doc", "r.pkg", "r.name")
    return each.select("doc", "repo", "path").distinct(), refs.join(resolved, ["doc", "pkg"]).select("doc", "path", "name", "pkg").distinct()


def local_removed(usings: DataFrame, declared: DataFrame) -> DataFrame:
    """Usings (doc, repo, path) without namespaces that their repository declares itself."""
    return usings.join(declared.select("repo", F.col("namespace").alias("path")).distinct(), ["repo", "path"], "left_anti")


@dataclass
class Counters:
    """docs (one row), path_doc, name_doc, name_path and pair counts over documents; decl and qual where known."""

    docs: DataFrame
    path_doc: DataFrame
    name_doc: DataFrame
    name_path: DataFrame
    pair: DataFrame


def count(uses: DataFrame) -> Counters:
    """Counters of distinct (doc, path, name) rows; unordered pairs are made within a document's own list of imports."""
    paths = uses.select("doc", "path").distinct()
    sets = paths.groupBy("doc").agg(F.sort_array(F.collect_list("path")).alias("p")).where(F.size("p") >= 2)
    ahead = F.transform("p", lambda a, i: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = sets.select(F.explode(F.flatten(ahead)).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("c"))
    return Counters(
        paths.agg(F.count_distinct("doc").alias("docs")), paths.groupBy("path").agg(F.count("*").alias("c")),
        uses.select("doc", "name").distinct().groupBy("name").agg(F.count("*").alias("c")), uses.select("doc", "name", "path").distinct().groupBy("name", "path").agg(F.count("*").alias("c")), pairs,
    )


def count_baskets(baskets: DataFrame) -> Counters:
    """``count`` of (doc, items), one row a document with its distinct items (array<struct<path, name>>), whose paths and names are ids.

    Every counter is made of a document's own row; a pair is one long until it is counted.
    """
    paths = baskets.select(F.array_distinct(F.transform("items", lambda x: x["path"])).alias("p"))
    names = baskets.select(F.explode(F.array_distinct(F.transform("items", lambda x: x["name"]))).alias("name"))
    both = baskets.select(F.explode("items").alias("x")).groupBy(F.col("x.name").alias("name"), F.col("x.path").alias("path")).agg(F.count("*").alias("c"))
    ahead = F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))))
    pairs = paths.select(F.explode(F.flatten(ahead)).alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    return Counters(
        baskets.agg(F.count("*").alias("docs")), paths.select(F.explode("p").alias("path")).groupBy("path").agg(F.count("*").alias("c")), names.groupBy("name").agg(F.count("*").alias("c")), both,
        pairs.select(F.shiftright("x", 32).cast("int").alias("a"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "c"),
    )


def merged(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Counters of several runs as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.sum("c").alias("c"))


def usage_weights(c: Counters, min_count: int, excess: bool, excess_share: float = 0.0, excess_rel: float = 0.0) -> DataFrame:
    """name, path, w: counts, or what exceeds chance; weak ones stay if they come near the name's strongest."""
    base = c.name_path.where(F.col("c") >= min_count)
    if not excess:
        return base.select("name", "path", F.col("c").cast("double").alias("w"))
    joined = base.join(c.name_doc.select("name", F.col("c").alias("cn")), "name").join(c.path_doc.select("path", F.col("c").alias("cp")), "path").crossJoin(F.broadcast(c.docs))
    w = joined.withColumn("w", F.col("c") - F.col("cn") * F.col("cp") / F.col("docs")).where(F.col("w") >= min_count)
    strong = F.col("w") >= excess_share * F.col("cn")
    top = F.max(F.when(strong, F.col("w"))).over(Window.partitionBy("name"))
    return w.withColumn("strong", strong).withColumn("top", top).where(F.col("strong") | (F.lit(excess_rel > 0) & (F.col("w") >= excess_rel * F.col("top")))).select("name", "path", "w")


def with_declarations(weights: DataFrame, decl: DataFrame, path_doc: DataFrame, min_use: int, weight: float, rel: float) -> DataFrame:
    """Weights plus what declarations (name, path, c) of namespaces in use add."""
    used = decl.join(path_doc.where(F.col("c") >= min_use).select("path"), "path", "left_semi")
    tops = weights.groupBy("name").agg(F.max("w").alias("top"))
    added = used.join(tops, "name", "left").select("name", "path", (F.greatest(F.lit(weight), rel * F.coalesce("top", F.lit(0.0))) * F.col("c")).alias("w"))
    return weights.unionByName(added).groupBy("name", "path").agg(F.sum("w").alias("w"))


def priors(weights: DataFrame, top: int = 16, min_total: float = 3.0) -> DataFrame:
    """name, doc, path, rank, q: the strongest paths of every name with quantised -ln p."""
    kept = top_per(weights, ["name"], [F.col("w").desc(), F.col("path")], top)
    total = F.sum("w").over(Window.partitionBy("name"))
    return kept.withColumn("total", total).where(F.col("total") >= min_total).select("name", F.bround("total").cast("int").alias("doc"), "path", "rank", q_logp(F.col("w") / F.col("total")).alias("q"))


def pmi_lists(c: Counters, min_count: int, min_doc: int, top: int = 32) -> DataFrame:
    """path, other, c, rank, q: partners of every frequent path, both ways, with quantised pointwise mutual information."""
    often = c.path_doc.where(F.col("c") >= min_doc)
    side = lambda s: often.select(F.col("path").alias(s), F.col("c").alias(f"c_{s}"))
    known = c.pair.where(F.col("c") >= min_count).join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(c.docs))
    q = known.select("a", "b", "c", q_pmi(F.log(F.col("c") * F.col("docs") / (F.col("c_a") * F.col("c_b")))).alias("q"))
    both = q.select(F.col("a").alias("path"), F.col("b").alias("other"), "c", "q").unionByName(q.select(F.col("b").alias("path"), F.col("a").alias("other"), "c", "q"))
    return top_per(both, ["path"], [F.col("c").desc(), F.col("other")], top)


def path_table(prior: DataFrame, path_doc: DataFrame, min_doc: int) -> DataFrame:
    """Paths that a name uses or that are frequent, with their documents."""
    used = prior.select("path").union(path_doc.where(F.col("c") >= min_doc).select("path")).distinct()
    return path_doc.join(used, "path", "left_semi")


def rank_imports(queries: DataFrame, context: DataFrame, prior: DataFrame, pmi: DataFrame, known: DataFrame, weight: float = 1.0, norm: str = "sum") -> DataFrame:
    """query, path, score, rank for queries (query, name) with present imports ``context`` (query, path).

    Score: ln p(path | name) + weight * sum of PMI with the present imports, a pair read from either side.
    A query has one row and one name; its list of paths stays one row until it is ranked.
    """
    # what a name's paths and a present import have in common, for pairs that have it: prior holds few paths a name
    own = prior.select("name", "path", "q")
    one = pmi.select("path", F.col("other").alias("present"), F.lit(0).alias("side"), "q")
    two = pmi.select(F.col("other").alias("path"), F.col("path").alias("present"), F.lit(1).alias("side"), "q")
    sides = one.unionByName(two).join(own.select("path").distinct(), "path", "left_semi").where("path <> present")
    related = sides.groupBy("path", "present").agg(F.min_by("q", "side").alias("pair_q")).join(own.select("name", "path"), "path")
    near = context.select("query", F.col("path").alias("present")).join(queries, "query").join(related, ["name", "present"])
    near = near.join(known.select(F.col("path").alias("present")), "present", "left_semi")
    found = near.groupBy("query", "path").agg(F.sum("pair_q").alias("pmi")).groupBy("query").agg(F.collect_list(F.struct("path", "pmi")).alias("found"))
    lists = own.groupBy("name").agg(F.collect_list(F.struct("path", "q")).alias("list"))
    scored = queries.join(lists, "name").join(found, "query", "left")
    scale = F.lit(1.0)
    if norm != "sum":
        sizes = context.join(known.select("path"), "path", "left_semi").groupBy("query").agg(F.count("*").alias("n_ctx"))
        scored, n = scored.join(sizes, "query", "left"), F.greatest(F.coalesce("n_ctx", F.lit(0)), F.lit(1))
        scale = F.when(F.col("n_ctx") > 0, 1 / {"sqrt": F.sqrt(n), "mean": n}[norm]).otherwise(0.0)
    empty = F.array().cast("array<struct<path:" + prior.schema["path"].dataType.simpleString() + ",pmi:bigint>>")
    met = F.coalesce("found", empty)
    pair = lambda x: F.aggregate(F.filter(met, lambda f: f["path"] == x["path"]), F.lit(0).cast("long"), lambda acc, f: acc + f["pmi"])
    each = F.transform("list", lambda x: F.struct(x["path"].alias("path"), ((-x["q"] + weight * pair(x) * scale) / STEPS).alias("score")))
    order = F.array_sort(F.transform(each, lambda x: F.struct((-F.round(x["score"], 9)).alias("minus"), x["path"].alias("path"), x["score"].alias("score"))))
    return scored.select("query", F.posexplode(order).alias("place", "x")).select("query", "x.path", "x.score", (F.col("place") + 1).alias("rank"))


def rank_co_imports(context: DataFrame, pmi: DataFrame, path_doc: DataFrame, docs: DataFrame, limit: int = 20) -> DataFrame:
    """query, path, score, rank: what usually goes with the present imports, which are not returned themselves."""
    beside = context.groupBy("query").agg(F.collect_set("path").alias("present"))
    near = beside.select("query", "present", F.explode("present").alias("own")).join(pmi.select(F.col("path").alias("own"), F.col("other").alias("path"), "q"), "own")
    parts = max(1, -(-context.count() // PART_PRESENT))
    fresh = near.where(~F.array_contains("present", F.col("path"))).select("query", "path", "q").repartition(parts, "query").groupBy("query", "path").agg(F.sum("q").alias("pmi"))
    prior = path_doc.crossJoin(F.broadcast(docs)).select("path", q_logp(F.col("c") / F.col("docs")).alias("prior"))
    scored = fresh.join(prior, "path").select("query", "path", ((F.col("pmi") - F.col("prior")) / STEPS).alias("score"))
    return top_per(scored, ["query"], [F.round("score", 9).desc(), F.col("path")], limit)


def hide_one(truth: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: queries, known, top1, top3 over all and top1 over the known, for truth (query, path)."""
    known = ranked.select("query").distinct().withColumn("known", F.lit(True))
    hit = truth.join(ranked, ["query", "path"], "left").join(known, "query", "left")
    top = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    n = F.count_if("known")
    return hit.agg(F.count("*").alias("queries"), n.alias("known"), F.round(top(1), 6).alias("top1"), F.round(top(3), 6).alias("top3"), F.round(F.count_if(F.col("rank") == 1) / F.greatest(n, F.lit(1)), 6).alias("top1_known"))


def co_hits(truth: DataFrame, context: DataFrame, ranked: DataFrame, path_doc: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """k, queries, hit, baseline: shares of hidden imports among the first k, against the most frequent paths not present.

    The baseline only needs the first k + |context| paths by frequency, whose number is measured.
    """
    widest = context.groupBy("query").count().agg(F.max("count")).first()[0] or 0
    frequent = path_doc.orderBy(F.col("c").desc(), "path").limit(max(ks) + widest).withColumn("place", F.row_number().over(Window.orderBy(F.col("c").desc(), "path")))
    ahead = context.join(F.broadcast(frequent), "path").select("query", F.col("place").alias("taken"))
    own = truth.join(F.broadcast(frequent), "path", "left").join(ahead.groupBy("query").agg(F.collect_list("taken").alias("taken")), "query", "left")
    base = F.col("place") - F.size(F.filter(F.coalesce("taken", F.array().cast("array<int>")), lambda t: t < F.col("place")))
    hit = own.withColumn("base", base).join(ranked.select("query", "path", "rank"), ["query", "path"], "left")
    each = hit.select("rank", "base", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    share = lambda c: F.round(F.avg(F.when(F.col(c) <= F.col("k"), 1.0).otherwise(0.0)), 6)
    return each.groupBy("k").agg(F.count("*").alias("queries"), share("rank").alias("hit"), share("base").alias("baseline"))


def unique_declaration(idents: DataFrame, usings: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc, name, path) where exactly one using of the document declares the name."""
    hits = idents.join(declared, "name").join(usings, ["doc", "path"])
    return hits.select("doc", "name", "path").distinct().withColumn("n", F.count("*").over(Window.partitionBy("doc", "name"))).where("n = 1").drop("n")


def saved(c: Counters, min_pair: int = 1) -> Counters:
    """Counters written once, for several uses; of the pairs only those seen ``min_pair`` times, where no use asks for others."""
    kept = {"pair": c.pair.where(F.col("c") >= min_pair)}
    return Counters(*[cut(kept.get(f, getattr(c, f)), f"imports-{f}") for f in ("docs", "path_doc", "name_doc", "name_path", "pair")])
