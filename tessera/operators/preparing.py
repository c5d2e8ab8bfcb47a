"""Corpus preparation: folds, reasons, caps, budgets and the manifest with its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import md5_prefix
from tessera.functions.filerules import early_reason, line_count, text_reason
from tessera.operators import dedup
from tessera.operators.ranks import bucketed_rank, running_total, top_per
from tessera.sources.storage import cut

FOLDS = ["lm", "rank", "test"]


def fold_order(fold: Column) -> Column:
    return F.when(fold == "lm", 0).when(fold == "rank", 1).otherwise(2)


def assign_folds(repos: DataFrame, test_repos: int) -> DataFrame:
    """repo, place, fold: in order of a digest, the first go to test, every third of the rest to rank, others to lm.

    The digest is uniform, so its first three digits deal repositories to ranking buckets of equal size.
    """
    named = repos.select("repo").distinct().withColumn("digest", md5_prefix(F.col("repo")))
    ranked = bucketed_rank(named, F.substring("digest", 1, 3), [F.col("digest"), F.col("repo")], "place")
    fold = F.when(F.col("place") <= test_repos, "test").when((F.col("place") - test_repos) % 3 == 0, "rank").otherwise("lm")
    return ranked.select("repo", "place", fold.alias("fold"))


def select_repos(repos: DataFrame, min_stars: int, most: int) -> DataFrame:
    """The ``most`` repositories with the most stars, at least ``min_stars``; ties by name."""
    return repos.where(F.col("stars") >= min_stars).orderBy(F.col("stars").desc(), "repo").limit(most)


def with_catalogue(repos: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Repositories with stars (0 if unknown), licence (none or unknown) and whether the catalogue has them."""
    known = catalogue.select("repo", "stars", F.coalesce("license", F.lit("none")).alias("license"), F.lit(True).alias("in_catalog"))
    return repos.join(known, "repo", "left").select("repo", F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("license", F.lit("unknown")).alias("license"), F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"))


def owner_quota(repos: DataFrame, quota: Column, most: int) -> DataFrame:
    """Best repositories by stars with at most ``quota`` of each owner, then the first ``most``."""
    by_owner = Window.partitionBy("owner").orderBy(F.col("stars").desc(), "repo")
    return repos.withColumn("owner_rank", F.row_number().over(by_owner)).where(F.col("owner_rank") <= quota).orderBy(F.col("stars").desc(), "repo").limit(most)


def curated(repos: DataFrame, created_before: str, topic_pattern: str, text_pattern: str) -> DataFrame:
    """Repositories by language share, age, forks against stars, watchers, and what their topics and descriptions say."""
    words = F.lower(F.concat_ws(" ", F.col("repo"), F.concat_ws(" ", "topics")))
    return repos.where(
        (F.col("share") >= 0.6) & (F.col("created_at") < F.lit(created_before)) & (F.col("forks") / F.col("stars") >= 0.03)
        & (F.col("forks") <= F.col("stars")) & (F.col("watchers") >= 20) & ~words.rlike(topic_pattern) & ~F.lower(F.coalesce("description", F.lit(""))).rlike(text_pattern)
    )


def fresh_set(manifest: DataFrame, catalogue: DataFrame, created_from: str, min_lines: int) -> DataFrame:
    """Kept files of repositories created late, outside lm, with enough lines; their fold becomes test."""
    late = catalogue.where(F.col("created_at") >= F.lit(created_from)).select("repo")
    ok = manifest.where("status = 'ok' and fold <> 'lm'").join(late, "repo", "left_semi")
    enough = ok.groupBy("repo").agg(F.sum("lines").alias("n")).where(F.col("n") >= min_lines).select("repo")
    return ok.join(enough, "repo", "left_semi").withColumn("fold", F.lit("test"))


def offer_key() -> list[Column]:
    """The order in which files are offered: fold, stars, repository, path."""
    return [fold_order(F.col("fold")), F.col("stars").desc(), F.col("repo"), F.col("path")]


def sort_key() -> list[Column]:
    """``offer_key`` with ascending columns only."""
    return [fold_order(F.col("fold")), -F.col("stars"), F.col("repo"), F.col("path")]


def offer_order(files: DataFrame) -> DataFrame:
    """``files`` (fold, stars, repo, path, ...) with offer_seq, from 1."""
    return running_total(files, sort_key(), F.lit(1), "offer_seq")


def cap_per_repo(files: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files of each repository in path order."""
    return top_per(files, ["repo"], [F.col("path")], most, "path_rank")


def budget_cut(files: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Status ``budget`` for files offered once their fold holds its budget of bytes."""
    total = running_total(files, sort_key(), F.col("bytes"), "upto")
    per = files.groupBy("fold").agg(F.sum("bytes").alias("fold_bytes"))
    starts = per.withColumn("start", F.coalesce(F.sum("fold_bytes").over(Window.orderBy(fold_order(F.col("fold"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))]), F.col("fold")), F.lit(0))
    before = F.col("upto") - F.col("bytes") - F.col("start")
    return total.join(F.broadcast(starts.select("fold", "start")), "fold").withColumn("status", F.when(before >= limit, "budget").otherwise("ok")).drop("upto", "start")


def described(files: DataFrame) -> DataFrame:
    """bytes, lines, words and the reason (or null) of every text file."""
    text = F.col("text")
    return files.withColumns({
        "bytes": F.octet_length(text).cast("long"), "lines": line_count(text), "tokens": F.regexp_count(text, F.lit(r"\S+")),
        "reason": F.coalesce(early_reason(F.lit(False), F.octet_length(text), F.col("path")), text_reason(text)),
    })


def manifest(files: DataFrame, folds: DataFrame, budgets: dict[str, int], tokens: Column, identifiers: Column, threshold: float = 0.8) -> DataFrame:
    """repo, path, bytes, lines, tokens, fold, status of every file.

    Status is the first of: a content reason, budget, dup_exact, dup_near, ok. A file beyond its fold's budget
    of kept bytes is not offered to the duplicate filter, so folds are judged one after another, each
    against what the folds before it offered.
    """
    known = described(files).join(folds, "repo")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_key())])
    good = cut(known.where("reason is null").select("*", key.alias("file_key"), tokens.alias("seq"), identifiers.alias("words")), "manifest-files")
    cols = ["repo", "path", "bytes", "lines", "tokens", "fold", "status"]
    out = known.where("reason is not null").select(*cols[:-1], F.col("reason").alias("status"))
    offered = None
    for fold in FOLDS:
        own = good.where(F.col("fold") == fold)
        pool = own if offered is None else offered.unionByName(own)
        verdicts = dedup.greedy(pool.select("file_key", F.col("seq").alias("tokens"), "words"), "file_key", threshold)
        judged = cut(own.join(verdicts, "file_key"), "manifest-fold")
        status = F.col("verdict")
        if fold in budgets:
            late = budget_cut(judged.where("verdict = 'ok'"), budgets).where("status = 'budget'")
            first = late.agg(F.min("file_key").alias("first"))
            judged = judged.crossJoin(F.broadcast(first))
            status = F.when(F.col("file_key") >= F.col("first"), "budget").otherwise(status)
        judged = judged.withColumn("status", status)
        out = out.unionByName(judged.select(*cols))
        fresh = judged.where("status <> 'budget'").select(*good.columns)
        offered = fresh if offered is None else offered.unionByName(fresh)
    return out


def drop_counters(manifest: DataFrame) -> DataFrame:
    """reason, files, bytes of what was dropped."""
    return manifest.where("status <> 'ok'").groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def fold_totals(manifest: DataFrame) -> DataFrame:
    """Per fold: repositories, those with data, kept files, bytes, lines, tokens, and duplicates with their share of bytes."""
    ok, dup = F.col("status") == "ok", F.col("status").startswith("dup")
    return manifest.groupBy("fold").agg(
        F.count_distinct("repo").alias("repos"), F.count_distinct(F.when(ok, F.col("repo"))).alias("repos_with_data"), F.count_if(ok).alias("files"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(ok, F.col("lines"))), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(dup).alias("dup_files"), F.coalesce(F.sum(F.when(dup, F.col("bytes"))), F.lit(0)).alias("dup_bytes"),
    )


def licenses(manifest: DataFrame, repos: DataFrame) -> DataFrame:
    """license, repos, bytes kept."""
    per = manifest.where("status = 'ok'").groupBy("repo").agg(F.sum("bytes").alias("bytes"))
    return repos.join(per, "repo", "left").groupBy("license").agg(F.count("*").alias("repos"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def stats_document(manifest: DataFrame) -> DataFrame:
    """One JSON document with totals per fold, drop counters and the largest repositories."""
    folds = fold_totals(manifest).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fold", F.struct("repos", "files", "bytes", "lines", "tokens"))))).alias("per_fold"))
    drops = drop_counters(manifest).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", F.struct("files", "bytes"))))).alias("dropped"))
    largest = manifest.where("status = 'ok'").groupBy("repo").agg(F.sum("bytes").alias("bytes")).orderBy(F.col("bytes").desc(), "repo").limit(50)
    top = largest.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "repo"))).alias("top")).select(F.transform("top", lambda x: F.struct(x["repo"].alias("repo"), (-x["minus"]).alias("bytes"))).alias("top"))
    return folds.crossJoin(drops).crossJoin(top).select(F.to_json(F.struct("per_fold", "dropped", "top")).alias("stats"))
