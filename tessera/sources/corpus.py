"""Readers and writers of corpora: source trees, catalogues, manifests, repository lists, logs and evaluation dumps.

Schemas are always given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.filerules import content_reason, decoded, early_reason, has_extension, line_count

CATALOGUE = "full_name string, stars int, size_kb int, license string, created_at string, pushed_at string, archived boolean, default_branch string"
MANIFEST = "repo string, path string, bytes bigint, lines int, tokens int, fold string, status string"
CONTEXT = (
    "file string, pos int, qualifier struct<members: array<string>, type: string, package: string, total: int>, scope struct<locals: array<string>, pkg: array<string>, pkg_total: int>,"
    "imports array<string>, xrefs array<string>, rest_idents array<struct<n: string, p: int>>, ms map<string, double>"
)
RECORD = (
    "repo string, path string, line int, kind string, is_test boolean, in_string boolean, true string, gen string, stop string, probs array<double>, conf_gm3 double, conf_min double, conf_prod double,"
    "rest_len int, gen_len int, match int, first_ok boolean, ok3 boolean, exact boolean, typed string, healed boolean, heal_miss boolean, punct_only boolean, repeated boolean, useful boolean"
)


def read_tree(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """repo, path, bytes, content and early reason of every file under root/<repo>/; content is read only where it is used.

    Empty files are not there: Spark's reader passes over files without bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the first two parts below the root: repository and path inside it
    inside = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    placed = raw.select(F.split(inside, "/", 2).alias("p"), F.col("length").alias("bytes"), "content")
    named = placed.where("size(p) = 2").select(F.col("p")[0].alias("repo"), F.col("p")[1].alias("path"), "bytes", "content")
    return named.where(has_extension(F.col("path"), extensions)).withColumn("early", early_reason(F.lit(False), F.col("bytes"), F.col("path")))


def judged_tree(tree: DataFrame) -> DataFrame:
    """``read_tree`` with text, lines and the reason why a file is dropped (null: kept)."""
    text = decoded(F.col("content"))
    return tree.withColumn("reason", F.when(F.col("early").isNotNull(), F.col("early")).otherwise(content_reason(F.col("content")))).select(
        "repo", "path", "bytes", "reason", F.when(F.col("reason").isNull(), text).alias("text"), F.when(F.col("reason").isNull(), line_count(text)).alias("lines")
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """repo (owner__name), stars, license (none if null), created_at of JSON lines; a torn line is dropped."""
    rows = spark.read.schema(CATALOGUE).option("mode", "DROPMALFORMED").json(path).where("full_name is not null")
    return rows.select(F.replace("full_name", F.lit("/"), F.lit("__")).alias("repo"), F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("license", F.lit("none")).alias("license"), "created_at", "size_kb", "archived")


def read_manifest(spark: SparkSession, path: str, fold: str | None = None) -> DataFrame:
    """Lines of a manifest; a half-written last line is dropped."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("fold") == fold) if fold else rows


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select("repo", "path", "bytes", "lines", "tokens", "fold", "status").write.mode("errorifexists").json(path)


def kept_by_repo(manifest: DataFrame) -> DataFrame:
    """repo and its kept files in path order."""
    return manifest.where("status = 'ok'").groupBy("repo").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """repo names of a text file, one a line; # begins a comment."""
    return spark.read.text(path).select(F.trim("value").alias("repo")).where("repo <> '' and not startswith(repo, '#')").distinct()


def include_only(repos: DataFrame, listed: DataFrame) -> DataFrame:
    """``repos`` that the list names; names that are missing are an error."""
    missing = [r["repo"] for r in listed.join(repos, "repo", "left_anti").orderBy("repo").limit(20).collect()]
    if missing:
        raise ValueError(f"listed but not there: {missing}")
    return repos.join(listed, "repo", "left_semi")


def read_log(spark: SparkSession, path: str, pattern: str, columns: dict[str, str]) -> DataFrame:
    """Typed rows from the lines that match; groups of the pattern become the columns (name: type) in order."""
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, i).cast(t).alias(n) for i, (n, t) in enumerate(columns.items(), 1)])


def export_summary(log: DataFrame) -> DataFrame:
    """One row over (positions, with_list, hits, ms): recall, share without a list, milliseconds per position."""
    n = F.sum("positions")
    return log.agg(n.alias("positions"), F.round(F.sum("hits") / n, 6).alias("recall"), F.round(1 - F.sum("with_list") / n, 6).alias("no_list"), F.round(F.sum("ms") / n, 6).alias("ms_per_position"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Context records with defaults for absent parts."""
    rows = spark.read.schema(CONTEXT).json(path)
    none = F.array().cast("array<string>")
    return rows.select(
        "file", "pos", F.coalesce("qualifier.members", none).alias("members"), F.coalesce("qualifier.total", F.lit(0)).alias("members_total"), F.coalesce("scope.locals", none).alias("locals"),
        F.coalesce("scope.pkg", none).alias("package"), F.coalesce("imports", none).alias("imports"), F.coalesce("xrefs", none).alias("xrefs"), F.coalesce("rest_idents", F.array().cast("array<struct<n: string, p: int>>")).alias("rest_idents"), "ms",
    )


def context_origin(contexts: DataFrame) -> DataFrame:
    """origin, n: where identifiers still to come are found first: members, locals, package, imports, or nowhere."""
    each = contexts.select("members", "locals", "package", "imports", F.explode("rest_idents").alias("x")).withColumn("name", F.col("x.n"))
    hit = lambda c: F.array_contains(F.col(c), F.col("name"))
    origin = F.when(F.col("x.p") == 1, "prefix").when(hit("members"), "members").when(hit("locals"), "locals").when(hit("package"), "package").when(hit("imports"), "imports").otherwise("nowhere")
    return each.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"))


def unresolved(used: DataFrame, symbols: DataFrame, index: DataFrame) -> DataFrame:
    """name, repos, files, samples of used (repo, file, name) that neither the symbol table nor the index knows."""
    gone = used.join(symbols.select("repo", "name"), ["repo", "name"], "left_anti").join(index.select("name"), "name", "left_anti")
    return gone.groupBy("name").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("file").alias("files"), F.slice(F.sort_array(F.collect_set("repo")), 1, 3).alias("samples"))


def read_fixture(spark: SparkSession, path: str, columns: list[str], separator: str = "\t") -> DataFrame:
    """Lines of a text fixture split into named columns."""
    parts = F.split("value", separator)
    return spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table; its header and rule are skipped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).select(cells.alias("c"))
    return rows.where(F.col("c")[0].rlike("^[0-9]+$")).select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])
