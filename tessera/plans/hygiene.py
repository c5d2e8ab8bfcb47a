"""Queries on secrets, provenance and test paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import secrets
from tessera.plans.common import FILES
from tessera.plans.registration import query
from tessera.sources.tables import files, table


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_COUNTED = f"{FILES}, counted AS (SELECT *, {', '.join(f'''len(regexp_extract_all(text, '{_q(p)}')) AS n_{k}''' for k, (p, _) in secrets.DETECTORS.items())} FROM files)"
_SCRUBBED = [k for k, d in secrets.DETECTORS.items() if d[1]]
_ALL, _CREDENTIAL = (" + ".join(f"n_{k}" for k in names) for names in (_SCRUBBED, secrets.CREDENTIALS))
_REASON = f"CASE WHEN n_private_key > 0 THEN 'private_key' WHEN {_CREDENTIAL} >= 3 THEN 'credential_hits' WHEN {_ALL} >= 100 THEN 'data_file' ELSE 'kept' END"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("*", *[secrets.hits(F.col("text"), k).alias(f"n_{k}") for k in secrets.DETECTORS])


@query(f"WITH {_COUNTED} SELECT file_id, {', '.join(f'n_{k}' for k in secrets.DETECTORS)}, {_REASON} AS verdict FROM counted")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = secrets.drop_reason({k: F.col(f"n_{k}") for k in secrets.DETECTORS})
    return counted(spark, sf_dir).select("file_id", *[f"n_{k}" for k in secrets.DETECTORS], F.coalesce(verdict, F.lit("kept")).alias("verdict"))


_SCRUB = "text"
for _k in _SCRUBBED:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_q(secrets.DETECTORS[_k][0])}', '<{_k.upper()}>', 'g')"


@query(f"WITH {FILES} SELECT file_id, md5({_SCRUB}) AS digest, length({_SCRUB}) AS chars FROM files")
def secret_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = files(spark, sf_dir).select("file_id", secrets.scrub(F.col("text")).alias("clean"))
    return clean.select("file_id", F.md5("clean").alias("digest"), F.length("clean").alias("chars"))


@query(f"WITH {_COUNTED} " + " UNION ALL ".join(f"SELECT '{k}' AS category, {str(d[1]).lower()} AS scrubbed, count(*) FILTER (n_{k} > 0) AS files, coalesce(sum(n_{k}), 0)::BIGINT AS matches FROM counted" for k, d in secrets.DETECTORS.items()))
def secret_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(d[1]).alias("scrubbed"), F.col(f"n_{k}").alias("n")) for k, d in secrets.DETECTORS.items()])).alias("x")
    return counted(spark, sf_dir).select(items).groupBy("x.category", "x.scrubbed").agg(F.count_if(F.col("x.n") > 0).alias("files"), F.sum("x.n").alias("matches"))


@query(f"WITH {_COUNTED}, sums AS (SELECT {_ALL} AS n FROM counted) SELECT CASE WHEN n >= 100 THEN '100+' WHEN n >= 50 THEN '50-99' WHEN n >= 10 THEN '10-49' WHEN n >= 5 THEN '5-9' WHEN n >= 2 THEN '2-4' ELSE '1' END AS bucket, count(*) AS files, sum(n)::BIGINT AS matches FROM sums WHERE n > 0 GROUP BY 1")
def secret_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sum((F.col(f"n_{k}") for k in _SCRUBBED), F.lit(0))
    return counted(spark, sf_dir).select(n.alias("n")).where("n > 0").groupBy(secrets.histogram_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("files"), F.sum("n").alias("matches"))


@query(f"WITH {FILES} SELECT domain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z])', 1)) AS domain FROM files) GROUP BY domain ORDER BY n DESC, domain LIMIT 30")
def email_domains_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent domains of e-mail addresses, as a report lists them."""
    found = files(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z])"), F.lit(1))).alias("domain"))
    return found.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "domain").limit(30)


@query("""WITH words AS (SELECT conv_id, turn, role, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}{3,}'))) AS w FROM conversations),
    asked AS (SELECT DISTINCT conv_id, turn, w FROM words WHERE role = 'assistant'), prefix AS (SELECT DISTINCT a.conv_id, a.turn, a.w FROM asked a JOIN words p ON p.conv_id = a.conv_id AND p.w = a.w AND p.turn < a.turn AND p.role = 'user'),
    context AS (SELECT DISTINCT a.conv_id, a.turn, a.w FROM asked a JOIN words p ON p.conv_id = a.conv_id AND p.w = a.w AND p.turn < a.turn AND p.role <> 'user')
    SELECT CASE WHEN p.w IS NOT NULL THEN 'prefix' WHEN c.w IS NOT NULL THEN 'context' ELSE 'nowhere' END AS origin, count(*) AS words FROM asked a LEFT JOIN prefix p USING (conv_id, turn, w) LEFT JOIN context c USING (conv_id, turn, w) GROUP BY 1""")
def provenance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of an answer come from: what the user said, other turns, or nowhere."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("w"))
    first = words.groupBy("conv_id", "w").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("user_first"), F.min(F.when(F.col("role") != "user", F.col("turn"))).alias("other_first"))
    asked = words.where("role = 'assistant'").select("conv_id", "turn", "w").distinct().join(first, ["conv_id", "w"])
    origin = F.when(F.col("user_first") < F.col("turn"), "prefix").when(F.col("other_first") < F.col("turn"), "context").otherwise("nowhere")
    return asked.groupBy(origin.alias("origin")).agg(F.count("*").alias("words"))


@query("SELECT p_partkey, path, ends_with(path, '_test.go') AS is_test FROM (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '_test.go' ELSE '.go' END AS path FROM part)")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_size") % 3 == 0, "_test.go").otherwise(".go")).alias("path"))
    return named.withColumn("is_test", secrets.test_path(F.col("path"), "go"))
