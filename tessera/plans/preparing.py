"""Queries on corpus preparation: folds, selection, filters, caps and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filerules
from tessera.functions.draws import md5_int
from tessera.operators import lexing, preparing, ranks
from tessera.plans.common import FILES, FOLDS, TEST_REPOS, draw
from tessera.plans.registration import query
from tessera.sources.tables import files, table


def folds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.assign_folds(files(spark, sf_dir).select("repo"), TEST_REPOS)


def starred(df: DataFrame) -> DataFrame:
    return df.withColumn("stars", md5_int(F.col("repo"), "stars") % 1000)


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = files(spark, sf_dir).join(folds_of(spark, sf_dir).select("repo", "fold"), "repo")
    return starred(known.select("file_id", "repo", "path", "fold", F.octet_length("text").cast("long").alias("bytes")))


@query(f"WITH {FOLDS} SELECT * FROM folds")
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_of(spark, sf_dir)


_SQL_REASON = r"""CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 1048576 THEN 'too_large'
    WHEN len(list_filter(string_split(substr(text, 1, 2048), chr(10)), lambda x: regexp_matches(x, '^\s*(//|/\*|\*|#)') AND (contains(x, '<auto-generated') OR contains(x, 'Code generated by') OR contains(x, 'Decompiled with')))) > 0
      OR regexp_matches(substr(text, 1, 1024), '@generated\b') OR contains(substr(text, 1, 2048), 'GeneratedCode(') THEN 'generated_marker'
    WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 1000 OR (n_lines > 0 AND length(text) // n_lines > 100) THEN 'long_lines' END"""
_SQL_LINES = "length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END"
_SQL_DESCRIBED = f"""{FILES}, lined AS (SELECT *, {_SQL_LINES} AS n_lines FROM files),
    described AS (SELECT *, strlen(text) AS bytes, {_SQL_REASON} AS reason FROM lined)"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.described(files(spark, sf_dir))


@query(f"WITH {_SQL_DESCRIBED} SELECT file_id, bytes, n_lines AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM described")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("file_id", "bytes", "lines", filerules.longest_line(F.col("text")).alias("longest"))


@query(f"WITH {_SQL_DESCRIBED} SELECT file_id, coalesce(reason, 'ok') AS reason FROM described")
def content_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("file_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(f"""WITH {_SQL_DESCRIBED}, pages_ AS (SELECT html AS text, {_SQL_LINES.replace('text', 'html')} AS n_lines, strlen(html) AS bytes FROM pages),
    every AS (SELECT reason, bytes FROM described UNION ALL SELECT {_SQL_REASON} AS reason, bytes FROM pages_)
    SELECT reason, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM every WHERE reason IS NOT NULL GROUP BY reason""")
def drop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("web").alias("repo"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"))
    every = described(spark, sf_dir).select("reason", "bytes").unionByName(preparing.described(pages).select("reason", "bytes"))
    return preparing.drop_counters(every.withColumn("status", F.coalesce("reason", F.lit("ok"))))


@query(r"""SELECT page_id, len(list_filter(string_split(substr(html, 1, 2048), chr(10)), lambda x: regexp_matches(x, '^\s*(//|/\*|\*|#)') AND contains(x, '<auto-generated'))) > 0 AS head,
    regexp_matches(substr(html, 1, 1024), '@generated\b') OR contains(substr(html, 1, 2048), 'GeneratedCode(') AS phrase FROM pages""")
def generated_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", filerules.generated_head(html).alias("head"), filerules.generated_phrase(html).alias("phrase"))


@query(r"""WITH named AS (SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_partkey % 6 WHEN 0 THEN '/vendor/a.go' WHEN 1 THEN '/x.pb.go' WHEN 2 THEN '/A.Designer.cs' WHEN 3 THEN '/Migrations/20240101123456_A.cs' WHEN 4 THEN '/vendor' ELSE '/main.go' END AS path, p_size * 25000 AS size FROM part)
    SELECT p_partkey, path, CASE WHEN path LIKE '%/vendor/%' THEN 'excluded_dir' WHEN size = 0 THEN 'empty' WHEN size > 1048576 THEN 'too_large' WHEN path LIKE '%.pb.go' OR lower(path) LIKE '%.designer.cs' THEN 'generated_name' WHEN path LIKE '%/Migrations/2%.cs' THEN 'generated_path' ELSE 'ok' END AS reason FROM named""")
def early_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(x) for x in ("/vendor/a.go", "/x.pb.go", "/A.Designer.cs", "/Migrations/20240101123456_A.cs", "/vendor", "/main.go")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "/"), ends).alias("path"), (F.col("p_size") * 25000).alias("size"))
    return named.select("p_partkey", "path", F.coalesce(filerules.early_reason(F.lit(False), F.col("size"), F.col("path")), F.lit("ok")).alias("reason"))


_SQL_OFFERED = f"{FILES}, {FOLDS}, offered AS (SELECT file_id, repo, path, fold, strlen(text) AS bytes, {draw('repo', 'stars')} % 1000 AS stars FROM files JOIN folds USING (repo))"
_SQL_OFFER_ORDER = "CASE fold WHEN 'lm' THEN 0 WHEN 'rank' THEN 1 ELSE 2 END, stars DESC, repo, path"


@query(f"WITH {_SQL_OFFERED} SELECT file_id, fold, stars, row_number() OVER (ORDER BY {_SQL_OFFER_ORDER}) AS offer_seq FROM offered")
def offer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.offer_order(offered(spark, sf_dir)).select("file_id", "fold", "stars", "offer_seq")


_BUDGETS = {"lm": 600_000, "rank": 300_000, "test": 100_000}


@query(f"""WITH {_SQL_OFFERED}, summed AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY fold ORDER BY {_SQL_OFFER_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM offered)
    SELECT file_id, fold, bytes, CASE WHEN before >= CASE fold WHEN 'lm' THEN {_BUDGETS['lm']} WHEN 'rank' THEN {_BUDGETS['rank']} ELSE {_BUDGETS['test']} END THEN 'budget' ELSE 'ok' END AS status FROM summed""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.budget_cut(offered(spark, sf_dir), _BUDGETS).select("file_id", "fold", "bytes", "status")


@query(f"WITH {FILES} SELECT file_id, repo, path_rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS path_rank FROM files) WHERE path_rank <= 25")
def repo_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.cap_per_repo(files(spark, sf_dir), 25).select("file_id", "repo", "path_rank")


@query("""WITH placed AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id FROM placed WHERE n <= 20 OR i IN (SELECT j * n // 20 FROM range(20) t(j))""")
def even_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.even_stride(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 20).select("event_id", "user_id")


@query("""WITH placed AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id FROM placed WHERE i % CAST(ceil(n / 20.0) AS BIGINT) = 0""")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.every_nth(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 20).select("event_id", "user_id")


@query("""WITH placed AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
    SELECT event_id, user_id, pos FROM placed WHERE pos > 0 AND pos % 7 = 0""")
def position_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1L AS pos")
    return placed.where("pos > 0 AND pos % 7 = 0")


def _customer_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("repo"), F.floor("c_acctbal").alias("stars"), F.col("c_nationkey").alias("owner"))


@query("SELECT c_name AS repo, CAST(floor(c_acctbal) AS BIGINT) AS stars FROM customer WHERE floor(c_acctbal) >= 500 ORDER BY 2 DESC, 1 LIMIT 200")
def repo_select_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.select_repos(_customer_repos(spark, sf_dir), 500, 200).select("repo", "stars")


@query("""SELECT repo, stars, owner, owner_rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY stars DESC, repo) AS owner_rank FROM
    (SELECT c_name AS repo, CAST(floor(c_acctbal) AS BIGINT) AS stars, c_nationkey AS owner FROM customer)) WHERE owner_rank <= CASE WHEN owner < 3 THEN 12 ELSE 5 END ORDER BY stars DESC, repo LIMIT 100""")
def owner_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.owner_quota(_customer_repos(spark, sf_dir), F.when(F.col("owner") < 3, 12).otherwise(5), 100)


@query("""SELECT c_name AS repo, coalesce(CAST(n.stars AS BIGINT), 0) AS stars, CASE WHEN n.repo IS NULL THEN 'unknown' ELSE coalesce(n.license, 'none') END AS license, n.repo IS NOT NULL AS in_catalog FROM customer
    LEFT JOIN (SELECT n_name AS repo, n_nationkey, n_nationkey * 10 AS stars, CASE WHEN n_regionkey = 1 THEN NULL ELSE 'L' || n_regionkey END AS license FROM nation WHERE n_nationkey < 18) n ON n.n_nationkey = c_nationkey""")
def catalog_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 18")
    known = nation.select(F.col("n_nationkey").alias("repo"), (F.col("n_nationkey") * 10).cast("long").alias("stars"), F.when(F.col("n_regionkey") != 1, F.concat(F.lit("L"), F.col("n_regionkey").cast("string"))).alias("license"))
    repos = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_name").alias("name"))
    found = preparing.with_catalogue(repos.select("repo").distinct(), known)
    return repos.join(found, "repo").select(F.col("name").alias("repo"), "stars", "license", "in_catalog")


@query(f"""WITH {_SQL_DESCRIBED}, {FOLDS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY path) AS nth FROM described),
    statused AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN nth > 1 THEN 'dup_exact' ELSE 'ok' END AS status FROM firsts JOIN folds USING (repo))
    SELECT fold, count(DISTINCT repo) AS repos, count(DISTINCT CASE WHEN status = 'ok' THEN repo END) AS repos_with_data, count(*) FILTER (status = 'ok') AS files, coalesce(sum(bytes) FILTER (status = 'ok'), 0)::BIGINT AS bytes,
    coalesce(sum(n_lines) FILTER (status = 'ok'), 0)::BIGINT AS lines, coalesce(sum(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+'))) FILTER (status = 'ok'), 0)::BIGINT AS tokens,
    count(*) FILTER (status LIKE 'dup%') AS dup_files, coalesce(sum(bytes) FILTER (status LIKE 'dup%'), 0)::BIGINT AS dup_bytes FROM statused GROUP BY fold""")
def fold_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = described(spark, sf_dir).join(folds_of(spark, sf_dir), "repo")
    first = known.groupBy(F.md5("text").alias("digest")).agg(F.min("path").alias("first"))
    status = F.coalesce("reason", F.when(F.col("path") > F.col("first"), "dup_exact").otherwise("ok"))
    return preparing.fold_totals(known.withColumn("digest", F.md5("text")).join(first, "digest").withColumn("status", status))


@query(f"""WITH {_SQL_DESCRIBED}, kept AS (SELECT repo, sum(bytes) AS bytes FROM described WHERE reason IS NULL GROUP BY repo)
    SELECT 'L' || ({draw('repo', 'license')} % 4) AS license, count(*) AS repos, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM (SELECT DISTINCT repo FROM files) LEFT JOIN kept USING (repo) GROUP BY 1""")
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = described(spark, sf_dir).withColumn("status", F.coalesce("reason", F.lit("ok")))
    repos = kept.select("repo").distinct().withColumn("license", F.concat(F.lit("L"), (md5_int(F.col("repo"), "license") % 4).cast("string")))
    return preparing.licenses(kept, repos)


@query()
def prepare_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation: reasons, budget, exact and near duplicates in offer order."""
    named = starred(files(spark, sf_dir))
    lexed = lexing.words_and_tokens(F.col("text"))
    return preparing.manifest(named, folds_of(spark, sf_dir).select("repo", "fold"), {"lm": 8_000_000}, lexed["tokens"], lexed["identifiers"])


@query(f"""WITH {FILES}, per AS (SELECT repo, sum(length(text)) AS lines_, min(file_id) AS least FROM files GROUP BY repo), {FOLDS}
    SELECT file_id, f.repo, 'test' AS fold FROM files f JOIN per USING (repo) JOIN folds USING (repo) WHERE fold <> 'lm' AND least >= 5""")
def fresh_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = described(spark, sf_dir).join(folds_of(spark, sf_dir).select("repo", "fold"), "repo").withColumn("status", F.lit("ok"))
    created = known.groupBy("repo").agg(F.lpad(F.min("file_id").cast("string"), 9, "0").alias("created_at"))
    return preparing.fresh_set(known, created, "000000005", 1).select("file_id", "repo", "fold")
