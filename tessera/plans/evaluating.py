"""Queries on evaluation records: thresholds, policies, calibration, breakdowns, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.draws import unit as drawn
from tessera.operators import evaluation
from tessera.plans.common import unit
from tessera.plans.registration import query
from tessera.sources.tables import table

# Records: one per labelled document, its token probabilities drawn by hash; quality is "right", toxicity "punctuation only".
_P = [f"(0.3::DOUBLE + 0.7::DOUBLE * {unit('d.doc_id', f'p{i}')})" for i in range(4)]
RECORDS = f"""base AS (SELECT d.doc_id, d.lang, d.n_chars, quality = 1 AS ok3, quality = 1 AND {unit('d.doc_id', 'x')} < 0.6 AS exact, quality = 1 OR {unit('d.doc_id', 'f')} < 0.5 AS first_ok, toxic = 1 AS punct_only, {unit('d.doc_id', 'r')} < 0.1 AS repeated,
        [{', '.join(_P)}] AS probs, (1 + d.doc_id % 13)::INT AS gen_len, least(1 + d.doc_id % 13, d.doc_id % 5)::INT AS match FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    records AS (SELECT *, exact AND NOT repeated AS useful, exp((ln(probs[1]) + ln(probs[2]) + ln(probs[3])) / 3) AS conf_gm3, list_min(probs) AS conf_min, 1.0::DOUBLE * probs[1] * probs[2] * probs[3] * probs[4] AS conf_prod FROM base)"""
LONG = ", ".join(f"('{c}')" for c in ("conf_gm3", "conf_min", "conf_prod"))
_LONG = " UNION ALL ".join(f"SELECT *, '{c}' AS conf_name, {c} AS conf FROM records" for c in ("conf_gm3", "conf_min", "conf_prod"))
_THR = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in evaluation.THRESHOLDS) + "]) AS thr)"
_SHARE = lambda c, name: f"round(avg(({c})::INT), 6) AS {name}"
CONFS = ["conf_gm3", "conf_min", "conf_prod"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    base = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    probs = F.array(*[0.3 + 0.7 * drawn(key, f"p{i}") for i in range(4)])
    good = F.col("quality") == 1
    known = base.select(
        "doc_id", "lang", "n_chars", good.alias("ok3"), (good & (drawn(key, "x") < 0.6)).alias("exact"), (good | (drawn(key, "f") < 0.5)).alias("first_ok"), (F.col("toxic") == 1).alias("punct_only"), (drawn(key, "r") < 0.1).alias("repeated"),
        probs.alias("probs"), (1 + key % 13).cast("int").alias("gen_len"), F.least(1 + key % 13, key % 5).cast("int").alias("match"),
    )
    return known.withColumn("useful", F.col("exact") & ~F.col("repeated")).withColumns(evaluation.confidences(F.col("probs")))


@query(f"WITH {RECORDS} SELECT doc_id, round(conf_gm3, 9) AS conf_gm3, round(conf_min, 9) AS conf_min, round(conf_prod, 9) AS conf_prod FROM records")
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", *[F.round(c, 9).alias(c) for c in CONFS])


@query(f"""WITH {RECORDS}, long AS ({_LONG}) SELECT conf_name, thr, count(*) AS n_shown, round(count(*)::DOUBLE / (SELECT count(*) FROM records), 6) AS shown, {_SHARE('ok3', 'prec_ok3')}, {_SHARE('exact', 'prec_exact')},
    round(sum(least(match, 3)) / sum(least(3, greatest(gen_len, 1))), 6) AS token_prec FROM long, {_THR} WHERE conf >= thr GROUP BY conf_name, thr""")
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_table(records(spark, sf_dir), CONFS)


@query(f"""WITH {RECORDS}, shown AS (SELECT *, unnest(list_filter([CASE WHEN true THEN 'none' END, CASE WHEN NOT punct_only THEN 'no punct-only' END, CASE WHEN NOT repeated THEN 'rep guard' END, CASE WHEN NOT punct_only AND NOT repeated THEN 'both' END], lambda x: x IS NOT NULL)) AS policy FROM records, {_THR} WHERE conf_prod >= thr)
    SELECT thr, policy, count(*) AS n_shown, {_SHARE('exact', 'prec_exact')}, count(*) FILTER (useful) AS useful, round(avg(exact::INT) FILTER (useful), 6) AS prec_useful FROM shown GROUP BY thr, policy""")
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.policy_table(records(spark, sf_dir), "conf_prod")


@query(f"""WITH {RECORDS}, long AS ({_LONG}), placed AS (SELECT *, least(floor(conf * 10), 9)::INT AS bin FROM long)
    SELECT conf_name, bin, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM records), 6) AS share, {_SHARE('ok3', 'ok3')}, {_SHARE('exact', 'exact')}, {_SHARE('first_ok', 'first_ok')} FROM placed GROUP BY conf_name, bin""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(records(spark, sf_dir), CONFS)


_BUCKET = "CASE WHEN gen_len <= 2 THEN '1-2' WHEN gen_len <= 5 THEN '3-5' WHEN gen_len <= 10 THEN '6-10' ELSE '11+' END"


@query(f"""WITH {RECORDS}, long AS (SELECT *, 'lang' AS dimension, lang AS value FROM records UNION ALL SELECT *, 'length', {_BUCKET} FROM records UNION ALL SELECT *, 'repeated', repeated::VARCHAR FROM records)
    SELECT dimension, value, count(*) AS n, {_SHARE('ok3', 'ok3')}, {_SHARE('exact', 'exact')}, {_SHARE('conf_gm3 >= 0.8', 'shown')}, round(avg(ok3::INT) FILTER (conf_gm3 >= 0.8), 6) AS precision FROM long GROUP BY dimension, value""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdown by language, length and repetition in one pass."""
    return evaluation.breakdowns(records(spark, sf_dir), {"lang": F.col("lang"), "length": evaluation.length_bucket(F.col("gen_len")), "repeated": F.col("repeated")})


@query(f"WITH {RECORDS} SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT exact AS a, first_ok AND conf_min >= 0.5 AS b FROM records)")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = records(spark, sf_dir)
    two = one.select("doc_id", (F.col("first_ok") & (F.col("conf_min") >= 0.5)).alias("exact"))
    return evaluation.contingency(one, two, ["doc_id"], "exact")


@query(f"WITH {RECORDS} SELECT thr, count(*) AS shown, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT repeated) AS shown_after, count(*) FILTER (NOT repeated AND exact) AS exact_after, count(*) FILTER (repeated AND NOT exact) AS wrong_removed, count(*) FILTER (repeated AND exact) AS right_removed FROM records, {_THR} WHERE conf_gm3 >= thr GROUP BY thr")
def filter_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.headroom(records(spark, sf_dir), "conf_gm3", ~F.col("repeated"))


@query("""WITH ids AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS w FROM events GROUP BY user_id), tails AS (SELECT user_id, w[-1:] AS t, w, len(w) AS n FROM ids)
    SELECT user_id, n, (n >= 3 AND w[n] = w[n-1] AND w[n] = w[n-2] AND length(w[n]) >= 4) OR (n >= 6 AND w[n-1:n] = w[n-3:n-2] AND w[n-1:n] = w[n-5:n-4]) OR (n >= 9 AND w[n-2:n] = w[n-5:n-3] AND w[n-2:n] = w[n-8:n-6]) OR (n >= 12 AND w[n-3:n] = w[n-7:n-4] AND w[n-3:n] = w[n-11:n-8]) AS repeated FROM tails""")
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's last events repeat themselves three times."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    w = F.transform("s", lambda x: x["event_type"])
    known = rows.select("user_id", w.alias("w")).withColumn("len", F.transform("w", lambda x: F.length(x)))
    return known.select("user_id", F.size("w").cast("long").alias("n"), evaluation.repeated(F.col("w"), F.col("len")).alias("repeated"))


@query("""WITH o AS (SELECT event_type, list(value ORDER BY value) AS s, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type)
    SELECT event_type, n, mean, most, s[CAST(floor(0.5 * n) AS BIGINT) + 1] AS q50, s[CAST(floor(0.9 * n) AS BIGINT) + 1] AS q90, s[CAST(floor(0.99 * n) AS BIGINT) + 1] AS q99 FROM o""")
def quantile_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.discrete_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9, 0.99])
    return found.withColumn("mean", F.round("mean", 6))


@query("""WITH o AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS s, count(*) AS n FROM lineitem)
    SELECT b::INT AS bin, CASE b WHEN 0 THEN s[1] WHEN 255 THEN s[n] ELSE s[CAST(floor((b + 0.5) / 256 * n) AS BIGINT) + 1] END AS centre FROM o, range(256) t(b)""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.quantile_centres(table(spark, sf_dir, "lineitem"), "l_extendedprice", 256)


@query("SELECT event_id, (props->>'$.k')::INT AS k, coalesce((props->>'$.missing')::INT, 0) AS missing FROM events")
def json_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of a JSON column, with defaults for what is absent."""
    props = F.from_json("props", "k int, missing int")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), F.coalesce(props["missing"], F.lit(0)).alias("missing"))


@query("SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by each of two dimensions and overall, as the reports print them."""
    return table(spark, sf_dir, "orders").groupingSets([("o_orderpriority",), ("o_orderstatus",), ()], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), "n", "mean")


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY substr(md5('sample|' || doc_id), 1, 15), doc_id) AS rank FROM documents) WHERE rank <= 5")
def example_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five random examples per category: a sample by hash order."""
    from tessera.operators.ranks import top_per

    key = F.substring(F.md5(F.concat(F.lit("sample|"), F.col("doc_id").cast("string"))), 1, 15)
    return top_per(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], [key, F.col("doc_id")], 5)
