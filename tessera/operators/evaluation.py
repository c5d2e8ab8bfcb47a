"""Evaluation tables: thresholds, policies, calibration, breakdowns, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import running_total

#: Confidence levels of the tables.
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
FILTERS = ["none", "no punct-only", "rep guard", "both"]


def share(test: Column) -> Column:
    return F.round(F.avg(test.cast("double")), 6)


def confidences(probs: Column) -> dict[str, Column]:
    """Geometric mean of the first three, minimum and product of token probabilities."""
    head = F.slice(probs, 1, 3)
    logs = F.aggregate(head, F.lit(0.0), lambda acc, p: acc + F.log(F.greatest(p, F.lit(1e-9))))
    return {"conf_gm3": F.exp(logs / F.size(head)), "conf_min": F.array_min(probs), "conf_prod": F.aggregate(probs, F.lit(1.0), lambda acc, p: acc * p)}


def _long(records: DataFrame, names: list[str]) -> DataFrame:
    """One row per confidence of every record: conf_name, conf."""
    return records.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("conf_name"), F.col(c).alias("conf")) for c in names])).alias("_c")).select("*", "_c.conf_name", "_c.conf").drop("_c")


def threshold_table(records: DataFrame, names: list[str], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """conf_name, thr, n_shown, shown, prec_ok3, prec_exact, token_prec; levels that show nothing have no row."""
    n = records.agg(F.count("*").alias("n"))
    each = _long(records, names).select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr")).where("conf >= thr")
    right, total = F.sum(F.least("match", F.lit(3))), F.sum(F.least(F.lit(3), F.greatest("gen_len", F.lit(1))))
    grouped = each.groupBy("conf_name", "thr").agg(F.count("*").alias("n_shown"), share(F.col("ok3")).alias("prec_ok3"), share(F.col("exact")).alias("prec_exact"), F.round(right / total, 6).alias("token_prec"))
    return grouped.crossJoin(F.broadcast(n)).select("conf_name", "thr", "n_shown", F.round(F.col("n_shown") / F.col("n"), 6).alias("shown"), "prec_ok3", "prec_exact", "token_prec")


def policy_table(records: DataFrame, conf: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """thr, policy, n_shown, prec_exact, useful, prec_useful under four display policies."""
    keep = {"none": F.lit(True), "no punct-only": ~F.col("punct_only"), "rep guard": ~F.col("repeated"), "both": ~F.col("punct_only") & ~F.col("repeated")}
    policies = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in keep.items()]), lambda x: x.isNotNull())
    each = records.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr")).where(F.col(conf) >= F.col("thr")).select("*", F.explode(policies).alias("policy"))
    return each.groupBy("thr", "policy").agg(
        F.count("*").alias("n_shown"), share(F.col("exact")).alias("prec_exact"), F.count_if("useful").alias("useful"), F.round(F.avg(F.when(F.col("useful"), F.col("exact").cast("double"))), 6).alias("prec_useful")
    )


def calibration(records: DataFrame, names: list[str], bins: int = 10) -> DataFrame:
    """conf_name, bin, n, share, ok3, exact, first_ok; the last bin is closed."""
    n = records.agg(F.count("*").alias("total"))
    placed = _long(records, names).withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int"))
    grouped = placed.groupBy("conf_name", "bin").agg(F.count("*").alias("n"), share(F.col("ok3")).alias("ok3"), share(F.col("exact")).alias("exact"), share(F.col("first_ok")).alias("first_ok"))
    return grouped.crossJoin(F.broadcast(n)).select("conf_name", "bin", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "ok3", "exact", "first_ok")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")


def breakdowns(records: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """dimension, value, n, ok3, exact, shown, precision at 0.8, for several groupings in one pass."""
    each = records.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in groups.items()])).alias("_g")).select("*", "_g.dimension", "_g.value")
    high = F.col("conf_gm3") >= 0.8
    return each.groupBy("dimension", "value").agg(F.count("*").alias("n"), share(F.col("ok3")).alias("ok3"), share(F.col("exact")).alias("exact"), share(high).alias("shown"), F.round(F.avg(F.when(high, F.col("ok3").cast("double"))), 6).alias("precision"))


def contingency(a: DataFrame, b: DataFrame, key: list[str], flag: str) -> DataFrame:
    """One row: how many paired records are right in both runs, only one of them, or neither."""
    pair = a.select(*key, F.col(flag).alias("fa")).join(b.select(*key, F.col(flag).alias("fb")), key)
    return pair.agg(F.count_if(F.col("fa") & F.col("fb")).alias("both"), F.count_if(F.col("fa") & ~F.col("fb")).alias("only_a"), F.count_if(~F.col("fa") & F.col("fb")).alias("only_b"), F.count_if(~F.col("fa") & ~F.col("fb")).alias("neither"))


def headroom(records: DataFrame, conf: str, passes: Column, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """thr, shown and exact before and after a filter, wrong and right suggestions that it removes."""
    each = records.withColumn("_ok", passes).select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr")).where(F.col(conf) >= F.col("thr"))
    ok, exact = F.col("_ok"), F.col("exact")
    return each.groupBy("thr").agg(F.count("*").alias("shown"), F.count_if(exact).alias("exact"), F.count_if(ok).alias("shown_after"), F.count_if(ok & exact).alias("exact_after"), F.count_if(~ok & ~exact).alias("wrong_removed"), F.count_if(~ok & exact).alias("right_removed"))


def repeated(ids: Column, lengths: Column, most: int = 4, least_bytes: int = 4) -> Column:
    """True if the last 3n ids are three copies of the same n (at most ``most``) of at least ``least_bytes`` bytes."""
    size = F.size(ids)
    out = F.lit(False)
    for n in range(1, most + 1):
        tail = lambda k, n=n: F.slice(ids, size - k * n + 1, n)
        weight = F.aggregate(F.slice(lengths, size - n + 1, n), F.lit(0), lambda acc, x: acc + x)
        out = F.when(size >= 3 * n, out | ((tail(1) == tail(2)) & (tail(1) == tail(3)) & (weight >= least_bytes))).otherwise(out)
    return out


def discrete_quantiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Per group: n, mean, max and sorted[int(p * n)] for every point, without gathering a group.

    Rows are ranked over range partitions; a group's offset is the count of those before it.
    """
    placed = running_total(df.select(*by, value).withColumn("_tie", F.monotonically_increasing_id()), [*map(F.col, by), F.col(value), F.col("_tie")], F.lit(1), "_seq")
    per = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    starts = placed.groupBy(*by).agg(F.min("_seq").alias("_first"))
    picks = F.explode(F.array(*[F.struct(F.lit(f"q{round(p * 100)}").alias("_name"), F.floor(F.lit(p) * F.col("n")).cast("long").alias("_at")) for p in points])).alias("_p")
    wanted = per.join(starts, by).select(*by, (F.col("_first")).alias("_first"), picks).select(*by, (F.col("_first") + F.col("_p._at")).alias("_seq"), "_p._name")
    got = placed.join(wanted, [*by, "_seq"]).groupBy(*by).pivot("_name", [f"q{round(p * 100)}" for p in points]).agg(F.first(value))
    return per.join(got, by)


def quantile_centres(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, centre: values at the middle of each of ``bins`` quantile ranges; the outer ones are the extremes."""
    sizes = df.agg(F.count("*").alias("n"))
    placed = running_total(df.select(value).withColumn("_tie", F.monotonically_increasing_id()), [F.col(value), F.col("_tie")], F.lit(1), "_seq")
    at = F.when(F.col("bin") == 0, 0).when(F.col("bin") == bins - 1, F.col("n") - 1).otherwise(F.floor((F.col("bin") + 0.5) / bins * F.col("n")))
    wanted = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(sizes).select("bin", (at + 1).alias("_seq"))
    return placed.join(F.broadcast(wanted), "_seq").select("bin", F.col(value).alias("centre"))


def nearest_centre(df: DataFrame, value: str, centres: DataFrame) -> DataFrame:
    """``df`` with its nearest centre; the ordered centres (one short array) go along with every row."""
    table = centres.agg(F.sort_array(F.collect_list("centre")).alias("_centres"))
    near = F.aggregate("_centres", F.element_at("_centres", 1), lambda acc, c: F.when(F.abs(c - F.col(value)) < F.abs(acc - F.col(value)), c).otherwise(acc))
    return df.crossJoin(F.broadcast(table)).withColumn("centre", near).drop("_centres")
