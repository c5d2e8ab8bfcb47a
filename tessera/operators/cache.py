"""A language model of the tokens seen so far in a file, and its mixture with a global one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DISCOUNT = 0.5


def cache_probability(positions: DataFrame, vocab_size: DataFrame, order: int = 3, discount: float = DISCOUNT) -> DataFrame:
    """``positions`` (file_id, pos, w, p1, ..., p_{order-1}) with p_cache, absolute discounting over what precedes each position.

    Counts, context totals and distinct continuations so far are running windows;
    all of them are within a file, so rows dealt by file are not dealt again.
    ``vocab_size`` is one row (v).
    """
    out, columns = positions.crossJoin(F.broadcast(vocab_size)), positions.columns
    for k in range(order):
        ctx = ["file_id", *[f"p{j}" for j in range(1, k + 1)]]
        seen = F.row_number().over(Window.partitionBy(*ctx, "w").orderBy("pos")) - 1
        out = out.withColumn(f"_c{k}", seen)
        by = Window.partitionBy(*ctx).orderBy("pos")
        out = out.withColumn(f"_t{k}", F.row_number().over(by) - 1)
        out = out.withColumn(f"_y{k}", F.coalesce(F.count_if(F.col(f"_c{k}") == 0).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = 1 / F.col("v")
    steps = [p]
    for k in range(order):
        t = F.greatest(F.col(f"_t{k}"), F.lit(1))
        p = F.greatest(F.col(f"_c{k}") - discount, F.lit(0.0)) / t + discount * F.col(f"_y{k}") / t * p
        steps.append(p)
    # the first context not seen yet ends the chain; the begin mark never was in the file
    alive = [F.lit(True)]
    for k in range(order):
        ok = (F.col(f"_t{k}") > 0) & (F.col("pos") >= k)
        alive.append(alive[-1] & ok)
    value = F
    for k in range(order, 0, -1):
        value = value.when(alive[k], steps[k])
    return out.withColumn("p_cache", value.otherwise(steps[0])).select(*columns, "p_cache")


def mixed_logp(weight: float) -> F.Column:
    """Log of the mixture of p_cache and exp(logp); the global model alone at a file's start."""
    p = F.exp("logp")
    return F.when(F.col("pos") == 0, F.col("logp")).otherwise(F.log(weight * F.col("p_cache") + (1 - weight) * p))


def perplexity(scored: DataFrame, by: list[str], logp: str = "logp") -> DataFrame:
    """Per group: n, perplexity and bits over all tokens, and over identifiers in the vocabulary with their share of unknowns.

    Needs is_ident and w.
    """
    known = F.col("is_ident") & (F.col("w") != "<ID>")
    lp = F.col(logp)
    grouped = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(lp).alias("mean"), F.avg(F.when(known, lp)).alias("mean_ident"),
        F.count_if(F.col("is_ident")).alias("idents"), F.count_if(F.col("is_ident") & (F.col("w") == "<ID>")).alias("oov"),
    )
    return _reported(grouped, by)


def _reported(grouped: DataFrame, by: list[str]) -> DataFrame:
    return grouped.select(
        *by, "n", F.round(F.exp(-F.col("mean")), 6).alias("perplexity"), F.round(-F.col("mean") / F.log(F.lit(2.0)), 6).alias("bits"),
        F.round(F.exp(-F.col("mean_ident")), 6).alias("ident_perplexity"), F.round(F.col("oov") / F.greatest("idents", F.lit(1)), 6).alias("oov_rate"),
    )


def perplexity_of_counts(scored: DataFrame, by: list[str], logp: str = "logp", n: str = "n") -> DataFrame:
    """``perplexity`` of rows that stand for ``n`` equal positions each, with is_ident and known (the vocabulary has the word)."""
    of_known = F.col("is_ident") & F.col("known")
    times, lp = F.col(n), F.col(logp)
    grouped = scored.groupBy(*by).agg(
        F.sum(times).alias("n"), (F.sum(lp * times) / F.sum(times)).alias("mean"), (F.sum(F.when(of_known, lp * times)) / F.sum(F.when(of_known, times))).alias("mean_ident"),
        F.sum(F.when(F.col("is_ident"), times).otherwise(0)).alias("idents"), F.sum(F.when(F.col("is_ident") & ~F.col("known"), times).otherwise(0)).alias("oov"),
    )
    return _reported(grouped, by)
