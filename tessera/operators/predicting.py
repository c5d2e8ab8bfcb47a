"""What comes next: exact top-k words of contexts, greedy continuation, and how often it is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ngram
from tessera.operators.ranks import top_per
from tessera.sources.storage import cut

#: Confidence levels at which suggestions are counted as shown.
THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def top_words(contexts: DataFrame, model: ngram.Model, k: int, allowed: DataFrame) -> DataFrame:
    """(ctx, w, logp, rank): the ``k`` best words of ``allowed`` (word) after each distinct ctx of order - 1 words.

    A word unseen after every suffix of a context scores the same weights plus its unigram, so the best
    ``k`` are among the continuations seen and the first k + |seen| unigrams: no contexts times vocabulary.
    Ties go to the smaller word.
    """
    n = model.order
    words = F.split("ctx", " ")
    suffixes = F.array(*[F.array_join(F.slice(words, F.lit(n - j), F.lit(j)), " ") for j in range(1, n)])
    asked = contexts.select("ctx", F.explode(suffixes).alias("tail"))
    grams = model.prob.where("n > 1").select(ngram.context_of("gram").alias("tail"), F.expr("substring_index(gram, ' ', -1)").alias("w"))
    seen = cut(asked.join(grams, "tail").select("ctx", "w").distinct(), "top-seen")
    ok = allowed.select(F.col("word").alias("w"))
    # unigrams by rank; their number is the vocabulary's, which its builder bounds
    uni = model.prob.where("n = 1").select(F.col("gram").alias("w"), "p").join(ok, "w")
    ranked = uni.select("w", F.row_number().over(Window.orderBy(F.col("p").desc(), "w")).alias("place"))
    reach = contexts.join(seen.groupBy("ctx").agg(F.count("*").alias("n_seen")), "ctx", "left").select("ctx", F.explode(F.sequence(F.lit(1), (F.coalesce("n_seen", F.lit(0)) + k).cast("int"))).alias("place"))
    frequent = reach.join(ranked, "place").select("ctx", "w")
    every = seen.join(ok, "w").select("ctx", "w").unionByName(frequent).distinct().withColumn("gram", F.concat_ws(" ", "ctx", "w"))
    scored = every.join(ngram.score(every.select("gram"), model), "gram")
    return top_per(scored.select("ctx", "w", "logp"), ["ctx"], [F.round("logp", 9).desc(), F.col("w")], k)


def greedy(positions: DataFrame, model: ngram.Model, allowed: DataFrame, steps: int) -> DataFrame:
    """``positions`` (file_id, pos, ctx) with gen and gen_logp, the words taken one after another.

    One pass per step over the distinct contexts of that step; each is written, so the plan does not grow.
    """
    state = positions.select("file_id", "pos", "ctx", F.array().cast("array<string>").alias("gen"), F.array().cast("array<double>").alias("gen_logp"))
    for _ in range(steps):
        best = top_words(state.select("ctx").distinct(), model, 1, allowed).select("ctx", F.col("w").alias("next"), "logp")
        grown = state.join(best, "ctx", "left")
        moved = F.array_join(F.concat(F.slice(F.split("ctx", " "), 2, model.order), F.array("next")), " ")
        state = cut(
            grown.select(
                "file_id", "pos", F.when(F.col("next").isNull(), F.col("ctx")).otherwise(moved).alias("ctx"),
                F.when(F.col("next").isNull(), F.col("gen")).otherwise(F.concat("gen", F.array("next"))).alias("gen"),
                F.when(F.col("next").isNull(), F.col("gen_logp")).otherwise(F.concat("gen_logp", F.array("logp"))).alias("gen_logp"),
            ),
            "greedy-step",
        )
    return state.drop("ctx")


def beam(positions: DataFrame, model: ngram.Model, allowed: DataFrame, steps: int, width: int) -> DataFrame:
    """``positions`` (file_id, pos, ctx) with the ``width`` best continuations by summed logp: gen, logp, rank.

    Every hypothesis grows by its ``width`` best words; a step keeps the ``width`` best of a position.
    """
    state = positions.select("file_id", "pos", "ctx", F.array().cast("array<string>").alias("gen"), F.lit(0.0).alias("logp"))
    for _ in range(steps):
        best = top_words(state.select("ctx").distinct(), model, width, allowed).select("ctx", F.col("w").alias("next"), F.col("logp").alias("more"))
        grown = state.join(best, "ctx").select(
            "file_id", "pos", F.array_join(F.concat(F.slice(F.split("ctx", " "), 2, model.order), F.array("next")), " ").alias("ctx"),
            F.concat("gen", F.array("next")).alias("gen"), (F.col("logp") + F.col("more")).alias("logp"),
        )
        state = cut(top_per(grown, ["file_id", "pos"], [F.round("logp", 9).desc(), F.col("gen")], width), "beam-step")
    return state.select("file_id", "pos", "gen", "logp", "rank")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading equal elements of two arrays."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def head_confidence(probs: Column, n: int = 3) -> Column:
    """Geometric mean of the first ``n`` probabilities, each at least 1e-9."""
    head = F.slice(probs, 1, n)
    total = F.aggregate(head, F.lit(0.0), lambda acc, p: acc + F.log(F.greatest(p, F.lit(1e-9))))
    return F.exp(total / F.size(head))


def prefix_hits(matched: DataFrame, most: int) -> DataFrame:
    """k, positions, hits, share: how often at least the first k words are right."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    return matched.select("match", ks).groupBy("k").agg(F.count("*").alias("positions"), F.count_if(F.col("match") >= F.col("k")).alias("hits"), F.round(F.avg((F.col("match") >= F.col("k")).cast("double")), 6).alias("share"))


def threshold_table(matched: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """thr, shown, ok3, token_precision over (conf, match, n_gen)."""
    each = matched.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr")).where("conf >= thr")
    head = F.least(F.lit(3), F.col("n_gen"))
    return each.groupBy("thr").agg(F.count("*").alias("shown"), F.count_if(F.col("match") >= 3).alias("ok3"), F.round(F.sum(F.least("match", head)) / F.sum(head), 6).alias("token_precision"))
