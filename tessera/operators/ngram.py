"""N-gram counts and smoothed models as tables keyed by the gram itself.

A gram is its words joined by one space; no word holds a space. Sequences are
(file_id, repo, pos, w). Only the highest order is counted over tokens; lower
orders are rolled up from its table. Grams of word ids (``coded``) are longs;
``keys`` says how the words of a gram are told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import coded
from tessera.operators.vocabulary import BEGIN, END
from tessera.sources.storage import cut

#: Log-probability of a word that the vocabulary lacks.
UNSEEN = -20.0


def tail_of(gram: str) -> Column:
    """A gram without its first word."""
    return F.expr(f"substring({gram}, locate(' ', {gram}) + 1)")


def context_of(gram: str) -> Column:
    return F.expr(f"substring({gram}, 1, greatest(length({gram}) - length(substring_index({gram}, ' ', -1)) - 1, 0))")


@dataclass(frozen=True)
class Keys:
    """How grams are written: ``tail`` and ``context`` of a column of grams of n words."""

    tail: Callable[[str, int], Column]
    context: Callable[[str, int], Column]
    kind: str


TEXT = Keys(lambda gram, n: tail_of(gram), lambda gram, n: context_of(gram), "string")
IDS = Keys(coded.tail_of, coded.context_of, "long")


def with_context(seq: DataFrame, order: int) -> DataFrame:
    """``seq`` with p1, p2, ...: the words before, padded with the begin mark."""
    by = Window.partitionBy("file_id").orderBy("pos")
    return seq.withColumns({f"p{k}": F.lag("w", k, BEGIN).over(by) for k in range(1, order)})


def gram_of(order: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"p{k}") for k in range(order - 1, 0, -1)], F.col("w"))


def with_end(seq: DataFrame) -> DataFrame:
    """``seq`` with an end mark after the last word of each file; keeps the partitioning by file."""
    by = Window.partitionBy("file_id").orderBy("pos")
    last = seq.withColumn("_last", F.lead("w").over(by).isNull())
    here = F.struct(F.col("pos").cast("long").alias("pos"), F.col("w").alias("w"))
    after = F.struct((F.col("pos") + 1).cast("long").alias("pos"), F.lit(END).alias("w"))
    rest = [c for c in seq.columns if c not in ("pos", "w")]
    return last.select(*rest, F.explode(F.when(F.col("_last"), F.array(here, after)).otherwise(F.array(here))).alias("_x")).select(*rest, "_x.pos", "_x.w")


def counts(seq: DataFrame, order: int) -> dict[int, DataFrame]:
    """Per order n: gram, c, repos (distinct repositories)."""
    return counts_of(with_context(with_end(seq), order).select(gram_of(order).alias("gram"), "repo"), order, TEXT)


def counts_of(grams: DataFrame, order: int, keys: Keys) -> dict[int, DataFrame]:
    """``counts`` from the grams of the highest order (gram, repo), one row an occurrence. Every table is written once."""
    raw = cut(grams.groupBy("gram", "repo").agg(F.count("*").alias("c")), "ngram-top")
    out = {}
    for n in range(order, 0, -1):
        out[n] = cut(raw.groupBy("gram").agg(F.sum("c").alias("c"), F.count("*").alias("repos")), "ngram-counts")
        if n > 1:
            raw = cut(raw.groupBy(keys.tail("gram", n).alias("gram"), "repo").agg(F.sum("c").alias("c")), "ngram-raw")
    return out


def without_own(seq: DataFrame, order: int) -> DataFrame:
    """file_id, gram, c: counts of the file's repository for the grams that the file has, without its own; only what is left."""
    own = with_context(seq, order).select("repo", "file_id", gram_of(order).alias("gram")).groupBy("repo", "file_id", "gram").agg(F.count("*").alias("own"))
    total = own.groupBy("repo", "gram").agg(F.sum("own").alias("total"))
    return own.join(total, ["repo", "gram"]).select("file_id", "gram", (F.col("total") - F.col("own")).alias("c")).where("c > 0")


def continuation(higher: DataFrame, n: int, keys: Keys = TEXT) -> DataFrame:
    """gram, c: in how many distinct grams of ``n`` words it is the suffix."""
    return higher.groupBy(keys.tail("gram", n).alias("gram")).agg(F.count("*").alias("c"))


def adjusted(counted: dict[int, DataFrame], order: int, keys: Keys = TEXT) -> dict[int, DataFrame]:
    """Raw counts for the highest order, continuation counts below; repos stay those of the raw gram."""
    out = {order: counted[order]}
    for n in range(order - 1, 0, -1):
        out[n] = cut(continuation(counted[n + 1], n + 1, keys).join(counted[n].select("gram", "repos"), "gram"), "ngram-adjusted")
    return out


def counts_of_counts(table: DataFrame) -> DataFrame:
    return table.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)])


def discounts(table: DataFrame) -> DataFrame:
    """One row: n1 to n4 and the discounts d1, d2, d3 of counts 1, 2 and more."""
    n = [F.greatest(F.col(f"n{k}"), F.lit(1)).cast("double") for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    clip = lambda v, top: F.greatest(F.lit(0.1), F.least(F.lit(top), v))
    return counts_of_counts(table).select("n1", "n2", "n3", "n4", *[clip(v, k - 0.001).alias(f"d{k}") for k, v in enumerate(raw, 1)])


def context_stats(table: DataFrame, n: int | None = None, keys: Keys = TEXT) -> DataFrame:
    """ctx, total, k1, k2, k3: mass and numbers of continuations seen once, twice, more often, over grams of ``n`` words."""
    return table.groupBy(keys.context("gram", n).alias("ctx")).agg(
        F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("k1"), F.count_if(F.col("c") == 2).alias("k2"), F.count_if(F.col("c") > 2).alias("k3")
    )


@dataclass
class Model:
    """prob: n, gram, p; backoff: n (words of the context), ctx, gamma."""

    order: int
    prob: DataFrame
    backoff: DataFrame
    keys: Keys = TEXT

    def saved(self, name: str = "ngram-model") -> Model:
        return Model(self.order, cut(self.prob, f"{name}-prob"), cut(self.backoff, f"{name}-backoff"), self.keys)


def estimate(counted: dict[int, DataFrame], order: int, vocabulary: DataFrame, min_counts: dict[int, int] | None = None, min_repos: dict[int, int] | None = None, jm_weight: float | None = None, keys: Keys = TEXT) -> Model:
    """Interpolated modified Kneser-Ney, or Jelinek-Mercer with ``jm_weight``, over the words of ``vocabulary`` (word).

    Each order needs one join with its contexts and one with the order below, which carries what it
    gives any suffix, kept or pruned. Where pruning drops grams, the context's backoff weight is set so that it sums to one.
    """
    min_counts, min_repos = min_counts or {}, min_repos or {}
    adj = {n: counted[n] for n in counted} if jm_weight is not None else adjusted(counted, order, keys)
    size = vocabulary.agg(F.count("*").alias("v"))
    probs, backoffs, lower = [], [], None
    for n in range(1, order + 1):
        table = adj[n].select("gram", "c", "repos", keys.context("gram", n).alias("ctx"))
        if jm_weight is not None:
            stats = context_stats(adj[n], n, keys).select("ctx", "total", F.lit(jm_weight).alias("gamma"), *[F.lit(0.0).alias(f"d{k}") for k in (1, 2, 3)])
        else:
            mass = F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")
            stats = context_stats(adj[n], n, keys).crossJoin(F.broadcast(discounts(adj[n]))).select("ctx", "total", (mass / F.col("total")).alias("gamma"), "d1", "d2", "d3")
        if n == 1:  # one context: its row goes along with the size of the vocabulary
            known = table.crossJoin(F.broadcast(stats.drop("ctx"))).crossJoin(F.broadcast(size)).withColumn("low", 1 / F.col("v"))
        else:
            below = lower.select(F.col("gram").alias("tail"), F.col("p_eff").alias("low"))
            known = table.join(stats, "ctx").withColumn("tail", keys.tail("gram", n)).join(below, "tail").drop("tail")
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        if jm_weight is not None:
            p = (1 - jm_weight) * F.col("c") / F.col("total") + jm_weight * F.col("low")
        else:
            p = F.greatest(F.col("c") - taken, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("low")
        known = known.withColumn("p", p).withColumn("keep", (F.col("c") >= min_counts.get(n, 1)) & (F.col("repos") >= min_repos.get(n, 1)))
        pruning = min_counts.get(n, 1) > 1 or min_repos.get(n, 1) > 1
        if n == 1:
            unseen = F.col("gamma") / F.col("v")
            lower = cut(known.withColumn("p_eff", F.when(F.col("keep"), F.col("p")).otherwise(unseen)).select("gram", "p_eff"), "ngram-lower")
            gone = stats.crossJoin(size).select((F.col("gamma") / F.col("v")).alias("unseen"))
            every = vocabulary.select(F.col("word").alias("gram")).join(lower, "gram", "left").crossJoin(F.broadcast(gone))
            probs.append(every.select(F.lit(1).alias("n"), "gram", F.coalesce("p_eff", "unseen").alias("p")))
            continue
        if pruning:
            kept = F.when(F.col("keep"), F.lit(1.0)).otherwise(F.lit(0.0))
            sums = known.groupBy("ctx").agg(F.sum(kept * F.col("p")).alias("kp"), F.sum(kept * F.col("low")).alias("kl"), F.max("keep").alias("some"))
            gamma = F.greatest(F.lit(1e-6), F.least(F.lit(10.0), (1 - F.col("kp")) / F.greatest(1 - F.col("kl"), F.lit(1e-6))))
            sums = sums.select("ctx", "some", F.when(F.col("some"), gamma).otherwise(1.0).alias("gamma2"))
            known = known.join(sums, "ctx").withColumn("p_eff", F.when(F.col("keep"), F.col("p")).otherwise(F.col("gamma2") * F.col("low")))
            backoffs.append(sums.where("some").select(F.lit(n - 1).alias("n"), "ctx", F.col("gamma2").alias("gamma")))
        else:
            known = known.withColumn("p_eff", F.col("p"))
            backoffs.append(stats.select(F.lit(n - 1).alias("n"), "ctx", "gamma"))
        known = known.select("gram", "p", "p_eff", "keep")
        if n < order or pruning:  # the highest order, if none of it is dropped, is read once and not written
            known = cut(known, "ngram-order")
        lower = known
        probs.append(known.where("keep").select(F.lit(n).alias("n"), "gram", "p"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    empty = counted[1].sparkSession.createDataFrame([], f"n int, ctx {keys.kind}, gamma double")
    return Model(order, union(probs), union(backoffs) if backoffs else empty, keys)


def score(grams: DataFrame, model: Model) -> DataFrame:
    """gram, logp of distinct grams of ``model.order`` words.

    A gram meets its own probability, the backoff weight of its context, and the score of its tail,
    which is asked once for all grams that end alike: three joins an order, each row sent once.
    """
    return _scored(grams.select("gram").distinct(), model, model.order)


def _scored(grams: DataFrame, model: Model, n: int) -> DataFrame:
    own = grams.join(model.prob.where(F.col("n") == n).select("gram", F.log("p").alias("own")), "gram", "left")
    if n == 1:
        return own.select("gram", F.coalesce("own", F.lit(UNSEEN)).alias("logp"))
    placed = own.select("gram", "own", model.keys.tail("gram", n).alias("tail"), model.keys.context("gram", n).alias("ctx"))
    lower = _scored(grams.select(model.keys.tail("gram", n).alias("gram")).distinct(), model, n - 1).select(F.col("gram").alias("tail"), F.col("logp").alias("low"))
    weights = model.backoff.where(F.col("n") == n - 1).select("ctx", F.log("gamma").alias("weight"))
    met = placed.join(weights, "ctx", "left").join(lower, "tail")
    return met.select("gram", F.coalesce("own", F.coalesce("weight", F.lit(0.0)) + F.col("low")).alias("logp"))


def score_positions(seq: DataFrame, model: Model) -> DataFrame:
    """``seq`` with its context columns and logp; equal grams are scored once."""
    placed = with_context(seq, model.order).withColumn("gram", gram_of(model.order))
    placed = cut(placed, "lm-positions")
    return placed.join(score(placed.select("gram").distinct(), model), "gram")
