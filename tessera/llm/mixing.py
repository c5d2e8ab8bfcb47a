"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a hash-shuffled order, repeated
once more when its share asks for a second pass. A document's words queue in
packets of at most ``PACKET`` words, so that a very long document does not hold
up its queue. A packet's virtual finish time is the source's words up to its
end, divided by the source's target. All packets are range-sorted by finish
time, summed in that order, and the mix ends where the total budget is spent;
the packet that spends it is cut. As every queue drains at the same virtual
speed, each source then stands within a packet of its target. Packets that
start at or after virtual time one are left out at once: those before them use
up the budget. Only DataFrame functions are used.

Defined results for odd input: a null text has size 0 and is never taken; null
sources form one source, ordered last; equal finish times are taken in the
order of the sources, then of the shuffle; repeated rows, and rows with null or
equal ids, queue one by one; a text of any length is counted whole; if all sizes
are 0 nothing is taken; an empty table gives an empty result; ``mix`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.running import running_total
from tessera.llm.shared import PAUSE, beside, cut, discard, fresh, numbered, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CEILING = 1.5, 2.0
#: Words of a packet, at most.
PACKET = 512


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per source: rank, source_size, target.

    The budget is ``share`` of all tokens. A target above ``ceiling`` times its
    source is lowered to that and the excess shared by weight again; the end of
    that is the level L with sum(least(ceiling * size, L * weight)) = budget,
    read off the sources in order of ceiling * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", ceiling * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = share * F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (budget - filled) / open_weight)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("ratio") < F.coalesce(level, F.lit(float("inf"))), F.col("cap")).otherwise(level * F.col("weight"))
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def _sizes(docs: DataFrame, key: str | None, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """key, doc_id, source, size and the place drawn for every row; equal rows differ in their key only."""
    own = F.col(key) if key else F.monotonically_increasing_id()
    drawn = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    drawn = F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long")
    return cut(docs.select(own.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), drawn.alias("drawn")), "mixing-sizes")


def _copies(sizes: DataFrame, targets: DataFrame, share: float = SHARE, packet: int = PACKET) -> DataFrame:
    """(key, lap, words taken, finish of the last of them) of every copy in the mix.

    sizes: key, source, size and drawn of every row; two laps serve any target up to twice a source's size.
    """
    starts = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    of = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target", F.coalesce(F.sum("source_size").over(starts), F.lit(0)).alias("_start"))
    joined = sizes.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    queue = running_total(joined.where("size > 0"), ["rank", "drawn", "key"], F.col("size"), "ahead", "mixing-queue")
    lap = queue.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("before", F.col("ahead") - F.col("_start") + F.col("lap") * F.col("source_size"))
    cutted = lap.where("before < target").withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {packet}"))))
    at = F.col("before") + F.col("packet") * packet
    words = F.least(F.lit(packet), F.col("size") - F.col("packet") * packet).cast("long")
    packets = cutted.withColumn("words", words).where(at < F.col("target")).withColumn("finish", (at + F.col("words")) / F.col("target"))
    slim = packets.select("finish", "rank", "lap", "drawn", "packet", "key", "words")
    spent = running_total(slim, ["finish", "rank", "lap", "drawn", "packet", "key"], F.col("words"), "spent", "mixing-finish")
    budget = F.broadcast(targets.agg((F.lit(share) * F.sum("source_size")).cast("long").alias("budget")))  # one row
    got = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("budget") - F.col("spent")))
    inside = spent.join(budget, F.lit(True)).where("spent < budget")
    return inside.groupBy("key", "lap").agg(F.sum(got).alias("taken"), F.max("finish").alias("finish"))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, words ``taken`` over both laps, and the virtual finish time of the last of them."""
    sizes = _sizes(docs, None, id_col, text_col, source_col, seed)
    targets = cut(source_targets(sizes), "mixing-targets")
    both = _copies(sizes, targets).groupBy("key").agg(F.sum("taken").alias("taken"), F.max("finish").alias("finish"))
    of = targets.select(F.col("source").alias("_source"), "source_size", "target")
    named = sizes.join(of, F.col("source").eqNullSafe(F.col("_source"))).join(both, "key", "left")
    return named.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """Copies of ``docs`` rows in the mix, with their own columns, range-sorted by virtual finish time.

    Whole documents are kept: a copy is in when more than half of its words are.
    Columns wfq_lap and wfq_finish follow (with underscores before them if ``docs`` has such).
    """
    key, lap, finish, laps = (fresh(c, docs) for c in ("wfq_key", "wfq_lap", "wfq_finish", "wfq_laps"))
    kept = numbered(docs, key, "mixing-documents")
    sizes = _sizes(kept, key, id_col, text_col, source_col, seed)
    copies = _copies(sizes, cut(source_targets(sizes), "mixing-targets"))
    whole = F.when(2 * F.col("taken") > F.col("size"), F.struct("lap", "finish"))
    both = sizes.select("key", "size").join(copies, "key", "left").groupBy(F.col("key").alias(key)).agg(F.collect_list(whole).alias(laps))  # two at most, or none
    chosen = cut(both, "mixing-chosen")
    for df in (copies, sizes):
        discard(df)
    release(docs.sparkSession, PAUSE)
    # the range sort alone exchanges texts
    each = beside(kept, chosen, key).withColumn(laps, F.explode(laps)).withColumns({lap: F.col(laps)["lap"], finish: F.col(laps)["finish"]}).drop(laps)
    return each.repartitionByRange(finish, key, lap).sortWithinPartitions(finish, key, lap).drop(key)
