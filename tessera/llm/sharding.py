"""Sharding by balanced label propagation.

Documents are linked through what they share: an equal text, or a line of at
least 64 characters. They start in order of a text hash, cut into shards of
equal counts. In each round a shared feature names the shard that holds most
of its documents, and a document that other features name more strongly wishes
to move there. Shards exchange rows along closed cycles of moves, so counts stay
at most one apart (law ``rows``): wishes match each other by gain, and rows
without a wish, linked ones at the loss of their votes, may leave in return.
Only cycles with a net gain are taken. Rounds go on until there is none; each
raises the votes that rows have for their own shards, so that ends.

Defined results for odd input: a null text counts as empty, with size 8 and
checksum 0; all empty texts are equal texts; null and repeated ids are sharded
row by row; ties (equal texts in the first cut, shards with equally many rows of
a feature, wishes of equal gain) fall by text hash and id, for equal ones by row;
a text of any length counts whole; fewer rows than shards leave the last shards
empty; an empty table gives an empty result; other columns are ignored by
``shards`` and kept by ``with_shards``, whatever their names.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.running import running_total
from tessera.llm.shared import PAUSE, beside, cut, discard, fresh, numbered, release

SHARDS = 24
ROUNDS = None
LINE = 64
HOT_SHARE = 1000


def _case(column: Column, values: list[int]) -> Column:
    """values[column], for one value per shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), column + 1)


class Arc:
    """Rows that may go one way, in levels of (profit of a row, rows), the best first."""

    def __init__(self, levels: list[tuple[float, int]]):
        self.levels, self.at, self.used = sorted(levels, reverse=True), 0, 0

    def more(self) -> tuple[float, int]:
        """Profit of the next row, and how many have it."""
        if self.at == len(self.levels):
            return -math.inf, 0
        return self.levels[self.at][0], self.levels[self.at][1] - self.used

    def back(self) -> tuple[float, int]:
        """The same for taking back the last row."""
        if self.used:
            return -self.levels[self.at][0], self.used
        return (-self.levels[self.at - 1][0], self.levels[self.at - 1][1]) if self.at else (-math.inf, 0)

    def shift(self, n: int) -> None:
        if n < 0 and not self.used:
            self.at -= 1
            self.used = self.levels[self.at][1]
        self.used += n
        if self.at < len(self.levels) and self.used == self.levels[self.at][1]:
            self.at, self.used = self.at + 1, 0

    def total(self) -> int:
        return sum(n for _, n in self.levels[: self.at]) + self.used


def exchange(arcs: dict[tuple[int, int], Arc], n: int) -> None:
    """Take rows of ``arcs`` between ``n`` places along cycles until none with a profit is left."""
    ways: dict[tuple[int, int], list[tuple[Arc, bool]]] = {}
    for (u, v), arc in arcs.items():
        ways.setdefault((u, v), []).append((arc, True))
        ways.setdefault((v, u), []).append((arc, False))
    best = lambda way: max(((a.more() if on else a.back()), k) for k, (a, on) in enumerate(way))
    worth = np.full((n, n), -np.inf)
    for (u, v), way in ways.items():
        worth[u, v] = best(way)[0][0]
    while True:
        reach, came, met = np.zeros(n), np.full(n, -1), -1
        for _ in range(n):
            through = reach[:, None] + worth
            top = through.max(axis=0)
            better = top > reach + 1e-9
            if not better.any():
                return
            came = np.where(better, through.argmax(axis=0), came)
            reach, met = np.where(better, top, reach), int(better.argmax())
        for _ in range(n):
            met = int(came[met])
        cycle = [met]
        while (up := int(came[cycle[-1]])) != met:
            cycle.append(up)
        cycle.reverse()
        steps = []
        for u, v in zip(cycle, [*cycle[1:], cycle[0]], strict=True):
            (_, rows), k = best(ways[u, v])
            steps.append((u, v, *ways[u, v][k], rows))
        rows = min(x[-1] for x in steps)
        for u, v, arc, on, _ in steps:
            arc.shift(rows if on else -rows)
        for u, v, *_ in steps:
            for x, y in ((u, v), (v, u)):
                if (x, y) in ways:
                    worth[x, y] = best(ways[x, y])[0][0]


def propagate(nodes: DataFrame, features: DataFrame, n_shards: int = SHARDS, rounds: int | None = ROUNDS) -> DataFrame:
    """(key, shard) for ``nodes`` (key, place), linked by ``features`` (key, feature).

    ``place`` orders the first assignment; counts stay at most one apart. ``rounds``
    limits the rounds; by default they end when no move is accepted.
    """
    ranked = running_total(nodes.select("key", "place"), ["place", "key"], F.lit(1), "rank", "sharding-rank")
    n = ranked.count()
    base, extra = divmod(n, n_shards)
    big = extra * (base + 1)
    shard = F.when(F.col("rank") < big, F.floor(F.col("rank") / (base + 1))).otherwise(extra + F.floor((F.col("rank") - big) / max(base, 1))).cast("int")
    labels = cut(ranked.select("key", shard.alias("shard")), "sharding-labels")
    discard(ranked)
    common = cut(features.groupBy("feature").agg(F.count("*").alias("n")).where("n > 1"), "sharding-features")
    # features in over a 1/HOT_SHARE of all places are fewer than HOT_SHARE, so they are broadcast; the others are dealt
    total = common.agg(F.sum("n")).first()[0] or 0
    hot = common.where(F.col("n") * HOT_SHARE > total)
    weighed = features.join(F.broadcast(hot.withColumnRenamed("n", "hot_n")), "feature", "left")
    links = weighed.where("hot_n is not null").select("key", "feature", (1 / F.col("hot_n")).alias("weight"), F.lit(True).alias("hot"))
    dealt = weighed.where("hot_n is null").join(common, "feature").select("key", "feature", (1 / F.col("n")).alias("weight"), F.lit(False).alias("hot"))
    links = cut(links.unionByName(dealt), "sharding-links")
    if links.isEmpty():
        return labels
    hub, done = n_shards, 0
    while rounds is None or done < rounds:
        done += 1
        seen = links.join(labels, "key").groupBy("feature", "shard").agg(F.count("*").alias("n"))
        named = seen.groupBy("feature").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("top")).select("feature", (-F.col("top.s")).alias("to"))
        named = cut(named, "sharding-named")
        near = F.broadcast(named.join(F.broadcast(hot), "feature", "left_semi"))
        met = links.where("hot").join(near, "feature").unionByName(links.where("not hot").join(named, "feature"))
        votes = met.groupBy("key", "to").agg(F.sum("weight").alias("votes"))
        voted = votes.join(labels, "key").groupBy("key").agg(F.max(F.struct("votes", (-F.col("to")).alias("s"))).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("votes"))), F.lit(0.0)).alias("stay"))
        gain = F.round(F.col("best.votes") - F.col("stay"), 9)
        # a row without a wish may go anywhere (to the hub) and loses its votes; levels are octaves, gains rounded down and losses up
        voted = voted.select("key", F.when(gain > 0, -F.col("best.s")).otherwise(hub).alias("to"), F.when(gain > 0, -gain).otherwise(F.round("stay", 9)).alias("loss"))
        level = F.when(F.col("loss") < 0, F.floor(F.log2(-F.col("loss")))).when(F.col("loss") > 0, F.ceil(F.log2("loss"))).cast("int")
        standing = labels.join(voted, "key", "left").select("key", "shard", F.coalesce("to", F.lit(hub)).alias("to"), F.coalesce("loss", F.lit(0.0)).alias("loss"))
        standing = cut(standing.withColumn("level", level), "sharding-standing")
        discard(named)
        arcs: dict[tuple[int, int], list[tuple[float, int]]] = {(hub, s): [(0.0, n)] for s in range(n_shards)}
        for s, t, k, c in standing.groupBy("shard", "to", "level").count().collect():  # rows per pair of shards and octave
            arcs.setdefault((s, t), []).append((0.0 if k is None else -(2.0**k) if t == hub else 2.0**k, c))
        flow = {pair: Arc(levels) for pair, levels in arcs.items()}
        exchange(flow, n_shards + 1)
        taken = {pair: arc.total() for pair, arc in flow.items()}
        if not any(c for (s, _), c in taken.items() if s != hub):
            discard(standing)
            break
        table = labels.sparkSession.createDataFrame([(s, t, c) for (s, t), c in taken.items() if s != hub and c], "shard int, to int, quota long")
        asked = standing.join(F.broadcast(table), ["shard", "to"])
        most = {(s, t): -min(x for x, _ in flow[s, t].levels[: flow[s, t].at + (flow[s, t].used > 0)]) for (s, t), c in taken.items() if t == hub and c}
        limit = F.lit(None).cast("double")
        for (s, _), x in most.items():
            limit = F.when(F.col("shard") == s, F.lit(x)).otherwise(limit)
        asked = asked.where((F.col("to") != hub) | (F.col("loss") <= limit))
        ranked = running_total(asked.withColumn("turn", F.xxhash64("key")), ["shard", "to", "loss", "turn", "key"], F.lit(1), "rank", "sharding-wishes")
        begin = {}
        at = 0
        for s, t, c in sorted(map(tuple, asked.groupBy("shard", "to").count().collect())):  # one row per pair of shards
            begin[s, t], at = at, at + c
        starts = labels.sparkSession.createDataFrame([(*pair, b) for pair, b in begin.items()], "shard int, to int, begin long")
        chosen = ranked.join(F.broadcast(starts), ["shard", "to"]).withColumn("turn", F.col("rank") - F.col("begin")).where(F.col("turn") < F.col("quota"))
        leave_first = [0, *accumulate(taken.get((s, hub), 0) for s in range(n_shards))][:n_shards]
        ends = list(accumulate(taken[hub, s] for s in range(n_shards)))
        seat = F.col("turn") + _case(F.col("shard"), leave_first)
        refuge = F.lit(n_shards - 1)
        for s in reversed(range(n_shards)):
            refuge = F.when(seat < ends[s], F.lit(s)).otherwise(refuge)
        moved = chosen.select("key", F.when(F.col("to") == hub, refuge).otherwise(F.col("to")).alias("to"))
        old, labels = labels, cut(labels.join(moved, "key", "left").select("key", F.coalesce("to", "shard").cast("int").alias("shard")), "sharding-labels")
        for df in (old, standing, ranked):
            discard(df)
    for df in (common, links):
        discard(df)
    return labels


def _prepared(docs: DataFrame, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.octet_length(x) >= LINE), lambda x: F.xxhash64(x, F.lit(1)))
    return text, F.xxhash64(text), F.array_distinct(F.concat(F.array(F.xxhash64(text, F.lit(0))), lines))


def _placed(base: DataFrame, n_shards: int, rounds: int | None) -> DataFrame:
    """``base`` (row, doc_id, place, features, ...) with shard and slot.

    The rank by text hash, id and then row is the key of a row from here on, so
    that ties fall alike however the table is split.
    """
    ranked = running_total(base, ["place", "doc_id", "row"], F.lit(1), "key", "sharding-keys")
    keyed = cut(ranked, "sharding-keyed")
    discard(ranked)
    features = keyed.select("key", F.explode("features").alias("feature"))
    labels = propagate(keyed, features, n_shards, rounds)
    slim = keyed.drop("features").join(labels, "key")
    ordered = running_total(slim, ["shard", "key"], F.lit(1), "rank", "sharding-slots")
    counts = dict(labels.groupBy("shard").count().collect())  # one row per shard
    first = [0, *accumulate(counts.get(s, 0) for s in range(n_shards))][:n_shards]
    for df in (keyed, labels):
        discard(df)
    return ordered.withColumn("slot", (F.col("rank") - _case(F.col("shard"), first)).cast("long"))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, rounds: int | None = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs``."""
    text, place, features = _prepared(docs, text_col)
    base = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"), features.alias("features")), "sharding-base")
    placed = _placed(base, n_shards, rounds)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, rounds: int | None = ROUNDS) -> DataFrame:
    """``docs`` with its own columns, then shard and slot (with underscores before them if ``docs`` has such)."""
    _, place, features = _prepared(docs, text_col)
    row, shard, slot = (fresh(c, docs) for c in ("blp_row", "shard", "slot"))
    kept = numbered(docs, row, "sharding-documents")
    base = cut(kept.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), place.alias("place"), features.alias("features")), "sharding-base")
    placed = cut(_placed(base, n_shards, rounds).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot)), "sharding-placed")
    discard(base)
    release(docs.sparkSession, PAUSE)
    return beside(kept, placed, row).drop(row)
