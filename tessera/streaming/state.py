"""Incremental per-key state as streaming operators: the cache model of a file, and exact duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "history array<string>, seen long, keys array<string>, counts array<long>"
SCORED = "file_id long, event_id long, pos long, w string, p_cache double"


class Cache:
    """Counts, totals and numbers of continuations of everything fed so far, by context length."""

    def __init__(self, order: int, vocab_size: int, discount: float, history: list[str], seen: int, counts: dict[str, int]):
        self.order, self.v, self.discount, self.history, self.seen, self.counts = order, vocab_size, discount, history, seen, counts

    def _context(self, k: int) -> str:
        return " ".join(self.history[len(self.history) - k :])

    def prob(self, w: str) -> float:
        p = 1 / self.v
        for k in range(min(self.order - 1, self.seen) + 1):
            ctx = self._context(k)
            total = self.counts.get(f"t{k} {ctx}", 0)
            if not total:
                break
            c, types = self.counts.get(f"c{k} {ctx} {w}", 0), self.counts[f"y{k} {ctx}"]
            p = max(c - self.discount, 0) / total + self.discount * types / total * p
        return p

    def add(self, w: str) -> None:
        for k in range(min(self.order - 1, self.seen) + 1):
            ctx = self._context(k)
            gram = f"c{k} {ctx} {w}"
            if gram not in self.counts:
                self.counts[f"y{k} {ctx}"] = self.counts.get(f"y{k} {ctx}", 0) + 1
            self.counts[gram] = self.counts.get(gram, 0) + 1
            self.counts[f"t{k} {ctx}"] = self.counts.get(f"t{k} {ctx}", 0) + 1
        self.history = [*self.history, w][1 - self.order :]
        self.seen += 1


def cache_stream(words: DataFrame, vocab_size: int, order: int = 3, discount: float = 0.5) -> DataFrame:
    """A stream of (file_id, ts, event_id, w) scored by each file's own cache before it learns the word.

    Rows of a micro-batch are ordered by time within their key; state outlives
    the batch, so the result does not depend on how the stream is cut.
    """

    def score(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        history, seen, keys, counts = state.get if state.exists else ([], 0, [], [])
        cache = Cache(order, vocab_size, discount, list(history), seen, dict(zip(keys, counts, strict=True)))
        out = []
        for event, w in zip(rows["event_id"].tolist(), rows["w"].tolist(), strict=True):
            out.append((int(key[0]), event, cache.seen, w, cache.prob(w)))
            cache.add(w)
        state.update((cache.history, cache.seen, list(cache.counts), list(cache.counts.values())))
        yield pd.DataFrame(out, columns=["file_id", "event_id", "pos", "w", "p_cache"])

    return words.groupBy("file_id").applyInPandasWithState(score, SCORED, STATE, "append", GroupStateTimeout.NoTimeout)


def first_within(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key has not come before within the watermark: exact duplicates leave the stream."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """What the stream holds now, through a file sink whose checkpoint makes a rerun go on, not repeat."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(out)
