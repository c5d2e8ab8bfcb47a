"""Katz backoff language model: Good-Turing discounts and exactly normalised backoff weights.

Texts lie in blocks. A block sends each distinct key (word, word pair, history)
once, as a front-coded sorted run per key range; the owner of a range adds the
counts of all blocks and answers in the order of the run, so no key is ever
hot and answers carry no keys. Three exchanges: counts of words and pairs;
per-history sums over the distinct pairs seen after it, each pair contributed
by the one block that owns it; the evaluation itself.

    P(w | h) = d(c(hw)) c(hw) / c(h)      if hw was seen in training,
               alpha(h) P(w)              if only h was,
               P(w)                       otherwise
    P(w)     = d(c(w)) c(w) / N, the mass left over goes to one unknown word
    alpha(h) = (1 - sum P(w | h) over w seen after h) / (1 - sum P(w) over them)

d is Good-Turing's r*/r for r <= 5, rescaled so that the mass taken equals that
of the singletons; where counts of counts give no discount in (0, 1] it is
(r - 0.5) / r. A history without any discounted count is divided by c(h) + 1
so that unseen words keep some mass.

Words are keyed by hashes of ``key_bits`` bits, chosen from the token count so
that a given key collides with any other with a chance below 2^-21.

Defined results for odd input: a null or empty text is one end token; a null
id is never held out; repeated rows count each time; equal texts have equal
scores; a text longer than a block is a block of its own and held whole; without
training rows the unknown word has probability one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import IN_SPACED_WORD, LOWER, Block, mix, pack_blocks, pack_ints, squeeze, unpack_ints, unsqueeze, word_bounds, word_hashes
from tessera.llm.shared import PAUSE, cut, release

FOLDS, HELD_OUT = 5, 1
TOP_COUNT = 5
PART_KEYS = 2_500_000
WORD, PAIR = 0, 1
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x1B873593CC9E2D51)
RUN = "bid long, kind int, part int, keys binary, vals binary"
ANSWER = "bid long, kind int, part int, vals binary"
_ANSWER_ARROW = pa.schema([("bid", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("vals", pa.binary())])


def is_held_out(ids: np.ndarray, nulls: np.ndarray, folds: int = FOLDS, fold: int = HELD_OUT) -> np.ndarray:
    out = np.array([zlib.crc32(str(i).encode()) % folds == fold for i in ids.tolist()], bool)
    return out & ~nulls


class Tokens:
    """Distinct words, pairs and histories of a block, and each token's place among them."""

    def __init__(self, block: Block, bits: int):
        body = LOWER[block.body]
        start, end = word_bounds(body, block.at, IN_SPACED_WORD)
        first = np.searchsorted(start, block.at)
        n, docs = len(start), len(block)
        self.first = first + np.arange(docs + 1)  # one end token per text
        word = np.empty(n + docs, np.uint64)
        is_end = np.zeros(n + docs, bool)
        is_end[self.first[1:] - 1] = True
        word[is_end], word[~is_end] = END, word_hashes(body, start, end)
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[self.first[:-1]] = BEGIN
        shift = np.uint64(64 - bits)
        train = np.repeat(~is_held_out(block.ids, block.nulls), np.diff(self.first))
        self.words, self.word_of = np.unique(word >> shift, return_inverse=True)
        pair = mix(history * np.uint64(0xD6E8FEB86659FD93) + word) >> shift
        self.pairs, at, self.pair_of = np.unique(pair, return_index=True, return_inverse=True)
        self.pair_word = self.word_of[at]
        self.histories, self.pair_history = np.unique(history[at] >> shift, return_inverse=True)
        self.word_count = np.bincount(self.word_of[train], minlength=len(self.words))
        self.pair_count = np.bincount(self.pair_of[train], minlength=len(self.pairs))
        self.counts = np.diff(self.first)


def ranges(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of ``parts`` equal key ranges begins in sorted ``keys``."""
    edges = np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def runs(block: Block, kind: int, keys: np.ndarray, values: list[np.ndarray], parts: int, bits: int, pack=pack_ints) -> Iterator[dict]:
    at = ranges(keys, parts, bits)
    for p in range(parts):
        own = slice(at[p], at[p + 1])
        if at[p] < at[p + 1]:
            yield {"bid": block.bid, "kind": kind, "part": p, "keys": pack_ints(keys[own], delta=True), "vals": pack(*[v[own] for v in values])}


def merged(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Runs of one range: block ids, keys per run, sorted distinct keys, place of every key."""
    bids = table.column("bid").to_pylist()
    keys = [unpack_ints(k.as_py(), delta=True).view(np.uint64) for k in table.column("keys")]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return bids, keys, distinct, place


def count_answers(table: pa.Table) -> pa.Table:
    """Total count of each key, doubled, plus one where the block owns the key; and a row of counts of counts."""
    table = table.sort_by("bid")
    bids, keys, distinct, place = merged(table)
    own = np.concatenate([unpack_ints(v.as_py()) for v in table.column("vals")])
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, own)
    owner = np.full(len(distinct), len(place), np.int64)
    np.minimum.at(owner, place, np.arange(len(place)))
    answer = total[place] * 2 + (owner[place] == np.arange(len(place)))
    seen = total[total > 0]
    stats = np.append(np.bincount(np.minimum(seen, TOP_COUNT + 2), minlength=TOP_COUNT + 3), [seen.sum(), len(seen)])
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    vals = [pack_ints(answer[edges[i] : edges[i + 1]]) for i in range(len(bids))]
    return pa.table({"bid": [*bids, -1], "kind": [kind] * (len(bids) + 1), "part": [part] * (len(bids) + 1), "vals": [*vals, pack_ints(stats)]}, schema=_ANSWER_ARROW)


class Discount:
    """Good-Turing factors of one order, from its counts of counts."""

    def __init__(self, stats: np.ndarray):
        n = stats.astype(float)
        self.total, self.types = int(stats[-2]), int(stats[-1])
        k = TOP_COUNT
        self.factor = np.ones(k + 2)
        taken = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - taken) / (1 - taken) if n[r] and taken != 1 else 0.0
            self.factor[r] = d if 0 < d <= 1 else (r - 0.5) / r
        kept = self.total - float(sum((1 - self.factor[r]) * r * n[r] for r in range(1, k + 1)))
        self.base = self.total if kept < self.total else self.total + 1
        self.unknown = 1 - kept / self.base if self.total else 1.0

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Discounted count."""
        return self.factor[np.minimum(count, TOP_COUNT + 1)] * count

    def prob(self, count: np.ndarray) -> np.ndarray:
        """Probability as an order-one model."""
        return np.where(count > 0, self.kept(count) / max(self.base, 1), self.unknown)


def _pack_sums(kept: np.ndarray, low: np.ndarray, total: np.ndarray) -> bytes:
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return squeeze(planes(kept.astype(np.float64)) + planes(low.astype(np.float64)) + planes(total.astype(np.int64)))


def _unpack(data: bytes, types: list[type]) -> list[np.ndarray]:
    raw = np.frombuffer(unsqueeze(data), np.uint8)
    width = sum(np.dtype(t).itemsize for t in types)
    n, out, at = len(raw) // width, [], 0
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).reshape(-1))
        at += n * size
    return out


def history_answers(key: tuple, table: pa.Table) -> pa.Table:
    """Backoff weight and count of each history, in the order of each run."""
    bids, keys, distinct, place = merged(table)
    sums = [_unpack(v.as_py(), [np.float64, np.float64, np.int64]) for v in table.column("vals")]
    kept, low, total = (np.concatenate([s[i] for s in sums]) for i in range(3))
    add = lambda v, t: np.bincount(place, v, minlength=len(distinct)).astype(t)
    kept, low, total = add(kept, float), add(low, float), add(total, np.int64)
    base = np.where(kept < total, total, total + 1)
    alpha = np.where(total > 0, (1 - kept / base) / np.maximum(1 - low, 1e-12), 1.0)
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    vals = []
    for i in range(len(bids)):
        at = place[edges[i] : edges[i + 1]]
        vals.append(squeeze(planes(alpha[at].astype(np.float32)) + planes(np.where(total > 0, base, 0)[at].astype(np.int64))))
    return pa.table({"bid": bids, "kind": [2] * len(bids), "part": [key[0].as_py()] * len(bids), "vals": vals}, schema=_ANSWER_ARROW)


def answers_of(table: pa.Table, kind: int) -> list[bytes]:
    """Packed answers of a kind, in the order of their ranges."""
    rows = [(p, v) for k, p, v in zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("vals").to_pylist(), strict=True) if k == kind]
    return [v for _, v in sorted(rows)]


def _ints(table: pa.Table, kind: int) -> np.ndarray:
    got = answers_of(table, kind)
    return np.concatenate([unpack_ints(v) for v in got]) if got else np.zeros(0, np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and the model's token perplexity, per row."""
    blocks = cut(pack_blocks(docs, id_col, text_col), "katz-blocks")
    n_bytes, n_docs = blocks.agg(F.sum("n_bytes"), F.sum("n_docs")).first()
    size = (n_bytes or 0) // 2 + (n_docs or 0) + 2
    bits, parts = min(64, ceil(log2(size)) + 22), max(1, ceil(size / 3 / PART_KEYS))

    def send_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                block = Block.of(table, i)
                t = Tokens(block, bits)
                rows = [*runs(block, WORD, t.words, [t.word_count], parts, bits), *runs(block, PAIR, t.pairs, [t.pair_count], parts, bits)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("bid", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())]))

    # key ranges are of equal size: each is a task of its own, none shares one by the chance of a hash
    dealt = blocks.mapInArrow(send_counts, RUN).withColumn("range", F.col("kind") * parts + F.col("part")).repartitionById(2 * parts, "range")
    counted = cut(dealt.groupBy("range").applyInArrow(count_answers, ANSWER), "katz-counts")
    stats = {WORD: np.zeros(TOP_COUNT + 5, np.int64), PAIR: np.zeros(TOP_COUNT + 5, np.int64)}
    for kind, vals in counted.where("bid = -1").select("kind", "vals").toLocalIterator():  # one short row per key range
        stats[kind] += unpack_ints(bytes(vals))
    one, two = Discount(stats[WORD]), Discount(stats[PAIR])
    known = counted.where("bid >= 0")

    def send_histories(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        t = Tokens(block, bits)
        words, pairs = _ints(right, WORD) // 2, _ints(right, PAIR)
        count = pairs // 2
        own = (pairs % 2 == 1) & (count > 0)
        add = lambda v: np.bincount(t.pair_history[own], v[own], minlength=len(t.histories))
        low = one.prob(words)[t.pair_word]
        values = [add(two.kept(count)), add(low), np.round(add(count.astype(float))).astype(np.int64)]
        rows = list(runs(block, 2, t.histories, values, parts, bits, _pack_sums))
        return pa.Table.from_pylist(rows, pa.schema([("bid", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())]))

    sums = blocks.groupBy("bid").cogroup(known.groupBy("bid")).applyInArrow(send_histories, RUN)
    release(docs.sparkSession, PAUSE)
    backoff = cut(sums.repartitionById(parts, "part").groupBy("part").applyInArrow(history_answers, ANSWER), "katz-backoff")
    release(docs.sparkSession, PAUSE)
    train_tokens, types = one.total, one.types

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        t = Tokens(block, bits)
        words, count = _ints(right, WORD) // 2, _ints(right, PAIR) // 2
        weights = [_unpack(v, [np.float32, np.int64]) for v in answers_of(right, 2)]
        alpha, base = (np.concatenate([w[i] for w in weights])[t.pair_history] for i in range(2))
        low = one.prob(words)[t.pair_word]
        with np.errstate(divide="ignore"):
            p = np.log10(np.where(count > 0, two.kept(count) / np.maximum(base, 1), np.where(base > 0, alpha.astype(np.float64), 1.0) * low))
        plain = np.log10((words + 0.5) / (train_tokens + 0.5 * (types + 1)))
        per = lambda v: np.add.reduceat(v, t.first[:-1])
        total = per(p[t.pair_of])
        return pa.table({
            "doc_id": block.id_column(), "held_out": is_held_out(block.ids, block.nulls), "n_tokens": t.counts, "n_known": per((words > 0).astype(np.int64)[t.word_of]),
            "train_tokens": np.full(len(block), train_tokens, np.int64), "base_score": per(plain[t.word_of]), "score": total, "perplexity": 10.0 ** (-total / t.counts),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return blocks.groupBy("bid").cogroup(known.unionByName(backoff).groupBy("bid")).applyInArrow(evaluate, schema)
