"""Quality classifier by positive-unlabelled learning.

A linear score over features of the whole text is fitted by minimising the
non-negative unbiased risk with a sigmoid loss over trusted positives (quality
1) and unlabelled texts, which are drawn from all texts, labelled or not. Rows
with quality 0 are never shown. The class prior is estimated from the same two
samples: a scorer is fitted on one half of each; over the other half, the share
of unlabelled texts above a cut, divided by that of positives, bounds the prior
from above where positives are pure, and the cut is taken where this bound and
its confidence term are least.

Training takes at most ``SAMPLE`` ids of either kind, drawn by a hash of the id,
one row each, and runs in one task; scoring visits every row.

Defined results for odd input: null and empty texts are scored from all-zero
features; a text of any length is read in pieces, with the same features; rows
with equal texts have equal scores; a score of exactly 0.5 is accepted; of rows
with equal ids one teaches; a document with several label rows is trusted only
if all say 1; null labels and null ids teach nothing; with no positives or no
unlabelled text every score is 0.5; an empty table gives an empty result; other
columns are ignored, and ``keep_good`` returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import IN_SPACED_WORD, LOWER, bounds_in_pieces, text_bytes, word_bounds, word_hashes

#: Bound on the trusted positives and on the unlabelled texts that training reads.
SAMPLE = 6_000
HOLD_OUT = 3
#: Text whose features are computed at once; a longer text is read in pieces.
CHUNK_BYTES = 256 << 10

# Byte classes: lower, upper, digit, space, line break, UTF-8 lead, UTF-8 tail, comma/stop, and one per busy symbol.
CLASSES = np.full(256, 15, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[32], CLASSES[10] = 0, 1, 2, 3, 4
CLASSES[0xC0:], CLASSES[0x80:0xC0] = 5, 6
for _k, _c in enumerate((".,", "!?", "|", "#*%$&", "@:/", "()[]{}<>", "-_=+~", "\"'`")):
    CLASSES[[ord(x) for x in _c]] = 7 + _k
N_FEATURES = 256 + 128 + 6


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per text: class pairs, ASCII bytes, and shape of words and lines."""
    n = len(at) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(body):
        return out
    size = np.maximum(np.diff(at), 1).astype(np.float32)[:, None]
    row = np.repeat(np.arange(n), np.diff(at))
    kind = CLASSES[body].astype(np.int64)
    pair = row[:-1] * 256 + kind[:-1] * 16 + kind[1:]
    pair = pair[row[:-1] == row[1:]]
    out[:, :256] = np.sqrt(np.bincount(pair, minlength=n * 256).reshape(n, 256) / size)
    ascii_ = body < 128
    out[:, 256:384] = np.sqrt(np.bincount(row[ascii_] * 128 + body[ascii_], minlength=n * 128).reshape(n, 128) / size)
    start, end = word_bounds(body, at, IN_SPACED_WORD)
    first = np.searchsorted(start, at)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    hashes = word_hashes(LOWER[body], start, end)

    def distinct(own: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, own))
        own, h = own[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
        return np.bincount(own[new], minlength=n)

    some = np.maximum(words, 1)
    out[:, 384] = np.log1p(words) / 8
    out[:, 385] = np.bincount(owner, end - start, minlength=n) / some / 16
    out[:, 386] = distinct(owner, hashes) / some
    ls, le = word_bounds(body, at, IN_LINE)
    lf = np.searchsorted(ls, at)
    lines = np.diff(lf)
    out[:, 387] = distinct(np.repeat(np.arange(n), lines), word_hashes(body, ls, le)) / np.maximum(lines, 1)
    out[:, 388] = np.log1p(np.bincount(np.repeat(np.arange(n), lines), le - ls, minlength=n) / np.maximum(lines, 1)) / 8
    out[:, 389] = np.bincount(owner, (end - start) == 1, minlength=n) / some
    return out


IN_LINE = np.ones(256, bool)
IN_LINE[10] = False


def long_features(body: np.ndarray, limit: int = 0) -> np.ndarray:
    """``features`` of one text, ``limit`` bytes at a time."""
    limit = limit or CHUNK_BYTES
    out = np.zeros((1, N_FEATURES), np.float32)
    pairs, ascii_ = np.zeros(256, np.int64), np.zeros(128, np.int64)
    for i in range(0, len(body), limit):
        piece = body[i : i + limit + 1]  # with the byte after it, for the pair across the cut
        kind = CLASSES[piece].astype(np.int64)
        pairs += np.bincount(kind[:-1] * 16 + kind[1:], minlength=256)
        piece = piece[:limit]
        ascii_ += np.bincount(piece[piece < 128], minlength=128)
    size = np.float32(max(len(body), 1))
    out[0, :256], out[0, 256:384] = np.sqrt(pairs / size), np.sqrt(ascii_ / size)
    shape = []
    for inside, lower in ((IN_SPACED_WORD, True), (IN_LINE, False)):
        count = total = single = 0
        seen = [np.zeros(0, np.uint64)]
        for start, end in bounds_in_pieces(body, inside, limit):
            own = body[start[0] : end[-1]]
            hashes = word_hashes(LOWER[own] if lower else own, start - start[0], end - start[0])
            count, total, single = count + len(start), total + int((end - start).sum()), single + int((end - start == 1).sum())
            seen.append(np.unique(hashes))
            if len(seen) > 32:
                seen = [np.unique(np.concatenate(seen))]
        shape.append((count, total, single, len(np.unique(np.concatenate(seen)))))
    (words, letters, single, kinds), (lines, line_bytes, _, line_kinds) = shape
    out[0, 384], out[0, 385], out[0, 386] = np.log1p(words) / 8, letters / max(words, 1) / 16, kinds / max(words, 1)
    out[0, 387], out[0, 388], out[0, 389] = line_kinds / max(lines, 1), np.log1p(line_bytes / max(lines, 1)) / 8, single / max(words, 1)
    return out


class Model:
    """Linear score on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weight, self.bias, self.prior = mean, scale, weight, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by full-batch Adam."""
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1], np.float64), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, epochs + 1):
        gp, gu = (1 / (1 + np.exp(-(x @ w.astype(np.float32) + b))) for x in (p, u))  # sigmoid loss of -g is sigmoid(g)
        dp, du = gp * (1 - gp), gu * (1 - gu)
        negative = gu.mean() - prior * gp.mean()
        if negative >= 0:
            cp, cu = (-2 * prior / len(p)) * dp, du / len(u)
        else:  # the estimated negative risk fell below zero: step back along it
            cp, cu = (prior / len(p)) * dp, -du / len(u)
        grad = np.append(cp.astype(np.float32) @ p + cu.astype(np.float32) @ u + decay * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, float(b), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the purest upper part of a held-apart half's scores."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    model = fit(positive[::2], unlabelled[::2], 0.5)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    cuts = np.unique(np.concatenate([p, u]))
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    some = above_p > 0
    above_p, above_u = above_p[some], above_u[some]
    unsure = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(u)) + 1.01 / np.sqrt(len(p)))
    best = int(np.argmin((above_u + unsure) / above_p))
    return float(min(max(above_u[best] / above_p[best], 0.02), 0.98))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD_OUT == 1, F.lit(False))


def _features(column: pa.Array) -> Iterator[np.ndarray]:
    """Features of all texts of a column, in order and in pieces."""
    body, at = text_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + CHUNK_BYTES, side="right")) - 1, lo + 1), lo + 500, n)
        own = body[at[lo] : at[hi]]
        yield long_features(own) if len(own) > CHUNK_BYTES else features(own, at[lo : hi + 1] - at[lo])
        lo = hi


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Model from rows outside the held-out fold; None if there are no positives or no other texts."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("mark"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & ~held_out("id"))
    ids = slim.select("id").distinct()
    drawn = lambda df, trusted: df.select("id", F.lit(trusted).alias("trusted"), F.lit(not trusted).alias("other")).orderBy(F.xxhash64("id"), "id").limit(sample)
    both = drawn(ids.join(marks.where("mark = 1"), "id", "left_semi"), True).unionByName(drawn(ids, False))
    picked = both.groupBy("id").agg(F.max("trusted").alias("trusted"), F.max("other").alias("other"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for x in _features(batch.column(1)):
                own = batch.slice(lo, len(x))
                lo += len(x)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["id", "trusted", "other", "x"])

    asked = slim.join(F.broadcast(picked), "id").select("id", "text", "trusted", "other")  # 2 * sample rows at most
    single = asked.mapInArrow(rows, "id long, trusted boolean, other boolean, x binary").groupBy("id", "trusted", "other").agg(F.min("x").alias("x"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        x = np.array([np.frombuffer(r.as_py(), np.float16) for r in table.column("x")]).astype(np.float32)
        order = np.argsort(table.column("id").to_numpy())
        trusted, other = (np.array(table.column(c).to_pylist(), bool)[order] for c in ("trusted", "other"))
        positive, unlabelled = x[order][trusted], x[order][other]
        if not len(positive) or not len(unlabelled):
            return
        prior = class_prior(positive, unlabelled)
        m = fit(positive, unlabelled, prior)
        yield pa.RecordBatch.from_arrays([*(pa.array([v.astype(np.float64).tobytes()], pa.binary()) for v in (m.mean, m.scale, m.weight)), pa.array([m.bias]), pa.array([prior])], names=["mean", "scale", "weight", "bias", "prior"])

    got = single.repartition(1).mapInArrow(learn, "mean binary, scale binary, weight binary, bias double, prior double").first()
    if got is None:
        return None
    mean, scale, weight = (np.frombuffer(bytes(v), np.float64) for v in (got["mean"], got["scale"], got["weight"]))
    return Model(mean.astype(np.float32), scale.astype(np.float32), weight, got["bias"], got["prior"])


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    parts = [model.score(x) if model else np.full(len(x), 0.5) for x in _features(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1: good) of every row."""
    model = train(docs, labels, id_col, text_col, label_col, sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, with their own columns, in one pass over the texts."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    text_at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(text_at)) >= 0.5))

    return docs.mapInArrow(rows, docs.schema)
