"""Benchmark decontamination with one FM-index per shard of the training texts.

Every shard (a block of whole texts) turns its words into codes of the
benchmark's vocabulary. A run of words outside it cannot lie inside a match
and collapses to one separator, as do runs too short for the shortest window.
The rest is indexed: suffix array, Burrows-Wheeler transform, a wavelet matrix
for ranks, and every eighth suffix position. All windows search backward
together, occurrences are located by walking to a sampled position, and the
covered words merge into removal spans.

Items that are equal count once. The benchmark is cut into passes of bounded
bytes, a long item into pieces that overlap by a window less a word; each pass is
built with sorted arrays and broadcast once. A long training text is indexed in
pieces that overlap likewise. Words are found by a 64-bit hash; those of an
occurrence are then compared byte by byte.

Defined results for odd input: a null or empty text has no words and no hits; a
text of any length is read whole; overlapping and touching occurrences make one
span; a null item text has no window, a null item id reads as ''; repeated rows
of either table are judged one by one, equal item ids are named once; an empty
benchmark leaves every document clean; an empty table gives an empty result;
other columns are ignored, and ``drop_contaminated`` returns them whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import IN_PLAIN_WORD, LOWER, bounds_in_pieces, text_bytes, word_bounds, word_hashes
from tessera.llm.shared import cut

WINDOW_WORDS = 10
#: Benchmark text that one pass sends to the executors (some 650,000 windows); more text takes more passes.
PASS_BYTES = 4 << 20
SAMPLE_EVERY = 8
#: Training text that one index covers.
CHUNK_BYTES = 2 << 20
SEPARATOR = 1
#: Bytes of a word before its capitals are lowered.
IN_PLAIN_LETTER = IN_PLAIN_WORD[LOWER]


class WaveletMatrix:
    """rank(c, i): occurrences of c among the first i symbols, for arrays of both."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.ones, self.zeros = [], []
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            i = np.where(up, zeros + ones[i], i - ones[i])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return i - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; ``symbols`` ends with a unique least symbol."""
    n, step = len(symbols), 1
    rank = symbols.astype(np.int64)
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else rank[n:]
        key = rank * (max(n, int(rank.max())) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        sa = suffix_array(symbols)
        self.bwt = symbols[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        self.n = len(symbols)
        self.sampled = sa % SAMPLE_EVERY == 0
        self.sample = np.where(self.sampled, sa, 0)[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (rows of codes, left-aligned)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back]
            lo[live], hi[live] = (self.less[c] + self.wavelet.rank(c, x[live]) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            found[open_[done]] = self.sample[self.sample_rank[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.less[c] + self.wavelet.rank(c, rows)
            steps += 1
        return found % self.n


class Benchmark:
    """Vocabulary and distinct windows of some items, with the items each stands in."""

    def __init__(self, items: pa.Table, window: int):
        body, at = text_bytes(items.column(1))
        body = LOWER[body]
        start, end = word_bounds(body, at, IN_PLAIN_WORD)
        self.words, first, codes = np.unique(word_hashes(body, start, end), return_index=True, return_inverse=True)
        self.text, self.start, self.end = body, start[first], end[first]  # one occurrence of each word
        for i in range(len(start)):
            if not self.is_word(codes[i], body[start[i] : end[i]]):
                raise ValueError("two words of the benchmark have one hash")
        bounds = np.searchsorted(start, at)
        count = np.diff(bounds)
        self.names, item = np.unique(np.array(["" if x is None else str(x) for x in items.column(0).to_pylist()], object), return_inverse=True)
        self.window = window
        windows = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        begin, of = spread(bounds[:-1], windows), np.repeat(np.arange(len(count)), windows)
        size = np.minimum(count[of], window)
        rows = np.zeros((len(begin), window), np.int32)
        padded = np.append(codes.astype(np.int32) + SEPARATOR + 1, np.zeros(window, np.int32))
        for k in range(window):
            rows[:, k] = np.where(k < size, padded[begin + k], 0)
        self.patterns, row = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.lengths = (self.patterns > 0).sum(axis=1)
        pairs = np.unique(np.stack([row.reshape(-1), item[of]], 1), axis=0)
        self.items = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.shortest = int(self.lengths.min()) if len(self.patterns) else 0

    @property
    def sigma(self) -> int:
        return len(self.words) + SEPARATOR + 1

    def is_word(self, k: int, word: np.ndarray) -> bool:
        a, b = self.start[k], self.end[k]
        return b - a == len(word) and self.text[a:b].tobytes() == word.tobytes()

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Code of each word, 0 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + SEPARATOR + 1, 0)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] values, then those of first[1]."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def occurrences(bench: Benchmark, body: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of each occurrence; body: lower-case, first: first word of each text."""
    none = np.zeros(0, np.int64)
    if not len(bench.words) or not len(start):
        return none, none
    codes = bench.code(word_hashes(body, start, end))
    known = codes > 0
    cut_before = ~known
    cut_before[first[:-1][first[:-1] < len(start)]] = True
    run = np.cumsum(cut_before)
    sizes = np.bincount(run[known], minlength=run[-1] + 1)
    keep = np.flatnonzero(known & (sizes[run] >= bench.shortest))
    if not len(keep):
        return none, none
    new_run = np.concatenate([[False], run[keep][1:] != run[keep][:-1]])
    place = np.arange(len(keep)) + np.cumsum(new_run)
    symbols = np.full(place[-1] + 3, SEPARATOR, np.int64)
    symbols[place], symbols[-1] = codes[keep], 0
    word_at = np.full(len(symbols), -1, np.int64)
    word_at[place] = keep
    index = FMIndex(symbols, bench.sigma)
    lo, hi = index.search(bench.patterns, bench.lengths)
    found = np.flatnonzero(lo < hi)
    count = hi[found] - lo[found]
    word, which = word_at[index.locate(spread(lo[found], count))], np.repeat(found, count)
    used = np.unique(spread(word, bench.lengths[which]))
    false = [i for i in used.tolist() if not bench.is_word(codes[i] - SEPARATOR - 1, body[start[i] : end[i]])]
    if false:  # a word that only shares a hash
        wrong = np.zeros(len(start) + 1, np.int64)
        wrong[np.array(false) + 1] = 1
        wrong = np.cumsum(wrong)
        good = wrong[word + bench.lengths[which]] == wrong[word]
        word, which = word[good], which[good]
    return word, which


def united(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals, those that overlap or touch as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    new = np.concatenate([[True], first[1:] > last[:-1]]) if len(first) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:] - 1, len(last) - 1)] if len(at) else last


def hits(bench: Benchmark, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words per text; spans as (text, first word, last, first byte, last) within it; pairs (text, item)."""
    body = LOWER[body]
    start, end = word_bounds(body, at, IN_PLAIN_WORD)
    first = np.searchsorted(start, at)
    word, which = occurrences(bench, body, start, end, first)
    text = np.searchsorted(first, word, side="right") - 1
    # a gap between texts keeps spans that end and begin at their edge apart
    a, b = united(word + text, word + bench.lengths[which] + text)
    owner = np.searchsorted(first + np.arange(len(first)), a, side="right") - 1
    a, b = a - owner, b - owner
    spans = (owner, a - first[owner], b - first[owner], start[a] - at[owner], end[b - 1] - at[owner])
    return np.diff(first), spans, _pairs(bench, text, which)


def _pairs(bench: Benchmark, text: np.ndarray, which: np.ndarray) -> np.ndarray:
    several = bench.item_at[which + 1] - bench.item_at[which]
    return np.unique(np.stack([np.repeat(text, several), bench.items[spread(bench.item_at[which], several)]], 1), axis=0)


def hits_of_long(bench: Benchmark, body: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """``hits`` of one text, some ``limit`` bytes at a time; the last words of a piece come again with the next one."""
    before, tail = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts, items = [], [np.zeros((0, 2), np.int64)]
    for start, end in bounds_in_pieces(body, IN_PLAIN_LETTER, limit):
        start, end = np.concatenate([tail[0], start]), np.concatenate([tail[1], end])
        low = LOWER[body[start[0] : end[-1]]]
        word, which = occurrences(bench, low, start - start[0], end - start[0], np.array([0, len(start)]))
        a, b = united(word, word + bench.lengths[which])
        parts.append(np.stack([a + before - len(tail[0]), b + before - len(tail[0]), start[a], end[b - 1]]) if len(a) else np.zeros((4, 0), np.int64))
        items.append(_pairs(bench, np.zeros(len(which), np.int64), which))
        before += len(start) - len(tail[0])
        tail = start[-(bench.window - 1) :], end[-(bench.window - 1) :]
        if bench.window == 1:
            tail = (start[:0], end[:0])
    every = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
    a, b = united(every[0], every[1])
    left = {int(w): int(x) for w, x in zip(every[0], every[2])}
    right = {int(w): int(x) for w, x in zip(every[1], every[3])}
    spans = (np.zeros(len(a), np.int64), a, b, np.array([left[int(w)] for w in a], np.int64), np.array([right[int(w)] for w in b], np.int64))
    return np.array([before]), spans, np.unique(np.concatenate(items), axis=0)


SPAN = "array<struct<word_start:long,word_end:long,byte_start:long,byte_end:long>>"
_SPAN_ARROW = pa.list_(pa.struct([(x, pa.int64()) for x in ("word_start", "word_end", "byte_start", "byte_end")]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN_ARROW), ("items", pa.list_(pa.string()))])


def judged(bench: Benchmark, body: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first text, last, ``hits``) over all texts, about CHUNK_BYTES at a time."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + CHUNK_BYTES, side="right")) - 1, lo + 1), n)
        own = body[at[lo] : at[hi]]
        yield lo, hi, hits_of_long(bench, own, CHUNK_BYTES) if len(own) > CHUNK_BYTES else hits(bench, own, at[lo : hi + 1] - at[lo])
        lo = hi


def _columns(bench: Benchmark, found: tuple[np.ndarray, ...]) -> list[pa.Array]:
    counts, (text, *bounds), pairs = found
    n = len(counts)
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in bounds], [f.name for f in _SPAN_ARROW.value_type])
    lists = lambda owner, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)
    names = pa.array(bench.names[pairs[:, 1]].tolist(), pa.string())
    return [pa.array(counts, pa.int64()), lists(text, spans), lists(pairs[:, 0], names)]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, pass_bytes: int) -> list[DataFrame]:
    """Distinct (item, text), long texts in overlapping pieces, in slices that fit one pass each."""
    piece = max(1, pass_bytes // 4)

    def piece_of(item: pa.Array, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        text = b" ".join(own[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True))
        return pa.RecordBatch.from_arrays([item, pa.array([text.decode()], pa.string())], names=["item", "text"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            for i in range(batch.num_rows):
                own, item = body[at[i] : at[i + 1]], batch.column(0).slice(i, 1)
                if len(own) <= piece:
                    yield batch.slice(i, 1)
                    continue
                start, end, any_ = np.zeros(0, np.int64), np.zeros(0, np.int64), False
                for more_start, more_end in bounds_in_pieces(own, IN_PLAIN_LETTER, piece):
                    start, end = np.concatenate([start, more_start]), np.concatenate([end, more_end])
                    if len(start) >= window:
                        any_ = True
                        yield piece_of(item, own, start, end)
                        start, end = (x[len(x) - window + 1 :] for x in (start, end))
                if len(start) and not any_:
                    yield piece_of(item, own, start, end)

    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    pieces = cut(named.mapInArrow(rows, "item string, text string"), "decontaminate-items")
    size = pieces.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-int(size) // pass_bytes))
    return [pieces] if n == 1 else [pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, removal ``spans`` (words and bytes) and ``items`` found, per row of ``docs``.

    The benchmark is measured first. What fits ``pass_bytes`` goes to the
    executors at once; a larger one is dealt into passes, whose spans and items
    are united per row.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    slices = _items(benchmark, item_col, item_text_col, window, pass_bytes)

    def over(sent, names: list[str]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, found in judged(sent.value, *text_bytes(batch.column(batch.num_columns - 1))):
                    keys = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*keys, *_columns(sent.value, found)], names=names)

        return rows

    if len(slices) == 1:
        rows = over(sc.broadcast(Benchmark(slices[0].toArrow(), window)), _OUT.names)
        return slim.mapInArrow(rows, f"doc_id long, n_words long, spans {SPAN}, items array<string>")
    keyed = cut(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate-documents")
    parts = None
    for slice_ in slices:
        rows = over(sc.broadcast(Benchmark(slice_.toArrow(), window)), ["row", *_OUT.names])
        part = keyed.mapInArrow(rows, f"row long, doc_id long, n_words long, spans {SPAN}, items array<string>")
        parts = part if parts is None else parts.unionByName(part)
    merged = F.expr("""aggregate(array_sort(flatten(collect_list(spans))), cast(array() as %s), (acc, x) ->
        if(size(acc) > 0 and x.word_start <= element_at(acc, -1).word_end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('word_start', element_at(acc, -1).word_start, 'word_end', greatest(x.word_end, element_at(acc, -1).word_end),
                  'byte_start', element_at(acc, -1).byte_start, 'byte_end', greatest(x.byte_end, element_at(acc, -1).byte_end)))),
           concat(acc, array(x))))""" % SPAN)
    return parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs, with their own columns; no shuffle."""
    text_at, sc = docs.columns.index(text_col), docs.sparkSession.sparkContext
    for slice_ in _items(benchmark, item_col, item_text_col, window, pass_bytes):

        def rows(batches: Iterator[pa.RecordBatch], sent=sc.broadcast(Benchmark(slice_.toArrow(), window))) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, (_, (text, *_), _) in judged(sent.value, *text_bytes(batch.column(text_at))):
                    clean[lo + text] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination()``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x.word_end - x.word_start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
