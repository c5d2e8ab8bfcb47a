"""Suffix-array dedup of repeated substrings by a common-prefix-aware merge sort.

A 50-byte window is a repeat when it also starts in a document with a smaller
id. Sorting every suffix of the corpus would move many times its size, so the
suffix array is sparse but exact: each window is filed under the position in it
whose 32-byte gram has the least order hash. Equal windows file under the same
gram at the same offset, wherever they stand, and one position files about ten
windows.

1. Every block sends its distinct gram fingerprints as front-coded sorted runs,
   one per fingerprint range; those met in two documents come back.
2. For such grams the block builds the suffix from the gram with what stands
   before it, sorts them, and sends front-coded runs (common prefix length with
   the predecessor, rest), with the smallest document of each distinct suffix.
3. A range merges its runs with a loser tree that compares common-prefix
   lengths first and bytes only past the prefix two suffixes are known to
   share. Neighbours with one gram form a group; windows of a group get their
   smallest document. Answers carry only windows whose smallest document
   precedes the one that the block knew.
4. The block marks its repeated windows and merges them into removal spans.

A block sends each distinct suffix once, so no document count, however large,
meets in one task; fingerprint collisions only send more to the exact step.

Defined results for odd input: a null or empty text has no bytes; texts below
the window length are untouched; a null id comes after every other id, and rows
with equal ids do not remove each other's bytes; a text longer than a block is a
block of its own and held whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import BYTE_CODES, Block, mix, pack_blocks, pack_ints, squeeze, unpack_ints, unsqueeze
from tessera.llm.shared import PAUSE, cut, release

WINDOW, GRAM = 50, 32
REACH = WINDOW - GRAM  # windows file at most this far before their gram
WIDTH = 72  # gram, two length bytes, up to 18 bytes after and 18 before, padding to a multiple of 8
BITS = 48
PART_BYTES = 24 << 20
_CODES32 = (BYTE_CODES >> np.uint64(32)).astype(np.uint32)
_ORDER_SALT = np.uint32(0x9E3779B1)
RUN = "bid long, part int, vals binary"
_RUN_ARROW = pa.schema([("bid", pa.int64()), ("part", pa.int32()), ("vals", pa.binary())])


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def filed(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram position) of every run of windows filed under one gram."""
    body, at, n = block.body, block.at, len(block.body)
    none = (np.zeros(0, np.int64),) * 3
    if n < WINDOW:
        return none
    h = _CODES32[body]
    for k, m in ((1, 0x2C1B3C6D), (2, 0x297A2D39), (4, 0x1B56C4E9), (8, 0x7FEB352D), (16, 0x846CA68B)):
        h = h[:-k] * np.uint32(m) + h[k:]
    h ^= h >> np.uint32(15)
    h *= _ORDER_SALT
    h ^= h >> np.uint32(13)
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        key = np.minimum(key[:-k], key[k:])
    key = np.minimum(key[:-3], key[3:])  # least of 19 grams
    gram = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(gram) + 1, np.int32)
    lens = np.diff(at)
    long = lens >= WINDOW
    np.add.at(whole, at[:-1][long], 1)
    np.add.at(whole, at[1:][long] - WINDOW + 1, -1)
    ok = np.cumsum(whole[:-1]) > 0
    where = np.flatnonzero(ok)
    if not len(where):
        return none
    g = gram[where]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(g)) - 1
    return where[first], where[last], g[first]


def fingerprint(body: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """48-bit fingerprints of the grams at some positions."""
    views = np.lib.stride_tricks.sliding_window_view(body, GRAM)[gram]
    words = np.ascontiguousarray(views).view(np.uint64)
    acc = np.zeros(len(gram), np.uint64)
    for i in range(GRAM // 8):
        acc = mix(acc * np.uint64(0x9DDFEA08EB382D69) ^ words[:, i])
    return acc >> np.uint64(64 - BITS)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    edges = np.array([(p << BITS) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def met_twice(key: tuple, table: pa.Table) -> pa.Table:
    """For each block of a range, its fingerprints that two documents have."""
    bids, keys, flags = table.column("bid").to_pylist(), [], []
    for v in table.column("vals"):
        k, f = _split(v.as_py())
        keys.append(unpack_ints(k, delta=True))
        flags.append(np.unpackbits(np.frombuffer(unsqueeze(f), np.uint8), count=len(keys[-1])).astype(bool))
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    distinct, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    twice = count > 1
    twice[place[np.concatenate(flags)]] = True
    hit = twice[place]
    out = [(b, k[hit[lo:hi]]) for b, k, lo, hi in zip(bids, keys, edges[:-1], edges[1:], strict=True)]
    out = [(b, k) for b, k in out if len(k)]
    part = key[0].as_py()
    return pa.table({"bid": [b for b, _ in out], "part": [part] * len(out), "vals": [pack_ints(k, delta=True) for _, k in out]}, schema=_RUN_ARROW)


def rows_of(block: Block, p1: np.ndarray, p2: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Fixed-width suffix keys: gram, lengths after and before it, the bytes after, the bytes before reversed."""
    out = np.zeros((len(gram), WIDTH), np.uint8)
    after, before = p2 + WINDOW - gram - GRAM, gram - p1
    padded = np.concatenate([np.zeros(REACH, np.uint8), block.body, np.zeros(REACH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, GRAM)
    out[:, :GRAM] = view[gram + REACH]
    out[:, GRAM], out[:, GRAM + 1] = after, before
    at = gram + REACH + GRAM
    rows = np.arange(len(gram))
    for j in range(REACH):
        live = rows[j < after]
        out[live, GRAM + 2 + j] = padded[at[live] + j]
        live = rows[j < before]
        out[live, GRAM + 2 + after[live] + j] = padded[gram[live] + REACH - 1 - j]
    return out


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted row with the one before, and the rest of every row."""
    lcp = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), WIDTH)
    return lcp, rows[np.arange(WIDTH)[None, :] >= lcp[:, None]].tobytes()


def decoded(lcp: np.ndarray, rest: bytes) -> np.ndarray:
    """Rows of a front-coded run."""
    rows = np.zeros((len(lcp), WIDTH), np.uint8)
    fresh = np.arange(WIDTH)[None, :] >= lcp[:, None]
    rows[fresh] = np.frombuffer(rest, np.uint8)
    index = np.arange(len(lcp))
    for j in range(WIDTH):
        rows[:, j] = rows[np.maximum.accumulate(np.where(fresh[:, j], index, 0)), j]
    return rows


class LoserTree:
    """Merge of sorted runs of fixed-width strings with known common prefixes.

    Every contender carries its common prefix with the last winner. Of two, the
    longer prefix is the smaller string; only equal prefixes are compared, from
    that point on, and what is learnt is kept with the loser.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.k = 1 << max(0, len(runs) - 1).bit_length()
        self.at = [0] * self.k
        self.head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (self.k - len(runs))
        self.lcp = [0] * self.k
        self.loser = [0] * self.k
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = self._play(a, b)
        self.loser[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.lcp[a], self.lcp[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        u, v = int.from_bytes(x[p:], "big"), int.from_bytes(y[p:], "big")
        if u == v:
            win, lose, common = (a, b, WIDTH) if a < b else (b, a, WIDTH)
        else:
            common = p + (((WIDTH - p) * 8 - (u ^ v).bit_length()) >> 3)
            win, lose = (a, b) if u < v else (b, a)
        self.lcp[lose] = common
        return win, lose

    def merge(self) -> tuple[list[int], list[int], list[int]]:
        """Run, place in it and common prefix with the string before, of every string in order."""
        out_run, out_at, out_lcp = [], [], []
        k, head, lcp, loser, at, play = self.k, self.head, self.lcp, self.loser, self.at, self._play
        w = self.winner
        while head[w] is not None:
            i = at[w]
            out_run.append(w)
            out_at.append(i)
            out_lcp.append(lcp[w])
            i += 1
            at[w] = i
            strings, prefixes = self.runs[w]
            if i < len(strings):
                head[w], lcp[w] = strings[i], prefixes[i]
            else:
                head[w], lcp[w] = None, 0
            node = (w + k) >> 1
            while node:
                c = loser[node]
                if head[c] is not None:
                    if head[w] is None or lcp[c] > lcp[w]:
                        loser[node], w = w, c
                    elif lcp[c] == lcp[w]:
                        w, loser[node] = play(w, c)
                node >>= 1
        return out_run, out_at, out_lcp


def text_of(row: bytes) -> bytes:
    """All bytes of the windows filed under a suffix, in order."""
    after, before = row[GRAM], row[GRAM + 1]
    start = GRAM + 2 + after
    return row[start : start + before][::-1] + row[:GRAM] + row[GRAM + 2 : start]


def merge_range(key: tuple, table: pa.Table, parts: int) -> pa.Table:
    """Answers of a range; notes, which lie in parts beyond the ranges, pass through to their block."""
    if key[0].as_py() >= parts:
        return table.select(["bid", "part", "vals"]).cast(_RUN_ARROW)
    table = table.sort_by("bid")
    bids, runs, docs = table.column("bid").to_pylist(), [], []
    for v in table.column("vals"):
        lcp, rest, least = _split(v.as_py())
        lcp = unpack_ints(lcp)
        raw = decoded(lcp, unsqueeze(rest)).tobytes()
        runs.append(([raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)], lcp.tolist()))
        docs.append(unpack_ints(least))
    run, at, lcp = (np.array(x, np.int64) for x in LoserTree(runs).merge())
    edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc = np.concatenate(docs)[edges[run] + at]
    suffix, group = np.cumsum(lcp < WIDTH) - 1, np.cumsum(lcp < GRAM) - 1
    first = np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1]))
    least = np.minimum.reduceat(doc, first)
    group_of = group[first]
    kinds = np.bincount(group_of)
    # groups with one suffix: every window has the least document of the suffix
    late = np.flatnonzero((kinds[group] == 1) & (doc > least[suffix]))
    answers = [np.stack([run[late], at[late], np.full(len(late), -1), least[suffix[late]]], 1)]
    # others: windows shared by different suffixes of the gram
    several = np.flatnonzero(kinds[group_of] > 1)
    ends = np.append(first[1:], len(doc))
    out: list[tuple[int, int, int, int]] = []
    i = 0
    while i < len(several):
        j = i
        while j < len(several) and group_of[several[j]] == group_of[several[i]]:
            j += 1
        texts, best = [], {}
        for s in several[i:j].tolist():
            r, a, d = int(run[first[s]]), int(at[first[s]]), int(least[s])
            text = text_of(runs[r][0][a])
            texts.append(text)
            for o in range(len(text) - WINDOW + 1):
                w = text[o : o + WINDOW]
                if d < best.get(w, d + 1):
                    best[w] = d
        for s, text in zip(several[i:j].tolist(), texts, strict=True):
            firsts = [best[text[o : o + WINDOW]] for o in range(len(text) - WINDOW + 1)]
            for m in range(int(first[s]), int(ends[s])):
                own = int(doc[m])
                out.extend((int(run[m]), int(at[m]), o, d) for o, d in enumerate(firsts) if d < own)
        i = j
    answers.append(np.array(out, np.int64).reshape(-1, 4))
    every = np.concatenate(answers)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    bounds = np.searchsorted(every[:, 0], np.arange(len(bids) + 1))
    rows = [(bids[r], every[bounds[r] : bounds[r + 1]]) for r in range(len(bids)) if bounds[r] < bounds[r + 1]]
    part = key[0].as_py()
    vals = [_join([pack_ints(x[:, 1], delta=True), pack_ints(x[:, 2]), pack_ints(x[:, 3])]) for _, x in rows]
    return pa.table({"bid": [b for b, _ in rows], "part": [part] * len(rows), "vals": vals}, schema=_RUN_ARROW)


def send_fingerprints(block: Block, parts: int) -> pa.RecordBatch:
    p1, _, gram = filed(block)
    keys = fingerprint(block.body, gram) if len(gram) else np.zeros(0, np.uint64)
    doc = block.ids[block.doc_of(p1)] if len(gram) else keys.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    rows = []
    if len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keys = keys[first]
        at = ranges(keys, parts)
        for p in range(parts):
            own = slice(at[p], at[p + 1])
            if at[p] < at[p + 1]:
                rows.append({"bid": block.bid, "part": p, "vals": _join([pack_ints(keys[own], delta=True), squeeze(np.packbits(several[own]).tobytes())])})
    return pa.RecordBatch.from_pylist(rows, _RUN_ARROW)


def send_suffixes(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """Runs of the block's suffixes whose gram two documents have, and a note of where they stand."""
    if not len(left) or not len(right):
        return _RUN_ARROW.empty_table()
    block = Block.of(left)
    p1, p2, gram = filed(block)
    keys = fingerprint(block.body, gram)
    twice = np.sort(np.concatenate([unpack_ints(v.as_py(), delta=True) for v in right.column("vals")])).view(np.uint64)
    hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
    p1, p2, gram, keys = p1[hit], p2[hit], gram[hit], keys[hit]
    doc = block.ids[block.doc_of(p1)]
    rows = rows_of(block, p1, p2, gram)
    part = ((keys >> np.uint64(16)) * np.uint64(parts) >> np.uint64(BITS - 16)).astype(np.int64)
    raw = rows.tobytes()
    strings = [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)]
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    order = order[np.argsort(part[order], kind="stable")]
    rows, part_sorted, doc_sorted = rows[order], part[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1) | (part_sorted[1:] != part_sorted[:-1])
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc_sorted, first)
    rows, suffix_part = rows[first], part_sorted[first]
    at = np.searchsorted(suffix_part, np.arange(parts + 1))
    out = []
    for p in np.unique(suffix_part).tolist():
        own = slice(at[p], at[p + 1])
        lcp, rest = front_coded(rows[own])
        out.append({"bid": block.bid, "part": p, "vals": _join([pack_ints(lcp), squeeze(rest), pack_ints(least[own])])})
    note = _join([pack_ints(p1, delta=True), pack_ints(p2 - p1), pack_ints(number), pack_ints(least), pack_ints(at)])
    # block numbers are spread by a hash, as their lower bits are alike
    out.append({"bid": block.bid, "part": parts + int(mix(np.array([block.bid], np.uint64))[0]) % parts, "vals": note})
    return pa.Table.from_pylist(out, _RUN_ARROW)


_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove(left: pa.Table, right: pa.Table, n_ranges: int) -> pa.Table:
    """Removal spans and kept bytes of a block's documents."""
    block = Block.of(left)
    n = len(block.body)
    gone = np.zeros(n + 1, np.int32)
    parts = dict(zip(right.column("part").to_pylist(), right.column("vals").to_pylist(), strict=True)) if len(right) else {}
    note = next((v for p, v in parts.items() if p >= n_ranges), None)
    if note is not None:
        packed = _split(note)
        p1, width, number = unpack_ints(packed[0], delta=True), unpack_ints(packed[1]) + 1, unpack_ints(packed[2])
        least, at = unpack_ints(packed[3]), unpack_ints(packed[4])
        doc = block.ids[block.doc_of(p1)]
        best = least.copy()
        single: list[np.ndarray] = []
        for p, v in parts.items():
            if p < n_ranges:
                i, o, d = (unpack_ints(x, delta=k == 0) for k, x in enumerate(_split(v)))
                i = i + at[p]
                all_ = o < 0
                best[i[all_]] = d[all_]
                single.append(np.stack([i[~all_], o[~all_], d[~all_]], 1))
        full = doc > best[number]
        np.add.at(gone, p1[full], 1)
        np.add.at(gone, p1[full] + width[full] + WINDOW - 1, -1)
        some = np.concatenate(single) if single else np.zeros((0, 3), np.int64)
        if len(some):
            some = some[np.argsort(some[:, 0], kind="stable")]
            lo, hi = np.searchsorted(some[:, 0], number), np.searchsorted(some[:, 0], number, side="right")
            live = np.flatnonzero((hi > lo) & ~full)
            count = (hi - lo)[live]
            ends = np.cumsum(count)
            rows = some[np.repeat(lo[live] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
            owner = np.repeat(live, count)
            hit = doc[owner] > rows[:, 2]
            start = p1[owner[hit]] + rows[hit, 1]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
    out = np.cumsum(gone[:-1]) > 0
    edge = np.zeros(n + 1, bool)
    edge[block.at] = True
    before, after = np.append(False, out[:-1])[:n], np.append(out[1:], False)[:n]
    start = np.flatnonzero(out & (~before | edge[:-1]))
    end = np.flatnonzero(out & (~after | edge[1:])) + 1
    owner = block.doc_of(start)
    spans = pa.StructArray.from_arrays([pa.array(start - block.at[owner]), pa.array(end - block.at[owner])], ["start", "end"])
    offsets = np.searchsorted(owner, np.arange(len(block) + 1))
    keep_at = np.concatenate([[0], np.cumsum(~out)])[block.at]
    kept = block.body[~out].tobytes()
    return pa.table({
        "doc_id": block.id_column(), "n_bytes": np.diff(block.at), "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
        "kept": pa.array([kept[a:b] for a, b in zip(keep_at[:-1].tolist(), keep_at[1:].tolist(), strict=True)], pa.binary()),
    })


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removal ``spans`` (bytes, maximal) and the ``kept`` bytes, per row of ``docs``."""
    blocks = cut(pack_blocks(docs, id_col, text_col), "suffix-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, -(-int(total) // PART_BYTES))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                yield send_fingerprints(Block.of(table, i), parts)

    twice = cut(blocks.mapInArrow(fingerprints, RUN).repartitionById(parts, "part").groupBy("part").applyInArrow(met_twice, RUN), "suffix-grams")
    sent = blocks.groupBy("bid").cogroup(twice.groupBy("bid")).applyInArrow(lambda left, right: send_suffixes(left, right, parts), RUN)
    release(docs.sparkSession, PAUSE)
    # ranges are of equal size: each is a task of its own, none shares one by the chance of a hash
    dealt = sent.repartitionById(2 * parts, "part").groupBy("part")
    answers = cut(dealt.applyInArrow(lambda key, table: merge_range(key, table, parts), RUN), "suffix-answers")
    release(docs.sparkSession, PAUSE)
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return blocks.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(lambda left, right: remove(left, right, parts), schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``dedup_substrings()``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
