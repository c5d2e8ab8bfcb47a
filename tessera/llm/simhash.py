"""SimHash near-duplicates, found exactly with vantage-point trees.

Two fingerprints that differ in at most r bits differ in at most r // 2 bits in
their upper or in their lower half, so each half gets a tree of its own under
the Hamming distance on 32 bits and the smaller radius. The upper levels of a
tree (fitted on a bounded sample) deal the distinct fingerprints to shards: a
fingerprint lives in one shard and is also sent, as a query, to each
neighbouring shard that the triangle inequality cannot rule out. Inside a shard
the same split goes on until few remain; those are compared, but not within
what a component has gathered. A shard
reports a spanning forest of its links, never all pairs of a group, and
components are joined by alternating large-star and small-star steps.

Defined results for odd input: null and empty texts have fingerprint zero and
link like any other; a bit set in exactly half the hashes is 0; a text of any
length is hashed in pieces of ``SLICE_BYTES``, with the same result; equal
texts share a fingerprint; a row with a null id gets the component of its
fingerprint (null if no id is known there); an empty table gives an empty
result; other columns are ignored, and ``keep_one`` returns them whatever
their names. Rows with equal ids are told apart by ``keep_one``, which keeps
one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import IN_SPACED_WORD, LOWER, id_values, text_bytes, word_bounds
from tessera.llm.shared import cut, discard, fresh

SHINGLE_WORDS = 3
RADIUS = 3
#: Rows that a shard is meant to hold, sampled fingerprints for each shard, and the most levels that deal shards.
SHARD_ROWS = 65_536
SAMPLES_A_SHARD = 32
MOST_DEPTH = 16
LEAF = 192
#: Text that is hashed at once; a longer text is hashed in pieces.
SLICE_BYTES = 256 << 10
HALVES = (32, 0)


def _hash_runs(raw: bytes, start: list[int], end: list[int], tidy: np.ndarray, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words of one text, or of all words if there are fewer.

    tidy: for each word but the first, whether a single space parts it from the one before.
    """
    n, h = len(start), xxhash.xxh64_intdigest
    if not n:
        return []
    last = max(1, n - words + 1)
    ends = end[words - 1 :] if n >= words else [end[-1]]
    own = [h(raw[a:b], 42) for a, b in zip(start[:last], ends, strict=True)]
    # runs over line breaks need their words joined anew; the rest are slices of the text
    for k in sorted({j for o in (np.flatnonzero(~tidy) + 1).tolist() for j in range(max(0, o - words + 1), min(o, last))}):
        own[k] = h(b" ".join(raw[start[j] : end[j]] for j in range(k, min(k + words, n))), 42)
    return own


def _hash_texts(body: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some short texts, and where those of each begin (n + 1 places)."""
    body = LOWER[body]
    start, end = word_bounds(body, at, IN_SPACED_WORD)
    first = np.searchsorted(start, at)
    tidy = (start[1:] - end[:-1] == 1) & (body[end[:-1]] == 0x20) if len(start) > 1 else np.zeros(0, bool)
    raw, s, e = body.tobytes(), start.tolist(), end.tolist()
    hashes: list[int] = []
    begin = [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes.extend(_hash_runs(raw, s[a:b], e[a:b], tidy[a : max(a, b - 1)], words))
        begin.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(begin, np.int64)


def _hash_long(body: np.ndarray, words: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of one long text, piece by piece; the last words of a piece go before the next one."""
    pos, carry, any_ = 0, b"", False
    while pos < len(body):
        stop = min(pos + limit, len(body))
        while stop < len(body):
            gap = np.flatnonzero(~IN_SPACED_WORD[body[stop : stop + limit]])
            stop += int(gap[0]) if len(gap) else min(limit, len(body) - stop)
            if len(gap):
                break
        piece = np.frombuffer(carry + b" ", np.uint8) if carry else np.zeros(0, np.uint8)
        piece = np.concatenate([piece, body[pos:stop]])
        pos = stop
        ends = np.array([0, len(piece)])
        start, end = word_bounds(piece, ends, IN_SPACED_WORD)
        if len(start) >= words:
            any_ = True
            yield _hash_texts(piece, ends, words)
            start, end = start[len(start) - words + 1 :], end[len(end) - words + 1 :]
        carry = b" ".join(piece[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    if carry and not any_:
        yield _hash_texts(np.frombuffer(carry, np.uint8), np.array([0, len(carry)]), words)


def shingle_hashes(body: np.ndarray, at: np.ndarray, words: int, limit: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, where those of each text begin) over all texts, about ``limit`` bytes at a time.

    The hashes of a long text come in several pieces.
    """
    limit = limit or SLICE_BYTES
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + limit, side="right")) - 1, lo + 1), n)
        own = body[at[lo] : at[hi]]
        if len(own) > limit:
            for hashes, begin in _hash_long(own, words, limit):
                yield lo, hashes, begin
        else:
            yield lo, *_hash_texts(own, at[lo : hi + 1] - at[lo], words)
        lo = hi


def fingerprints(body: np.ndarray, at: np.ndarray, words: int = SHINGLE_WORDS, limit: int = 0) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit integers."""
    n = len(at) - 1
    ones, sizes = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for lo, hashes, begin in shingle_hashes(body, at, words, limit):
        own = np.diff(begin)
        full = np.flatnonzero(own)
        if len(full):
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[lo + full] += np.add.reduceat(bits, begin[full], axis=0, dtype=np.int32)
            sizes[lo + full] += own[full]
    return np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, missing = id_values(batch.column(0))
            fp = fingerprints(*text_bytes(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=missing), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, fp long")


def bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_at(points: np.ndarray, vantage: int) -> int | None:
    """Median distance from the vantage point that leaves both sides filled, if there is one."""
    d = np.sort(bit_distance(points, points.dtype.type(vantage)))
    mu = int(d[len(d) // 2])
    if mu >= d[-1]:
        mu = int(d[-1]) - 1
    return mu if mu >= d[0] and d[0] < d[-1] else None


class Tree:
    """Upper levels of a vantage-point tree: node i has its children at 2i (inside) and 2i + 1; mu -1 marks a shard."""

    def __init__(self, points: np.ndarray, depth: int, seed: int):
        self.vantage, self.mu = np.zeros(1 << depth, np.uint32), np.full(1 << depth, -1, np.int8)
        rng, stack = np.random.default_rng(seed), [(1, points)]
        while stack:
            node, own = stack.pop()
            if node >= len(self.mu) or len(own) < 8:
                continue
            vantage = int(own[rng.integers(len(own))])
            mu = split_at(own, vantage)
            if mu is not None:
                self.vantage[node], self.mu[node] = vantage, mu
                near = bit_distance(own, np.uint32(vantage)) <= mu
                stack += [(2 * node, own[near]), (2 * node + 1, own[~near])]

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): the shards whose points may be within the radius of each point."""
        row, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
        out = []
        while len(row):
            inner = np.zeros(len(row), bool)
            low = node < len(self.mu)
            inner[low] = self.mu[node[low]] >= 0
            out.append((row[~inner], node[~inner], home[~inner]))
            row, node, home = row[inner], node[inner], home[inner]
            mu, d = self.mu[node].astype(np.int64), bit_distance(points[row], self.vantage[node]).astype(np.int64)
            go = [(d - radius <= mu, d <= mu, 0), (d + radius > mu, d > mu, 1)]
            row, node, home = (np.concatenate(x) for x in ([row[g] for g, _, _ in go], [2 * node[g] + bit for g, _, bit in go], [(home & own)[g] for g, own, _ in go]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Forest:
    """Union-find over the rows of a shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Add links a-b; those inside a component known so far are dropped in bulk."""
        while len(a):
            self.flatten()
            new = self.parent[a] != self.parent[b]
            a, b = a[new], b[new]
            for i, j in zip(a[:4096].tolist(), b[:4096].tolist(), strict=True):
                ri, rj = self.find(i), self.find(j)
                if ri != rj:
                    self.parent[max(ri, rj)] = min(ri, rj)
                    self.edges.append((i, j))
            a, b = a[4096:], b[4096:]


def link_shard(fps: np.ndarray, home: np.ndarray, shift: int, radius: int, seed: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most ``radius`` bits) between home rows and all rows.

    The shard's tree goes on over the half; points that share a half are split by
    the whole fingerprint. What a component has gathered is not compared again.
    """
    part = ((fps >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    forest, rng = Forest(len(fps)), np.random.default_rng(seed)
    stack = [(np.flatnonzero(home), np.arange(len(fps)), part, radius // 2)]
    while stack:
        own, seen, keys, reach = stack.pop()
        if not len(own) or not len(seen):
            continue
        mu = None
        if len(own) > LEAF:
            vantage = keys[own[rng.integers(len(own))]]
            mu = split_at(keys[own], vantage)
            if mu is None and keys is part:
                stack.append((own, seen, fps, radius))
                continue
        if mu is not None:
            d_own, d_seen = (bit_distance(keys[x], vantage).astype(np.int64) for x in (own, seen))
            stack.append((own[d_own <= mu], seen[d_seen - reach <= mu], keys, reach))
            stack.append((own[d_own > mu], seen[d_seen + reach > mu], keys, reach))
            continue
        for i in range(0, len(own), LEAF):
            rows = own[i : i + LEAF]
            for j in range(0, len(seen), 4096):
                cols = seen[j : j + 4096]
                roots = forest.parent[rows]
                if (roots == roots[0]).all():
                    cols = cols[forest.parent[cols] != roots[0]]
                r, c = np.nonzero(bit_distance(fps[rows][:, None], fps[cols][None, :]) <= radius)
                other = rows[r] != cols[c]
                forest.join(rows[r[other]], cols[c[other]])
    return forest.edges


def links(points: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) between the ``node`` ids of distinct fingerprints ``fp``.

    The trees are fitted on a hash-drawn sample of some ``SAMPLES_A_SHARD``
    fingerprints a shard, two million at most, as trees have ``MOST_DEPTH``
    levels at most; past that, shards grow (17 bytes a row).
    """
    n = points.count()
    depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    share = min(1.0, (SAMPLES_A_SHARD << depth) / max(1, n))
    drawn = points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = np.sort(drawn.toArrow().column(0).to_numpy() if depth else np.zeros(0, np.int64)).view(np.uint64)
    trees = {s: Tree(((picked >> np.uint64(s)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), depth, s + 1) for s in HALVES}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, tree in trees.items():
                part = ((fp.view(np.uint64) >> np.uint64(s)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                row, shard, home = tree.route(part, radius // 2)
                for i in range(0, len(row), 100_000):
                    r, p, h = row[i : i + 100_000], shard[i : i + 100_000], home[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), s, np.int32)), pa.array(p), pa.array(h), pa.array(fp[r]), pa.array(node[r])], names=["half", "shard", "home", "fp", "node"])

    def shard_links(key: tuple, table: pa.Table) -> pa.Table:
        fp, node = table.column("fp").to_numpy(), table.column("node").to_numpy()
        order = np.lexsort((node, fp))
        fp, node, home = fp[order], node[order], table.column("home").to_numpy()[order]
        edges = np.array(link_shard(fp.view(np.uint64), home, int(key[0].as_py()), radius, int(key[1].as_py())), np.int64).reshape(-1, 2)
        a, b = node[edges[:, 0]], node[edges[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = points.select("fp", "node").mapInArrow(deal, "half int, shard long, home boolean, fp long, node long")
    found = dealt.groupBy("half", "shard").applyInArrow(shard_links, "a long, b long")
    return cut(found.distinct(), "simhash-links")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for every node that has a link.

    Large-star then small-star until no link changes; each round is written to
    shared storage.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    previous = None
    for _ in range(max_rounds):
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        earlier, stars = stars, cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "simhash-stars")
        if previous is not None:
            discard(earlier)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    inner = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = cut(fingerprint(docs, id_col, text_col, words), "simhash-fingerprints")
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-points")
    found = components(links(points.where("node is not null"), radius, shard_rows))
    labelled = points.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def first_of_each(kept: DataFrame, found: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows of ``kept`` that come first, by id (null last) and then key, in their component of ``found`` (key, component)."""
    ranked = found.select("key", "component").join(kept.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id")), "key")
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("first"))
    return kept.join(first.select(F.col("first.key").alias(key)), key, "left_semi").drop(key)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that of the least id (null last), with its own columns."""
    key = fresh("simhash_key", docs)
    kept = cut(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-documents")
    found = near_duplicates(kept, key, text_col, words, radius)
    return first_of_each(kept, found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), key, id_col)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
