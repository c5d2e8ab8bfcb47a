"""Near copies on word shingles: SimHash trees and MinHash buckets propose, the Jaccard similarity decides.

A text is the set of its runs of five words. Texts of equal sets are one class,
and its first row stands for it. The SimHash fingerprints of the sets go through
the vantage-point trees of ``simhash``, whose shards report spanning links
between fingerprints at most ``RADIUS`` bits apart; equal fingerprints are
linked too. Those links whose sets have a Jaccard similarity of at least 0.8
stand and are joined to components. Most pairs that are less alike than some
0.95 lie further apart than trees can reach, so what unlike components hold is
proposed once more: twenty bands of five minima put two sets of similarity 0.8
into a common bucket with probability 1 - (1 - 0.8^5)^20 = 0.9996, more alike
ones more surely; two classes in a common bucket are linked by the same test.

Classes are dealt to tiles, those of a bucket next to each other. Two wide tiles
(a bounded number of classes) that hold unlike components of a bucket meet in
one task with a byte of each of the hundred minima of the classes in such
buckets; fewer than 60 equal ones of a pair of similarity 0.8 have a chance below
10^-5. Those with a partner for whom the bytes leave hope meet again with their
sets, in tiles of bounded bytes. The task compares the sets and reports a
spanning forest of the links, so no pair is ever a row, and a class is sent on
only to tiles that hold, in a bucket of its own, another component than its own.
A bucket that spans several wide tiles is first thinned: each of its classes is
compared with one of them, drawn anew in every round, until the bucket is one
component or a round links nothing. So a group of copies costs a comparison a
row; only what hangs together loosely in a large bucket is compared tile by tile.

Defined results for odd input: texts of fewer than five words have one shingle,
of all of them; null, empty and blank texts have none and are one class; a
similarity of exactly 0.8 links; a text of any length is hashed in pieces, its
set is held whole (8 bytes a distinct shingle); repeated rows and rows with
equal or null ids are told apart; an empty table gives an empty result; all
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.packing import text_bytes
from tessera.llm.running import running_total
from tessera.llm.shared import cut, discard, fresh
from tessera.llm.sieve import sieve, sifted
from tessera.llm.simhash import RADIUS, Forest, components, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Bytes of the sets of a tile, and what a class weighs beside its set.
TILE_BYTES, CLASS_BYTES = 512 << 10, 512
#: Classes that are weighed against each other by their minima in one task, and at once.
TILE_CLASSES, BLOCK = 4_096, 512
#: Classes of a bucket beyond which it is thinned first.
WIDE = 20_000
#: Minima of a hundred that must agree, by a byte each, for the sets to be compared.
HOPE = 60

_draws = np.random.default_rng(20)
_TIMES = _draws.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _draws.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_BAND_TIMES = _draws.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(body: np.ndarray, at: np.ndarray, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct shingle hashes) of every text, in order."""
    held, parts = -1, []
    for lo, hashes, begin in shingle_hashes(body, at, words):
        for i in range(len(begin) - 1):
            if parts and held != lo + i:
                yield held, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
                parts = []
            held = lo + i
            parts.append(np.unique(hashes[begin[i] : begin[i + 1]]))
            if len(parts) > 1 and len(parts) % 64 == 0:
                parts = [np.unique(np.concatenate(parts))]
    if parts:
        yield held, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def buckets(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket a band, and a byte of each minimum, for each text that has shingles."""
    full = begin[:-1][np.diff(begin) > 0]
    least = np.empty((BANDS * ROWS, len(full)), np.uint64)
    for i, (times, flip) in enumerate(zip(_TIMES, _FLIPS, strict=True)):
        least[i] = np.minimum.reduceat((hashes ^ flip) * times, full)
    least = _mixed(least)
    short = np.ascontiguousarray((least >> np.uint64(56)).astype(np.uint8).T)
    return _mixed((least.reshape(BANDS, ROWS, -1) * _BAND_TIMES[:, :, None]).sum(axis=1, dtype=np.uint64)).T, short


def fingerprints(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SimHash of each set; an empty one has zero."""
    size = np.diff(begin)
    full = np.flatnonzero(size)
    first, ones = begin[:-1][full], np.zeros((len(size), 64), np.int64)
    for lo in range(0, len(hashes), 65_536):
        part = hashes[lo : lo + 65_536]
        a, b = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + len(part))
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[full[a:b]] += np.add.reduceat(bits, np.maximum(first[a:b], lo) - lo, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > size[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def sketches(docs: DataFrame, key: str, text_col: str, words: int) -> DataFrame:
    """key, print (digest of the set), weight (its bytes), fp (its SimHash), buckets and bytes of the minima of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size, lo = batch.column(0), [], 0, 0

            def flush() -> pa.RecordBatch:
                begin = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int64)
                hashes = np.concatenate(held)
                found, short = buckets(hashes, begin) if len(hashes) else (np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS * ROWS), np.uint8))
                short = iter(short)
                minima = pa.array([next(short).tobytes() if n else b"" for n in np.diff(begin).tolist()], pa.binary())
                at = np.concatenate([[0], np.cumsum(np.where(np.diff(begin) > 0, BANDS, 0))])
                placed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(found).reshape(-1).view(np.int64)))
                prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in held], pa.binary())
                return pa.RecordBatch.from_arrays([keys.slice(lo, len(held)), prints, pa.array(8 * np.diff(begin)), pa.array(fingerprints(hashes, begin).view(np.int64)), placed, minima], names=["key", "print", "weight", "fp", "buckets", "minima"])

            for _, own in shingle_sets(*text_bytes(batch.column(1)), words):
                held.append(own)
                size += len(own)
                if size > 65_536:
                    yield flush()
                    lo, held, size = lo + len(held), [], 0
            if held:
                yield flush()

    slim = docs.select(F.col(key), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "key long, print binary, weight long, fp long, buckets array<long>, minima binary")


def sets_of(docs: DataFrame, key: str, text_col: str, words: int) -> DataFrame:
    """node and shingles (its set as bytes) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size, lo = batch.column(0), [], 0, 0
            for _, own in shingle_sets(*text_bytes(batch.column(1)), words):
                held.append(own.tobytes())
                size += len(held[-1])
                if size > TILE_BYTES:
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, len(held)), pa.array(held, pa.binary())], names=["node", "shingles"])
                    lo, held, size = lo + len(held), [], 0
            if held:
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(held)), pa.array(held, pa.binary())], names=["node", "shingles"])

    slim = docs.select(F.col(key), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "node long, shingles binary")


def _alike(n: np.ndarray, m: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    return both >= similarity * (n + m - both) - 1e-9


def hopeful_pairs(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that their sizes and minima leave hope."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), BANDS * ROWS) for i in (4, 5))
            keep = (np.minimum(n, m) >= similarity * np.maximum(n, m)) & ((x == y).sum(axis=1) >= HOPE)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    side = lambda c: heads.select(F.col("node").alias(c), F.col("weight").alias(f"weight_{c}"), F.col("minima").alias(f"minima_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "weight_a", "weight_b", "minima_a", "minima_b")
    return both.mapInArrow(rows, "a long, b long")


def tree_pairs(heads: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) that hang together all classes whose fingerprints lie at most ``radius`` bits apart."""
    full = heads.where("weight > 0").select("node", "fp")
    points = cut(full.groupBy("fp").agg(F.min("node").alias("node")), "near-points")
    equal = full.join(points.withColumnRenamed("node", "a"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    return simhash.links(points, radius).select("a", "b").unionByName(equal)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    keep[i] = _alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    def side(c: str) -> DataFrame:
        asked = sifted(sets, "node", cut(sieve(pairs, c), "near-sieve"))[0]
        return asked.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(rows, "a long, b long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # columns of the elements that two sets have, at least
    row, keep = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), times[code] > 1
    row, column = row[keep], shared[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def candidates(places: list[np.ndarray], size: np.ndarray, tile: np.ndarray, component: np.ndarray, within: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in a common bucket, of one tile (``within``) or of two, of unlike components, that sizes allow to be alike."""
    n = len(places)
    together = np.zeros((n, n), bool)
    bucket, row = np.concatenate(places), np.repeat(np.arange(n), [len(p) for p in places])
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], row[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            together[np.ix_(row[a:b], row[a:b])] = True
    together &= (tile[:, None] == tile[None, :]) == within
    together &= np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :])
    together &= component[:, None] != component[None, :]
    return np.nonzero(np.triu(together, 1))


def compare(sets: list[np.ndarray], places: list[np.ndarray], tile: np.ndarray, component: np.ndarray, within: bool, similarity: float) -> list[tuple[int, int]]:
    """Spanning links between sets in a common bucket, of one tile (``within``) or of two."""
    n, forest = len(sets), Forest(len(sets))
    size = np.array([len(s) for s in sets])
    _, first, code = np.unique(component, return_index=True, return_inverse=True)
    forest.parent = first[code]
    x, y = candidates(places, size, tile, component, within, similarity)
    if len(x) <= 8 * n:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if forest.find(i) != forest.find(j) and _alike(size[i], size[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True)), similarity):
                forest.join(np.array([i]), np.array([j]))
    else:
        hit = _alike(size[x], size[y], common_counts(sets)[x, y], similarity)
        forest.join(x[hit], y[hit])
    return forest.edges


def _meetings(table: pa.Table) -> Iterator[tuple[np.ndarray, bool, dict[str, list[np.ndarray]]]]:
    """For each pair of tiles in ``table``: its rows' places in it, whether the two are one, and the binary or list columns of them."""
    ta, tb, node = (table.column(c).to_numpy() for c in ("ta", "tb", "node"))
    order = np.lexsort((node, tb, ta))
    ta, tb = ta[order], tb[order]
    held = {c: table.column(c).combine_chunks() for c in table.column_names if c in ("buckets", "minima", "shingles")}
    starts = np.flatnonzero(np.concatenate([[True], (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1]), [True]]))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = order[a:b]
        got = {c: [v[i].values.to_numpy() if c == "buckets" else np.frombuffer(v[i].as_buffer(), np.uint8 if c == "minima" else np.uint64) for i in at.tolist()] for c, v in held.items()}
        yield at, bool(ta[a] == tb[a]), got


def _dealt_to_tasks(asked: DataFrame, size: str) -> DataFrame:
    """``asked`` with slot, own_a and own_b: a task of its own for each large pair of tiles, one for many small pairs."""
    loads = asked.groupBy("ta", "tb").agg(F.sum(size).alias("load"))
    small = loads.where(F.col("load") <= TILE_BYTES).agg(F.sum("load")).first()[0] or 0
    slots = max(1, -(-int(small) // (4 * TILE_BYTES)))
    slot = F.when(F.col("load") <= TILE_BYTES, F.pmod(F.xxhash64("ta", "tb"), F.lit(slots))).otherwise(-1)
    own = lambda c: F.when(F.col("load") > TILE_BYTES, F.col(c))
    return asked.join(loads.select("ta", "tb", slot.alias("slot"), own("ta").alias("own_a"), own("tb").alias("own_b")), ["ta", "tb"])


def tile_links(placed: DataFrame, heads: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that hang together what the linked pairs of ``placed`` (node, bucket, n, weight, component) do."""
    nodes = placed.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("most"), F.first("weight").alias("weight"), F.first("component").alias("component"), F.collect_list("bucket").alias("buckets"))
    nodes = nodes.select("node", F.col("most.n").alias("width"), F.col("most.bucket").alias("spot"), "component", "buckets", "weight")
    dealt = running_total(nodes, ["width", "spot", "component", "node"], F.col("weight") + CLASS_BYTES, "before", "near-tiles")
    dealt = dealt.withColumn("tile", F.expr(f"before div {TILE_BYTES}")).drop("before")
    dealt = running_total(dealt, ["width", "spot", "component", "node"], F.lit(1), "before", "near-tiles")
    dealt = dealt.select("node", "buckets", "weight", "tile", F.expr(f"before div {TILE_CLASSES}").alias("wide"))
    dealt = cut(dealt.join(heads.select("node", "minima"), "node"), "near-dealt")
    here = cut(placed.join(dealt.select("node", F.col("wide").alias("tile")), "node").select("node", "tile", "bucket", "component"), "near-here")
    others = here.groupBy("bucket", F.col("tile").alias("other")).agg(F.min("component").alias("least"), F.max("component").alias("most"))
    met = here.join(others, "bucket").where("least <> component or most <> component")
    asked = cut(met.select(F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "node", F.col("tile").alias("wide"), "component").distinct(), "near-asked")
    described = _dealt_to_tasks(asked.withColumn("bytes", F.lit(CLASS_BYTES)), "bytes").join(dealt.select("node", "tile", "buckets", "weight", "minima"), "node")
    kept = "ta long, tb long, node long, tile long, component long, weight long"

    def hopeful(table: pa.Table) -> pa.Table:
        """Rows with a partner that their minima leave hope for, by the pairs of small tiles that they are to meet in."""
        weight, tile, wide, component = (table.column(c).to_numpy() for c in ("weight", "tile", "wide", "component"))
        out = [np.zeros((3, 0), np.int64)]
        for at, within, got in _meetings(table):
            minima = np.array(got["minima"])
            # blocks of classes of one wide tile, in pairs: each with those of the other one, or with itself and those after it
            blocks = [rows[i : i + BLOCK] for w in np.unique(wide[at]).tolist() for rows in [np.flatnonzero(wide[at] == w)] for i in range(0, len(rows), BLOCK)]
            for p, one in enumerate(blocks):
                for other in blocks[p:]:
                    if not within and wide[at[one[0]]] == wide[at[other[0]]]:
                        continue
                    rows = one if other is one else np.concatenate([one, other])
                    side = np.zeros(len(rows), np.int64)
                    side[len(one) :] = 1
                    x, y = candidates([got["buckets"][i] for i in rows.tolist()], weight[at[rows]], side, component[at[rows]], other is one, similarity)
                    for i in range(0, len(x), 20_000):
                        a, b = rows[x[i : i + 20_000]], rows[y[i : i + 20_000]]
                        good = (minima[a] == minima[b]).sum(axis=1) >= HOPE
                        a, b = at[a[good]], at[b[good]]
                        ta, tb = np.minimum(tile[a], tile[b]), np.maximum(tile[a], tile[b])
                        out.append(np.unique(np.concatenate([[ta, tb, a], [ta, tb, b]], axis=1), axis=1))
        ta, tb, row = np.unique(np.concatenate(out, axis=1), axis=1)
        return table.select(["node", "tile", "component", "weight"]).take(pa.array(row)).add_column(0, "tb", pa.array(tb)).add_column(0, "ta", pa.array(ta))

    columns = ["slot", "own_a", "own_b", "ta", "tb", "node", "tile", "component", "weight", "buckets"]
    left = cut(described.select(*columns, "wide", "minima").groupBy("slot", "own_a", "own_b").applyInArrow(hopeful, kept).distinct(), "near-hopeful")
    full = _dealt_to_tasks(left, "weight").join(dealt.select("node", "buckets"), "node").join(sets, "node").select(*columns, "shingles")

    def meet(table: pa.Table) -> pa.Table:
        node, tile, component = (table.column(c).to_numpy() for c in ("node", "tile", "component"))
        found = []
        for at, within, got in _meetings(table):
            edges = compare(got["shingles"], got["buckets"], tile[at], component[at], within, similarity)
            found += [(node[at[i]], node[at[j]]) for i, j in edges]
        links_ = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": links_[:, 0], "b": links_[:, 1]})

    out = cut(full.groupBy("slot", "own_a", "own_b").applyInArrow(meet, "a long, b long"), "near-links")
    for df in (here, asked, left):
        discard(df)
    return out


def unlike(placed: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Rows of ``placed`` in buckets that the links ``found`` leave in more than one component, with its components."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    named = placed.drop("component").join(components(every), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    return cut(named.join(mixed, "bucket", "left_semi"), "near-places")


def links(placed: DataFrame, heads: DataFrame, sets: DataFrame, found: list[DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that hang together what ``found`` and all confirmed pairs of ``placed`` (node, bucket, n, weight) do."""
    placed, turn = unlike(placed, found), 0
    while not (wide := placed.where(F.col("n") > WIDE)).isEmpty():
        drawn = F.struct(F.xxhash64("node", F.lit(turn)), "node", "component")
        leads = wide.groupBy("bucket").agg(F.min(drawn).alias("lead")).select("bucket", F.col("lead.node").alias("a"), F.col("lead.component").alias("of"))
        pairs = wide.join(leads, "bucket").where("component <> of").select("a", F.col("node").alias("b")).distinct()
        hope = cut(hopeful_pairs(pairs, heads, similarity), "near-pairs")
        near = cut(confirmed(hope, sets, similarity), "near-links")
        discard(hope)
        if near.isEmpty():
            break
        found = [*found, near]
        earlier, placed = placed, unlike(placed, found)
        discard(earlier)
        turn += 1
    out = tile_links(placed, heads, sets, similarity)
    discard(placed)
    for more in found:
        out = out.unionByName(more)
    return out


def without_copies(kept: DataFrame, named: DataFrame, key: str, id_col: str) -> DataFrame:
    """``kept`` without rows that do not come first, by id (null last) and then key, in their component of ``named`` (key, component)."""
    ranked = named.join(kept.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id")), "key")
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("first"))
    dropped = cut(named.join(first.select("component", F.col("first.key").alias("stays")), "component").where("key <> stays").select(F.col("key").alias(key)), "near-dropped")
    # texts are exchanged only for rows that may be among the dropped
    may_go, stay = sifted(kept, key, cut(sieve(dropped, key), "near-sieve"))
    return stay.unionByName(may_go.join(dropped, key, "left_anti").select(*stay.columns)).drop(key)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near copies, that of the least id (null last), with its own columns."""
    key = fresh("near_key", docs)
    kept = cut(docs.withColumn(key, F.monotonically_increasing_id()), "near-documents")
    prints = cut(sketches(kept, key, text_col, words), "near-prints")
    first = prints.groupBy("print").agg(F.min(F.struct("key", "weight", "fp", "buckets", "minima")).alias("first"))
    heads = cut(first.select("print", F.col("first.key").alias("node"), "first.weight", "first.fp", "first.buckets", "first.minima"), "near-heads")
    every = heads.select("node", "weight", F.explode("buckets").alias("bucket"))
    placed = cut(every.join(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "near-places")
    pairs = cut(hopeful_pairs(tree_pairs(heads), heads, similarity), "near-pairs")
    asked = placed.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node")))
    sets = cut(sets_of(sifted(kept, key, cut(sieve(asked, "node"), "near-sieve"))[0], key, text_col, words), "near-sets")
    trees = cut(confirmed(pairs, sets, similarity), "near-links")
    joined = components(links(placed, heads, sets, [trees], similarity))
    labelled = heads.join(joined, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    named = cut(prints.select("key", "print").join(labelled, "print").select("key", "component"), "near-named")
    for df in (prints, heads, placed, pairs, sets):
        discard(df)
    return without_copies(kept, named, key, id_col)
