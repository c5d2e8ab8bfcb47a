"""Byte-pair encoding over corpora: word tables, merge learning, encoding of distinct pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.functions.bytepairs import Merges, encode_piece, pretokens, ranks_of
from tessera.sources.storage import cut


def word_table(files: DataFrame) -> DataFrame:
    """piece, c: distinct pre-tokens with their counts."""
    return files.select(F.explode(pretokens(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("c"))


def pair_counts(words: DataFrame) -> DataFrame:
    """l, r, c: adjacent pairs of ``words`` (ids, c), each as often as its words."""
    return words.where("size(ids) > 1").select("c", F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1).alias("l"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("r"))).alias("p")).groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("c").alias("c"))


def merged(flat: np.ndarray, of: np.ndarray, merges: Merges, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words side by side (``of`` numbers their word) with the pairs of ``merges`` replaced by ids from ``first`` on, one after another, from the left."""
    for k, (left, right) in enumerate(merges):
        at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right) & (of[:-1] == of[1:]))
        if left == right and len(at):  # in a run of equal ids every second place begins a pair
            starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(at - np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))) % 2 == 0]
        flat = flat.copy()
        flat[at] = first + k
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        flat, of = flat[keep], of[keep]
    return flat, of


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("ids")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def merge_pairs(words: DataFrame, merges: Merges, first: int) -> DataFrame:
    """Every word of (ids, c) with the pairs of ``merges`` replaced by ids from ``first`` on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, of = merged(*_words_of(batch), merges, first)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), batch.column("c")], names=["ids", "c"])

    return words.select("ids", "c").mapInArrow(rows, "ids array<int>, c long")


def pair_totals(words: DataFrame) -> DataFrame:
    """``pair_counts``, a batch of words at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, of = _words_of(batch)
            own = of[:-1] == of[1:]
            pairs, at = np.unique((flat[:-1].astype(np.int64) << 32 | flat[1:])[own], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, batch.column("c").to_numpy()[of[:-1][own]])
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["l", "r", "c"])

    return words.mapInArrow(rows, "l int, r int, c long").groupBy("l", "r").agg(F.sum("c").alias("c"))


def bytes_of(words: DataFrame) -> DataFrame:
    """(ids, c) of (piece, c): the ids of single bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), batch.column("c")], names=["ids", "c"])

    return words.select("piece", "c").mapInArrow(rows, "ids array<int>, c long")


def together(best: list[tuple[int, int]]) -> Merges:
    """The leading pairs of ``best`` that would be learnt in this order one at a time.

    A merge changes counts of pairs with one of its tokens only, and a pair with
    the new token is at most as frequent as an old one with that token, and comes
    after it in a tie. So pairs that share no token with those before them may be
    merged with them, up to the first that does share one, or a token beside itself.
    """
    out, used = [], set()
    for left, right in best:
        if left in used or right in used:
            break
        out.append((left, right))
        used |= {left, right}
        if left == right:
            break
    return out


def learn(words: DataFrame, n_merges: int, every: int = 4, most: int = 64) -> Merges:
    """The most frequent pair, again and again; ties go to the smallest. Stops at pairs seen once.

    Counting and merging stay distributed; the driver holds the merges only, and
    looks at ``most`` pairs a job. ``words`` is (piece, c).
    """
    table = cut(bytes_of(words), "bpe-words")
    merges: Merges = []
    turn = 0
    while len(merges) < n_merges:
        best = pair_totals(table).where("c > 1").orderBy(F.col("c").desc(), "l", "r").limit(min(most, n_merges - len(merges))).collect()
        found = together([(x["l"], x["r"]) for x in best])
        if not found:
            break
        table = merge_pairs(table, found, 256 + len(merges))
        merges += found
        turn += 1
        if turn % every == 0:
            table = cut(table, "bpe-words")
    return merges


def _encoder(merges: Merges) -> Callable[[pa.Array], pa.Array]:
    """Ids of each of many pieces; a piece is encoded once as long as the encoder lives, or until it knows MOST_KNOWN."""
    ranks, known = ranks_of(merges), {}

    def ids(piece: bytes) -> list[int]:
        found = known.get(piece)
        if found is None:
            if len(known) >= MOST_KNOWN:
                known.clear()
            found = known[piece] = encode_piece(piece, ranks)
        return found

    return lambda pieces: pa.array([ids(p) for p in pieces.to_pylist()], pa.list_(pa.int32()))


#: Pieces that a task keeps with their ids; of others it makes them again.
MOST_KNOWN = 1 << 18


def encode(files: DataFrame, merges: Merges, keep: tuple[str, ...] = ()) -> DataFrame:
    """file_id, keep, ids of files (file_id, text): a file is encoded in its row, each distinct piece of a batch once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(merges)
        for batch in batches:
            lists = batch.column("p")
            placed = lists.flatten().dictionary_encode()
            coded = coder(placed.dictionary).take(placed.indices) if len(placed) else pa.array([], pa.list_(pa.int32()))
            sizes = np.r_[0, np.cumsum(pc.list_value_length(coded).to_numpy(zero_copy_only=False))]
            ends = sizes[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in head], pa.ListArray.from_arrays(pa.array(ends), coded.flatten())], names=[*head, "ids"])

    head = ["file_id", *keep]
    placed = files.select(*head, pretokens(F.col("text")).alias("p")).where("size(p) > 0")
    return placed.mapInArrow(rows, StructType([*[placed.schema[c] for c in head], StructField("ids", ArrayType(IntegerType()))]))


def bytes_per_token(words: DataFrame, merges: Merges) -> DataFrame:
    """One row: bytes, tokens and their ratio, from the word table alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(merges)
        for batch in batches:
            n = pc.list_value_length(coder(batch.column("piece"))).cast(pa.int64())
            size = pc.binary_length(batch.column("piece")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pc.multiply(size, batch.column("c")), pc.multiply(n, batch.column("c"))], names=["bytes", "tokens"])

    each = words.select("piece", "c").mapInArrow(rows, "bytes long, tokens long")
    return each.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")).withColumn("ratio", F.round(F.col("bytes") / F.col("tokens"), 6))
