"""Packed numeric columns and text blocks, for operators that work on raw bytes.

A *block* holds the whole texts of some documents, zstd-compressed, in one
row, so an operator that visits the texts several times moves few bytes.
Integer runs travel as differences split into byte planes, which is front
coding for sorted fixed-width keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = "bid long, n_bytes long, n_docs long, ids binary, nulls binary, lens binary, body binary"
NULL_ID = np.iinfo(np.int64).max


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers as compressed byte planes, of differences if ``delta`` (sorted runs)."""
    wide = np.ascontiguousarray(values).astype(np.int64).view(np.uint64)
    if delta and len(wide):
        wide = np.diff(wide, prepend=np.uint64(0))
    return squeeze(wide.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_ints(data: bytes, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    wide = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    if delta:
        wide = np.cumsum(wide, dtype=np.uint64)
    return wide.view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and its n + 1 offsets, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def id_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 and where they are null; a null id sorts after every other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.int64())
    return pc.fill_null(column, NULL_ID).to_numpy(zero_copy_only=False), np.asarray(column.is_null())


class Block:
    """Texts of some documents: ``body`` bytes, ``at`` offsets, ``ids``, ``nulls``."""

    def __init__(self, bid: int, ids: np.ndarray, nulls: np.ndarray, body: np.ndarray, at: np.ndarray):
        self.bid, self.ids, self.nulls, self.body, self.at = bid, ids, nulls, body, at

    @classmethod
    def of(cls, table: pa.Table, row: int = 0) -> Block:
        get = lambda c: table.column(c)[row].as_py()
        lens = unpack_ints(get("lens"))
        return cls(
            get("bid"),
            unpack_ints(get("ids")),
            np.frombuffer(unsqueeze(get("nulls")), bool),
            np.frombuffer(unsqueeze(get("body")), np.uint8),
            np.concatenate([[0], np.cumsum(lens)]).astype(np.int64),
        )

    def __len__(self) -> int:
        return len(self.ids)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, side="right") - 1

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


def pack_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts in blocks of about ``block_bytes``; a longer text is a block of its own.

    Only the id and the text are read, so extra columns of any name are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        ids, nulls, lens, bodies, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            size = np.concatenate(lens)
            out = {
                "bid": [(task << 24) | seq], "n_bytes": [int(size.sum())], "n_docs": [len(size)],
                "ids": [pack_ints(np.concatenate(ids))], "nulls": [squeeze(np.concatenate(nulls).tobytes())],
                "lens": [pack_ints(size)], "body": [squeeze(b"".join(bodies), 3)],
            }
            seq, held = seq + 1, 0
            for part in (ids, nulls, lens, bodies):
                part.clear()
            return pa.RecordBatch.from_pydict(out, BLOCK_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, missing = id_values(batch.column(0))
            body, at = text_bytes(batch.column(1))
            first = 0
            while first < len(key):
                last = int(np.searchsorted(at, at[first] + max(1, block_bytes - held), side="right")) - 1
                last = min(max(last, first + 1), len(key))
                ids.append(key[first:last]); nulls.append(missing[first:last])  # noqa: E702
                lens.append(np.diff(at[first : last + 1])); bodies.append(body[at[first] : at[last]].tobytes())  # noqa: E702
                held += int(at[last] - at[first]) + 64 * (last - first)
                first = last
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    return slim.mapInArrow(rows, BLOCK_SCHEMA)


BLOCK_ARROW = pa.schema([("bid", pa.int64()), ("n_bytes", pa.int64()), ("n_docs", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "lens", "body"))])

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STRIDE = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = _powers(_BASE, _STRIDE), _powers(_INVERSE, _STRIDE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each body[start:end]; equal bytes have equal hashes anywhere.

    Sum of byte codes times powers of an odd base by place; places wrap at
    2^16 only for words longer than that, which are hashed in strides.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    out = np.zeros(len(starts), np.uint64)
    short = lens <= _STRIDE // 2
    # words lie in order: their bytes are gathered window by window, so the table of powers stays small
    s, e = starts[short], ends[short]
    if len(s):
        values = np.zeros(len(s), np.uint64)
        first = 0
        while first < len(s):
            origin = s[first]
            last = max(first + 1, int(np.searchsorted(e, origin + _STRIDE, side="right")))
            piece = BYTE_CODES[body[origin : e[last - 1]]] * POWERS[: e[last - 1] - origin]
            edges = np.empty(2 * (last - first), np.int64)
            edges[0::2], edges[1::2] = s[first:last] - origin, e[first:last] - origin
            total = np.add.reduceat(np.append(piece, np.uint64(0)), edges)[0::2]
            values[first:last] = total * INVERSES[s[first:last] - origin]
            first = last
        out[short] = values
    for i in np.flatnonzero(~short):
        acc = np.uint64(0)
        for at in range(int(starts[i]), int(ends[i]), _STRIDE):
            piece = body[at : min(at + _STRIDE, int(ends[i]))]
            acc = mix(np.array([acc], np.uint64))[0] ^ np.add.reduce(BYTE_CODES[piece] * POWERS[: len(piece)])
        out[i] = acc
    return mix(out + mix(lens.astype(np.uint64)))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IN_SPACED_WORD = ~_SPACES
IN_PLAIN_WORD = np.zeros(256, bool)
IN_PLAIN_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def word_bounds(body: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; runs stop where a text ends."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = inside[body]
    begins = ok.copy()
    begins[1:] &= ~ok[:-1]
    stops = ok.copy()
    stops[:-1] &= ~ok[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(body))]
    begins[edges] |= ok[edges]
    stops[edges - 1] |= ok[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def bounds_in_pieces(body: np.ndarray, inside: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word_bounds`` of one text, about ``limit`` bytes at a time; a run over a cut comes whole, with the piece that it ends in."""
    open_ = -1
    for lo in range(0, len(body), limit):
        ok = inside[body[lo : lo + limit]]
        step = np.diff(ok.astype(np.int8), prepend=np.int8(open_ >= 0))
        start, end = lo + np.flatnonzero(step == 1), lo + np.flatnonzero(step == -1)
        if open_ >= 0:
            start = np.concatenate([[open_], start])
        open_ = int(start[-1]) if ok[-1] else -1
        if open_ >= 0:
            start = start[:-1]
        if len(start):
            yield start, end
    if open_ >= 0:
        yield np.array([open_]), np.array([len(body)])
