"""Media columns with content-defined chunking.

A payload is stored as 8-bit mono samples (a RIFF/WAVE form: 44 header bytes,
then the payload). It is cut where a gear rolling hash of its last 32 bytes has
its upper bits zero, so equal passages give equal chunks wherever they stand.
Chunk digests are deduplicated by Spark joins: the first payload with a chunk
owns its bytes, others refer to it. The store holds owned bytes only; reading
back joins references with shared chunks, puts the stored header before each
ordered chunk list and verifies header and digest before features are computed.

Payloads travel to the store in compressed packs, one per map batch and key
range, keyed by the payload's digest, so equal texts are stored once and rows
never meet by id.

Defined results for odd input: a null text counts as empty and its payload is
64 zero bytes; equal texts have equal values whatever their ids; null or
repeated ids are carried along; of equal chunks the one in the least payload
digest, and first place in it, is the owner; a very long text is one payload,
held whole by the task that cuts it; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import id_values, squeeze, text_bytes, unsqueeze
from tessera.llm.shared import PAUSE, cut, release

UNIT = 64
LEAST, MOST, MASK_BITS = 256, 8192, 10
PART_BYTES = 32 << 20
RATE = 8000
GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


HEAD_BYTES = 44


def head_of(payload: bytes) -> bytes:
    """The header that makes a RIFF/WAVE form of 8-bit mono samples."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples_of(form: bytes) -> bytes:
    """Payload of a stored form; its header is checked."""
    head = struct.unpack("<4sI4s4sIHHIIHH4sI", form[:44])
    if head[0] != b"RIFF" or head[-1] != len(form) - 44:
        raise ValueError("not a stored form")
    return form[44:]


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    n, out, last = len(payload), [], 0
    if n > LEAST:
        h = GEAR[np.frombuffer(payload, np.uint8)]
        for k in (1, 2, 4, 8, 16):
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
        for at in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
            while at - last > MOST:
                last += MOST
                out.append(last)
            if at - last >= LEAST and n - at >= UNIT:
                out.append(at)
                last = at
        while n - last > MOST:
            last += MOST
            out.append(last)
    return [*out, n]


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    body, at = text_bytes(batch.column(column))
    raw, at = memoryview(body), at.tolist()
    for i in range(len(at) - 1):
        yield bytes(raw[at[i] : at[i + 1]])


def catalogue(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, key (payload digest), digests and ends of the chunks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, missing = id_values(batch.column(0))
            sizes, keys, digests, ends = [], [], [], []
            for text in _texts(batch, 1):
                payload = payload_of(text)
                end = cuts(payload)
                sizes.append(len(text))
                keys.append(digest16(payload))
                digests.append([digest16(payload[a:b]) for a, b in zip([0, *end], end, strict=False)])
                ends.append(end)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=missing), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "key", "digests", "ends"])

    return docs.mapInArrow(rows, "doc_id long, n_bytes long, key binary, digests array<binary>, ends array<int>")


def range_of(key: bytes, parts: int) -> int:
    return int.from_bytes(key[:4], "big") * parts >> 32


def packs(docs: DataFrame, parts: int) -> DataFrame:
    """Distinct payloads of each map batch, compressed together per key range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, dict[bytes, bytes]] = {}
            for text in _texts(batch, 1):
                payload = payload_of(text)
                key = digest16(payload)
                held.setdefault(range_of(key, parts), {})[key] = payload
            for part, own in held.items():
                lens = struct.pack(f"<{len(own)}I", *map(len, own.values()))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([lens], pa.binary()), pa.array([squeeze(b"".join(own.values()), 3)], pa.binary())], names=["part", "n", "lens", "body"])

    return docs.mapInArrow(rows, "part int, n int, lens binary, body binary")


_STORED_ARROW = pa.schema([("part", pa.int32()), ("keys", pa.list_(pa.binary())), ("digests", pa.list_(pa.list_(pa.binary()))), ("sizes", pa.list_(pa.list_(pa.int32()))), ("state", pa.list_(pa.binary())), ("heads", pa.binary()), ("body", pa.binary())])
PACK = "part int, keys array<binary>, digests array<array<binary>>, sizes array<array<int>>, state array<binary>, heads binary, body binary"
GROUP_BYTES = 8 << 20
OWNED, LENT, BORROWED = 0, 1, 2


def store(docs: DataFrame, listed: DataFrame, parts: int) -> DataFrame:
    """Packs of owned chunk bytes with the ordered chunk lists of their payloads.

    ``state`` has a byte per chunk: owned, owned and lent to others, or borrowed.
    """
    distinct = listed.groupBy("key").agg(F.first("digests").alias("digests"))
    chunks = distinct.select("key", F.posexplode("digests").alias("i", "digest"))
    owners = chunks.groupBy("digest").agg(F.min(F.struct("key", "i")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    shared = chunks.join(owners, "digest").select("key", "i", F.when((F.col("owner.key") == F.col("key")) & (F.col("owner.i") == F.col("i")), LENT).otherwise(BORROWED).alias("state"))
    part = F.shiftright(F.conv(F.hex(F.substr("key", F.lit(1), F.lit(4))), 16, 10).cast("long") * parts, 32).cast("int")
    marks = shared.select(part.alias("part"), "key", "i", "state")

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        state: dict[bytes, dict[int, int]] = {}
        for k, i, s in zip(right.column("key").to_pylist(), right.column("i").to_pylist(), right.column("state").to_pylist(), strict=True):
            state.setdefault(k, {})[i] = s
        done, out = set(), []
        new = lambda: {"part": None, "keys": [], "digests": [], "sizes": [], "state": [], "heads": [], "body": []}
        packed = lambda row: row | {"heads": squeeze(b"".join(row["heads"]), 6), "body": squeeze(b"".join(row["body"]), 6)}
        row, held = new(), 0
        for part_, n, lens, body in zip(*(left.column(c).to_pylist() for c in ("part", "n", "lens", "body")), strict=True):
            raw, at = unsqueeze(body), 0
            for size in struct.unpack(f"<{n}I", lens):
                payload, at = raw[at : at + size], at + size
                key = digest16(payload)
                if key in done:
                    continue
                done.add(key)
                end, own = cuts(payload), state.get(key, {})
                pieces = [payload[a:b] for a, b in zip([0, *end], end, strict=False)]
                marks_ = [own.get(i, OWNED) for i in range(len(pieces))]
                row["keys"].append(key)
                row["digests"].append([digest16(p) if m else b"" for p, m in zip(pieces, marks_, strict=True)])
                row["sizes"].append([len(p) for p in pieces])
                row["state"].append(bytes(marks_))
                row["heads"].append(head_of(payload))
                row["body"].extend(p for p, m in zip(pieces, marks_, strict=True) if m != BORROWED)
                held += size
                if held >= GROUP_BYTES:
                    out.append(packed(row) | {"part": part_})
                    row, held = new(), 0
            row["part"] = part_
        if row["keys"]:
            out.append(packed(row))
        return pa.Table.from_pylist(out, _STORED_ARROW)

    # key ranges are of equal size: each is a task of its own, none shares one by the chance of a hash
    left, right = (df.repartitionById(parts, "part").groupBy("part") for df in (packs(docs, parts), marks))
    return left.cogroup(right).applyInArrow(keep, PACK)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], bytes, bytes, list[bytes | None]]]:
    """key, digests, state, header and the pieces at hand (None: borrowed) of every stored form."""
    for batch in batches:
        for keys, digests, sizes, states, heads, body in zip(*(batch.column(c).to_pylist() for c in ("keys", "digests", "sizes", "state", "heads", "body")), strict=True):
            raw, at, heads = unsqueeze(body), 0, unsqueeze(heads)
            for k, (key, own, size, state) in enumerate(zip(keys, digests, sizes, states, strict=True)):
                pieces: list[bytes | None] = []
                for n, s in zip(size, state, strict=True):
                    if s == BORROWED:
                        pieces.append(None)
                    else:
                        pieces.append(raw[at : at + n])
                        at += n
                yield key, own, state, heads[k * HEAD_BYTES : (k + 1) * HEAD_BYTES], pieces


def read_back(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, form) of stored forms that own all their chunks, and of those put together from others' chunks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for key, _, state, head, pieces in _opened(iter([batch])):
                if BORROWED not in state:
                    keys.append(key)
                    bodies.append(head + b"".join(pieces))
                if len(keys) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["key", "form"])
                    keys, bodies = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["key", "form"])

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "i", "digest", "bytes"]
        types = (pa.binary(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            for key, digests, state, head, pieces in _opened(iter([batch])):
                if BORROWED in state:
                    rows.append((key, -1, None, head))
                    rows.extend((key, i, digests[i] if pieces[i] is None else None, pieces[i]) for i in range(len(pieces)))
                if len(rows) >= 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, pieces = [], []
            for _, own, state, _, got in _opened(iter([batch])):
                for i, s in enumerate(state):
                    if s == LENT:
                        digests.append(own[i])
                        pieces.append(got[i])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(pieces, pa.binary())], names=["digest", "lent"])

    direct = stored.mapInArrow(whole, "key binary, form binary")
    listed = stored.mapInArrow(parts_of, "key binary, i int, digest binary, bytes binary")
    chunks = stored.mapInArrow(lent, "digest binary, lent binary")
    filled = listed.where("digest is not null").join(chunks, "digest").select("key", "i", F.col("lent").alias("bytes"))
    every = filled.unionByName(listed.where("digest is null").select("key", "i", "bytes"))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        return pa.table({"key": [key[0].as_py()], "form": [b"".join(table.column("bytes").to_pylist())]}, schema=pa.schema([("key", pa.binary()), ("form", pa.binary())]))

    rebuilt = every.groupBy("key").applyInArrow(joined, "key binary, form binary")
    return direct, rebuilt


def feature_of(payload: bytes) -> str:
    """Integer features of the samples: count, mean, energy and crossings of the middle level."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    up = x >= 0
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};crossings={int((up[1:] != up[:-1]).sum())}"


def described(forms: DataFrame) -> DataFrame:
    """Verified digests and features of (key, form) as read back."""
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                back = samples_of(form)
                if digest16(back) != key:
                    raise ValueError("a stored payload does not match its digest")
                out.append((key, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), feature_of(back)))
            if out:
                types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return forms.mapInArrow(rows, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the read-back columns of each row's stored media."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    listed = cut(catalogue(slim), "media-catalogue")
    total = listed.agg(F.sum("n_bytes")).first()[0] or 0
    stored = cut(store(slim, listed, max(1, -(-int(total) // PART_BYTES))), "media-store")
    release(docs.sparkSession, PAUSE)
    direct, rebuilt = read_back(stored)
    values = described(direct.unionByName(rebuilt))
    return listed.select("doc_id", "n_bytes", "key").join(values, "key").drop("key")
