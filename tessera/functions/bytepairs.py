"""Byte-pair encoding: pre-tokens as columns, merges over single pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pre-token pattern (non-ASCII counts as letters), its name, the longest pre-token, and the special tokens.
PRETOKEN = (
    r"[\r\n]+[ \t]*|[ \t]+(?= [^ \t\r\n])| ?[A-Za-z_\x{80}-\x{10FFFF}]+| ?[0-9]|"
    r" ?[^A-Za-z0-9_\x{80}-\x{10FFFF} \t\r\n]+|[ \t]+"
)
PRETOKEN_ID, MOST_BYTES, MAGIC, VERSION = "go-code-1", 128, "CMLBPE", 1
SPECIALS = ["<|endoftext|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|file_sep|>", "<|repo_name|>", "<|pad|>"] + [f"<|reserved_{i}|>" for i in range(9)]

Merges = list[tuple[int, int]]


def pretokens(text: Column) -> Column:
    """array<binary>; pieces beyond MOST_BYTES are cut into chunks of that size."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0)), lambda x: x.cast("binary"))

    def chunks(b: Column) -> Column:
        n = F.octet_length(b)
        return F.when(n <= MOST_BYTES, F.array(b)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / MOST_BYTES).cast("int")), lambda i: F.substring(b, i * MOST_BYTES + 1, F.lit(MOST_BYTES))))

    return F.flatten(F.transform(whole, chunks))


def tokens_of(merges: Merges) -> list[bytes]:
    """Bytes of every id: single bytes, then merges in order."""
    out = [bytes([i]) for i in range(256)]
    for left, right in merges:
        if left >= len(out) or right >= len(out):
            raise ValueError(f"merge {len(out) - 256} names a later id")
        out.append(out[left] + out[right])
    return out


def encode_piece(piece: bytes, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Ids of a piece: the lowest merge that applies is made everywhere, until none applies."""
    ids = list(piece)
    while len(ids) > 1:
        best = min((ranks.get(p, 1 << 30), p) for p in zip(ids, ids[1:]))
        if best[0] == 1 << 30:
            break
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == best[1]:
                out.append(256 + best[0])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def ranks_of(merges: Merges) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    for r, m in enumerate(merges):
        out.setdefault(tuple(m), r)
    return out


def encode_pieces(pieces: DataFrame, merges: Merges) -> DataFrame:
    """(piece, ids) of distinct pieces."""
    ranks = ranks_of(merges)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_piece(p, ranks) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])

    return pieces.select("piece").mapInArrow(rows, "piece binary, ids array<int>")


def decoder(merges: Merges):
    """Arrow UDF from ids to bytes; ids beyond the merges are special tokens, which stand for no bytes."""
    import pandas as pd

    tokens = tokens_of(merges)

    def decode(ids):
        return pd.Series([b"".join(tokens[i] for i in row if i < len(tokens)) for row in ids])

    return F.pandas_udf(decode, "binary")


def boundaries(text: Column) -> Column:
    """Byte offsets at which pre-tokens end, in order."""
    sizes = F.transform(pretokens(text), lambda x: F.octet_length(x))
    return F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda acc, v: acc + v))


def last_boundary(text: Column, cursor: Column) -> Column:
    """The last pre-token end at or before ``cursor`` (bytes); 0 if there is none."""
    return F.coalesce(F.array_max(F.filter(boundaries(text), lambda x: x <= cursor)), F.lit(0))


def heal_split(line: Column) -> Column:
    """The trailing word of a line prefix with the one space before it, which generation has to repeat."""
    return F.regexp_extract(line, r"( ?[A-Za-z0-9_\x{80}-\x{10FFFF}-]+)$", 1)


def dump(merges: Merges, specials: Iterable[str] = SPECIALS) -> str:
    """A vocabulary as text: header, merges, special tokens."""
    head = f"{MAGIC} {VERSION}\npretok {PRETOKEN_ID}\nmerges {len(merges)}"
    return "\n".join([head, *(f"{a} {b}" for a, b in merges), *(f"special {s}" for s in specials)]) + "\n"


def load(text: str) -> tuple[Merges, list[str]]:
    lines = text.splitlines()
    if not lines or lines[0] != f"{MAGIC} {VERSION}" or lines[1] != f"pretok {PRETOKEN_ID}":
        raise ValueError("not a vocabulary of this format")
    n = int(lines[2].split()[1])
    merges = [tuple(map(int, x.split())) for x in lines[3 : 3 + n]]
    tokens_of(merges)
    return merges, [x.removeprefix("special ") for x in lines[3 + n :]]
