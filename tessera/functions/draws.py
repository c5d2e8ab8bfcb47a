"""Random draws as pure functions of a key, the same in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sixteen to the power of the hex digits that a draw uses.
SPAN = 1 << 60


def md5_int(key: Column, salt: str) -> Column:
    """Integer in [0, 2^60) from salt and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def unit(key: Column, salt: str) -> Column:
    """Uniform draw in [0, 1]."""
    return md5_int(key, salt).cast("double") / F.lit(float(SPAN))


def bucket(key: Column, salt: str, n: int) -> Column:
    return md5_int(key, salt) % n


def md5_prefix(name: Column) -> Column:
    """First eight hex digits of a name's digest, the order in which names are dealt to folds."""
    return F.substring(F.md5(name), 1, 8)
