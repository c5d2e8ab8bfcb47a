"""Trimming and judging suggestions for the rest of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that close or separate, which a suggestion may repeat from what follows.
CLOSERS = " \t)]};,\"'`"


def trim_closers(text: Column, after: Column) -> Column:
    """``text`` without the longest tail that repeats the start of ``after`` and is closers only."""
    most = F.least(F.length(text), F.length(F.regexp_extract(after, "^[" + CLOSERS.replace("]", r"\]") + "]*", 0)))
    cut = F.filter(F.sequence(F.lit(0), most), lambda k: F.substring(text, F.length(text) - k + 1, k) == F.substring(after, F.lit(1), k))
    return F.substring(text, F.lit(1), F.length(text) - F.coalesce(F.array_max(cut), F.lit(0)))


def punctuation_only(text: Column) -> Column:
    """True if nothing in the text is a letter, digit, underscore, quote or beyond ASCII."""
    return ~text.rlike("[A-Za-z0-9_\"'`]|[^\\x00-\\x7F]")


def stable_tail(size: Column, line_starts: Column, target: int, most: int, step: int) -> Column:
    """Where to cut an id sequence of ``size`` so that about ``target`` ids stay: at a line start found from a multiple of ``step`` on.

    ``line_starts`` is the ordered array of places where lines start; the cut moves only every ``step`` ids.
    """
    exact = size - target
    first = F.floor(exact / step) * step
    limit = F.least(size - F.lit(target // 2), exact + 2 * step)
    at = F.coalesce(F.array_min(F.filter(line_starts, lambda x: (x >= first) & (x < limit))), exact)
    return F.when(size <= target, 0).otherwise(F.greatest(at, size - most)).cast("int")


def healed_boundary(line: Column, bol: Column, boundary: Column) -> Column:
    """``boundary`` moved back over blanks, unless only blanks precede it on its line, which begins at ``bol``."""
    head = F.substring(line, bol + 1, boundary - bol)
    kept = F.length(F.regexp_replace(head, "[ \t]+$", ""))
    return F.when(kept > 0, bol + kept).otherwise(boundary)
