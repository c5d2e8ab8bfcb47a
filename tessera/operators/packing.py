"""Training windows: how much of each repository, documents with a middle cut out, and packing into fixed lengths."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import md5_int, unit
from tessera.operators.ranks import running_total
from tessera.sources.storage import cut

#: Bounds of documents with a cut-out middle, in tokens.
MAX_MID, MAX_SUF, MARGIN, SHRINK_MIN, MIN_PRE, MAX_SKIP = 256, 512, 8, 384, 32, 32


def waterfill_cap(totals: DataFrame, budget: int) -> DataFrame:
    """One row, cap: the least integer with sum(min(total, cap)) >= budget; the largest total if all is too little.

    ``totals`` has a row per repository. In order of totals, the cap that fills up the rest is read off where it fits.
    """
    order = Window.orderBy("total", "repo")
    filled = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    steps = totals.select("total", "repo", F.ceil((F.lit(budget) - filled) / left).alias("cap"))
    fits = F.when(F.col("cap") <= F.col("total"), F.struct("total", "repo", "cap"))
    return steps.agg(F.coalesce(F.min(fits)["cap"], F.max("total")).alias("cap"))


def keep_probability(total: Column, t_min: int) -> Column:
    """Large repositories are thinned by the root of their size."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(t_min)) / F.greatest(total, F.lit(1))))


def epoch_files(files: DataFrame, epoch: int, t_min: int, most_tokens: int) -> DataFrame:
    """Files (file_id, repo, n_tokens) drawn for an epoch, with the draw that orders them."""
    totals = files.groupBy("repo").agg(F.sum("n_tokens").alias("repo_tokens"))
    drawn = files.join(totals, "repo").withColumn("p", keep_probability(F.col("repo_tokens"), t_min))
    ok = (unit(F.col("file_id"), f"keep{epoch}") < F.col("p")) & F.col("n_tokens").between(1, most_tokens)
    return drawn.where(ok).withColumn("turn", md5_int(F.col("file_id"), f"order{epoch}"))


def group_files(kept: DataFrame, group_tokens: int, runs_of: int = 64) -> DataFrame:
    """``kept`` (file_id, repo, n_tokens, repo_tokens, turn) with run and grp: consecutive files of a repository in groups of at most ``group_tokens``.

    A repository is first dealt into runs of about ``runs_of`` groups, so none
    is gathered in one task however large it is.
    """
    n_runs = F.greatest(F.lit(1), F.ceil((F.col("repo_tokens")) / (group_tokens * runs_of)))
    dealt = kept.withColumn("run", (md5_int(F.col("file_id"), "run") % n_runs).cast("int"))

    def cut_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "file_id"])
        out, group, held = [], 0, 0
        for size in (pdf["n_tokens"] + 3).tolist():
            if held and held + size > group_tokens:
                group, held = group + 1, 0
            held += size
            out.append(group)
        return pdf[["file_id", "repo", "run"]].assign(grp=out)

    return dealt.select("file_id", "repo", "n_tokens", "turn", "run").groupBy("repo", "run").applyInPandas(cut_up, "file_id long, repo string, run int, grp int")


def flat_windows(docs: DataFrame, order: list[Column], length: int) -> DataFrame:
    """``docs`` (n_tokens, ...) with off, first_window and last_window when laid end to end in windows of ``length`` + 1 tokens."""
    placed = running_total(docs, order, F.col("n_tokens"), "upto")
    off = F.col("upto") - F.col("n_tokens")
    return placed.withColumn("off", off).withColumn("first_window", F.floor(F.col("off") / (length + 1))).withColumn("last_window", F.floor((F.col("upto") - 1) / (length + 1))).drop("upto")


def fim_cuts(docs: DataFrame, key: str, line_rate: float = 0.5, single_line: float = 0.5, newline: str = "\n") -> DataFrame:
    """``docs`` (body, ...) with a and b of a cut-out middle body[a:b], at most MAX_MID long: between any tokens, or aligned with lines."""
    k = F.col(key)
    n = F.size("body")
    places = F.filter(F.transform("body", lambda x, i: F.when(x == newline, i)), lambda i: i.isNotNull())
    geometric = 1 + F.ceil(F.log(F.greatest(1 - unit(k, "lines"), F.lit(1e-12))) / F.log(F.lit(0.65)))
    lines = F.when(unit(k, "single") < single_line, 1).otherwise(F.least(F.lit(8), geometric)).cast("int")
    marked = docs.withColumns({"_breaks": places, "_lines": lines})
    n_ends = F.size("_breaks") + 1
    marked = marked.withColumn("_j", F.least(F.floor(unit(k, "end") * n_ends), n_ends - 1).cast("int"))
    marked = marked.withColumns({"_end": F.coalesce(F.get("_breaks", F.col("_j")), n), "_before": F.get("_breaks", F.col("_j") - F.col("_lines"))})
    # the cursor's line begins after its break and the breaks that follow it at once
    after = F.array_min(F.filter(F.transform("body", lambda x, i: F.when((i > F.col("_before")) & (x != newline), i)), lambda i: i.isNotNull()))
    marked = marked.withColumn("_start", F.least(F.when(F.col("_j") < F.col("_lines"), 0).otherwise(F.coalesce(after, n)), F.col("_end")))
    start, end = F.col("_start"), F.col("_end")
    inside = start + F.floor(unit(k, "inside") * (end - start)).cast("int")
    line_a = F.greatest(F.when((unit(k, "at") < 0.5) | (start >= end), start).otherwise(inside), end - MAX_MID)
    any_a = F.least(F.floor(unit(k, "a") * (n + 1)), n).cast("int")
    span = F.when(unit(k, "short") < 0.5, F.floor(unit(k, "len") * 33)).otherwise(F.floor(unit(k, "len") * (MAX_MID + 1))).cast("int")
    aligned = (unit(k, "aligned") < line_rate) & (F.size("_breaks") > 0)
    cut_up = marked.withColumn("a", F.when(aligned, line_a).otherwise(any_a)).withColumn("b", F.when(aligned, end).otherwise(F.least(n, F.col("a") + span)))
    return cut_up.drop("_breaks", "_lines", "_j", "_end", "_before", "_start")


def fim_pieces(body: Column, a: Column, b: Column, header: int, length: int) -> dict[str, Column]:
    """pre, mid, suf: the middle, MAX_SUF tokens after it, and what fits of the tokens before it."""
    mid = F.slice(body, a + 1, b - a)
    suf = F.slice(body, b + 1, F.lit(MAX_SUF))
    room = F.greatest(F.lit(0), F.lit(length - MARGIN - 4 - header) - F.size(suf) - F.size(mid))
    first = F.greatest(F.lit(0), a - room)
    return {"pre": F.slice(body, first + 1, a - first), "mid": mid, "suf": suf}


def fim_document(pre: Column, mid: Column, suf: Column, header: Column, spm: Column) -> Column:
    """Tokens of a document with its middle last: prefix first, or suffix first if ``spm``."""
    sp = lambda name: F.array(F.lit(name))
    psm = F.concat(sp("<|fim_prefix|>"), header, pre, sp("<|fim_suffix|>"), suf, sp("<|fim_middle|>"), mid, sp("<|endoftext|>"))
    return F.when(spm, F.concat(sp("<|fim_prefix|>"), sp("<|fim_suffix|>"), suf, sp("<|fim_middle|>"), header, pre, mid, sp("<|endoftext|>"))).otherwise(psm)


def dealt_streams(docs: DataFrame, tokens: int = 4 << 20) -> DataFrame:
    """``docs`` (doc, n_tokens, ...) with shard: streams of about ``tokens`` tokens, as many as the table needs, dealt by a hash of doc."""
    kept = cut(docs, "stream-documents")
    total = kept.agg(F.sum(F.col("n_tokens").cast("long"))).first()[0] or 0
    return kept.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-total // tokens)))).cast("int"))


def pack_windows(docs: DataFrame, length: int) -> DataFrame:
    """shard, window, pieces: documents packed into windows of ``length`` + 1 tokens, one stream per shard.

    ``docs`` is (shard, turn, doc, n_tokens, fixed): ``fixed`` is 0 for plain documents, which may be split over
    windows, else the length besides the prefix, which may be shortened where that leaves enough; others wait for the next window.
    Shards bound what a task holds.
    """
    need = length + 1

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc"])
        queue = deque(zip(pdf["doc"].tolist(), pdf["n_tokens"].tolist(), pdf["fixed"].tolist(), [0] * len(pdf), strict=True))
        shard, rows, window, used, waiting = pdf["shard"].iloc[0], [], 0, 0, []
        put = lambda doc, start, size: rows.append((shard, window, doc, start, size))
        while queue or waiting:
            if used == need or not queue:
                queue.extendleft(reversed(waiting))
                if used < need and not waiting:
                    break
                waiting, window, used = [], window + 1, 0
                continue
            doc, size, fixed, start = queue.popleft()
            room = need - used
            if size <= room:
                put(doc, start, size)
                used += size
            elif not fixed:
                put(doc, start, room)
                used = need
                queue.appendleft((doc, size - room, 0, start + room))
            elif room >= SHRINK_MIN and fixed + MIN_PRE <= room:
                put(doc, size - room, room)
                used = need
            elif len(waiting) < MAX_SKIP and size <= need:
                waiting.append((doc, size, fixed, start))
            else:
                queue.appendleft((doc, size - 3, 0, start))
        return pd.DataFrame(rows, columns=["shard", "window", "doc", "start", "n"])

    return docs.select("shard", "turn", "doc", "n_tokens", "fixed").groupBy("shard").applyInPandas(pack, "shard int, window int, doc long, start int, n int")

