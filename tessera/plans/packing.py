"""Queries on byte-pair encoding and training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bytepairs as pieces
from tessera.operators import bytepairs, packing
from tessera.plans.common import FILES, draw, unit
from tessera.plans.registration import query
from tessera.sources.storage import cut
from tessera.sources.tables import files

# RE2 has no look-ahead: a mark is set where a run of blanks leaves its last one to the next piece.
_MARKED = "regexp_replace(text, '([ \\t]+)( [^ \\t\\r\\n])', '\\1' || chr(1) || '\\2', 'g')"
_PRETOKENS = f"list_transform(regexp_extract_all({_MARKED}, '[\\r\\n]+[ \\t]*|[ \\t]+\\x01| ?[A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+| ?[0-9]| ?[^A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}} \\t\\r\\n\\x01]+|[ \\t]+'), lambda x: replace(x, chr(1), ''))"


# Chunks of 128 bytes may end inside a character, so pieces are shown in hex.
_CHUNKS = f"flatten(list_transform(list_transform({_PRETOKENS}, lambda x: hex(encode(x))), lambda h: list_transform(range(0, length(h), 256), lambda i: h[i + 1 : i + 256])))"


@query(f"WITH {FILES}, cut_up AS (SELECT file_id, {_CHUNKS} AS p FROM files) SELECT file_id, coalesce(len(p), 0) AS n, md5(array_to_string(coalesce(p, []), ' ')) AS digest FROM cut_up")
def bpe_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens of every file; long ones as chunks, an empty or null text has none."""
    placed = files(spark, sf_dir).select("file_id", F.coalesce(pieces.pretokens(F.col("text")), F.array().cast("array<binary>")).alias("p"))
    return placed.select("file_id", F.size("p").cast("long").alias("n"), F.md5(F.concat_ws(" ", F.transform("p", F.hex))).alias("digest"))


@query(f"WITH {FILES}, cut_up AS (SELECT unnest({_CHUNKS}) AS piece FROM files) SELECT piece, count(*) AS c FROM cut_up GROUP BY piece")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each piece occurs, in hex, over all files."""
    return bytepairs.word_table(files(spark, sf_dir)).select(F.hex("piece").alias("piece"), "c")


@query(f"WITH {FILES}, words AS (SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM files) GROUP BY w), pairs AS (SELECT c, unnest(list_zip(string_split(w, '')[1:-2], string_split(w, '')[2:])) AS p FROM words WHERE length(w) > 1) SELECT p[1] AS l, p[2] AS r, sum(c)::BIGINT AS c FROM pairs GROUP BY 1, 2")
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = files(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return bytepairs.pair_counts(words.select(F.split("w", "(?!^)(?!$)").alias("ids"), "c"))


N_MERGES = 12


def learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pieces.Merges]:
    words = cut(bytepairs.word_table(files(spark, sf_dir)), "word-table")
    return words, bytepairs.learn(words, N_MERGES)


@query()
def bpe_train_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, merges = learnt(spark, sf_dir)
    tokens = pieces.tokens_of(merges)
    return spark.createDataFrame([(i, a, b, bytearray(tokens[256 + i])) for i, (a, b) in enumerate(merges)], "rank int, l int, r int, token binary").select("rank", "l", "r", F.hex("token").alias("token"))


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file encoded; the last column says that decoding gives its bytes back."""
    _, merges = learnt(spark, sf_dir)
    back = bytepairs.encode(files(spark, sf_dir), merges, ("text",)).withColumn("back", pieces.decoder(merges)("ids"))
    return back.select("file_id", F.size("ids").alias("n"), (F.col("back") == F.col("text").cast("binary")).alias("same"))


@query()
def bytes_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, merges = learnt(spark, sf_dir)
    return bytepairs.bytes_per_token(words, merges)


_SIZED = f"{FILES}, sized AS (SELECT file_id, repo, len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')) AS n_tokens FROM files), totals AS (SELECT repo, sum(n_tokens)::BIGINT AS total FROM sized GROUP BY repo)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", "repo", F.regexp_count("text", F.lit(r"[^\x09-\x0D\x20]+")).cast("long").alias("n_tokens"))


@query(f"WITH {_SIZED}, caps AS (SELECT unnest(range(1, (SELECT max(total) + 1 FROM totals))) AS cap) SELECT min(cap) AS cap FROM caps WHERE (SELECT sum(least(total, cap)) FROM totals) >= (SELECT sum(total) * 0.6 FROM totals) OR cap = (SELECT max(total) FROM totals)")
def waterfill_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = cut(sized(spark, sf_dir).groupBy("repo").agg(F.sum("n_tokens").alias("total")), "repo-totals")
    budget = -(-(totals.agg(F.sum("total")).first()[0] or 0) * 6 // 10)
    return packing.waterfill_cap(totals, budget)


@query(f"WITH {_SIZED} SELECT repo, total, round(least(1.0, sqrt(5000.0 / greatest(total, 1))), 9) AS p FROM totals")
def repo_keep_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = sized(spark, sf_dir).groupBy("repo").agg(F.sum("n_tokens").alias("total"))
    return totals.select("repo", "total", F.round(packing.keep_probability(F.col("total"), 5000), 9).alias("p"))


@query(f"WITH {_SIZED} SELECT file_id, s.repo, n_tokens, {draw('file_id', 'order1')} AS turn FROM sized s JOIN totals USING (repo) WHERE {unit('file_id', 'keep1')} < least(1.0::DOUBLE, sqrt(5000.0::DOUBLE / greatest(total, 1))) AND n_tokens BETWEEN 1 AND 4096")
def epoch_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.epoch_files(sized(spark, sf_dir), 1, 5000, 4096).select("file_id", "repo", "n_tokens", "turn")


@query()
def epoch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.group_files(packing.epoch_files(sized(spark, sf_dir), 1, 1 << 40, 4096), 2048)


@query(f"""WITH {_SIZED}, laid AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY {draw('file_id', 'lay')}, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sized WHERE n_tokens > 0)
    SELECT file_id, n_tokens, off, off // 1025 AS first_window, (off + n_tokens - 1) // 1025 AS last_window FROM laid""")
def pack_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.draws import md5_int

    docs = sized(spark, sf_dir).where("n_tokens > 0")
    return packing.flat_windows(docs, [md5_int(F.col("file_id"), "lay"), F.col("file_id")], 1024).select("file_id", "n_tokens", "off", "first_window", "last_window")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_extract_all("text", F.lit(r"\n|[^\x09-\x0D\x20]+"), F.lit(0))
    return packing.fim_cuts(files(spark, sf_dir).select("file_id", body.alias("body")).where("size(body) >= 2"), "file_id")


_BODY = f"{FILES}, bodies AS (SELECT file_id, regexp_extract_all(text, '\\n|[^\\x09-\\x0D\\x20]+') AS body FROM files), long AS (SELECT *, len(body) AS n FROM bodies WHERE len(body) >= 2)"
_U = lambda salt: unit("file_id", salt)


@query(f"""WITH {_BODY}, drawn AS (SELECT *, least(floor({_U('a')} * (n + 1)), n)::INT AS a, CASE WHEN {_U('short')} < 0.5 THEN floor({_U('len')} * 33) ELSE floor({_U('len')} * 257) END::INT AS span FROM long)
    SELECT file_id, a, least(n, a + span)::INT AS b, md5(array_to_string(body[a + 1 : least(n, a + span)], ' ')) AS mid FROM drawn""")
def fim_token_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles cut between any tokens."""
    body = files(spark, sf_dir).select("file_id", F.regexp_extract_all("text", F.lit(r"\n|[^\x09-\x0D\x20]+"), F.lit(0)).alias("body")).where("size(body) >= 2")
    return packing.fim_cuts(body, "file_id", line_rate=-1.0).select("file_id", "a", "b", F.md5(F.concat_ws(" ", F.slice("body", F.col("a") + 1, F.col("b") - F.col("a")))).alias("mid"))


@query(f"WITH {_BODY} SELECT file_id, n, true AS same, true AS bounded FROM long")
def fim_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles cut in either way give their body back, and stay within bounds."""
    cut_up = _bodies(spark, sf_dir)
    part = packing.fim_pieces(F.col("body"), F.col("a"), F.col("b"), 1, 2048)
    known = cut_up.withColumns(part)
    start, end = F.col("a") - F.size("pre"), F.col("b") + F.size("suf")
    same = F.concat("pre", "mid", "suf") == F.slice("body", start + 1, end - start)
    bounded = (F.size("mid") <= packing.MAX_MID) & (F.size("suf") <= packing.MAX_SUF) & (F.size("pre") + F.size("mid") + F.size("suf") + 5 <= 2048 - packing.MARGIN)
    return known.select("file_id", F.size("body").cast("long").alias("n"), same.alias("same"), bounded.alias("bounded"))


@query()
def pack_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1025 tokens from plain documents and ones with their middle last, in streams of bounded size."""
    from tessera.functions.draws import md5_int, unit as drawn

    part = packing.fim_pieces(F.col("body"), F.col("a"), F.col("b"), 1, 1024)
    known = _bodies(spark, sf_dir).withColumns(part).withColumn("fim", drawn(F.col("file_id"), "fim") < 0.5)
    around = F.size("mid") + F.size("suf") + 5
    n = F.when(F.col("fim"), around + F.size("pre")).otherwise(F.size("body") + 2)
    docs = known.select(md5_int(F.col("file_id"), "turn").alias("turn"), F.col("file_id").alias("doc"), n.cast("int").alias("n_tokens"), F.when(F.col("fim"), around).otherwise(0).cast("int").alias("fixed"))
    return packing.pack_windows(packing.dealt_streams(docs), 1024)


@query()
def eval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed windows of evaluation: every document has its middle last."""
    from tessera.functions.draws import md5_int

    part = packing.fim_pieces(F.col("body"), F.col("a"), F.col("b"), 1, 1024)
    known = _bodies(spark, sf_dir).withColumns(part)
    around = F.size("mid") + F.size("suf") + 5
    docs = known.select(md5_int(F.col("file_id"), "eval").alias("turn"), F.col("file_id").alias("doc"), (around + F.size("pre")).cast("int").alias("n_tokens"), around.cast("int").alias("fixed"))
    return packing.pack_windows(packing.dealt_streams(docs), 1024)


@query(f"WITH {_SIZED} SELECT repo, count(*) AS files, sum(n_tokens)::BIGINT AS tokens, round(sum(n_tokens * least(1.0::DOUBLE, sqrt(5000.0::DOUBLE / greatest(total, 1)))), 4) AS expected FROM sized JOIN totals USING (repo) GROUP BY repo")
def expected_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per repository and what down-weighting leaves of them on average."""
    known = sized(spark, sf_dir)
    totals = known.groupBy("repo").agg(F.count("*").alias("files"), F.sum("n_tokens").alias("tokens"))
    return totals.select("repo", "files", "tokens", F.round(F.col("tokens") * packing.keep_probability(F.col("tokens"), 5000), 4).alias("expected"))
