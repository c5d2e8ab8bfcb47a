"""Queries on tokens and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.languages import PROSE, PUNCTUATION, SPACE
from tessera.operators import lexing, vocabulary
from tessera.plans.common import FILES
from tessera.plans.registration import query
from tessera.sources.storage import cut
from tessera.sources.tables import files, table


def _sql(text: str) -> str:
    return text.replace("'", "''")


_KEYWORDS = ", ".join(f"'{k}'" for k in PROSE.keywords)
_KIND = f"""CASE WHEN piece = chr(10) THEN 'NEWLINE' WHEN starts_with(piece, '//') OR starts_with(piece, '/*') THEN 'COMMENT' WHEN regexp_matches(piece, '^{_sql(SPACE)}*$') THEN 'SPACE'
    WHEN piece[1] IN ('"', '`') THEN 'STRING' WHEN piece[1] = '''' THEN 'CHAR' WHEN regexp_matches(piece, '^\\.?\\p{{Nd}}') THEN 'NUMBER'
    WHEN regexp_matches(piece, '^[\\p{{L}}_]') THEN CASE WHEN piece IN ({_KEYWORDS}) THEN 'KEYWORD' ELSE 'IDENT' END WHEN regexp_matches(piece, '^@[\\p{{L}}_]') THEN 'IDENT'
    WHEN piece IN ({', '.join(f"'{p}'" for p in PUNCTUATION)}) THEN 'PUNCT' ELSE 'OTHER' END"""
_TEXT = "CASE kind WHEN 'STRING' THEN '<STR>' WHEN 'CHAR' THEN '<CHAR>' WHEN 'NUMBER' THEN '<NUM>' WHEN 'IDENT' THEN ltrim(piece, '@') ELSE piece END"


def tokens_sql(source: str = "files", keep: str = "repo, lang", name: str = "tokens") -> str:
    """CTEs ending in ``tokens`` (file_id, keep, pos, kind, text, off, line, line_start)."""
    return f"""{name}_p AS (SELECT file_id, {keep}, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT *, regexp_extract_all(text, '{_sql(PROSE.tiling)}') AS p FROM {source})),
    {name}_o AS (SELECT *, coalesce(sum(length(piece)) OVER w, 0)::INT AS off, coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w, 0)::INT AS line, {_KIND} AS kind
        FROM {name}_p WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name} AS (SELECT file_id, {keep}, row_number() OVER w - 1 AS pos, kind, {_TEXT} AS text, off, line, coalesce(line > lag(line) OVER w, false) AS line_start
        FROM {name}_o WHERE kind NOT IN ('NEWLINE', 'SPACE', 'COMMENT', 'OTHER') WINDOW w AS (PARTITION BY file_id ORDER BY i))"""


TOKENS = f"{FILES}, {tokens_sql()}"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexing.token_table(files(spark, sf_dir), keep=("repo", "lang"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tokens`` without places in the text, which cost an exchange and a sort."""
    return lexing.token_rows(files(spark, sf_dir), keep=("repo", "lang"))


def token_arrays(known: DataFrame) -> DataFrame:
    """``known`` with toks, the marked tokens of a file in order, in place of its text."""
    return known.select(*[c for c in known.columns if c != "text"], lexing.token_marks(F.col("text")).alias("toks"))


@query(f"WITH {TOKENS} SELECT file_id, kind, count(*) AS n, sum(off)::BIGINT AS offsets, sum(pos)::BIGINT AS places, sum(length(text))::BIGINT AS chars, min(text) AS least, max(text) AS most FROM tokens GROUP BY file_id, kind")
def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every file, summed up by kind so that places and offsets are checked too."""
    return tokens(spark, sf_dir).groupBy("file_id", "kind").agg(
        F.count("*").alias("n"), F.sum("off").alias("offsets"), F.sum("pos").alias("places"), F.sum(F.length("text")).alias("chars"), F.min("text").alias("least"), F.max("text").alias("most")
    )


@query(f"""WITH pages_ AS (SELECT page_id AS file_id, 'web' AS repo, '' AS lang, html AS text FROM pages), {tokens_sql('pages_')} SELECT kind, count(*) AS n, count(DISTINCT text) AS texts FROM tokens GROUP BY kind""")
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("text"))
    return lexing.token_table(pages).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


@query(f"WITH {TOKENS} SELECT text, CASE WHEN bool_or(kind = 'IDENT') THEN 'IDENT' ELSE max(kind) END AS kind, count(*) AS cnt FROM tokens GROUP BY text")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.token_counts(token_rows(spark, sf_dir))


@query(f"WITH {TOKENS} SELECT text, bool_or(kind = 'IDENT') AS is_ident, count(DISTINCT file_id) AS df, count(*) AS tf FROM tokens GROUP BY text")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.array_frequencies(token_arrays(files(spark, sf_dir)))


MIN_DF, MOST_NAMES = 2, 20_000
VOCABULARY = f"""counted AS (SELECT text, bool_or(kind = 'IDENT') AS is_ident, count(DISTINCT file_id) AS df, count(*) AS tf FROM tokens GROUP BY text),
    named AS (SELECT * FROM counted WHERE is_ident AND df >= {MIN_DF} ORDER BY df DESC, tf DESC, text LIMIT {MOST_NAMES}),
    vocab AS (SELECT 0 AS id, '<ID>' AS word, false AS is_ident, 0 AS df, 0 AS tf UNION ALL SELECT 1, '<BOS>', false, 0, 0 UNION ALL SELECT 2, '<EOS>', false, 0, 0 UNION ALL
        SELECT (row_number() OVER (ORDER BY is_ident, CASE WHEN is_ident THEN -df ELSE 0 END, CASE WHEN is_ident THEN -tf ELSE 0 END, text) + 2)::INT, text, is_ident, df, tf FROM (SELECT * FROM counted WHERE NOT is_ident UNION ALL SELECT * FROM named))"""


def vocab_of(known: DataFrame) -> DataFrame:
    """Vocabulary of files with toks."""
    return vocabulary.build(vocabulary.array_frequencies(known), MIN_DF, MOST_NAMES)


@query(f"WITH {TOKENS}, {VOCABULARY} SELECT * FROM vocab")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_of(token_arrays(files(spark, sf_dir)))


@query(f"""WITH {TOKENS}, counts AS (SELECT text, CASE WHEN bool_or(kind = 'IDENT') THEN 'IDENT' ELSE max(kind) END AS kind, count(*) AS cnt FROM tokens GROUP BY text)
    SELECT row_number() OVER (ORDER BY cnt DESC, text) AS id, text, kind, cnt FROM counts WHERE NOT (kind = 'IDENT' AND cnt < 3)
    UNION ALL SELECT 0, '<ID>', 'IDENT', coalesce(sum(cnt), 0)::BIGINT FROM counts WHERE kind = 'IDENT' AND cnt < 3""")
def rare_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.shard_ids(cut(vocabulary.token_counts(token_rows(spark, sf_dir)), "token-counts"), 3)


@query(f"WITH {TOKENS}, {VOCABULARY} SELECT file_id, count(*) AS n, sum(coalesce(v.id, 0) * (pos % 97 + 1))::BIGINT AS checksum, count(*) FILTER (v.id IS NULL) AS unknown FROM tokens LEFT JOIN vocab v ON v.word = text GROUP BY file_id")
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = cut(token_arrays(files(spark, sf_dir).select("file_id", "text")), "file-tokens")
    toks = known.select("file_id", F.posexplode("toks").alias("pos", "t")).select("file_id", "pos", lexing.unmarked(F.col("t")).alias("text"))
    return vocabulary.encode(toks, F.broadcast(vocab_of(known))).groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.col("id") * (F.col("pos") % 97 + 1)).alias("checksum"), F.count_if(F.col("id") == 0).alias("unknown"))


@query(f"WITH {TOKENS} SELECT file_id, count(*) FILTER (line_start) AS line_starts, sum(CASE WHEN line_start THEN pos ELSE 0 END)::BIGINT AS places FROM tokens GROUP BY file_id")
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).groupBy("file_id").agg(F.count_if("line_start").alias("line_starts"), F.sum(F.when(F.col("line_start"), F.col("pos")).otherwise(0)).alias("places"))


@query(f"""WITH {TOKENS}, rested AS (SELECT file_id, pos, count(*) OVER (PARTITION BY file_id, line ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM tokens)
    SELECT file_id, sum(rest)::BIGINT AS rests, max(rest) AS longest, sum(rest * (pos % 13))::BIGINT AS checksum FROM rested GROUP BY file_id""")
def rest_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rested = lexing.rest_of_line(tokens(spark, sf_dir))
    return rested.groupBy("file_id").agg(F.sum("rest").alias("rests"), F.max("rest").alias("longest"), F.sum(F.col("rest") * (F.col("pos") % 13)).alias("checksum"))


@query(f"""WITH {TOKENS}, prev AS (SELECT file_id, kind, pos, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM tokens WINDOW w AS (PARTITION BY file_id ORDER BY pos))
    SELECT CASE WHEN pk = 'PUNCT' AND pt IN ('.', '?.', '->', '::') THEN 'AFTER_DOT' WHEN pk = 'PUNCT' AND pt IN (';', '{{', '}}') THEN 'STATEMENT_START' WHEN pk = 'PUNCT' AND pt IN ('(', ',') THEN 'ARGUMENT'
        WHEN pk = 'PUNCT' AND pt IN ('=', ':=', '??=') THEN 'ASSIGN_RHS' WHEN pk = 'PUNCT' AND pt IN ('<', '[', '*', '&') THEN 'TYPE_POSITION'
        WHEN pk = 'KEYWORD' AND pt IN ('return', 'await', 'yield', 'case') THEN 'ASSIGN_RHS' WHEN pk = 'KEYWORD' AND pt IN ('new', 'is', 'as', 'typeof', 'chan', 'map', 'struct', 'func', 'var', 'const', 'type') THEN 'TYPE_POSITION'
        WHEN pk = 'KEYWORD' AND pt IN ('if', 'while', 'for', 'foreach', 'switch', 'else', 'defer', 'go', 'throw') THEN 'STATEMENT_START' ELSE 'OTHER' END AS context, count(*) AS n FROM prev WHERE kind = 'IDENT' AND pos > 0 GROUP BY 1""")
def context_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an identifier goes with the token before it, which is all that its context needs
    marks = files(spark, sf_dir).select(lexing.token_pieces(F.col("text")).alias("toks"))
    beside = marks.select(F.explode(F.zip_with(F.slice("toks", F.lit(2), F.greatest(F.size("toks") - 1, F.lit(0))), F.slice("toks", F.lit(1), F.greatest(F.size("toks") - 1, F.lit(0))), lambda t, b: F.struct(t.alias("t"), b.alias("b")))).alias("x"))
    kinds = beside.select("x.b", lexing.piece_kind(F.col("x.t")).alias("kind")).where("kind = 'IDENT'").select("b", lexing.piece_kind(F.col("b")).alias("pk"))
    placed = kinds.select("pk", lexing.token_text(F.col("b"), F.col("pk")).alias("pt"))
    return placed.groupBy(lexing.context_kind(F.col("pk"), F.col("pt")).alias("context")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS}, prev AS (SELECT file_id, pos, line_start, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM tokens WINDOW w AS (PARTITION BY file_id ORDER BY pos))
    SELECT CASE WHEN pos = 0 OR line_start THEN 'line-start' WHEN pt = '.' THEN 'after-dot' WHEN pt IN ('(', '[', '{{') THEN 'after-open' WHEN pt = ',' THEN 'after-comma' WHEN pt IN ('=', ':=') THEN 'after-assign'
        WHEN pk = 'KEYWORD' THEN 'after-keyword' WHEN pk = 'IDENT' THEN 'after-ident' ELSE 'after-other' END AS position, count(*) AS n FROM prev GROUP BY 1""")
def position_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tokens(spark, sf_dir).selectExpr("pos", "line_start", "lag(kind) OVER (PARTITION BY file_id ORDER BY pos) AS pk", "lag(text) OVER (PARTITION BY file_id ORDER BY pos) AS pt")
    kind = lexing.position_kind((F.col("pos") == 0) | F.col("line_start"), F.col("pk"), F.col("pt"), ["=", ":="], ["."])
    return placed.groupBy(kind.alias("position")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS}, occ AS (SELECT file_id, pos, text, row_number() OVER w - 1 AS freq, coalesce(pos - lag(pos) OVER w, 0) AS gap FROM tokens WHERE kind = 'IDENT' WINDOW w AS (PARTITION BY file_id, text ORDER BY pos))
    SELECT file_id, sum(freq)::BIGINT AS freqs, round(sum(CASE WHEN gap > 0 THEN ln(1 + gap) ELSE 0 END), 6) AS recencies FROM occ GROUP BY file_id""")
def running_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-file frequency and recency of every identifier before its position."""
    occ = tokens(spark, sf_dir).where("kind = 'IDENT'").selectExpr("file_id", "row_number() OVER (PARTITION BY file_id, text ORDER BY pos) - 1 AS freq", "coalesce(pos - lag(pos) OVER (PARTITION BY file_id, text ORDER BY pos), 0) AS gap")
    return occ.groupBy("file_id").agg(F.sum("freq").cast("long").alias("freqs"), F.round(F.sum(F.when(F.col("gap") > 0, F.log1p("gap")).otherwise(0.0)), 6).alias("recencies"))
