"""Tokens of source files: a tiling pattern cuts a text into pieces, windows place and classify them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.languages import PROSE, PUNCTUATION, SEMICOLON_KEYWORDS, SEMICOLON_PUNCTUATION, SPACE, Language

TRIVIA = ["NEWLINE", "SPACE", "COMMENT", "OTHER"]
#: Bytes of text that a task of ``token_table`` cuts up: their rows, some hundred bytes a piece, are sorted in memory.
PART_BYTES = 4 << 20


def pieces(text: Column, language: Language = PROSE) -> Column:
    """All of the text in pieces, as array<string>."""
    return F.regexp_extract_all(text, F.lit(language.tiling), F.lit(0))


def piece_kind(x: Column, language: Language = PROSE) -> Column:
    word = F.when(x.isin(list(language.keywords)), "KEYWORD").otherwise("IDENT")
    # most pieces are a blank or begin with a plain letter, which no other kind does: they need no pattern
    letter = ((x >= "a") & (x < "{")) | ((x >= "A") & (x < "["))
    out = (
        F.when(x == " ", "SPACE").when(letter, word).when(x == "\n", "NEWLINE").when(x.startswith("//") | x.startswith("/*"), "COMMENT").when(x.rlike(f"^{SPACE}*$"), "SPACE")
        .when(x.rlike(r"^(?:[@$]{0,2}\"|`)"), "STRING").when(x.startswith("'"), "CHAR").when(x.rlike(r"^\.?\p{Nd}"), "NUMBER")
        .when(x.rlike(r"^[\p{L}_]"), word).when(x.rlike(r"^@[\p{L}_]"), "IDENT").when(x.isin(PUNCTUATION), "PUNCT")
    )
    if language.line_directive:
        out = F.when(x.rlike(r"^[ \t]*#"), "COMMENT").otherwise(out)
    return F.coalesce(out, F.lit("OTHER"))


def token_pieces(text: Column, language: Language = PROSE) -> Column:
    """The pieces of a text that are tokens, in order; for languages whose line breaks are no tokens."""
    worded = F.filter(pieces(text, language), lambda x: x != " ")
    return F.filter(worded, lambda x: ~piece_kind(x, language).isin(TRIVIA))


#: Before the text of a token that is no identifier in ``token_marks``; no identifier begins with it.
MARK = "\x01"


def token_marks(text: Column, language: Language = PROSE) -> Column:
    """Texts of the tokens in order, as array<string>; those of other tokens than identifiers begin with MARK."""

    def one(x: Column) -> Column:
        kind = piece_kind(x, language)
        return F.when(kind == "IDENT", token_text(x, F.lit("IDENT"))).otherwise(F.concat(F.lit(MARK), token_text(x, kind)))

    # a piece that begins with a plain letter is an identifier or a keyword: it is not looked at again
    letter = lambda x: ((x >= "a") & (x < "{")) | ((x >= "A") & (x < "["))
    word = lambda x: F.when(x.isin(list(language.keywords)), F.concat(F.lit(MARK), x)).otherwise(x)
    return F.transform(token_pieces(text, language), lambda x: F.when(letter(x), word(x)).otherwise(one(x)))


def unmarked(mark: Column) -> Column:
    """The token's text."""
    return F.when(mark.startswith(MARK), F.substring(mark, 2, 1 << 30)).otherwise(mark)


def token_rows(files: DataFrame, language: Language = PROSE, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns file_id, keep, pos, kind and text of ``token_table``: no row is exchanged or sorted, as a text's tokens lie in order."""
    if language.auto_semicolon:
        raise ValueError("semicolons read at line breaks need token_table")
    cut_up = files.select("file_id", *keep, F.posexplode(token_pieces(F.col("text"), language)).alias("pos", "piece"))
    return cut_up.withColumn("kind", piece_kind(F.col("piece"), language)).select("file_id", *keep, "pos", "kind", token_text(F.col("piece"), F.col("kind")).alias("text"))


def parts_of(files: DataFrame) -> int:
    """Tasks among which the texts of ``files`` are dealt so that each gets PART_BYTES or so."""
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(files.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))


def token_text(x: Column, kind: Column) -> Column:
    """Literals normalised, an escaped keyword without its mark."""
    return F.when(kind == "STRING", "<STR>").when(kind == "CHAR", "<CHAR>").when(kind == "NUMBER", "<NUM>").when((kind == "IDENT") & x.startswith("@"), F.substring(x, 2, 1 << 30)).otherwise(x)


def words_and_tokens(text: Column, language: Language = PROSE) -> dict[str, Column]:
    """``tokens`` (normalised, in order) and ``identifiers`` as array columns, without a shuffle."""
    marked = F.transform(pieces(text, language), lambda x: F.struct(piece_kind(x, language).alias("kind"), x.alias("piece")))
    tokens = F.filter(marked, lambda p: ~p["kind"].isin(TRIVIA))
    return {
        "tokens": F.transform(tokens, lambda p: token_text(p["piece"], p["kind"])),
        "identifiers": F.transform(F.filter(marked, lambda p: p["kind"] == "IDENT"), lambda p: token_text(p["piece"], p["kind"])),
    }


def token_table(files: DataFrame, language: Language = PROSE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token of (file_id, text): pos, kind, text, off, line, line_start, at_line_end, and the ``keep`` columns.

    Texts are dealt by file before they are cut up, so all windows below run on
    that one exchange. Tokens take some thirty times the room of their text, so the
    number of tasks follows the bytes of text: a task sorts what it holds in memory.
    Offsets count code points.
    """
    parts = pieces(F.col("text"), language)
    if language.auto_semicolon:
        parts = F.concat(parts, F.array(F.lit("\n")))  # the end of a file ends its line
    cut_up = files.repartition(parts_of(files), "file_id").select("file_id", *keep, F.posexplode(parts).alias("i", "piece"))
    order = Window.partitionBy("file_id").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    placed = cut_up.select(
        "file_id", *keep, "i", "piece", piece_kind(F.col("piece"), language).alias("kind"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int").alias("off"), F.coalesce(F.sum(breaks).over(before), F.lit(0)).cast("int").alias("line"),
    )
    trivia = [t for t in TRIVIA if not (language.auto_semicolon and t == "NEWLINE")]
    tokens = placed.where(~F.col("kind").isin(trivia)).withColumn("text", token_text(F.col("piece"), F.col("kind")))
    at_end = F.lit(False)
    if language.auto_semicolon:
        kind, text = F.lag("kind").over(order), F.lag("text").over(order)
        ends = kind.isin("IDENT", "NUMBER", "STRING", "CHAR") | ((kind == "KEYWORD") & text.isin(SEMICOLON_KEYWORDS)) | ((kind == "PUNCT") & text.isin(SEMICOLON_PUNCTUATION))
        tokens = tokens.withColumn("ends", F.coalesce(ends, F.lit(False))).where("kind <> 'NEWLINE' or ends")
        at_end = F.col("kind") == "NEWLINE"
        tokens = tokens.withColumn("at_line_end", at_end).withColumn("text", F.when(at_end, ";").otherwise(F.col("text"))).withColumn("kind", F.when(at_end, "PUNCT").otherwise(F.col("kind")))
    else:
        tokens = tokens.withColumn("at_line_end", at_end)
    return tokens.select(
        "file_id", *keep, (F.row_number().over(order) - 1).alias("pos"), "kind", "text", "off", "line",
        F.coalesce(F.col("line") > F.lag("line").over(order), F.lit(False)).alias("line_start"), "at_line_end",
    )


def rest_of_line(tokens: DataFrame) -> DataFrame:
    """``tokens`` with rest: tokens from here to the end of the line, a semicolon read at the line break not counted."""
    onward = Window.partitionBy("file_id", "line").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return tokens.withColumn("rest", F.count_if(~F.col("at_line_end")).over(onward))


# Previous tokens by context.
CONTEXTS = {
    "PUNCT": {"AFTER_DOT": [".", "?.", "->", "::"], "STATEMENT_START": [";", "{", "}"], "ARGUMENT": ["(", ","], "ASSIGN_RHS": ["=", ":=", "??="], "TYPE_POSITION": ["<", "[", "*", "&"]},
    "KEYWORD": {
        "ASSIGN_RHS": ["return", "await", "yield", "case"],
        "TYPE_POSITION": ["new", "is", "as", "typeof", "chan", "map", "struct", "func", "var", "const", "type"],
        "STATEMENT_START": ["if", "while", "for", "foreach", "switch", "else", "defer", "go", "throw"],
    },
}


def context_kind(prev_kind: Column, prev_text: Column) -> Column:
    """What a completion stands after: one of six kinds, from the token before it."""
    out = F
    for kind, table in CONTEXTS.items():
        for name, words in table.items():
            out = out.when((prev_kind == kind) & prev_text.isin(words), name)
    return out.otherwise("OTHER")


def position_kind(first_of_line: Column, prev_kind: Column, prev_text: Column, assign: list[str], dots: list[str]) -> Column:
    """Where a cursor stands: at a line start, or after a comment, dot, opener, comma, assignment, keyword, name or anything else."""
    return (
        F.when(first_of_line, "line-start").when(prev_kind == "COMMENT", "after-comment").when(prev_text.isin(dots), "after-dot").when(prev_text.isin("(", "[", "{"), "after-open")
        .when(prev_text == ",", "after-comma").when(prev_text.isin(assign), "after-assign").when(prev_kind == "KEYWORD", "after-keyword").when(prev_kind == "IDENT", "after-ident").otherwise("after-other")
    )


def code_part(line: Column, language: Language = PROSE) -> Column:
    """A line without its trailing comment and blanks."""
    marked = F.transform(pieces(line, language), lambda x: F.struct(piece_kind(x, language).alias("kind"), x.alias("piece")))
    last = F.array_max(F.filter(F.transform(marked, lambda p, i: F.when(~p["kind"].isin("COMMENT", "SPACE", "NEWLINE"), i + 1)), lambda i: i.isNotNull()))
    return F.array_join(F.transform(F.slice(marked, F.lit(1), F.coalesce(last, F.lit(0))), lambda p: p["piece"]), "")


def evaluation_tokens(text: Column, language: Language = PROSE) -> Column:
    """Tokens with comments kept, as evaluation compares them: array<struct<kind, text>>."""
    marked = F.transform(pieces(text, language), lambda x: F.struct(piece_kind(x, language).alias("kind"), x.alias("piece")))
    kept = F.filter(marked, lambda p: ~p["kind"].isin("SPACE", "NEWLINE", "OTHER"))
    return F.transform(kept, lambda p: F.struct(p["kind"].alias("kind"), token_text(p["piece"], p["kind"]).alias("text")))
