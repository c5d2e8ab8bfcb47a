"""Steps that must not grow faster than their input: what is exchanged, sorted and held, and that the results stay."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.languages import PROSE
from tessera.operators import cache, coded, lexing, ngram, vocabulary
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "if @if x", "a.b(c) // d\ne", '"s" \'c\' 1.5 `r`\n\n@else else', "/* x\ny */ z\x00 é Ä_1 {[", None, "one one two"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "file_id long, text string")


def test_token_rows_are_those_of_the_table(spark, odd):
    want = {(r.file_id, r.pos, r.kind, r.text) for r in lexing.token_table(odd).collect()}
    assert {(r.file_id, r.pos, r.kind, r.text) for r in lexing.token_rows(odd).collect()} == want
    marks = odd.select("file_id", F.posexplode(lexing.token_marks(F.col("text"))).alias("pos", "m")).select("file_id", "pos", F.col("m").startswith(lexing.MARK).alias("other"), lexing.unmarked(F.col("m")).alias("text"))
    assert {(r.file_id, r.pos, r.other, r.text) for r in marks.collect()} == {(f, p, k != "IDENT", t) for f, p, k, t in want}


def test_array_frequencies(spark, odd):
    want = sorted(vocabulary.frequencies(lexing.token_table(odd)).select("text", "is_ident", "df", "tf").collect())
    got = vocabulary.array_frequencies(odd.select("file_id", lexing.token_marks(F.col("text")).alias("toks")))
    assert sorted(got.select("text", "is_ident", "df", "tf").collect()) == want


@pytest.mark.parametrize("name", ["context_kinds", "token_counts", "doc_freq", "candidate_lists"])
def test_no_token_is_exchanged_or_sorted_by_file(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "hashpartitioning(file_id" not in p and "hashpartitioning(doc_id" not in p
    assert "Window" not in p or name == "candidate_lists"  # its folds are ranked


def test_lexing_tasks_follow_the_bytes_of_text(spark, odd, monkeypatch):
    assert lexing.parts_of(odd) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(lexing, "PART_BYTES", 4)
    assert lexing.parts_of(odd) == -(-sum(len((t or "").encode()) for t in ODD) // 4)
    assert lexing.token_table(odd).count() == lexing.token_rows(odd).count()


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    words = ["a", "b", "c", "d"]
    files = [(i, i % 3, "l", [draw.choice([*words, "zz", lexing.MARK + "."]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 30, 0, 50, 7])]
    toks = spark.createDataFrame(files, "file_id long, repo int, lang string, toks array<string>")
    vocab = spark.createDataFrame(list(enumerate([*vocabulary.SPECIAL, *words, "."])), "id int, word string")
    seq = toks.select("file_id", F.col("repo").cast("string").alias("repo"), F.posexplode("toks").alias("pos", "m")).withColumn("text", lexing.unmarked(F.col("m")))
    return toks, vocab, vocabulary.fold_rare(seq, vocab).select("file_id", "repo", F.col("pos").cast("long").alias("pos"), "w")


def test_grams_of_ids_are_counted_and_scored_like_words(spark, corpus):
    toks, vocab, seq = corpus
    words = coded.encode(toks, vocab, ["repo", "lang"])
    name = {r.id: r.word for r in vocab.collect()}
    text = lambda g, n: " ".join(name[g >> coded.BITS * k & (1 << coded.BITS) - 1] for k in range(n - 1, -1, -1))
    by_id, by_word = ngram.counts_of(coded.grams(words, 3), 3, ngram.IDS), ngram.counts(seq, 3)
    for n in (1, 2, 3):
        assert {(text(r.gram, n), r.c, r.repos) for r in by_id[n].collect()} == {(r.gram, r.c, r.repos) for r in by_word[n].collect()}
    model = ngram.estimate(by_id, 3, vocab.select(F.col("id").cast("long").alias("word")), keys=ngram.IDS)
    like = ngram.estimate(by_word, 3, vocab.select("word"))
    asked = spark.createDataFrame([(a, b, c) for a in range(8) for b in (3, 7) for c in (0, 4, 5)], "a long, b long, c long")
    got = {text(r.gram, 3): round(r.logp, 9) for r in ngram.score(asked.select(coded.pair(coded.pair(F.col("a"), F.col("b")), F.col("c")).alias("gram")), model).collect()}
    want = {r.gram: round(r.logp, 9) for r in ngram.score(spark.createDataFrame([(g,) for g in got], "gram string"), like).collect()}
    assert got == want and len(got) == 48


def test_cache_of_arrays_is_that_of_windows(spark, corpus):
    toks, vocab, seq = corpus
    got = {(r.file_id, r.pos): round(r.p_cache, 12) for r in coded.positions(coded.encode(toks, vocab, ["repo", "lang"]), 3, 8).collect()}
    want = cache.cache_probability(ngram.with_context(seq, 3), spark.range(1).select(F.lit(8).alias("v")))
    assert got == {(r.file_id, r.pos): round(r.p_cache, 12) for r in want.collect()}


def test_scores_send_a_gram_once_an_order(spark, corpus):
    _, vocab, seq = corpus
    model = ngram.estimate(ngram.counts(seq, 3), 3, vocab.select("word"))
    grams = spark.createDataFrame([("a b c",)], "gram string")
    assert "Generate" not in plan(ngram.score(grams, model))  # a row was exploded into five probes


def test_marks_need_no_semicolons(spark, odd):
    from tessera.functions.languages import GO

    assert PROSE.auto_semicolon is False
    with pytest.raises(ValueError, match="token_table"):
        lexing.token_rows(odd, GO)


def test_baskets_hold_no_text(spark):
    from tessera.plans import importing

    b = importing.baskets(spark, SF)
    assert b.rows.schema.simpleString() == "struct<doc:bigint,items:array<struct<path:int,name:int>>,hidden:struct<path:int,name:int>>"
    ordered = [r.text for r in b.paths.orderBy("id").collect()]
    assert ordered == sorted(ordered) and len(set(ordered)) == len(ordered)


def test_ranking_makes_no_row_a_path_and_present_import(spark):
    from tessera.operators import importing

    prior = spark.createDataFrame([("n", p, p) for p in range(16)], "name string, path int, q int")
    pmi = spark.createDataFrame([(1, 100, 5)], "path int, other int, q int")
    context = spark.createDataFrame([(1, p) for p in range(100, 150)], "query long, path int")
    known = spark.createDataFrame([(p,) for p in range(200)], "path int")
    ranked = importing.rank_imports(spark.createDataFrame([(1, "n")], "query long, name string"), context, prior, pmi, known)
    assert [r.path for r in ranked.orderBy("rank").collect()][:2] == [1, 0] and ranked.count() == 16
    assert "[query" not in "".join(x for x in plan(ranked).split("\n") if "Join" in x and "path" in x)  # the old plan joined on (query, path)


def test_signatures_of_arrays(spark):
    from tessera.operators import dedup

    draw = random.Random(5)
    words = [[f"w{draw.randrange(900)}é" for _ in range(n)] for n in (0, 3, 5, 6, 40, 9000)] + [None, ["a"] * 9]
    df = spark.createDataFrame(list(enumerate(words)), "key long, words array<string>")
    want = {r.key: r.sig for r in dedup.signatures(df, "key").collect()}
    got = dedup.array_signatures(df, "key", [])
    assert {r.key: r.sig for r in got.collect()} == {i: want.get(i) for i in range(len(words))} and want[5]
    assert "Exchange" not in plan(got)  # each distinct word of a file was a row with 128 minima


def test_set_pairs_are_judged_where_they_meet(spark):
    from tessera.operators import dedup

    draw = random.Random(6)
    base = [f"w{i}" for i in range(3000)]
    sets = [(i, "b", draw.sample(base[: 700 if i % 2 else 3000], 200 + i)) for i in range(12)]
    sets += [(100 + i, "b", [*s[2][: -(i + 1) * 5], f"x{i}"]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(sets, "key long, block string, words array<string>")
    pairs = dedup.jaccard_pairs(df, "key", "block", 0.8)
    want = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and len(set(a[2]) & set(b[2])) >= 0.8 * len(set(a[2]) | set(b[2]))}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 5
    assert any("bit_count" in x and "Join" in x for x in plan(pairs).split("\n"))


def test_merges_of_words_side_by_side(spark):
    import numpy as np

    from tessera.functions import bytepairs as pieces
    from tessera.operators import bytepairs

    draw = random.Random(7)
    words = [bytes(draw.choice(b"aab") for _ in range(n)) for n in (0, 1, 2, 3, 9, 40, 128, 4)]
    merges = [(97, 97), (256, 97), (97, 98), (256, 256)]
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat, of = bytepairs.merged(flat, of, merges, 256)
    assert [flat[of == i].tolist() for i in range(len(words))] == [pieces.encode_piece(w, pieces.ranks_of(merges)) for w in words]
    files = spark.createDataFrame([(0, "aab aab"), (1, None), (2, ""), (3, "aab")], "file_id long, text string")
    assert "Exchange" not in plan(bytepairs.encode(files, merges))  # pieces were exchanged, and again by file
    table = bytepairs.word_table(files)
    by_batch, by_row = bytepairs.pair_totals(bytepairs.bytes_of(table)), bytepairs.pair_counts(bytepairs.bytes_of(table))
    assert sorted(by_batch.collect()) == sorted(by_row.collect()) and by_batch.count() > 2
