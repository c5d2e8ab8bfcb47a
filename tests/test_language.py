import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import bytepairs as bp
from tessera.functions import completion
from tessera.functions.languages import CSHARP, GO
from tessera.operators import bytepairs, cache, lexing, ngram, packing, predicting, vocabulary
from tessera.sources import models


def lexed(spark, text, language):
    df = spark.createDataFrame([(1, text)], "file_id long, text string")
    return lexing.token_table(df, language).orderBy("pos").collect()


def words(spark, text, language):
    return [r.text for r in lexed(spark, text, language)]


def test_csharp_tokens(spark):
    assert words(spark, 'var x = await foo.Bar("a\\"b", 1.5e-3); // comment', CSHARP) == ["var", "x", "=", "await", "foo", ".", "Bar", "(", "<STR>", ",", "<NUM>", ")", ";"]
    text = 'a = @"v""w"; b = $"i{x}"; c = """raw "x" """; d = $@"y"; e = \'c\'; x\n  #if DEBUG "\ny'
    got = words(spark, text, CSHARP)
    assert got.count("<STR>") == 4 and got.count("<CHAR>") == 1 and got[-2:] == ["x", "y"]
    assert [(r.kind, r.text) for r in lexed(spark, "@class class", CSHARP)] == [("IDENT", "class"), ("KEYWORD", "class")]


def test_go_tokens(spark):
    assert words(spark, "x := a.B()\nreturn x\n", GO) == ["x", ":=", "a", ".", "B", "(", ")", ";", "return", "x", ";"]
    assert words(spark, "a &&\nb {\nc", GO) == ["a", "&&", "b", "{", "c", ";"]
    assert words(spark, "s := `raw\nstring`", GO) == ["s", ":=", "<STR>", ";"]
    assert [r.off for r in lexed(spark, "  foo.Bar", GO)][:3] == [2, 5, 6]
    assert words(spark, "/* open", GO) == []


def test_line_flags_against_offsets(spark):
    text = "a := 1 // x\n/* y\n */ b(\n\n c)\nd `r\ns` e\n"
    rows = lexed(spark, text, GO)
    for i, r in enumerate(rows):
        assert r.line_start == (i > 0 and "\n" in text[rows[i - 1].off : r.off])
        assert r.at_line_end == (r.off >= len(text) or text[r.off] == "\n")
    rest = {r.pos: r.rest for r in lexing.rest_of_line(lexing.token_table(spark.createDataFrame([(1, text)], "file_id long, text string"), GO)).collect()}
    for i in range(len(rows)):
        n, j = 0, i
        while j < len(rows) and (j == i or not rows[j].line_start):
            n += not rows[j].at_line_end
            j += 1
        assert rest[i] == n


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "func f() {\n\treturn héllo\n}\n" * (i + 1)) for i in range(4)], "file_id long, text string")
    toks = lexing.token_table(df, GO)
    vocab = vocabulary.build(vocabulary.frequencies(toks), 1, 100)
    coded = vocabulary.encode(toks, vocab)
    packed = vocabulary.packed_values(coded).withColumn("repo", F.lit("r")).withColumn("fold", F.when(F.col("file_id") < 2, "lm").otherwise("test"))
    models.write_shards(packed, str(tmp_path / "shards"))
    back = models.read_shards(spark, str(tmp_path / "shards"), "lm")
    want = {(r.file_id, r.pos): (r.id, r.line_start, r.at_line_end) for r in coded.where("file_id < 2").collect()}
    assert {(r.file_id, r.pos): (r.id, r.line_start, r.at_line_end) for r in back.collect()} == want


class Reference:
    """A recursive model straight from the definition."""

    def __init__(self, seqs, order, vocab, min_counts, min_repos):
        raw = [Counter() for _ in range(order + 1)]
        repos = defaultdict(set)
        for repo, seq in seqs:
            padded = ["<BOS>"] * (order - 1) + seq + ["<EOS>"]
            for end in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    g = tuple(padded[end - n + 1 : end + 1])
                    raw[n][g] += 1
                    repos[g].add(repo)
        self.order, self.v = order, len(vocab)
        self.adj = [None] + [raw[n] if n == order else Counter(g[1:] for g in raw[n + 1]) for n in range(1, order + 1)]
        self.keep = lambda g: self.adj[len(g)][g] >= min_counts.get(len(g), 1) and len(repos[g]) >= min_repos.get(len(g), 1)
        self.pruned = {n: min_counts.get(n, 1) > 1 or min_repos.get(n, 1) > 1 for n in range(1, order + 1)}
        self.d = [None]
        for n in range(1, order + 1):
            c = Counter(self.adj[n].values())
            n1, n2, n3, n4 = (max(c[k], 1) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            clip = lambda x, top: min(max(x, 0.1), top)
            self.d.append((clip(1 - 2 * y * n2 / n1, 0.999), clip(2 - 3 * y * n3 / n2, 1.999), clip(3 - 4 * y * n4 / n3, 2.999)))
        self.after = [None] + [defaultdict(list) for _ in range(order)]
        for n in range(1, order + 1):
            for g in self.adj[n]:
                self.after[n][g[:-1]].append(g[-1])

    def full(self, g):
        n, ctx = len(g), g[:-1]
        cont = [self.adj[n][(*ctx, w)] for w in self.after[n][ctx]]
        total = sum(cont)
        d = lambda c: self.d[n][min(c, 3) - 1]
        gamma = sum(d(c) for c in cont) / total
        low = 1 / self.v if n == 1 else self.p(g[1:])
        c = self.adj[n][g]
        return max(c - d(c), 0) / total + gamma * low if c else gamma * low

    def p(self, g):
        n, ctx = len(g), g[:-1]
        if n == 1:
            return self.full(g) if not self.adj[1][g] or self.keep(g) else self.full((*ctx, None))
        if ctx not in self.after[n]:
            return self.p(g[1:])
        if self.adj[n][g] and self.keep(g):
            return self.full(g)
        kept = [w for w in self.after[n][ctx] if self.keep((*ctx, w))]
        if not self.pruned[n]:
            return self.full(g)
        if not kept:
            return self.p(g[1:])
        gamma = (1 - sum(self.full((*ctx, w)) for w in kept)) / max(1 - sum(self.p((*ctx[1:], w)) for w in kept), 1e-6)
        return min(max(gamma, 1e-6), 10) * self.p(g[1:])


@pytest.mark.parametrize(("order", "min_counts", "min_repos"), [(2, {}, {}), (3, {}, {}), (3, {2: 2, 3: 3}, {3: 2})])
def test_kneser_ney(spark, order, min_counts, min_repos):
    rng = random.Random(42 + order)
    seqs = [(f"r{i // 5}", [f"w{min(int(abs(rng.gauss(0, 5))), 14)}" for _ in range(rng.randint(3, 30))]) for i in range(30)]
    vocab = sorted({w for _, s in seqs for w in s} | {"<ID>", "<BOS>", "<EOS>", "never"})
    rows = [(i, r, p, w) for i, (r, s) in enumerate(seqs) for p, w in enumerate(s)]
    seq = spark.createDataFrame(rows, "file_id long, repo string, pos long, w string").repartition(4)
    model = ngram.estimate(ngram.counts(seq, order), order, spark.createDataFrame([(w,) for w in vocab], "word string"), min_counts, min_repos).saved()
    ref = Reference(seqs, order, vocab, min_counts, min_repos)
    contexts = [tuple(rng.choice(vocab) for _ in range(order - 1)) for _ in range(8)] + [tuple(s[k : k + order - 1]) for _, s in seqs[:6] for k in (0, 1)]
    contexts = [c for c in contexts if len(c) == order - 1]
    grams = [" ".join((*c, w)) for c in set(contexts) for w in vocab]
    got = {r.gram: math.exp(r.logp) for r in ngram.score(spark.createDataFrame([(g,) for g in set(grams)], "gram string"), model).collect()}
    for g in grams:
        assert got[g] == pytest.approx(ref.p(tuple(g.split())), rel=1e-9), g
    for c in set(contexts):
        assert sum(got[" ".join((*c, w))] for w in vocab) == pytest.approx(1, abs=1e-6)


def test_stored_model(spark, tmp_path):
    seq = spark.createDataFrame([(1, "r", i, w) for i, w in enumerate("a b a c a b".split())], "file_id long, repo string, pos long, w string")
    vocab = spark.createDataFrame([(w,) for w in "a b c <ID> <BOS> <EOS>".split()], "word string")
    model = ngram.estimate(ngram.counts(seq, 2), 2, vocab)
    models.write_ngram(spark, str(tmp_path / "m"), model, "go")
    back = models.read_ngram(spark, str(tmp_path / "m"))
    assert back.order == 2 and sorted(back.prob.collect()) == sorted(model.prob.collect())
    with pytest.raises(ValueError, match="ngram"):
        models.read(spark, str(tmp_path / "m"), "imports")
    best = predicting.top_words(spark.createDataFrame([("a",), ("z",)], "ctx string"), back, 2, vocab.where("word not like '<%'")).collect()
    probs = {(c, w): ngram.score(spark.createDataFrame([(f"{c} {w}",)], "gram string"), back).first().logp for c in "az" for w in "abc"}
    for c in "az":
        assert [r.w for r in sorted(best, key=lambda r: r.rank) if r.ctx == c] == sorted("abc", key=lambda w: (-round(probs[c, w], 9), w))[:2]


def test_cache(spark):
    rng = random.Random(9)
    seq = [(f, i, rng.choice("abc")) for f in range(3) for i in range(40)]
    df = spark.createDataFrame(seq, "file_id long, pos long, w string")
    got = {(r.file_id, r.pos): r.p_cache for r in cache.cache_probability(ngram.with_context(df, 3), spark.range(1).select(F.lit(7).alias("v"))).collect()}
    from tessera.streaming.state import Cache

    for f in range(3):
        c = Cache(3, 7, 0.5, [], 0, {})
        for _, i, w in [s for s in seq if s[0] == f]:
            assert got[f, i] == pytest.approx(c.prob(w))
            assert sum(c.prob(x) for x in "abcdefg") == pytest.approx(1)
            c.add(w)


def test_beam(spark):
    seq = spark.createDataFrame([(1, "r", i, w) for i, w in enumerate("a b a c a b b c a a c b".split())], "file_id long, repo string, pos long, w string")
    vocab = spark.createDataFrame([(w,) for w in "a b c <ID> <BOS> <EOS>".split()], "word string")
    model = ngram.estimate(ngram.counts(seq, 2), 2, vocab).saved()
    starts = spark.createDataFrame([(1, 0, "a")], "file_id long, pos long, ctx string")
    got = predicting.beam(starts, model, vocab.where("word not like '<%'"), 3, 27).collect()
    p = {r.gram: r.logp for r in ngram.score(spark.createDataFrame([(f"{x} {y}",) for x in "abc" for y in "abc"], "gram string"), model).collect()}
    want = {(x, y, z): p[f"a {x}"] + p[f"{x} {y}"] + p[f"{y} {z}"] for x in "abc" for y in "abc" for z in "abc"}
    assert {tuple(r.gen): pytest.approx(r.logp) for r in got} == want
    best = predicting.beam(starts, model, vocab.where("word not like '<%'"), 2, 2).where("rank = 1").first()
    assert len(best.gen) == 2


def test_completion_helpers(spark):
    rows = [("foo)", ")", "foo"), ("foo);", ");x", "foo"), ("foo", "bar", "foo"), ("a})", "}) ", "a"), ("x)", "y)", "x)"), ("", ")", "")]
    df = spark.createDataFrame(rows, "t string, after string, want string")
    assert all(r[0] == r[1] for r in df.select(completion.trim_closers(F.col("t"), F.col("after")), "want").collect())
    flags = [(");", True), ("a;", False), ('"', False), ("é", False), ("", True)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(flags, "t string, y boolean").select(completion.punctuation_only(F.col("t")), "y").collect())
    lines = [("x := 1 // note", "x := 1"), ("// only", ""), ('s := "// no"  ', 's := "// no"')]
    assert all(r[0] == r[1] for r in spark.createDataFrame(lines, "t string, y string").select(lexing.code_part(F.col("t"), GO), "y").collect())
    heal = [("\tfoo  ", 0, 6, 4), ("\t\t", 0, 2, 2), ("a b", 0, 2, 1)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(heal, "t string, bol int, b int, y int").select(completion.healed_boundary(F.col("t"), F.col("bol"), F.col("b")), "y").collect())
    tails = [(100, [0, 40, 70], 100, 0), (300, [0, 128, 190, 210], 100, 210), (300, [0, 5], 100, 200)]
    got = spark.createDataFrame(tails, "n int, s array<int>, target int, y int").select(completion.stable_tail(F.col("n"), F.col("s"), 100, 200, 64), "y").collect()
    assert [r[0] for r in got] == [0, 210, 200]
    kinds = spark.createDataFrame([("a // c",)], "t string").select(lexing.evaluation_tokens(F.col("t"), GO)).first()[0]
    assert [k.kind for k in kinds] == ["IDENT", "COMMENT"]


CASES = ["", "a", "if err != nil {\n\t\treturn err\n\t}\n", "a  b\t c \n\n  x", "日本語 naïve_é 12345", "x" * 300, "\r\n\r\n \t", "== != //", "é" * 100, "😀👨‍👩‍👧 end ", "tab\t", " lead", "a\rb"]


def hand_scan(data: bytes):
    """Pre-tokens by walking over bytes."""
    kind = lambda c: "N" if c in b"\r\n" else "W" if c in b" \t" else "D" if 48 <= c <= 57 else "L" if c >= 128 or c == 95 or chr(c).isalpha() else "P"
    out, i, n = [], 0, len(data)
    while i < n:
        j = i
        if kind(data[i]) == "N":
            while j < n and kind(data[j]) == "N":
                j += 1
            while j < n and kind(data[j]) == "W":
                j += 1
        else:
            if kind(data[i]) == "W":
                while j < n and kind(data[j]) == "W":
                    j += 1
                if not (j < n and data[j - 1] == 32 and kind(data[j]) != "N"):
                    out.append(data[i:j])
                    i = j
                    continue
                if j - 1 > i:
                    out.append(data[i : j - 1])
                    i = j - 1
            k = kind(data[j])
            e = j + 1
            while k != "D" and e < n and kind(data[e]) == k:
                e += 1
            j = e
        out.append(data[i:j])
        i = j
    return [p[k : k + 128] for p in out for k in range(0, len(p), 128)]


def test_pretokens(spark):
    rng = random.Random(6)
    texts = CASES + ["".join(rng.choice("ab1 \t\n_(é") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", bp.pretokens(F.col("text")).alias("p"))
    for r in df.collect():
        assert [bytes(x) for x in r.p] == hand_scan(texts[r.i].encode()), texts[r.i]


def test_byte_pairs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES * 3)], "file_id long, text string")
    table = bytepairs.word_table(df)
    merges = bytepairs.learn(table, 30)
    # the same merges by brute force
    words = {bytes(r.piece): r.c for r in table.collect()}
    ids = {w: list(w) for w in words}
    for step, merge in enumerate(merges):
        count = Counter()
        for w, c in words.items():
            for p in zip(ids[w], ids[w][1:]):
                count[p] += c
        assert merge == min(count, key=lambda p: (-count[p], p))
        for w in words:
            out, i = [], 0
            while i < len(ids[w]):
                hit = tuple(ids[w][i : i + 2]) == merge
                out.append(256 + step if hit else ids[w][i])
                i += 1 + hit
            ids[w] = out
    back = bytepairs.encode(df, merges).withColumn("t", bp.decoder(merges)("ids")).collect()
    assert all(bytes(r.t) == (CASES * 3)[r.file_id].encode() for r in back)
    assert bp.load(bp.dump(merges)) == (merges, bp.SPECIALS)
    assert spark.createDataFrame([("foo bar", 5)], "t string, c int").select(bp.last_boundary(F.col("t"), F.col("c")), bp.heal_split(F.col("t"))).first() == (3, " bar")


def test_groups_and_windows(spark):
    rng = random.Random(8)
    sizes = [(i, f"r{i % 3}", rng.randint(1, 90)) for i in range(300)]
    files = spark.createDataFrame(sizes, "file_id long, repo string, n_tokens long")
    kept = packing.epoch_files(files, 1, 1 << 40, 80)
    groups = defaultdict(int)
    size = {i: n for i, _, n in sizes}
    for r in packing.group_files(kept, 200, runs_of=4).collect():
        groups[r.repo, r.run, r.grp] += size[r.file_id] + 3
    assert max(groups.values()) <= 200 and sum(groups.values()) == sum(n + 3 for _, _, n in sizes if n <= 80)
    docs = [(i % 2, i, i, rng.randint(20, 900), 0) for i in range(60)]
    docs = [(s, t, d, n, n // 2 if d % 3 == 0 else 0) for s, t, d, n, _ in docs]
    rows = packing.pack_windows(spark.createDataFrame(docs, "shard int, turn long, doc long, n_tokens int, fixed int"), 1024).collect()
    fill = defaultdict(int)
    covered = defaultdict(list)
    for r in rows:
        fill[r.shard, r.window] += r.n
        covered[r.doc].append((r.start, r.n, r.window))
    last = {s: max(w for sh, w in fill if sh == s) for s in (0, 1)}
    assert all(n == 1025 for (s, w), n in fill.items() if w < last[s] - 1) and all(n <= 1025 for n in fill.values())
    for _, _, d, n, fixed in docs:
        if fixed:
            assert len(covered[d]) == 1  # never over two windows
        else:
            assert sum(x[1] for x in covered[d]) == n
    totals = spark.createDataFrame([("a", 10), ("b", 50), ("c", 200)], "repo string, total long")
    for budget in (1, 30, 31, 100, 101, 260, 999):
        want = next((c for c in range(1, 201) if sum(min(t, c) for t in (10, 50, 200)) >= budget), 200)
        assert packing.waterfill_cap(totals, budget).first().cap == want


def test_pairs_merged_together():
    assert bytepairs.together([(1, 2), (3, 4), (5, 1), (6, 7)]) == [(1, 2), (3, 4)]
    assert bytepairs.together([(1, 2), (3, 3), (4, 5)]) == [(1, 2), (3, 3)]
    assert bytepairs.together([]) == []


def test_streams_grow_with_tokens(spark):
    docs = spark.createDataFrame([(i % 7, i, 100, 0) for i in range(200)], "turn long, doc long, n_tokens int, fixed int")
    dealt = packing.dealt_streams(docs, 2_000)
    assert {r.shard for r in dealt.select("shard").distinct().collect()} == set(range(10))
    pieces = packing.pack_windows(dealt, 64).groupBy("doc").agg(F.sum("n").alias("n")).collect()
    assert len(pieces) == 200 and all(r.n == 100 for r in pieces)
    assert packing.dealt_streams(docs.limit(0)).count() == 0
