"""Queries on n-gram models: counting, smoothing, scoring, cache mixtures and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import cache, coded, evaluation, ngram, predicting, vocabulary
from tessera.plans.common import FILES, FOLDS
from tessera.plans.lexical import VOCABULARY, token_arrays, tokens_sql, vocab_of
from tessera.plans.preparing import folds_of
from tessera.plans.registration import query
from tessera.sources.storage import cut
from tessera.sources.tables import event_words, files

_TAIL = "substr(gram, strpos(gram, ' ') + 1)"


def _ctx(n: int) -> str:
    return "''" if n == 1 else f"substr(gram, 1, length(gram) - length(split_part(gram, ' ', {n})) - 1)"


def counts_sql(order: int, seq: str = "seq") -> str:
    """CTEs r1..rN (gram, c, repos) of raw counts over ``seq`` (file_id, repo, pos, w)."""
    lags = ", ".join(f"coalesce(lag(w, {k}) OVER f, '<BOS>') AS p{k}" for k in range(1, order))
    parts = [f"""ended AS (SELECT file_id, repo, pos, w FROM {seq} UNION ALL SELECT file_id, repo, max(pos) + 1, '<EOS>' FROM {seq} GROUP BY file_id, repo),
    lagged AS (SELECT file_id, repo, pos, w{', ' + lags if lags else ''} FROM ended WINDOW f AS (PARTITION BY file_id ORDER BY pos))"""]
    for n in range(1, order + 1):
        gram = " || ' ' || ".join([*(f"p{k}" for k in range(n - 1, 0, -1)), "w"])
        parts.append(f"r{n} AS (SELECT {gram} AS gram, count(*) AS c, count(DISTINCT repo) AS repos FROM lagged GROUP BY 1)")
    return ",\n    ".join(parts)


def adjusted_sql(order: int, smoothing: str = "mkn") -> str:
    out = []
    for n in range(1, order + 1):
        if n == order or smoothing == "jm":
            out.append(f"a{n} AS (SELECT gram, {_ctx(n)} AS ctx, c, repos FROM r{n})")
        else:
            out.append(f"a{n} AS (SELECT gram, {_ctx(n)} AS ctx, s.c, repos FROM (SELECT {_TAIL} AS gram, count(*) AS c FROM r{n + 1} GROUP BY 1) s JOIN r{n} USING (gram))")
    return ",\n    ".join(out)


def discounts_sql(n: int) -> str:
    k = [f"greatest(count(*) FILTER (c = {i}), 1)::DOUBLE" for i in range(1, 5)]
    y = f"({k[0]} / ({k[0]} + 2 * {k[1]}))"
    return f"""d{n} AS (SELECT greatest(0.1, least(0.999, 1 - 2 * {y} * {k[1]} / {k[0]}))::DOUBLE AS d1, greatest(0.1, least(1.999, 2 - 3 * {y} * {k[2]} / {k[1]}))::DOUBLE AS d2,
    greatest(0.1, least(2.999, 3 - 4 * {y} * {k[3]} / {k[2]}))::DOUBLE AS d3 FROM a{n})"""


def model_sql(order: int, vocab: str, min_counts: dict[int, int] | None = None, min_repos: dict[int, int] | None = None, jm: float | None = None) -> str:
    """CTEs m1..mN (gram, p), e1..eN (gram, p_eff) and b1..b{N-1} (ctx, gamma) of a model over r1..rN."""
    min_counts, min_repos = min_counts or {}, min_repos or {}
    parts = [adjusted_sql(order, "jm" if jm is not None else "mkn")]
    for n in range(1, order + 1):
        mc, mr = min_counts.get(n, 1), min_repos.get(n, 1)
        if jm is None:
            parts.append(discounts_sql(n))
            parts.append(f"s{n} AS (SELECT ctx, sum(c)::DOUBLE AS total, (any_value(d1) * count(*) FILTER (c = 1) + any_value(d2) * count(*) FILTER (c = 2) + any_value(d3) * count(*) FILTER (c > 2)) / sum(c)::DOUBLE AS gamma, any_value(d1) AS d1, any_value(d2) AS d2, any_value(d3) AS d3 FROM a{n}, d{n} GROUP BY ctx)")
            p = "greatest(c - CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END, 0) / total + gamma * low"
        else:
            parts.append(f"s{n} AS (SELECT ctx, sum(c)::DOUBLE AS total, {jm}::DOUBLE AS gamma FROM a{n} GROUP BY ctx)")
            p = f"(1 - {jm}::DOUBLE) * c / total + {jm}::DOUBLE * low"
        if n == 1:
            low = f"(SELECT 1.0::DOUBLE / count(*) FROM {vocab})"
            parts.append(f"x1 AS (SELECT gram, ctx, c, low, gamma, {p} AS p, c >= {mc} AND repos >= {mr} AS keep FROM (SELECT a.*, s.* EXCLUDE (ctx), {low} AS low FROM a1 a JOIN s1 s USING (ctx)))")
            parts.append("e1 AS (SELECT gram, CASE WHEN keep THEN p ELSE gamma * low END AS p_eff FROM x1)")
            parts.append(f"m1 AS (SELECT word AS gram, coalesce(p_eff, (SELECT gamma FROM s1) / (SELECT count(*) FROM {vocab})) AS p FROM {vocab} LEFT JOIN e1 ON e1.gram = word)")
            continue
        parts.append(f"x{n} AS (SELECT gram, ctx, c, low, gamma, {p} AS p, c >= {mc} AND repos >= {mr} AS keep FROM (SELECT a.*, s.* EXCLUDE (ctx), e.p_eff AS low FROM a{n} a JOIN s{n} s USING (ctx) JOIN e{n - 1} e ON e.gram = {_TAIL.replace('gram', 'a.gram')}))")
        if mc > 1 or mr > 1:
            parts.append(f"k{n} AS (SELECT ctx, bool_or(keep) AS has_kept, CASE WHEN bool_or(keep) THEN greatest(1e-6, least(10.0, (1 - coalesce(sum(p) FILTER (keep), 0)) / greatest(1 - coalesce(sum(low) FILTER (keep), 0), 1e-6))) ELSE 1.0 END::DOUBLE AS gamma FROM x{n} GROUP BY ctx)")
            parts.append(f"e{n} AS (SELECT gram, CASE WHEN keep THEN p ELSE k.gamma * low END AS p_eff FROM x{n} JOIN k{n} k USING (ctx))")
            parts.append(f"b{n - 1} AS (SELECT ctx, gamma FROM k{n} WHERE has_kept)")
        else:
            parts.append(f"e{n} AS (SELECT gram, p AS p_eff FROM x{n})")
            parts.append(f"b{n - 1} AS (SELECT ctx, gamma FROM s{n})")
        parts.append(f"m{n} AS (SELECT gram, p FROM x{n} WHERE keep)")
    return ",\n    ".join(parts)


def score_sql(order: int, grams: str, out: str = "scored") -> str:
    """CTE ``out`` (gram, logp) over distinct grams of ``order`` words."""
    words = [f"split_part(g.gram, ' ', {i})" for i in range(1, order + 1)]
    joins, value = [], f"coalesce(ln(q1.p), {ngram.UNSEEN})"
    for k in range(1, order + 1):
        tail = " || ' ' || ".join(words[order - k:])
        joins.append(f"LEFT JOIN m{k} q{k} ON q{k}.gram = {tail}")
        if k > 1:
            ctx = " || ' ' || ".join(words[order - k:order - 1])
            joins.append(f"LEFT JOIN b{k - 1} h{k} ON h{k}.ctx = {ctx}")
            value = f"CASE WHEN q{k}.p IS NOT NULL THEN ln(q{k}.p) ELSE coalesce(ln(h{k}.gamma), 0) + {value} END"
    return f"{out} AS (SELECT g.gram, {value} AS logp FROM (SELECT DISTINCT gram FROM {grams}) g {' '.join(joins)})"


def positions_sql(order: int, seq: str, out: str = "placed") -> str:
    lags = ", ".join(f"coalesce(lag(w, {k}) OVER f, '<BOS>') AS p{k}" for k in range(1, order))
    gram = " || ' ' || ".join([*(f"p{k}" for k in range(order - 1, 0, -1)), "w"])
    return f"{out} AS (SELECT *, {gram} AS gram FROM (SELECT *, {lags} FROM {seq} WINDOW f AS (PARTITION BY file_id ORDER BY pos)))"


def cache_sql(source: str, v: str, out: str = "cached") -> str:
    """CTE ``out``: ``source`` (with p1, p2) and p_cache of an order-3 cache."""
    ctx = ["file_id", "file_id, p1", "file_id, p1, p2"]
    first = ", ".join(f"row_number() OVER (PARTITION BY {c}, w ORDER BY pos) - 1 AS c{k}, row_number() OVER (PARTITION BY {c} ORDER BY pos) - 1 AS t{k}" for k, c in enumerate(ctx))
    second = ", ".join(f"count(*) FILTER (c{k} = 0) OVER (PARTITION BY {c} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y{k}" for k, c in enumerate(ctx))
    step = lambda k, p: f"(greatest(c{k} - 0.5, 0)::DOUBLE / greatest(t{k}, 1) + 0.5::DOUBLE * y{k} / greatest(t{k}, 1) * {p})"
    p0 = f"(1.0::DOUBLE / {v})"
    p1, p2, p3 = step(0, p0), step(1, step(0, p0)), step(2, step(1, step(0, p0)))
    return f"""{out}_a AS (SELECT *, {first} FROM {source}), {out}_b AS (SELECT *, {second} FROM {out}_a),
    {out} AS (SELECT *, CASE WHEN t0 = 0 THEN {p0} WHEN t1 = 0 OR pos < 1 THEN {p1} WHEN t2 = 0 OR pos < 2 THEN {p2} ELSE {p3} END AS p_cache FROM {out}_b)"""


# events as a corpus over five words

EVENT_SEQ = """all_events AS (SELECT user_id AS file_id, 'r' || (user_id % 10) AS repo, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS w FROM events),
    seq AS (SELECT * FROM all_events WHERE file_id % 5 <> 0), test AS (SELECT * FROM all_events WHERE file_id % 5 = 0),
    vocab AS (SELECT DISTINCT w AS word FROM seq UNION ALL SELECT '<ID>' UNION ALL SELECT '<BOS>' UNION ALL SELECT '<EOS>')"""


def event_seq(spark: SparkSession, sf_dir: str, test: bool = False) -> DataFrame:
    rows = event_words(spark, sf_dir).where(F.col("file_id") % 5 == 0 if test else F.col("file_id") % 5 != 0)
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("file_id").orderBy("seq")) - 1).cast("long")).select("file_id", "repo", "pos", "w")


def words_of(seq: DataFrame) -> DataFrame:
    special = seq.sparkSession.createDataFrame([(w,) for w in vocabulary.SPECIAL], "word string")
    return seq.select(F.col("w").alias("word")).distinct().unionByName(special)


def event_model(spark: SparkSession, sf_dir: str, **kw) -> ngram.Model:
    seq = event_seq(spark, sf_dir)
    return ngram.estimate(ngram.counts(seq, 3), 3, words_of(seq), **kw).saved()


# documents: words of the lm fold, rare names folded

DOC_SEQ = f"""{FILES}, {FOLDS}, folded AS (SELECT f.*, fold FROM files f JOIN folds USING (repo)), {tokens_sql('folded', 'repo, lang, fold', 'every')},
    tokens AS (SELECT * FROM every WHERE fold = 'lm'), {VOCABULARY},
    doc_words AS (SELECT e.file_id, e.repo, e.lang, e.fold, e.pos, e.kind = 'IDENT' AS is_ident, CASE WHEN v.word IS NULL THEN '<ID>' ELSE e.text END AS w FROM every e LEFT JOIN vocab v ON v.word = e.text),
    seq AS (SELECT file_id, repo, pos, w FROM doc_words WHERE fold = 'lm'), test AS (SELECT * FROM doc_words WHERE fold = 'test')"""


def doc_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file_id, repo, lang, fold, toks) of all documents, the vocabulary (id, word) of the lm fold, and ``doc_words``.

    A file's words are one array, so no table holds a row a token. Repositories
    go by their place in the order of folds, of which there is a row each.
    """
    folds = F.broadcast(folds_of(spark, sf_dir).select("repo", "fold", F.col("place").alias("repo_id")))
    known = files(spark, sf_dir).select("file_id", "repo", "lang", "text").join(folds, "repo").drop("repo")
    toks = cut(token_arrays(known.select("file_id", F.col("repo_id").cast("int").alias("repo"), "lang", "fold", "text")), "doc-tokens")
    vocab = cut(vocab_of(toks.where("fold = 'lm'")), "doc-vocabulary").select("id", "word")
    return toks, vocab, cut(coded.encode(toks, vocab, ["repo", "lang", "fold"]), "doc-words")


def doc_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(file_id, repo, lang, fold, n, codes) of all documents, and the vocabulary of the lm fold."""
    _, vocab, words = doc_tokens(spark, sf_dir)
    return words, vocab


def doc_counts(words: DataFrame, order: int) -> dict[int, DataFrame]:
    """Counts of the lm fold's grams of ids."""
    return ngram.counts_of(coded.grams(coded.dealt(words.where("fold = 'lm'")), order), order, ngram.IDS)


def doc_model(words: DataFrame, vocab: DataFrame, order: int) -> ngram.Model:
    return ngram.estimate(doc_counts(words, order), order, vocab.select(F.col("id").cast("long").alias("word")), keys=ngram.IDS)


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)} SELECT 1 AS n, gram, c FROM r1 UNION ALL SELECT 2, gram, c FROM r2 UNION ALL SELECT 3, gram, c FROM r3")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [t.select(F.lit(n).alias("n"), "gram", "c") for n, t in ngram.counts(event_seq(spark, sf_dir), 3).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {DOC_SEQ}, {counts_sql(3)}, every_n AS (SELECT 1 AS n, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3)
    SELECT n, count(*) AS grams, sum(c)::BIGINT AS total, sum(c * c)::BIGINT AS squares, sum(repos)::BIGINT AS repos, count(*) FILTER (c >= 2 AND repos >= 2) AS kept FROM every_n GROUP BY n""")
def ngram_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams of documents with their repositories, summed up per order."""
    counted = doc_counts(doc_words(spark, sf_dir)[0], 3)
    parts = [t.agg(F.lit(n).alias("n"), F.count("*").alias("grams"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("repos").alias("repos"), F.count_if((F.col("c") >= 2) & (F.col("repos") >= 2)).alias("kept")) for n, t in counted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)}, {adjusted_sql(3)} SELECT 1 AS n, gram, c FROM a1 UNION ALL SELECT 2, gram, c FROM a2")
def continuation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = ngram.adjusted(ngram.counts(event_seq(spark, sf_dir), 3), 3)
    return adj[1].select(F.lit(1).alias("n"), "gram", "c").unionByName(adj[2].select(F.lit(2).alias("n"), "gram", "c"))


_NK = ", ".join(f"count(*) FILTER (c = {k}) AS n{k}" for k in range(1, 5))


@query(f"WITH {DOC_SEQ}, {counts_sql(3)}, {adjusted_sql(3)} " + " UNION ALL ".join(f"SELECT {n} AS n, {_NK} FROM a{n}" for n in (1, 2, 3)))
def counts_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = ngram.adjusted(doc_counts(doc_words(spark, sf_dir)[0], 3), 3, ngram.IDS)
    parts = [ngram.counts_of_counts(adj[n]).select(F.lit(n).alias("n"), "n1", "n2", "n3", "n4") for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {DOC_SEQ}, {counts_sql(3)}, {adjusted_sql(3)}, {discounts_sql(1)}, {discounts_sql(2)}, {discounts_sql(3)} " + " UNION ALL ".join(f"SELECT {n} AS n, round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM d{n}" for n in (1, 2, 3)))
def mkn_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = ngram.adjusted(doc_counts(doc_words(spark, sf_dir)[0], 3), 3, ngram.IDS)
    parts = [ngram.discounts(adj[n]).select(F.lit(n).alias("n"), *[F.round(f"d{k}", 9).alias(f"d{k}") for k in (1, 2, 3)]) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_STATS = "ctx, sum(c)::BIGINT AS total, count(*) FILTER (c = 1) AS k1, count(*) FILTER (c = 2) AS k2, count(*) FILTER (c > 2) AS k3"


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)}, {adjusted_sql(3)} " + " UNION ALL ".join(f"SELECT {n} AS n, {_STATS} FROM a{n} GROUP BY ctx" for n in (1, 2, 3)))
def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = ngram.adjusted(ngram.counts(event_seq(spark, sf_dir), 3), 3)
    parts = [ngram.context_stats(adj[n], n).select(F.lit(n).alias("n"), "*") for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _prob_sql(order: int) -> str:
    return " UNION ALL ".join(f"SELECT {n} AS n, gram, round(p, 9) AS p FROM m{n}" for n in range(1, order + 1))


def _rounded(model: ngram.Model) -> DataFrame:
    return model.prob.select("n", "gram", F.round("p", 9).alias("p"))


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab')} {_prob_sql(3)}")
def mkn_probs_o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(event_model(spark, sf_dir))


_DOC_MODEL_SUMMARY = "count(*) AS grams, round(sum(p), 6) AS mass, round(min(p), 12) AS least, round(max(p), 9) AS most"


@query(f"WITH {DOC_SEQ}, {counts_sql(2)}, {model_sql(2, 'vocab')} SELECT 1 AS n, {_DOC_MODEL_SUMMARY} FROM m1 UNION ALL SELECT 2, {_DOC_MODEL_SUMMARY} FROM m2")
def mkn_probs_o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-2 model of documents, summed up per order."""
    words, vocab = doc_words(spark, sf_dir)
    model = doc_model(words, vocab, 2)
    return model.prob.groupBy("n").agg(F.count("*").alias("grams"), F.round(F.sum("p"), 6).alias("mass"), F.round(F.min("p"), 12).alias("least"), F.round(F.max("p"), 9).alias("most"))


_PRUNE = {"min_counts": {2: 3, 3: 4}, "min_repos": {3: 2}}


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab', **_PRUNE)} SELECT 'p' || n AS kind, gram, p FROM ({_prob_sql(3)}) UNION ALL SELECT 'b1', ctx, round(gamma, 9) FROM b1 UNION ALL SELECT 'b2', ctx, round(gamma, 9) FROM b2")
def mkn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = event_model(spark, sf_dir, **_PRUNE)
    probs = model.prob.select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("kind"), "gram", F.round("p", 9).alias("p"))
    return probs.unionByName(model.backoff.select(F.concat(F.lit("b"), F.col("n").cast("string")).alias("kind"), F.col("ctx").alias("gram"), F.round("gamma", 9).alias("p")))


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab', jm=0.5)} {_prob_sql(3)}")
def jm_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(event_model(spark, sf_dir, jm_weight=0.5))


@query(f"""WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab', **_PRUNE)}, contexts AS (SELECT ctx FROM a3 GROUP BY ctx UNION SELECT 'click never' UNION SELECT 'never never'),
    grams AS (SELECT ctx, ctx || ' ' || word AS gram FROM contexts, vocab), {score_sql(3, 'grams')} SELECT ctx, round(sum(exp(logp)), 6) AS mass FROM grams JOIN scored USING (gram) GROUP BY ctx""")
def lm_sum_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each context, seen or not, gives to all words of the (small, fixed) event vocabulary together."""
    seq = event_seq(spark, sf_dir)
    model = event_model(spark, sf_dir, **_PRUNE)
    counted = ngram.counts(seq, 3)[3].select(ngram.context_of("gram").alias("ctx")).distinct()
    contexts = counted.union(spark.createDataFrame([("click never",), ("never never",)], "ctx string"))
    grams = contexts.crossJoin(F.broadcast(words_of(seq))).select("ctx", F.concat_ws(" ", "ctx", "word").alias("gram"))
    return grams.join(ngram.score(grams.select("gram"), model), "gram").groupBy("ctx").agg(F.round(F.sum(F.exp("logp")), 6).alias("mass"))


@query(f"WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab', **_PRUNE)}, {positions_sql(3, 'test')}, {score_sql(3, 'placed')} SELECT file_id, pos, w, round(logp, 9) AS logp FROM placed JOIN scored USING (gram)")
def lm_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram.score_positions(event_seq(spark, sf_dir, test=True), event_model(spark, sf_dir, **_PRUNE))
    return scored.select("file_id", "pos", "w", F.round("logp", 9).alias("logp"))


def _perplexity_sql(by: str, source: str, logp: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(exp(-avg({logp})), 6) AS perplexity, round(-avg({logp}) / ln(2), 6) AS bits, round(exp(-avg({logp}) FILTER (is_ident AND w <> '<ID>')), 6) AS ident_perplexity,
    round((count(*) FILTER (is_ident AND w = '<ID>'))::DOUBLE / greatest(count(*) FILTER (is_ident), 1), 6) AS oov_rate FROM {source} GROUP BY {by}"""


@query(f"WITH {DOC_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab')}, {positions_sql(3, 'test')}, {score_sql(3, 'placed')}, joined AS (SELECT * FROM placed JOIN scored USING (gram)) {_perplexity_sql('lang', 'joined', 'logp')}")
def lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, vocab = doc_words(spark, sf_dir)
    model = doc_model(words, vocab, 3)
    placed = coded.positions(coded.dealt(words.where("fold = 'test'")), 3)
    alike = cut(placed.groupBy("lang", "gram", "is_ident", "known").agg(F.count("*").alias("n")), "lm-positions")
    return cache.perplexity_of_counts(alike.join(ngram.score(alike, model), "gram"), ["lang"])


@query(f"WITH {DOC_SEQ} SELECT fold, lang, count(*) FILTER (is_ident) AS idents, count(*) FILTER (is_ident AND w = '<ID>') AS unknown FROM doc_words GROUP BY fold, lang")
def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, _ = doc_words(spark, sf_dir)
    idents = F.sum(F.size(F.filter("codes", lambda x: x.bitwiseAND(F.lit(1)) == 1)))
    unknown = F.sum(F.size(F.filter("codes", lambda x: x == coded.UNKNOWN * 2 + 1)))
    return words.groupBy("fold", "lang").agg(idents.alias("idents"), unknown.alias("unknown"))


@query(f"WITH {EVENT_SEQ}, {positions_sql(3, 'test')}, {cache_sql('placed', '(SELECT count(*) FROM vocab)')} SELECT file_id, pos, round(p_cache, 9) AS p_cache FROM cached")
def cache_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ngram.with_context(event_seq(spark, sf_dir, test=True), 3)
    size = words_of(event_seq(spark, sf_dir)).agg(F.count("*").alias("v"))
    return cache.cache_probability(placed, size).select("file_id", "pos", F.round("p_cache", 9).alias("p_cache"))


@query(f"""WITH turns AS (SELECT conv_id AS file_id, 'c' AS repo, turn, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM conversations)),
    test AS (SELECT file_id, repo, row_number() OVER (PARTITION BY file_id ORDER BY turn, k) - 1 AS pos, w FROM turns), {positions_sql(3, 'test')}, {cache_sql('placed', '1000')}
    SELECT file_id, count(*) AS n, round(exp(-avg(ln(p_cache))), 6) AS perplexity FROM cached GROUP BY file_id""")
def cache_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a stream of words: how well what was said predicts what follows."""
    from tessera.sources.tables import table

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("k", "w"))
    seq = turns.withColumn("pos", F.row_number().over(Window.partitionBy("file_id").orderBy("turn", "k")) - 1)
    size = spark.range(1).select(F.lit(1000).alias("v"))
    return cache.cache_probability(ngram.with_context(seq, 3), size).groupBy("file_id").agg(F.count("*").alias("n"), F.round(F.exp(-F.avg(F.log("p_cache"))), 6).alias("perplexity"))


_MIXED = "CASE WHEN pos = 0 THEN logp ELSE ln(0.3::DOUBLE * p_cache + 0.7::DOUBLE * exp(logp)) END"


@query(f"""WITH {DOC_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab')}, {positions_sql(3, 'test')}, {score_sql(3, 'placed')}, joined AS (SELECT * FROM placed JOIN scored USING (gram)),
    {cache_sql('joined', '(SELECT count(*) FROM vocab)')}, mixed AS (SELECT *, {_MIXED} AS mlp FROM cached) {_perplexity_sql('lang', 'mixed', 'mlp')}""")
def mixed_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-3 model of the lm fold, mixed with a cache per file, on the test fold."""
    words, vocab = doc_words(spark, sf_dir)
    model = doc_model(words, vocab, 3)
    placed = cut(coded.positions(coded.dealt(words.where("fold = 'test'")), 3, vocab.count()).drop("file_id"), "lm-positions")
    scored = placed.join(ngram.score(placed, model), "gram")
    return cache.perplexity_of_counts(scored.withColumn("mixed", cache.mixed_logp(0.3)).withColumn("n", F.lit(1)), ["lang"], "mixed")


@query(f"""WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab')}, {positions_sql(3, 'test')}, contexts AS (SELECT DISTINCT p2 || ' ' || p1 AS ctx FROM placed),
    grams AS (SELECT ctx, word, ctx || ' ' || word AS gram FROM contexts, vocab WHERE word NOT LIKE '<%'), {score_sql(3, 'grams')}
    SELECT ctx, w, round(logp, 9) AS logp, rank FROM (SELECT ctx, word AS w, logp, row_number() OVER (PARTITION BY ctx ORDER BY round(logp, 9) DESC, word) AS rank FROM grams JOIN scored USING (gram)) WHERE rank <= 3""")
def lm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = ngram.with_context(event_seq(spark, sf_dir, test=True), 3).select(F.concat_ws(" ", "p2", "p1").alias("ctx")).distinct()
    allowed = words_of(event_seq(spark, sf_dir)).where("word not like '<%'")
    return predicting.top_words(contexts, event_model(spark, sf_dir), 3, allowed).select("ctx", "w", F.round("logp", 9).alias("logp"), "rank")


@query(f"""WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab')}, {positions_sql(3, 'test')}, contexts AS (SELECT DISTINCT p2 || ' ' || p1 AS ctx FROM placed WHERE pos % 4 = 0),
    grams AS (SELECT ctx, word, ctx || ' ' || word AS gram FROM contexts, vocab WHERE word NOT LIKE '<%'), {score_sql(3, 'grams')},
    ranked AS (SELECT ctx, word, row_number() OVER (PARTITION BY ctx ORDER BY round(logp, 9) DESC, word) AS rank FROM grams JOIN scored USING (gram))
    SELECT repo, count(*) AS scored, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM placed JOIN ranked ON ctx = p2 || ' ' || p1 AND word = w WHERE pos % 4 = 0 GROUP BY repo""")
def topk_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the next word is among the best, at every fourth position."""
    placed = ngram.with_context(event_seq(spark, sf_dir, test=True), 3).where("pos % 4 = 0").withColumn("ctx", F.concat_ws(" ", "p2", "p1"))
    best = predicting.top_words(placed.select("ctx").distinct(), event_model(spark, sf_dir), 3, words_of(event_seq(spark, sf_dir)).where("word not like '<%'"))
    hit = placed.join(best.select("ctx", "w", "rank"), ["ctx", "w"], "left")
    share = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return hit.groupBy("repo").agg(F.count("*").alias("scored"), share(1).alias("top1"), share(3).alias("top3"))


def _continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth test position with its greedy continuation, what follows, the match and the confidence."""
    seq = event_seq(spark, sf_dir, test=True)
    placed = ngram.with_context(seq, 3).where("pos > 0 and pos % 4 = 0").select("file_id", "pos", F.concat_ws(" ", "p2", "p1").alias("ctx"))
    gen = predicting.greedy(placed, event_model(spark, sf_dir), words_of(event_seq(spark, sf_dir)).where("word not like '<%'"), 8)
    ahead = seq.select("file_id", "pos", F.collect_list("w").over(Window.partitionBy("file_id").orderBy("pos").rowsBetween(0, 7)).alias("true"))
    both = gen.join(ahead, ["file_id", "pos"])
    return both.withColumn("match", predicting.common_prefix(F.col("gen"), F.col("true"))).withColumn("conf", predicting.head_confidence(F.transform("gen_logp", F.exp))).withColumn("n_gen", F.size("gen"))


@query(f"""WITH {EVENT_SEQ}, {positions_sql(2, 'all_events')}, own AS (SELECT repo, file_id, gram, count(*) AS own FROM placed GROUP BY ALL), total AS (SELECT repo, gram, sum(own) AS total FROM own GROUP BY ALL)
    SELECT file_id, gram, (total - own)::BIGINT AS c FROM own JOIN total USING (repo, gram) WHERE total > own""")
def project_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rest of a repository knows about a file's bigrams."""
    return ngram.without_own(event_seq(spark, sf_dir).unionByName(event_seq(spark, sf_dir, test=True)), 2)


@query()
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ngram.with_context(event_seq(spark, sf_dir, test=True), 3).where("pos > 0 and pos % 16 = 0").select("file_id", "pos", F.concat_ws(" ", "p2", "p1").alias("ctx"))
    found = predicting.beam(placed, event_model(spark, sf_dir), words_of(event_seq(spark, sf_dir)).where("word not like '<%'"), 4, 3)
    return found.withColumn("logp", F.round("logp", 6))


@query()
def inline_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _continued(spark, sf_dir).select("file_id", "pos", "gen", "match", F.round("conf", 6).alias("conf"))


@query()
def inline_prefix_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicting.prefix_hits(_continued(spark, sf_dir), 8)


@query()
def inline_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicting.threshold_table(_continued(spark, sf_dir))


@query(f"""WITH {EVENT_SEQ}, {counts_sql(3)}, {model_sql(3, 'vocab')}, vals AS (SELECT gram, ln(p) AS v FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)),
    ordered AS (SELECT list(v ORDER BY v) AS s, count(*) AS n FROM vals), centres AS (SELECT b, CASE b WHEN 0 THEN s[1] WHEN 255 THEN s[n] ELSE s[CAST(floor((b + 0.5) / 256 * n) AS BIGINT) + 1] END AS c FROM ordered, range(256) t(b))
    SELECT count(*) AS n, round(max(err), 6) AS worst, round(avg(err), 6) AS mean FROM (SELECT gram, min(abs(v - c)) AS err FROM vals, centres GROUP BY gram)""")
def quant_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of storing log-probabilities as one of 256 quantile centres."""
    values = event_model(spark, sf_dir).prob.select("gram", F.log("p").alias("v"))
    centres = evaluation.quantile_centres(values, "v", 256)
    return evaluation.nearest_centre(values, "v", centres).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("v") - F.col("centre"))), 6).alias("worst"), F.round(F.avg(F.abs(F.col("v") - F.col("centre"))), 6).alias("mean"))
