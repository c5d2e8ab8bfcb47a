"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random
from collections import Counter

import brute
import corpus_pipeline
import xxhash
from test_others import fair_queue

from tessera.llm import nearcopies, quality, sieve


def shingle_set(text, words=5):
    w = brute.SPACED.findall(brute.lower(text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y) if x or y else True


def survivors(docs):
    """Row numbers that stay, one a component: the least id, null last."""
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        rank = (docs[i][0] is None, docs[i][0] or 0)
        best[g] = min(best.get(g, rank), rank)
    return sorted(best.values())


def edited(rng, words, share):
    """A copy in which words are replaced at even distances."""
    out = list(words)
    for i in range(0, len(out), max(6, int(5 / share))):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_near_copies_to_the_threshold_are_found(spark):
    rng = random.Random(2)
    docs, levels = [], []
    for k in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([200, 1000]))]
        copy = edited(rng, base, rng.choice([0.02, 0.05, 0.1, 0.105, 0.12, 0.2]))
        x, y = shingle_set(" ".join(base)), shingle_set(" ".join(copy))
        levels.append(len(x & y) / len(x | y))
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert sum(v >= 0.8 for v in levels) > 30 and sum(0.8 <= v < 0.85 for v in levels) > 5 and sum(v < 0.8 for v in levels) > 10
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert kept(corpus_pipeline.drop_near_copies(spark, df, "")) == survivors(docs)


def test_wide_buckets_and_small_tiles_lose_no_links(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(edited(rng, base, 0.03))) for i in range(40)] + [(100 + i, " ".join(base[: 60 + i])) for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = survivors(docs)
    assert kept(nearcopies.keep_one(df)) == want
    monkeypatch.setattr(nearcopies, "TILE_BYTES", 6_000)
    assert kept(nearcopies.keep_one(df)) == want
    monkeypatch.setattr(nearcopies, "WIDE", 3)
    assert kept(nearcopies.keep_one(df)) == want


def simhash_of(shingles):
    """The majority of each bit over the distinct shingles."""
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_trees_link_near_copies_by_themselves(spark, monkeypatch):
    rng = random.Random(7)
    docs = []
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], "last"]))]
    sets = [shingle_set(t) for _, t in docs]
    prints = [simhash_of(x) for x in sets]
    body, at = nearcopies.text_bytes(nearcopies.pa.array([t for _, t in docs]))
    own = [x for _, x in nearcopies.shingle_sets(body, at)]
    begin = [0]
    for x in own:
        begin.append(begin[-1] + len(x))
    assert nearcopies.fingerprints(nearcopies.np.concatenate(own), nearcopies.np.array(begin)).tolist() == prints
    near = [k for k in range(40) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 3 and alike(sets[2 * k], sets[2 * k + 1])]
    assert len(near) > 10
    # buckets propose nothing, so that what is linked is linked by the trees
    monkeypatch.setattr(nearcopies, "tile_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert kept(corpus_pipeline.drop_near_copies(spark, df, "")) == [(False, i) for i in range(80) if i % 2 == 0 or i // 2 not in near]


def test_rows_of_a_large_bucket_do_not_grow_with_its_square(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(120)]
    docs = [(i, " ".join(edited(rng, passage, 0.03))) for i in range(60)]  # hang together
    docs += [(100 + i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 60))])) for i in range(200)]  # do not
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want, sizes, cut = survivors(docs), {}, nearcopies.cut

    def noted(df, name):
        out = cut(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(nearcopies, "cut", noted)
    monkeypatch.setattr(nearcopies, "TILE_BYTES", 6_000)
    assert kept(nearcopies.keep_one(df)) == want
    assert sizes["near-asked"] <= len(docs)
    monkeypatch.setattr(nearcopies, "TILE_CLASSES", 16)
    monkeypatch.setattr(nearcopies, "BLOCK", 5)
    assert kept(nearcopies.keep_one(df)) == want


def test_sieve_loses_no_key_and_needs_no_exchange(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as key", "id * 2 as word", "'x' as text")
    keys = df.where("key % 10 = 0").select("key")
    for bits in (sieve.BITS, 64):
        monkeypatch.setattr(sieve, "BITS", bits)
        may_be, not_in = sieve.sifted(df, "key", sieve.sieve(keys, "key"))
        assert may_be.columns == not_in.columns == df.columns
        got, rest = ({r.key for r in x.collect()} for x in (may_be, not_in))
        assert got >= set(range(0, 3000, 10)) and not got & rest and got | rest == set(range(3000))
        assert bits == 64 or len(got) < 310
        join = not_in._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in join


def test_run(spark, tmp_path, small_docs, small_benchmark, small_rows, monkeypatch):
    small_docs.write.parquet(f"{tmp_path}/documents.parquet")
    small_benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int((r[0] or 0) % 27 != 0)) for r in small_rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}

    def noted(name, stage):
        def call(spark, docs, sf_dir):
            seen[name] = docs
            return stage(spark, docs, sf_dir)

        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(n, f)) for n, f in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    ids = lambda found: sorted((i is None, i or 0) for i, _ in found)
    assert list(seen) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    start = rows(seen["quality"])
    assert Counter(start) == Counter(r[:2] for r in small_rows)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    judged = Counter(r.doc_id for r in quality.quality(seen["quality"], labels).where("predicted = 1").collect())
    good = rows(seen["near_dedup"])
    assert Counter(i for i, _ in good) == judged
    single = rows(seen["decontamination"])
    assert ids(single) == survivors(good) and len(single) < len(good)
    items = [tuple(r) for r in small_benchmark.collect()]
    assert ids(rows(seen["mixing"])) == ids([d for d, hit in zip(single, brute.op9(single, items)) if not hit[-1]])
    clean = [(r.doc_id, r.text, r.source) for r in seen["mixing"].collect()]
    copies, _, _ = fair_queue(clean)
    mixed = Counter(i for i, _ in rows(seen["sharding"]))
    assert mixed == Counter(clean[k][0] for (k, _), n in copies.items() if 2 * n > len(brute.SPACED.findall(clean[k][1] or "")))
    out = got.collect()
    assert Counter(r.doc_id for r in out) == mixed
    count = Counter(r._shard for r in out)  # the documents have a shard column of their own
    assert max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in out if r._shard == s) == list(range(count[s])) for s in count)


def test_near_copies_of_few_rows(spark):
    for texts in ([], [None], ["", None, " "], ["a b", "a b", "c"], ["one two three four five six"] * 3):
        docs = list(enumerate(texts))
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert kept(nearcopies.keep_one(df)) == survivors(docs)
