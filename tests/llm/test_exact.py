import brute
import pytest

from tessera.llm import decontaminate, katz, pii, simhash, suffix_dedup


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="session")
def pairs(small_rows):
    return [r[:2] for r in small_rows]


def test_suffix_dedup(small_docs, pairs):
    same(suffix_dedup.digest(suffix_dedup.dedup_substrings(small_docs)), brute.op1(pairs))


def test_suffix_dedup_over_many_blocks(small_docs, pairs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20_000)
    pack = suffix_dedup.pack_blocks
    monkeypatch.setattr(suffix_dedup, "pack_blocks", lambda d, i, t: pack(d, i, t, 2_000))
    same(suffix_dedup.digest(suffix_dedup.dedup_substrings(small_docs)), brute.op1(pairs))


def test_simhash(small_docs, pairs):
    same(simhash.digest(simhash.near_duplicates(small_docs)), brute.op4(pairs))
    same(simhash.digest(simhash.near_duplicates(small_docs, shard_rows=4)), brute.op4(pairs))


def test_pii(small_docs, pairs):
    got = pii.digest(pii.find_pii(small_docs)).drop("spans", "scores")
    expected = brute.op8([p for p in pairs if len(p[1] or "") < 40_000])
    same(got.join(small_docs.where("length(text) >= 40000").select("doc_id"), "doc_id", "left_anti"), expected)


def test_decontamination(small_docs, small_benchmark, pairs):
    items = [tuple(r) for r in small_benchmark.collect()]
    expected = brute.op9(pairs, items)
    same(decontaminate.digest(decontaminate.contamination(small_docs, small_benchmark)), expected)
    same(decontaminate.digest(decontaminate.contamination(small_docs, small_benchmark, pass_bytes=150)), expected)


def test_decontamination_in_pieces(spark, small_docs, pairs, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 200)
    long = " ".join(t for _, t in pairs[:40] if t and len(t) < 900)
    items = [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, "short item"), (5, long), (6, "x" * 500 + " tiny"), (7, pairs[3][1]), (7, pairs[3][1])]
    docs = [*pairs, (900, long + " " + long), (901, long.upper()), (902, "x" * 500 + " tiny"), (903, "A " + pairs[3][1] + "\n" + pairs[3][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    expected = brute.op9(docs, items)
    for pass_bytes in (1 << 20, 700):
        found = decontaminate.contamination(df, bench, pass_bytes=pass_bytes)
        same(decontaminate.digest(found), expected)
        clean = decontaminate.drop_contaminated(df, bench, pass_bytes=pass_bytes)
        assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(r[0]) for r in expected if not r[-1])
    text = dict(docs)
    for r in found.where("doc_id >= 900").collect():
        for x in r.spans:
            own = text[r.doc_id].encode()
            assert len(brute.PLAIN.findall(brute.lower(own[x.byte_start : x.byte_end].decode()))) == x.word_end - x.word_start
            assert len(brute.PLAIN.findall(brute.lower(own[: x.byte_start].decode()))) == x.word_start


def test_katz(small_docs, pairs):
    expected, p, one, after = brute.katz(pairs)
    got = katz.score(small_docs).drop("perplexity").collect()
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)
    for h in ["<s>", "alpha", "item"]:  # distributions sum to one, the unknown word included
        assert sum(p(h, w) for w in [*one, "never seen"]) == pytest.approx(1)


def test_empty_tables(no_docs, small_benchmark):
    assert suffix_dedup.dedup_substrings(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert pii.find_pii(no_docs).count() == 0
    assert decontaminate.contamination(no_docs, small_benchmark).count() == 0
    assert katz.score(no_docs).count() == 0


def test_empty_benchmark(small_docs, small_benchmark, pairs):
    same(decontaminate.digest(decontaminate.contamination(small_docs, small_benchmark.limit(0))), brute.op9(pairs, []))
