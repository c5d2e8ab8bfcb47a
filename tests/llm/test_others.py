import hashlib
import heapq
import re
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, mixing, pii, quality, sharding, shared, urls


def targets(sizes, weights=(3, 1, 2)):
    """The excess reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def fair_queue(rows, packet=512):
    """Words taken of each row and lap, by heads of queues in a heap; rows: (id, text, source)."""
    size = lambda t: len(brute.SPACED.findall(t or ""))
    per, queues = defaultdict(int), defaultdict(list)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for k, (i, text, source) in enumerate(rows):
        per[source] += size(text)
        drawn = int(md5(f"{'' if i is None else i}|0|{md5(text or '')}")[:15], 16)
        queues[source].append((drawn, k, size(text)))
    target, heap, out = targets(per), [], Counter()
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))

    def packets(source):
        done = 0
        for lap in (0, 1):
            for drawn, k, n in sorted(queues[source]):
                for p in range(0, n, packet):
                    words = min(packet, n - p)
                    done += words
                    yield done / target[source], lap, drawn, p, k, words

    live = {s: packets(s) for s in order}
    for rank, s in enumerate(order):
        if (head := next(live[s], None)) is not None:
            heapq.heappush(heap, (head[0], rank, head[1:]))
    left = int(1.5 * sum(per.values()))
    while heap and left:
        _, rank, (lap, _, _, k, words) = heapq.heappop(heap)
        out[k, lap] += min(words, left)
        left -= min(words, left)
        if (head := next(live[order[rank]], None)) is not None:
            heapq.heappush(heap, (head[0], rank, head[1:]))
    return out, per, target


def test_mixing(small_docs, small_rows):
    got = mixing.taken(small_docs).collect()
    rows = [(r[0], r[1], r[3]) for r in small_rows]
    size = lambda t: len(brute.SPACED.findall(t or ""))
    copies, per, want = fair_queue(rows)
    by_row = Counter()
    for (k, _), n in copies.items():
        by_row[k] += n
    told = lambda i, t, s, n: (i is None, i or 0, size(t) if t is not None else 0, per[s], n)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken) for r in got) == sorted(told(i, t, s, by_row[k]) for k, (i, t, s) in enumerate(rows))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[r.source_size, round(r.target, 6)] += r.taken
    assert {k[1]: v for k, v in by_target.items()} == {round(t, 6): pytest.approx(t, abs=mixing.PACKET) for t in want.values()}
    assert sorted(map(tuple, mixing.taken(small_docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    clash = small_docs.withColumnsRenamed({"value": "wfq_key", "key": "wfq_lap"})
    mixed = mixing.mix(clash)
    assert mixed.columns == [*clash.columns, "_wfq_lap", "wfq_finish"]
    out = mixed.collect()
    assert {r.wfq_key for r in out} <= {"v", None} and [r.wfq_finish for r in out] == sorted(r.wfq_finish for r in out)
    whole = Counter(rows[k][0] for (k, _), n in copies.items() if 2 * n > size(rows[k][1]))
    assert Counter(r.doc_id for r in out) == whole


def test_mixing_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "same text of five words", "a")] * 300 + [(None, f"w{i} " * (i % 7), "b") for i in range(200)], "doc_id long, text string, source string").repartition(4)
    got = mixing.taken(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert len(got) == 2 and all(abs(r.n - r.target) <= mixing.PACKET for r in got)


def test_sharding(small_docs, small_rows):
    got = sharding.shards(small_docs, n_shards=5).collect()
    assert len(got) == len(small_rows)
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(5))
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in small_rows)
    same = sharding.with_shards(small_docs.repartition(2).withColumnRenamed("value", "slot"), n_shards=5)
    assert same.columns == [*small_docs.columns[:7], "slot", *small_docs.columns[8:], "_shard", "_slot"]
    # neither the split of the table nor clashing columns change the shards
    assert sorted((r.doc_id is None, r.doc_id or 0, r._shard) for r in same.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.shard) for r in got)
    few = sharding.shards(small_docs.limit(3)).collect()
    assert len(few) == 3 and max(Counter(r.shard for r in few).values()) == 1


def test_sharding_gathers_linked_rows(spark):
    nodes = spark.range(600).select(F.col("id").alias("key"), F.xxhash64("id").alias("place"))
    features = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 20).alias("feature"))
    cuts = []
    for rounds in (0, 3):
        got = {r.key: r.shard for r in sharding.propagate(nodes, features, 4, rounds).collect()}
        assert set(Counter(got.values()).values()) == {150}
        groups = defaultdict(Counter)
        for k in range(200):
            groups[k % 20][got[k]] += 1
        cuts.append(sum(sum(g.values()) - max(g.values()) for g in groups.values()))
    assert cuts[1] < cuts[0] / 3


def stored_form(payload):
    out = BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(8000)
        f.writeframes(payload)
    return out.getvalue()


def test_media(small_docs, small_rows):
    got = {}
    for r in media.media_column(small_docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(small_rows)
    for r in small_rows:
        text = (r[1] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        form, x = stored_form(payload), [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        feature = f"n={len(x)};mean={sum(x) * 1000 // len(x)};energy={sum(v * v for v in x) // len(x)};crossings={crossings}"
        assert any(
            (y.n_bytes, y.payload_bytes, y.payload_sha256, y.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            and (y.media_bytes, y.media_sha256, y.feature) == (len(form), hashlib.sha256(form).hexdigest(), feature)
            for y in got[r[0]]
        )


def test_media_stores_shared_chunks_once(spark):
    import random

    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    docs = spark.createDataFrame([(i, f"{i} " * 50 + shared + str(i)) for i in range(8)], "doc_id long, text string").repartition(4)
    stored = media.store(docs, media.catalogue(docs), 3)
    owned = sum(n for r in stored.collect() for sizes, state in zip(r.sizes, r.state) for n, s in zip(sizes, state) if s != media.BORROWED)
    assert owned < 120_000
    back = media.media_column(docs).collect()
    assert {r.payload_bytes for r in back} == {-(-len(f"{r.doc_id} " * 50 + shared + "0") // 64) * 64 for r in back}


def test_urls(spark):
    pages = [
        (1, "http://Good.Example.com/en/7?x", '<a href="https://friend.net/x">'), (2, "https://bad.com/en/x#t", None), (3, "nothing", ""), (4, None, "x"),
        (5, "http://linker.io/", "<a href='http://bad.com/en/x'>"), (6, "http://friend.net", ""), (7, "http://a.org/es/", ""), (8, "http://example.net/de/81", ""),
        (9, "http://net/de/", ""), (10, "ftp://sub.bad.com?/en/", ""), (2, "https://bad.com/en/x#t", None), (None, "http://notexample.com/fr/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("trust", F.lit(1))
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect())
    assert got == [
        (0, "notexample.com", "/fr/", None, "allow"), (1, "good.example.com", "/en/7", "example.com/en/7", "allow"), (2, "bad.com", "/en/x", "com/en/", "block"), (2, "bad.com", "/en/x", "com/en/", "block"),
        (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "linker.io", "/", None, "block"), (6, "friend.net", "", None, "allow"),
        (7, "a.org", "/es/", "org/es/", "block"), (8, "example.net", "/de/81", "example.net/de/8", "block"), (9, "net", "/de/", "net/de/", "allow"), (10, "sub.bad.com", "", None, "block"),
    ]
    assert urls.judge(df.limit(0)).count() == 0
    few = sorted(map(str, urls.judge(df).collect()))
    for rules in (urls.rule_table(spark, urls.RULES), (*urls.RULES, *(urls.Rule(f"h{i}.example", "/", False) for i in range(600)))):
        judged = urls.judge(df, rules)
        assert sorted(map(str, judged.collect())) == few


def test_pii_additions(small_docs):
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(small_docs)).collect()}
    spans = ",".join(r.spans for r in got.values())
    assert "iban:5:32" in spans and "ssn:" in spans
    row = pii.redact(pii.find_pii(small_docs.where("text like 'iban%'"))).first()
    assert "GB82" not in row.text and "078-05" not in row.text


def test_ibans_before_capitals_and_digits(spark):
    texts = {
        "DE89370400440532013000 Please": [(0, 22)], "DE89 3704 0044 0532 0130 00 BIC COBADEFF": [(0, 27)], "GB82WEST12345698765432 2024": [(0, 22)],
        "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 A": [(0, 27), (28, 50)], "DE89370400440532013000": [(0, 22)], "DE89370400440532013001 Please": [],
        "DE89370400440532013000X": [], "XX12 ABCDEFGHIJK DE89370400440532013000 NO93 8601 1117 947 EUR 5": [(17, 39), (40, 58)],
        "iban ZZ65123456789012 Please": [(5, 21)], "iban ZZ65123456789012 PAID 2024": [(5, 21)], "MT84 MALT 0110 0001 2345 MTLC AST0 01S OK": [(0, 38)],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: [(x.start, x.end) for x in r.iban] for r in pii.find_pii(df).collect()}
    assert got == texts
    red = [r.text for r in pii.redact(pii.find_pii(df)).collect()]
    assert "█" * 22 + " Please" in red


def test_quality(spark):
    import random

    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "over"]) for _ in range(rng.randint(5, 60))) + "."
    bad = lambda: " ".join(rng.choice(["BUY%%", "###", "NOW!!", "$$$"]) for _ in range(rng.randint(5, 60)))
    truth = {i: int(rng.random() < 0.8) for i in range(1200)}
    docs = spark.createDataFrame([(i, good() if y else bad(), 0.5) for i, y in truth.items()] + [(None, None, 0.0), (5000, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 2] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == 1202
    assert all(got[i].held_out == brute.held(i, 3, 1) and got[i].predicted == (got[i].score >= 0.5) for i in got)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) > 0.97 * len(held)
    assert quality.keep_good(docs, labels).columns == docs.columns
    every = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")  # all texts are labelled
    got = {r.doc_id: r for r in quality.quality(docs, every).collect()}
    assert sum(got[i].predicted == truth[i] for i in held) > 0.97 * len(held)
    copies = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(20_000)).drop("id"))  # one id that many rows have
    assert {(r.doc_id, r.score) for r in quality.quality(copies, every).collect()} == {(i, r.score) for i, r in got.items()}
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_empty_tables(no_docs):
    assert mixing.taken(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert sharding.shards(no_docs).count() == 0 and sharding.with_shards(no_docs).count() == 0
    assert media.media_column(no_docs).count() == 0
    assert quality.quality(no_docs, no_docs.select("doc_id", F.lit(1).alias("quality"))).count() == 0


def gathered(got, features):
    """Rows that are in the shard that most rows of a feature are in."""
    groups = defaultdict(Counter)
    for k, f in features:
        groups[f][got[k]] += 1
    return sum(max(g.values()) for g in groups.values())


@pytest.mark.parametrize("common", [False, True])
def test_sharding_gathers_where_all_rows_are_linked(spark, common):
    own = [(k, k % 60) for k in range(600)]
    nodes = spark.range(600).select(F.col("id").alias("key"), F.xxhash64("id").alias("place"))
    features = spark.createDataFrame(own + [(k, 1000) for k in range(600)] * common, "key long, feature long")
    found = []
    for rounds in (0, None):
        got = {r.key: r.shard for r in sharding.propagate(nodes, features, 4, rounds).collect()}
        assert set(Counter(got.values()).values()) == {150}
        found.append(gathered(got, own))
    assert found[1] > 1.8 * found[0]


def test_exchange_takes_the_best_cycles():
    arcs = {(0, 1): sharding.Arc([(2.0, 3), (0.5, 4)]), (1, 0): sharding.Arc([(1.0, 2)]), (1, 2): sharding.Arc([(-0.25, 5)]), (2, 0): sharding.Arc([(0.0, 100)])}
    sharding.exchange(arcs, 3)
    assert {k: a.total() for k, a in arcs.items()} == {(0, 1): 7, (1, 0): 2, (1, 2): 5, (2, 0): 5}


def test_long_texts_have_the_same_features():
    texts = [b"", b"word", b"One line, two words\n\nand a long one " + b"z" * 900 + b"\n a b a c\n" * 60, "é ß\n日本".encode() * 80, b"\n" * 300, b"no break " * 200]
    for t in texts:
        body = np.frombuffer(t, np.uint8)
        whole = quality.features(body, np.array([0, len(t)]))
        for limit in (1, 7, 64, 10_000):
            assert quality.long_features(body, limit) == pytest.approx(whole, abs=1e-6)


def risk(model_weight, bias, p, u, prior):
    """The non-negative risk, written out."""
    loss = lambda g: 1 / (1 + np.exp(g))
    gp, gu = p @ model_weight + bias, u @ model_weight + bias
    return prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean())


def test_fit_minimises_the_nonnegative_risk():
    rng = np.random.default_rng(4)
    p, mixed = rng.normal(1, 1, (400, 6)), np.concatenate([rng.normal(1, 1, (280, 6)), rng.normal(-1, 1, (120, 6))])
    prior = quality.class_prior(p, mixed)
    assert prior == pytest.approx(0.7, abs=0.08)
    m = quality.fit(p, mixed, 0.7)
    scaled = lambda x: np.clip((x - m.mean) / m.scale, -6, 6)
    least = risk(m.weight, m.bias, scaled(p), scaled(mixed), 0.7)
    assert least < 0.1
    for _ in range(50):
        assert risk(m.weight + rng.normal(0, 0.3, 6), m.bias + rng.normal(0, 0.3), scaled(p), scaled(mixed), 0.7) > least - 0.01


def carriers(df, name="text"):
    """Exchanges in the plan of ``df`` that carry the column ``name``."""
    said = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return len(re.findall(rf"\) Exchange\nInput \[\d+\]: \[[^\n]*\b{name}#", said))


def test_mix_exchanges_texts_once_and_sharding_never(spark, small_docs, monkeypatch):
    docs = spark.createDataFrame(small_docs.collect(), small_docs.schema).repartition(3)
    want = sorted(map(str, mixing.mix(docs).collect())), sorted(map(str, sharding.with_shards(docs, n_shards=5).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    monkeypatch.setattr(shared, "BLOCK_BITS", 3)
    try:
        scan = shared.cut(docs, "test-documents")
        for made, most, want in ((lambda: mixing.mix(scan), 1, want[0]), (lambda: sharding.with_shards(scan, n_shards=5), 0, want[1])):
            seen = []
            for module in (mixing, sharding):
                monkeypatch.setattr(module, "cut", lambda df, name: (seen.append(carriers(df)), shared.cut(df, name))[1])
            out = made()
            assert sum(seen) + carriers(out) == most
            assert sorted(map(str, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns_beside_rows_that_stay(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK_BITS", 4)
    docs = spark.range(300).repartition(7).withColumn("a.b`c", F.lit(None).cast("string")).withColumn("row_block", F.col("id") * 2)
    kept = shared.numbered(docs, "row", "test-numbered")
    slim = kept.select("row", (F.col("id") * 3).alias("v"), F.lit("x").alias("w"))
    for few in (slim, shared.cut(slim, "test-slim")):
        out = shared.beside(kept, few, "row")
        assert out.columns == ["id", "a.b`c", "row_block", "row", "v", "w"] and (few is slim or not carriers(out, "id"))
        got = out.collect()
        assert sorted(r.id for r in got) == list(range(300)) and all((r.row_block, r.v, r.w, r["a.b`c"]) == (2 * r.id, 3 * r.id, "x", None) for r in got)
    with pytest.raises(Exception, match="a row has nothing beside it"):  # none is dropped in silence
        shared.beside(kept, slim.where("v <> 30"), "row").collect()
    none = shared.numbered(docs.limit(0), "row", "test-numbered")
    assert shared.beside(none, none.select("row", F.lit(1).alias("v")), "row").collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
