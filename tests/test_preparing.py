import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import filerules
from tessera.functions.draws import md5_prefix
from tessera.operators import dedup, preparing, ranks
from tessera.sources import corpus


def one(spark, value, schema, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], schema).select(column(F.col("v"))).collect()]


def test_folds(spark):
    names = spark.createDataFrame([(f"owner{i}__repo{i}",) for i in range(300)], "repo string")
    folds = {r.repo: r.fold for r in preparing.assign_folds(names, 30).collect()}
    assert sorted(folds.values()).count("test") == 30 and sorted(folds.values()).count("rank") == 90 and sorted(folds.values()).count("lm") == 180
    assert one(spark, ["abc"], "v string", md5_prefix) == ["90015098"]
    assert {r.repo: r.fold for r in preparing.assign_folds(names.repartition(7), 30).collect()} == folds


def test_content_reasons(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        line = "x = '" + "a" * 2000 + "'\n"
        contents = [b"a\x00b", b"\x70\x81\x8d", b"\x70\xff\xfe", b"// Code generated by tool. DO NOT EDIT.\npackage a\n", b"// generated by x, see y\n", line.encode(), b"package a\n\nfunc f() {}\n", b"\xff\xfea\x00"[:3], "// © 2020\n".encode("cp1252"), b"/* This file was generated */\n", b""]
        got = one(spark, [bytearray(c) for c in contents], "v binary", filerules.content_reason)
        assert got == ["binary", "non_utf8", None, "generated_marker", "generated_marker", "long_lines", None, "non_utf8", None, "generated_marker", None]
        assert one(spark, [bytearray("é".encode("cp1252"))], "v binary", filerules.decoded) == ["é"]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_generated_heads(spark):
    yes = ["// <auto-generated/>\n", "/* Code generated X */\n// DO NOT EDIT\n", "# Generated code\n* do not modify\n", "﻿// Decompiled with ILSpy\n"]
    no = ['fmt.Println("// Code generated by x DO NOT EDIT")\n', "package main\n// Code generated\n", "// do not edit\n"]
    assert one(spark, yes + no, "v string", filerules.generated_head) == [True] * 4 + [False] * 3
    names = ["a/x.pb.go", "a/Form1.Designer.cs", "a/TemporaryGeneratedFile_1.cs", "a/main.go", "a/Designer.cs"]
    assert one(spark, names, "v string", filerules.generated_name) == [True, True, True, False, False]
    paths = ["src/Migrations/20240101123456_Init.cs", "Migrations/20240101_Init.cs", "src/Migrations/Init.cs"]
    assert one(spark, paths, "v string", filerules.generated_path) == [True, True, False]
    assert one(spark, ["vendor/a.go", "a/vendor", "a/testdata/b.go", "b.go"], "v string", filerules.in_excluded_dir) == [True, False, True, False]


def test_lines(spark):
    texts = ["", "a", "a\n", "a\nb", "\n\n"]
    assert one(spark, texts, "v string", filerules.line_count) == [0, 1, 1, 2, 2]
    assert one(spark, texts, "v string", filerules.longest_line) == [0, 1, 1, 1, 0]


def test_selection(spark):
    repos = spark.createDataFrame([("a__x",), ("b__y",), ("c__z",), ("d__w",)], "repo string")
    known = spark.createDataFrame([("b__y", 90, "MIT"), ("c__z", 30, None), ("d__w", 20, "MIT")], "repo string, stars int, license string")
    joined = preparing.with_catalogue(repos, known)
    assert {r.repo: (r.stars, r.license, r.in_catalog) for r in joined.collect()} == {"a__x": (0, "unknown", False), "b__y": (90, "MIT", True), "c__z": (30, "none", True), "d__w": (20, "MIT", True)}
    assert [r.repo for r in preparing.select_repos(joined, 20, 2).collect()] == ["b__y", "c__z"]
    assert preparing.curated(
        spark.createDataFrame([("a__x", 0.7, "2020-01-01", 100, 10, 50, ["cli"], "tool"), ("b__y", 0.7, "2020-01-01", 100, 1, 50, [], ""), ("c__z", 0.9, "2020-01-01", 100, 10, 50, ["tutorial"], None)], "repo string, share double, created_at string, stars int, forks int, watchers int, topics array<string>, description string"),
        "2024-07-01", "awesome|tutorial", "awesome list",
    ).collect()[0].repo == "a__x"


def sequential(files, threshold):
    """Verdicts of a loop over files in order."""
    signed = {}
    seen, accepted, out = set(), [], {}
    for key, tokens, sig in files:
        text = "\x01".join(tokens)
        if text in seen:
            out[key] = "dup_exact"
            continue
        seen.add(text)
        if sig is not None and any(sum(a == b for a, b in zip(sig, s)) / dedup.PERMUTATIONS >= threshold and any(sig[i : i + dedup.ROWS] == s[i : i + dedup.ROWS] for i in range(0, dedup.PERMUTATIONS, dedup.ROWS)) for s in accepted):
            out[key] = "dup_near"
            continue
        out[key] = "ok"
        if sig is not None:
            accepted.append(sig)
        signed[key] = sig
    return out


def test_greedy_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.sample(words, 60) for _ in range(12)]
    files = []
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12])):
            text[rng.randrange(len(text))] = rng.choice(words)
        files.append((i, text, text))
    files += [(200, ["a", "b"], ["a", "b"]), (201, ["a", "b"], ["a", "b"]), (202, ["a", "c"], ["a", "c"]), (203, [], [])]
    df = spark.createDataFrame(files, "key long, tokens array<string>, words array<string>").repartition(5)
    sigs = {r.key: r.sig for r in dedup.signatures(df.where("size(words) > 0"), "key").collect()}
    expected = sequential([(k, t, sigs.get(k)) for k, t, _ in files], 0.8)
    got = {r.key: r.verdict for r in dedup.greedy(df, "key").collect()}
    assert got == expected
    assert {"ok", "dup_exact", "dup_near"} == set(got.values())


def test_manifest(spark):
    rng = random.Random(1)
    body = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(n)) + "\n"
    copied = body(9)
    rows = [(f"r{i % 6}", f"f{i}.go", copied if i % 7 == 0 else body(9), (i % 6) * 10) for i in range(40)] + [("r1", "gen.go", "// <auto-generated>\n", 10)]
    files = spark.createDataFrame(rows, "repo string, path string, text string, stars int")
    folds = spark.createDataFrame([(f"r{i}", preparing.FOLDS[i % 3]) for i in range(6)], "repo string, fold string")
    words = F.split("text", " ")
    got = preparing.manifest(files, folds, {"lm": 300}, words, words).collect()
    assert len(got) == len(rows)
    by = {(r.repo, r.path): r for r in got}
    assert by["r1", "gen.go"].status == "generated_marker"
    fold_of = {f"r{i}": preparing.FOLDS[i % 3] for i in range(6)}
    seen, kept = set(), 0
    order = sorted((r for r in rows if r[1] != "gen.go"), key=lambda r: (preparing.FOLDS.index(fold_of[r[0]]), -r[3], r[0], r[1]))
    for repo, path, text, _ in order:
        if fold_of[repo] == "lm" and kept >= 300:
            want = "budget"
        elif text in seen:
            want = "dup_exact"
        else:
            want = "ok"
            seen.add(text)
            kept += len(text) if fold_of[repo] == "lm" else 0
        assert by[repo, path].status == want or (want == "ok" and by[repo, path].status == "dup_near"), (repo, path)
    stats = preparing.stats_document(spark.createDataFrame(got)).first().stats
    assert '"per_fold"' in stats and '"generated_marker"' in stats


def test_jaccard_pairs_find_all(spark):
    rng = random.Random(2)
    sets = [(i, "b", rng.sample("abcdefghijklmnopqrst", rng.randint(8, 12))) for i in range(60)]
    sets += [(100 + i, "b", s[2][:-1]) for i, s in enumerate(sets[:20])]
    df = spark.createDataFrame(sets, "key long, block string, words array<string>")
    got = {(r.a, r.b) for r in dedup.jaccard_pairs(df, "key", "block", 0.7).collect()}
    want = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) >= 0.7}
    assert got == want and want


def test_running_total_and_ranks(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g int, v int").repartition(9)
    got = {r.id: r.s for r in ranks.running_total(df, [F.col("g"), F.col("id")], F.col("v"), "s").collect()}
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        want[i] = total
    assert got == want
    assert {r.id: r.k for r in ranks.bucketed_rank(df, F.col("g"), [F.col("id")], "k").collect()} == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}


def test_tree_and_manifest_sources(spark, tmp_path):
    for name, data in {"o__a/main.go": b"package main\n", "o__a/vendor/x.go": b"x", "o__b/empty.go": b"", "o__b/bin.go": b"a\x00", "o__b/readme.md": b"no"}.items():
        p = tmp_path / "repos" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    tree = corpus.judged_tree(corpus.read_tree(spark, str(tmp_path / "repos"), [".go"]))
    assert {(r.repo, r.path): r.reason for r in tree.collect()} == {("o__a", "main.go"): None, ("o__a", "vendor/x.go"): "excluded_dir", ("o__b", "bin.go"): "binary"}
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    rows = spark.createDataFrame([("r", 'a "quoted" \\ path', 1, 2, 3, "lm", "ok"), ("r", "b", 1, 2, 3, "test", "dup_exact")], corpus.MANIFEST)
    corpus.write_manifest(rows, str(tmp_path / "manifest"))
    assert corpus.read_manifest(spark, str(tmp_path / "manifest"), "lm").collect() == rows.where("fold = 'lm'").collect()
    torn = tmp_path / "torn.jsonl"
    torn.write_text('{"full_name":"a/b","stars":3,"license":null,"created_at":"2020"}\n{"full_name":"c/d","sta')
    assert [(r.repo, r.stars, r.license) for r in corpus.read_catalogue(spark, str(torn)).collect()] == [("a__b", 3, "none")]
    (tmp_path / "list.txt").write_text("# names\na__b\n\nx__y\n")
    listed = corpus.read_repo_list(spark, str(tmp_path / "list.txt"))
    with pytest.raises(ValueError, match="x__y"):
        corpus.include_only(spark.createDataFrame([("a__b",)], "repo string"), listed)
    (tmp_path / "t.md").write_text("| # | repo | stars |\n|---|---|---|\n| 1 | a/b | 10 |\n| 2 | c/d | 9 |\ntext\n")
    assert [tuple(r) for r in corpus.read_markdown_table(spark, str(tmp_path / "t.md"), ["n", "repo", "stars"]).collect()] == [("1", "a/b", "10"), ("2", "c/d", "9")]
    (tmp_path / "w.log").write_text("worker 1: positions=10 hits=4\nnoise\nworker 2: positions=30 hits=6\n")
    log = corpus.read_log(spark, str(tmp_path / "w.log"), r"positions=(\d+) hits=(\d+)", {"positions": "int", "hits": "int"})
    assert log.agg(F.sum("positions"), F.sum("hits")).first() == (40, 10)
