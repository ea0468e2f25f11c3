"""Hand-computed cases and properties."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import external, metrics, ranking, relational, sampling, splitting, stats, validation
from tessel.operators.components import connected_components
from tessel.sources import tables


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_text_keys_and_style(spark):
    df = spark.createDataFrame([("  «Κτίριο» – Α ", "Laptop HP 15"), (None, "ΑΓΟΡΑ LAPTOP"), ("ΟΔΟΣ", "123")], "a string, b string")
    out = df.select(T.text_key(F.col("a")).alias("k"), T.plain_text_key(F.col("a")).alias("p"), T.language_style(F.col("b")).alias("s"), T.is_uppercase(F.col("b")).alias("u"), T.has_digit(F.col("b")).alias("d"), T.word_count(F.col("b")).alias("w")).collect()
    assert [tuple(r) for r in out] == [("κτιριο - α", "«κτιριο» – α", "english", False, True, 3), ("", "", "mixed", True, False, 2), ("οδοσ", "οδοσ", "other", False, True, 1)]


def test_same_word(spark):
    pairs = [("ktirii", "ktiria", True), ("logistiko", "logismiko", False), ("pos", "post", False), ("pos", "pos", True), ("laptop", "laptops", True)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.same == r.found for r in df.select("same", T.same_word(F.col("a"), F.col("b")).alias("found")).collect())


def test_parsers_raise(spark):
    df = spark.createDataFrame([("yes",)], "v string")
    with pytest.raises(Exception, match="not an agreement"):
        df.select(T.agreement(F.col("v")).alias("v")).collect()


def test_null_keys_match_and_keep_first(spark):
    one = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    two = spark.createDataFrame([(None, 10), ("b", 20)], "k string, v int")
    assert {(r.id, r.v) for r in relational.null_safe_join(one, two, ["k"]).collect()} == {(1, 10), (2, None)}
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert rows(relational.keep_first(df, ["k"], [F.asc("n")]), "k", "n") == [("a", 1), ("b", 3)]
    assert rows(relational.drop_conflicts(spark.createDataFrame([("t", 1), ("t", 0), ("u", 1)], "k string, n int"), ["k"], "n"), "k", "n") == [("u", 1)]


def test_allocations(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "g string, n bigint")
    assert rows(sampling.largest_remainder(counts, "n", 6, [], [F.desc("n")]), "g", "allocated") == [("a", 3), ("b", 2), ("c", 1)]
    counts = spark.createDataFrame([("a", 20), ("b", 5), ("c", 1)], "g string, n bigint")
    assert rows(sampling.stratified_sizes(counts, "n", 10, [F.asc("g")]), "g", "allocated") == [("a", 7), ("b", 2), ("c", 1)]
    assert rows(sampling.stratified_sizes(counts, "n", 99, [F.asc("g")]), "g", "allocated") == [("a", 20), ("b", 5), ("c", 1)]
    with pytest.raises(Exception, match="fewer rows"):
        sampling.stratified_sizes(counts, "n", 2, [F.asc("g")]).collect()
    groups = spark.createDataFrame([(f"c{i:02d}",) for i in range(14)], "g string")
    assert sorted(r.quota for r in sampling.quotas(groups, [F.asc("g")], 500).collect()) == [35] * 4 + [36] * 10


def test_coverage_and_percentiles(spark):
    ranks = spark.createDataFrame([("c", r, 6) for r in (1, 1, 2, 5)], "class string, rank bigint, most bigint")
    coverage = stats.coverage_by_k(ranks, "class", "rank", "most")
    assert rows(coverage, "k", "coverage") == [(1, 0.5), (2, 0.75), (3, 0.75), (4, 0.75), (5, 1.0), (6, 1.0)]
    assert rows(stats.coverage_summary(coverage, "class"), "k_90", "k_95", "k_100") == [(5, 5, 5)]
    assert rows(stats.rank_summary(ranks, "class", "rank"), "median_rank", "p90_rank", "p95_rank", "p95_ceiling") == [(1.5, 4.1, 4.55, 5)]


def test_mining(spark):
    texts = "abacd"
    ranked = spark.createDataFrame([(1, i, texts[i - 1], i) for i in range(1, 6)], "client_id int, candidate_id int, text string, distance_rank int")
    pick = lambda k: rows(ranking.outside_pick(ranked, "text", 2, F.lit(k)), "distance_rank", "kind")
    assert pick(3) == [(1, "semi_hard"), (2, "semi_hard"), (4, "outside_k95")]
    assert pick(10) == [(1, "semi_hard"), (2, "semi_hard"), (5, "farthest_fallback")]
    sims = spark.createDataFrame([(1, i, f"t{i}", s, i) for i, s in enumerate([0.80, 0.79995, 0.79, 0.50], 1)], "client_id int, candidate_id int, text string, similarity double, distance_rank int")
    found = ranking.semi_hard(sims, spark.createDataFrame([(1, 0.80)], "client_id int, positive_similarity double"), "text")
    assert rows(found, "candidate_id", "semi_hard_order") == [(3, 1), (4, 2)]


def test_early_stop(spark):
    def run(verdicts):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(verdicts, 1)], "client_id int, place int, verdict string")
        out = ranking.early_stop(df, "place", F.col("verdict") == "SKIP", F.col("verdict") == "INVALID")
        return [r.position for r in out.orderBy("place").collect()]

    assert run(["SKIP", "VALID", "VALID", "UNCERTAIN", "INVALID"]) == [None, 1, 2, 3]
    assert run(["VALID", "INVALID", "INVALID"]) == [1, 2]


def test_metrics(spark):
    assert rows(metrics.random_baseline(spark.createDataFrame([(5,), (20,)], "n_candidates int")), "recall_1", "recall_3", "mrr") == [(0.125, 0.375, 0.318277)]
    scored = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.55), (0, 0.1)], "y int, score double")
    assert rows(metrics.best_threshold(metrics.threshold_curve(scored, "y", "score")), "threshold", "f1") == [(0.6, 1.0)]
    scored = spark.createDataFrame([("g", 1, 0.8), ("g", 1, 0.5), ("g", 0, 0.5), ("g", 0, 0.2), ("h", 1, 0.3)], "g string, y int, score double")
    assert {(r.g, r.roc_auc) for r in metrics.roc_auc(scored, "y", "score", ["g"]).collect()} == {("g", 0.875), ("h", None)}
    counts = spark.createDataFrame([(0, 0, 2, 1)], "tp int, fp int, fn int, tn int")
    assert rows(metrics.rates(counts), "precision", "recall", "f1", "accuracy") == [(0.0, 0.0, 0.0, 0.333333)]


def test_components(spark):
    df = spark.createDataFrame([("g1", "x"), ("g2", "x"), ("g2", "y"), ("g3", "z")], "g string, c string")
    assert rows(splitting.group_components(df, "g", "c"), "g", "component") == [("g1", "g1"), ("g2", "g1"), ("g3", "g3")]
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = sorted((x, find(x)) for x in {y for a, b in edges if a != b for y in (a, b)})
    assert rows(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component") == expected


def test_splits():
    assert sorted([3, 2, 2][i] for i in splitting.subset_sum([3, 2, 2], 4)) == [2, 2]
    with pytest.raises(ValueError):
        splitting.subset_sum([3, 2, 2], 6)
    counts = {f"g{i}": {"a": i % 3 + 1, "b": (i * 7) % 4} for i in range(40)}
    folds = splitting.stratified_group_folds(counts, 4)
    assert set(folds) == set(counts) and set(folds.values()) == {0, 1, 2, 3}
    sizes = [sum(sum(counts[g].values()) for g in counts if folds[g] == k) for k in range(4)]
    assert max(sizes) - min(sizes) <= 6
    chosen = splitting.greedy_groups([("a", f"g{i}", 2) for i in range(10)] + [("b", "g1", 5), ("b", "g2", 5)], 0.35)
    assert 2 * len([g for g in chosen if g != "none"]) >= 7


def test_validation(spark):
    df = spark.createDataFrame([("  ΜΗ ΕΠΙΛΕΞΙΜΕΣ   ΔΑΠΑΝΕΣ ", "x"), ("Υπηρεσίες τρίτων", "y")], "a string, b string")
    found = [r.m for r in df.select(validation.marked_columns(["a", "b"], ["μη επιλεξιμες δαπανες"]).alias("m")).collect()]
    assert found == [["a"], []]
    bad = spark.createDataFrame([("t", "d", "one", "two")], "t string, d string, a string, b string")
    with pytest.raises(Exception, match="two classes"):
        bad.select(validation.negative_check(["t", "d"], "a", "b").alias("v")).collect()


def test_sources(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes('﻿a;b\n"x ""q""\ny";NA\n;2\n'.encode())
    df = tables.read_csv(spark, f"file://{path}", sep=";")
    assert rows(df, "a", "b") == [("", "2"), ('x "q"\ny', "NA")]
    assert rows(tables.read_csv(spark, f"file://{path}", sep=";", null_texts=("NA",)).where("b IS NULL"), "a") == [('x "q"\ny',)]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.read_csv(spark, f"file://{path}", sep=";", columns=["z"])
    errors = []
    both = tables.read_files(spark, [f"file://{path}", f"file://{tmp_path}/none.csv"], lambda s, p: tables.read_csv(s, p, sep=";"), lambda p, e: errors.append(p))
    assert rows(both, "row_in_file", "source_file") == [(1, "in.csv"), (2, "in.csv")] and len(errors) == 1
    numbered = tables.with_ordinal(spark.range(100).repartition(3).withColumn("p", F.spark_partition_id()))
    assert sorted(r.ordinal for r in numbered.collect()) == list(range(1, 101))
    out = f"file://{tmp_path}/out"
    tables.write_csv(df, out)
    with pytest.raises(Exception):
        tables.write_csv(df, out)
    tables.write_csv(df, f"{out}2", dry_run=True)
    assert not (tmp_path / "out2").exists()
    tables.append_log(df, f"{out}3")
    tables.append_log(df, f"{out}3")
    assert spark.read.parquet(f"{out}3").count() == 4
    assert spark.read.parquet(tables.backup(spark, f"{out}3", "v1")).count() == 4
    changed, count = tables.replace_text(df, ["a"], "q", "r")
    assert count.first()["occurrences"] == 1 and rows(changed, "a")[1] == ('x "r"\ny',)
    assert tables.find_name(["Program _ Fields ", "Other"], "program_fields") == "Program _ Fields "


def test_external(spark):
    items = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, n int")

    def make():
        return lambda seed: json.dumps({"items": [{"t": f"{seed['id']}-{i}"} for i in range(2)]}) if seed["id"] < 3 else "no json"

    out = external.generate_rows(items, "id", make, "items", ["t"], "n").collect()
    assert sorted(r.t for r in out if r.t) == ["1-0", "1-1", "2-0", "2-1"]
    assert sorted(r.id for r in out if r.issue) == [2, 3]
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>")
    texts = spark.createDataFrame([("a",), ("a",), ("bc",), (None,)], "t string")
    made = external.encode_distinct(texts, "t", lambda: lambda ts: [[float(len(t))] for t in ts], cache)
    assert sorted(r.embedding[0] for r in made.collect()) == [1.0, 2.0]
    filled = spark.createDataFrame([(r.text_hash, r.embedding) for r in made.collect()], "text_hash string, embedding array<float>")

    def never():
        raise AssertionError("the cache has all")

    assert external.encode_distinct(texts, "t", never, filled).count() == 2


def test_resumable_stream(spark, tmp_path):
    from tessel.streaming.resume import process_stream

    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    spark.range(10).write.parquet(source)

    def run():
        stream = spark.readStream.schema("id bigint").parquet(source)
        process_stream(stream, lambda b: b.withColumn("twice", F.col("id") * 2), out, state, "id").awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 10
    spark.range(5, 15).write.mode("append").parquet(source)
    assert run() == 15
