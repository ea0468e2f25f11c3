"""Text forms, numbering, links, caches, folds, streams and workbooks against plain Python."""

from __future__ import annotations

import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import external, lexical, relational, sampling, splitting, stats, validation
from tessel.scratch import new_path
from tessel.sources import tables, workbook

ODD_TEXTS = ["", None, "plain", "STRAẞE ß ﬁ ſ", "ΣΊΣΥΦΟΣ ς", "İi̇ ŉ ǰ", "Ǆ Ω K Å ᾳ ᾈ ΐ", "é é ñ", "각 가각", "ⅷ Ⅷ ꭰ Ꭰ", "日本 🙂", "ὒ ᾷ ῼ", "µ ϐ ϑ ϕ ẛ", "ỗ ệ ử", "à́̂ ÷ ×", "ʹ ; ·", "ы й ё"]


def test_unicode_forms(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "i int, t string")
    out = rows.select("t", T.casefold(F.col("t")).alias("folded"), T.strip_accents(F.col("t")).alias("plain"), T.nfc(F.col("t")).alias("nfc")).collect()
    for r in out:
        t = r["t"]
        if t is None:
            assert r["folded"] is r["plain"] is r["nfc"] is None
            continue
        assert r["folded"] == t.casefold(), t
        assert r["plain"] == "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), t
        assert r["nfc"] == unicodedata.normalize("NFC", t), t


def test_numbered(spark):
    rows = spark.range(500).repartition(7).withColumn("k", (F.col("id") * 37) % 500)
    assert sorted((r["k"], r["n"]) for r in relational.numbered(rows, [F.asc("k")], "n").collect()) == [(k, k + 1) for k in range(500)]
    assert relational.numbered(rows.limit(0), [F.asc("k")], "n").count() == 0
    source = rows.withColumn("p", F.spark_partition_id())
    assert sorted(r["row"] for r in tables.with_ordinal(source, "row").collect()) == list(range(1, 501))
    padded = relational.padded_ids(rows.select("k"), "N", 4, [F.desc("k")])
    assert sorted((r["id"], r["k"]) for r in padded.collect())[:2] == [("N0001", 499), ("N0002", 498)]


def test_two_hops(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "k string")
    middle = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 1), ("c", 1, 3), ("d", 1, None), ("a", 0, 2)], "k string, o int, m int")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31), (None, 40)], "m int, id int")
    first = relational.link_two_hops(left, middle, right, ["k"], ["m"], "id", [F.asc("o")])
    assert {r["k"]: r["id"] for r in first.collect()} == {"a": 20, "b": 10, "c": None, "d": 40, None: None}
    every = relational.link_two_hops(left, middle, right, ["k"], ["m"], "id", [F.asc("o")], unanimous=True)
    assert {r["k"]: r["id"] for r in every.collect()} == {"a": None, "b": 10, "c": None, "d": 40, None: None}


def test_checks_and_labels(spark):
    rows = spark.createDataFrame([(1, " x ", "y"), (2, " ", "y"), (3, None, None)], "i int, a string, b string")
    assert [r[0] for r in rows.orderBy("i").select(validation.first_given(F.col("a"), F.col("b"))).collect()] == ["x", "y", None]
    assert tuple(validation.conservation(rows, rows.limit(1), rows.limit(1)).first()) == (3, 1, 1, False)
    joined, counts = relational.join_indicated(rows.select("i"), spark.createDataFrame([(1,), (1,)], "i int"), ["i"])
    assert tuple(counts.first()) == (0, 1, 2) and joined.count() == 4


def test_caches(spark):
    path = new_path(spark, "cache-test")
    assert tables.read_cache(spark, path) is None
    unit = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [1.0, 0.0])], "text_hash string, embedding array<float>")
    tables.write_cache(unit, path)
    tables.write_cache(unit.limit(1), path)
    assert tables.read_cache(spark, path).count() == 1
    broken = spark.createDataFrame([([1.0],), ([float("nan"), 0.0],), ([3.0, 4.0],), (None,)], "embedding array<float>")
    assert tuple(external.checked_embeddings(broken, 2, 5)[1].first()) == (2, 2, 3, 1)

    def make():
        return lambda texts: [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "one"), (2, "one"), (3, None), (4, "three")], "i int, t string")
    assert [(r["i"], r["embedding"]) for r in external.encode_rows(rows, "t", make).orderBy("i").collect()] == [(1, [3.0]), (2, [3.0]), (3, None), (4, [5.0])]
    lengths = external.token_lengths(rows, "t", lambda: lambda texts: [len(t) for t in texts], batch=2)
    assert sorted((r["i"], r["n_tokens"]) for r in lengths.collect()) == [(1, 3), (2, 3), (3, 0), (4, 5)]


def test_folds_beyond_the_exact_bound(spark):
    rows = spark.range(3000).select((F.col("id") % 600).alias("g"), F.when(F.col("id") % 600 < 200, "x").otherwise("y").alias("s"))
    folds = splitting.assign_folds(rows, "g", "s", 5, most_exact=100)
    by = {r["g"]: r["fold"] for r in folds.collect()}
    assert len(by) == 600 and folds.count() == 600
    for stratum in (range(200), range(200, 600)):
        sizes = [sum(by[str(g)] == k for g in stratum) for k in range(5)]
        assert max(sizes) - min(sizes) <= 2


def test_greedy_split_is_the_list_form(spark):
    rows = spark.range(2000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("c"), F.concat(F.lit("g"), F.floor(F.sqrt("id")).cast("string")).alias("g"))
    sizes = [(r["c"], r["g"], r["n"]) for r in rows.groupBy("c", "g").agg(F.count("*").alias("n")).collect()]
    assert {r["g"] for r in splitting.greedy_split(rows, "c", "g", 35).collect()} == splitting.greedy_groups(sizes, 0.35)


def test_csv_mark_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a;b"), (2, 'c"d'), (3, "ß")], "i int, t string").coalesce(1)
    path = f"{tmp_path}/csv"
    tables.write_csv(rows, path, bom=True)
    part = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfi,t")
    assert sorted(tuple(r) for r in tables.read_csv(spark, path).collect()) == [("1", "a;b"), ("2", 'c"d'), ("3", "ß")]
    plain = f"{tmp_path}/plain"
    tables.write_csv(rows, plain)
    assert sorted(tuple(r) for r in tables.read_csv(spark, plain, multi_line=False).collect()) == [("1", "a;b"), ("2", 'c"d'), ("3", "ß")]
    stream = tables.stream_csv(spark, plain, ["i", "t"], where=F.col("i") != "2")
    running = stream.writeStream.format("memory").queryName("csv_rows").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("csv_rows").collect()) == [("1", "a;b"), ("3", "ß")]


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a <&> b", 1.5, True, None), (2, " two\nlines ", None, False, "ß\x01"), (3, None, -2.0, None, "🙂")], "i int, t string, x double, f boolean, u string").coalesce(1)
    path = f"{tmp_path}/book.xlsx"
    workbook.write_workbook({"First Sheet": rows, "Empty": rows.limit(0)}, path)
    with pytest.raises(Exception):
        workbook.write_workbook({"First Sheet": rows}, path)
    assert "xl/styles.xml" in zipfile.ZipFile(path).namelist()
    out = workbook.read_sheet(spark, path, "firstsheet")
    assert out.columns == ["row_in_sheet", "i", "t", "x", "f", "u"]
    assert [tuple(r) for r in out.orderBy("row_in_sheet").collect()] == [(2, "1", "a <&> b", "1.5", "TRUE", None), (3, "2", " two\nlines ", None, "FALSE", "ß"), (4, "3", None, "-2.0", None, "🙂")]
    assert workbook.read_sheet(spark, path, "Empty").count() == 0
    headless = workbook.read_sheet(spark, path, "Empty", header_row=None)
    assert [tuple(r) for r in headless.collect()] == [(1, "i", "t", "x", "f", "u")]
    assert workbook.read_cells(spark, path, "First Sheet").where("row = 2").count() == 4
    assert [workbook.column_number(workbook.column_name(n)) for n in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
    # shared strings, as other writers store texts
    shared = f"{tmp_path}/shared.xlsx"
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(shared, "w") as new:
        for name in old.namelist():
            data = old.read(name)
            if name == "xl/worksheets/sheet2.xml":
                data = data.split(b"<sheetData>")[0] + b'<sheetData><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>'
            new.writestr(name, data)
        new.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>no</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
    assert [(r["row"], r["cells"]) for r in workbook.read_rows(spark, shared, "empty").collect()] == [(3, [None, "rich"])]


def test_samples_by_md5(spark):
    import hashlib

    out = [r["id"] for r in sampling.shuffled(spark.range(50), "id").collect()]
    assert out == sorted(range(50), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))


def test_plain_tokens_are_tokens(spark):
    texts = [t for t in ODD_TEXTS if t] + ["Ärger über Öl, naïve Straße 12x", "a\U00010a01b é\U0001e8d0x", "Οι μήλα x-y ABC"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t")).alias("a"), T.normalized_words(F.array_distinct(T.tokens(F.col("t")))).alias("w")).collect()
    spelled = lexical._Spelled()
    for r in out:
        assert [x.decode() if isinstance(x, bytes) else x for x in T.plain_tokens(r["t"])] == r["a"], r["t"]
        assert spelled.words(r["t"]) == set(r["w"])


def test_lexical_overlap_joins_no_words(spark, monkeypatch):
    """Nor do parts of the items or caches that are emptied change it."""
    docs = spark.createDataFrame([(i, f"hidden word{i} treasure{i % 7} laptops cat") for i in range(60)], "doc_id int, text string")
    items = spark.createDataFrame([(i, f"treasure{i} laptop cats word{i}") for i in range(9)] + [(9, None)], "item_id bigint, text string")
    made = lexical.overlap(docs, "doc_id", "text", items, "item_id", "text")
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, made.collect()))
    words = lambda df, k, c: df.select(k, T.normalized_words(T.tokens(F.col("text"))).alias(c))
    scores = words(docs, "doc_id", "a").crossJoin(words(items, "item_id", "b")).select("doc_id", "item_id", F.round(T.overlap_score(F.col("a"), F.col("b")), 6).alias("score")).where("score > 0")
    assert found == sorted(map(tuple, scores.collect()))
    monkeypatch.setattr(lexical, "MOST_ITEM_WORDS", 5)
    assert found == sorted(map(tuple, lexical.overlap(docs, "doc_id", "text", items, "item_id", "text").collect()))
    spelled, few = lexical._Spelled(), lexical._Items([["laptop", "xyz"], ["cat"]])
    monkeypatch.setattr(lexical, "MOST_CACHED", 1)
    for _ in range(3):
        places, scores = few.scores(spelled.words("laptops cat dog"))
        assert list(places) == [0, 1] and list(scores) == [0.5, 1.0]


def test_fingerprint_is_one_pass(spark):
    """The same as by expressions, with no pattern searched in the text and one step in Python."""
    texts = [*ODD_TEXTS, " a\tb \n", "\x85\xa0x\u2003 y\u3000", "\x1c a \x1f\x1d b\x1e", "\u2000e\u0301\u2001", "\u180e a\u200b b", "\u0301 x", " \u0301x", "\u1680\u2028q\u2029\u202f\u205fr\x0b\x0c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.left(F.sha2(F.concat(F.lit("text="), T.collapse(T.nfc(T.clean_value(F.col("t")))), F.lit("\x1f")), 256), F.lit(24))
    df = rows.select("t", T.fingerprint({"text": F.col("t")}).alias("new"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
    assert [r["new"] for r in df.collect()] == [r["old"] for r in rows.select(old.alias("old")).collect()]


def test_percentiles_by_ranges(spark):
    """Equal to percentile(), without its table of all values in one task."""
    for values in ([], [None], [3.5], [1.0, None, 2.0, 2.0, 2.0, 9.0], [float((i * 7919) % 1009) / 4 for i in range(3000)], [-0.0, 0.0, float("inf"), -5.5]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
        exact = df.selectExpr(*[f"round(percentile(x, {p}), 6)" for p in (0.25, 0.5, 0.75)]).first()
        made = stats.describe(df, "x")
        assert "percentile(" not in made._jdf.queryExecution().executedPlan().toString()
        r = made.first()
        assert (r["p25"], r["p50"], r["p75"]) == tuple(exact) and r["n"] == sum(v is not None for v in values), values
