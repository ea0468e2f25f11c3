"""Queries over all rows of their tables, against brute force on small tables."""

from __future__ import annotations

import re

from tessel.functions import text as T
from tessel.plans import registered
from tessel.scratch import new_path


def run(spark, name, tables):
    sf_dir = new_path(spark, "whole")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/{table}.parquet")
    return [tuple(r) for r in registered()[name][0](spark, sf_dir).collect()]


def spelled(word):
    for a, b in T.GREEK_PAIRS:
        word = word.replace(a, b)
    word = "".join(T.GREEK_LETTERS.get(c, c) for c in word)
    for a, b in T.LATIN_SPELLINGS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def lexical(one, two):
    stop = {spelled(T._fold(w)) for w in T.STOPWORDS}
    a, b = ({w for x in re.findall("[a-zα-ω0-9]+", T._fold(t or "")) if len(w := spelled(x)) >= 2} - stop for t in (one, two))
    small, large = (a, b) if len(a) <= len(b) else (b, a)

    def same(x, y):
        n = min(len(x), len(y))
        need = max(5, -(-7 * n // 10))
        return x == y if n < 5 else x[:need] == y[:need]

    return round(sum(any(same(x, y) for y in large) for x in small) / len(small), 6) if small else 0.0


def test_lexical_overlap(spark):
    pad = " ".join(f"filler{i}" for i in range(100, 140))
    docs = [(0, f"{pad} hidden treasure"), (1, "κτίριο laptops sixty"), (2, ""), (3, None), (4, "programming programmer cat cats"), (5, "hidden")]
    items = [(7, "hidden treasure"), (45, "laptop κτιρίου"), (199, f"{pad} treasures"), (60, ""), (61, "programmed cat dog")]
    expected = {(d, i): lexical(t, u) for d, t in docs for i, u in items}
    tables = {"documents": (docs, "doc_id bigint, text string"), "benchmark": (items, "item_id bigint, text string")}
    assert expected[0, 7] == 1 and expected[1, 45] > 0
    assert sorted(run(spark, "lexical_overlap", tables)) == sorted((d, i, s) for (d, i), s in expected.items() if s)
    bands = [("= 0" if s == 0 else "0–0.1" if s < 0.1 else ">= 0.1") for s in expected.values()]
    assert sorted(run(spark, "lexical_band_counts", tables)) == sorted((b, bands.count(b)) for b in set(bands))


def test_connected_components(spark):
    rows = [(37 * i, 1000 + i) for i in range(6)] + [(37 * i + 1, 1000 + i) for i in range(5)] + [(37 * i + 1, 1001 + i) for i in range(5)] + [(437, 1700), (37, 2000), (900, 3000), (901, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for order, customer in rows:
        if customer is not None:
            parent[root(("g", str(order)))] = root(("h", str(customer)))
    groups = {}
    for kind, name in parent:
        if kind == "g":
            groups.setdefault(root((kind, name)), []).append(name)
    expected = sorted((name, min(members)) for members in groups.values() for name in members)
    assert 1 < len(groups) < 5
    assert sorted(run(spark, "connected_components", {"orders": (rows, "o_orderkey bigint, o_custkey bigint")})) == expected


def test_exact_one_link_reasons(spark):
    orders = [(1, 501, "2-HIGH", 1.0), (2, 501, "2-HIGH", 2.0), (3, 96, "1-URGENT", 1.0), (4, 96, "2-HIGH", 7.5), (5, 14001, "2-HIGH", 3.0), (6, 77, "2-HIGH", 1.0), (7, 64, "2-HIGH", 1.0), (8, None, "2-HIGH", 1.0), (9, 500, "2-HIGH", 1.0)]
    customers = [(501,), (96,), (14001,), (64,), (65,), (1,), (500,)]  # every fifth has the key before it
    out = run(spark, "exact_one_link_reasons", {"orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double"), "customer": (customers, "c_custkey bigint")})
    assert sorted(out) == [(1, 501, None), (2, 501, "duplicate"), (3, 96, "unknown"), (4, 96, "excluded"), (5, 14001, None), (6, None, "no match"), (7, 64, "several matches"), (8, None, "no match"), (9, None, "no match")]


def test_verdict_caches(spark):
    # event_ids with every remainder by 3 and 30, users over 50
    events = [(i, f"2024-01-{1 + i // 2:02d} 00:00:00" if i < 60 else None, 45 + i % 11, ("view", "click")[i % 2], float(i)) for i in range(62)]
    df = spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, event_type string, value double").selectExpr("event_id", "to_timestamp(ts) AS ts", "user_id", "event_type", "value")
    tables = {"events": (df.collect(), df.schema)}
    first = {}
    for i, _, user, kind, value in events:
        first.setdefault((user, kind), (value, i))
    assert sorted(run(spark, "verdict_cache_first", tables)) == sorted((*k, *v) for k, v in first.items())
    log = {(u, k) for _, ts, u, k, _ in events if ts and ts < "2024-01-16"}
    requests = [(u, k) for _, ts, u, k, _ in events if not ts or ts >= "2024-01-16"]
    hits = sum(r in log for r in requests)
    assert len(requests) + sum(1 for e in events if e[1] and e[1] < "2024-01-16") == len(events)
    assert sorted(run(spark, "verdict_cache_lookup", tables)) == [("hit", hits), ("miss", len(requests) - hits)]


def test_two_hop_links_of_equal_lines(spark):
    """The first of an order's lines with the least number, by its place in a table of several files."""
    lines = [(o, 1 + k // 16, 1 + (7 * o + 5 * k) % 11) for k in range(40) for o in range(9)] + [(9, None, 3), (9, 2, 4)]
    tables = {
        "orders": ([(o,) for o in range(11)], "o_orderkey bigint"), "lineitem": (lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint"),
        "supplier": ([(s, s) for s in range(1, 12)], "s_suppkey bigint, s_nationkey int"),
    }
    expected = [(o, str(1 + 7 * o % 11), None) for o in range(9)] + [(9, "4", None), (10, None, None)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # tasks of other rows than the files'
    try:
        assert sorted(run(spark, "two_hop_links", tables)) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
