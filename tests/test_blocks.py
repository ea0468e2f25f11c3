"""Lists of all pairs of a class, against SQL on tables with odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from test_queries import plain

from tessel.operators import blocks
from tessel.plans import registered
from tessel.scratch import new_path

LISTED = {
    "F1": "best_and_first_relevant", "F2": "candidate_scopes", "F3": "class_distance_rank", "F4": "client_summary_d1_d10", "F5": "coverage_by_k", "F6": "coverage_summary", "F7": "early_stop_first_invalid",
    "F8": "early_stop_unbounded", "F9": "margin_buckets", "F10": "nearest_in_class", "F11": "negative_outside_k95", "F12": "ordered_candidates", "F13": "rank_distribution_cumulative",
    "F14": "rank_summary_percentiles", "F15": "retrieval_metrics", "F16": "semi_hard_margin", "F17": "similarity_summary", "F18": "topk_context_negatives", "F19": "triplets",
}


def items(repeated: bool) -> list[tuple]:
    """Vectors of three large classes and some small ones, with ties, nulls, and, if asked for, ids that come twice."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        v = rng.normal(size=8).astype(np.float32)
        v /= np.linalg.norm(v)
        rows.append((i, [float(x) for x in v], i % 3 if i < 250 else i))
    rows += [(300 + i, rows[3 * i][1], 0) for i in range(20)]  # copies: ties
    rows += [(400, None, 1), (402, [float("nan")] * 8, 2), (None, rows[5][1], 2), (403, rows[6][1], None), (404, [3.0] * 8, 2), (405, rows[7][1], 77), (-5, rows[8][1], 0), (-8, rows[10][1], 0)]
    if repeated:
        extra = rng.normal(size=(8, 8))
        extra /= np.linalg.norm(extra, axis=1)[:, None]
        rows = [r for r in rows if r[0] is not None and 0 <= r[0] < 250] + [(k, [float(x) for x in np.float32(v)], c) for v, k, c in zip(extra, (7, 7, 8, 9, 500, 500, 501, 501), (1, 0, 2, 2, 1, 1, 88, 89))]
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    out = {}
    for repeated in (False, True):
        out[repeated] = new_path(spark, "vectors")
        spark.createDataFrame(items(repeated), "vec_id bigint, embedding array<float>, label int").write.parquet(f"{out[repeated]}/embeddings.parquet")
    return out


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("name", LISTED.values())
def test_odd_vectors(spark, tables, name, repeated):
    if repeated and name == "retrieval_metrics":
        return  # a target that comes twice is two ranks in the SQL; here it is the first
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tables[repeated].removeprefix('file://')}/embeddings.parquet/*.parquet'")
    function, sql = registered()[name]
    df = function(spark, tables[repeated])
    result = con.sql(sql)
    place = [result.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in result.fetchall())


@pytest.mark.parametrize("name", LISTED.values())
def test_pairs_are_no_rows(spark, tables, name):
    """Similarities are worked out as matrices, not in a join of the class with itself."""
    plan = registered()[name][0](spark, tables[False])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_units_in_order():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    vectors = rng.choice([0.1, 0.2, 0.3, -0.7, 1e-5, 5e-5], size=(300, 6))  # many products end in 5
    group = blocks.Group(pa.scalar(1), pa.table({"id": np.arange(300), "own": np.ones(300, bool), "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())), "extra": np.zeros(300, np.int32)}))
    for some, units in group.tiles():
        for i in some:
            total = np.zeros(300)
            for k in range(6):
                total = total + vectors[i, k] * vectors[:, k]
            scaled = np.clip(total, -1, 1) * 1e9
            assert (units[list(some).index(i)] == np.trunc(scaled + np.copysign(0.5, scaled))).all()
