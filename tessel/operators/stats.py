"""Rank, coverage and count statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import written


def style_profile(rows: DataFrame, class_col: str, title: str, description: str) -> DataFrame:
    """Per class: rows, seven percentages, two medians of word counts."""
    style = T.language_style(F.col(title))
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    flags = {
        "pct_greek": style == "greek", "pct_english": style == "english", "pct_mixed": style == "mixed", "pct_other": style == "other",
        "pct_uppercase": T.is_uppercase(F.col(title)), "pct_digit": T.has_digit(F.col(title)), "pct_same": F.col(title) == F.col(description),
    }
    return rows.where(F.col(class_col).isNotNull()).groupBy(class_col).agg(
        F.count("*").alias("n_examples"),
        *[share(flag).alias(name) for name, flag in flags.items()],
        F.round(F.median(T.word_count(F.col(title))), 1).alias("median_title_words"),
        F.round(F.median(T.word_count(F.col(description))), 1).alias("median_description_words"),
    )


def rank_summary(ranks: DataFrame, group: str, rank: str) -> DataFrame:
    """Exact percentiles with linear interpolation, and their ceilings."""
    at = lambda p: F.expr(f"percentile({rank}, {p})")
    return ranks.where(F.col(rank).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n_clients"), F.min(rank).alias("min_rank"), F.round(at(0.5), 6).alias("median_rank"), F.round(at(0.9), 6).alias("p90_rank"), F.round(at(0.95), 6).alias("p95_rank"),
        F.max(rank).alias("max_rank"), F.round(F.avg(rank), 6).alias("mean_rank"), F.ceil(F.round(at(0.9), 9)).cast("bigint").alias("p90_ceiling"), F.ceil(F.round(at(0.95), 9)).cast("bigint").alias("p95_ceiling"),
    )


def rank_distribution(ranks: DataFrame, group: str, rank: str) -> DataFrame:
    """Clients at each rank with share, running count and running percentage; totals come from a window, not a join."""
    counted = ranks.where(F.col(rank).isNotNull()).groupBy(group, rank).agg(F.count("*").alias("n_clients"))
    total = F.sum("n_clients").over(Window.partitionBy(group))
    running = F.sum("n_clients").over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.select(group, rank, "n_clients", F.round(100 * F.col("n_clients") / total, 6).alias("pct"), running.cast("bigint").alias("cumulative"), F.round(100 * running / total, 6).alias("cumulative_pct"))


def coverage_by_k(ranks: DataFrame, group: str, rank: str, max_k: str) -> DataFrame:
    """For k = 1 .. the largest max_k of the group: clients with a known rank of k or less, their total, and the coverage.

    Clients are counted by rank first, so what is expanded to k rows is one row a group."""
    counted = ranks.groupBy(group, rank).agg(F.count("*").alias("n"), F.max(max_k).alias("__most"))
    groups = counted.groupBy(group).agg(F.max("__most").alias("__most"), F.sum(F.when(F.col(rank).isNotNull(), F.col("n")).otherwise(0)).alias("total"))
    ks = groups.where("__most >= 1").select(group, "total", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__most").cast("bigint"))).alias("k"))
    at = ks.join(counted.where(F.col(rank).isNotNull()).select(F.col(group), F.col(rank).cast("bigint").alias("k"), "n"), [group, "k"], "left")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    return at.select(group, "k", inside.cast("bigint").alias("inside"), F.col("total").cast("bigint")).withColumn("coverage", F.round(F.when(F.col("total") > 0, F.col("inside") / F.col("total")), 6))


def coverage_summary(coverage: DataFrame, group: str) -> DataFrame:
    """The first k with a coverage of .90, .95 and 1 (compared as whole numbers)."""
    first = lambda percent: F.min(F.when((100 * F.col("inside") >= percent * F.col("total")) & (F.col("total") > 0), F.col("k")))
    return coverage.groupBy(group).agg(first(90).alias("k_90"), first(95).alias("k_95"), first(100).alias("k_100"))


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, p0 .. : exact percentiles with linear interpolation; null without values. Values are counted, sorted by range and
    written; only the ranges that hold a rank which is asked for are summed up row by row, so no task sees all values."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__n"))
    placed = written(counted.orderBy("__value").withColumn("__partition", F.spark_partition_id()), "percentiles")
    sizes = placed.groupBy("__partition").agg(F.sum("__n").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__partition")) - F.col("__size")  # one row a partition
    offsets = sizes.select("__partition", "__size", before.alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(0))).alias("__all"))
    position = lambda p: F.lit(p) * (F.col("__all") - 1)
    ranks = [(F.floor(position(p)), F.ceil(position(p))) for p in shares]
    holds = lambda start, n, rank: (start <= rank) & (rank < start + n)
    asked = F.lit(False)
    for rank in (r for both in ranks for r in both):
        asked = asked | holds(F.col("__before"), F.col("__size"), rank)
    rows = placed.join(offsets.where(asked), "__partition")
    start = F.col("__before") + F.sum("__n").over(Window.partitionBy("__partition").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    rows = rows.withColumns({"__start": start, "__number": F.col("__value").cast("double")})
    at = lambda rank: F.max(F.when(holds(F.col("__start"), F.col("__n"), rank), F.col("__number")))
    found = rows.agg(F.max("__all").alias("__all"), *[at(r).alias(f"__{side}{i}") for i, both in enumerate(ranks) for side, r in zip(("low", "high"), both)])
    between = lambda i, low, high: (high - position(shares[i])) * F.col(f"__low{i}") + (position(shares[i]) - low) * F.col(f"__high{i}")
    return found.select(*[F.when(low == high, F.col(f"__low{i}")).otherwise(between(i, low, high)).alias(f"p{i}") for i, (low, high) in enumerate(ranks)])


def describe(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    r = lambda c: F.round(c, digits)
    whole = df.agg(F.count(column).alias("n"), r(F.avg(column)).alias("mean"), r(F.stddev(column)).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return whole.crossJoin(percentiles(df, column, [0.25, 0.5, 0.75])).select("n", "mean", "std", "min", r("p0").alias("p25"), r("p1").alias("p50"), r("p2").alias("p75"), "max")  # one-row tables


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with a total row and a total column; every value of the domain has its column."""
    cells = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    out = df.rollup(row).agg(*cells, F.count_if(F.col(column).isin(*values)).alias("total"), F.grouping(row).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "total").otherwise(F.col(row)).alias(row), *[f"n_{v}" for v in values], "total")


def crosstab_shares(df: DataFrame, row: str, column: str, digits: int = 6) -> DataFrame:
    """Each cell as a share of its row."""
    counted = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(row)), digits))


def domain_counts(df: DataFrame, columns: list[str], domain: DataFrame) -> DataFrame:
    """Counts for every row of the domain, 0 where there is none."""
    return domain.join(df.groupBy(*columns).agg(F.count("*").alias("n")), columns, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def guarded_ratio(one: Column, two: Column, digits: int = 6) -> Column:
    """one / two; 0 where two is 0."""
    return F.round(F.when(two > 0, one / two).otherwise(0.0), digits)


def buckets(value: Column, edges: list[float]) -> Column:
    """The interval (a, b] that a value is in, as text; null at or under the first edge."""
    out = None
    for low, high in zip(edges, edges[1:]):
        name = f"({low:g}, {high:g}]"
        inside = (value > low) & (value <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out
