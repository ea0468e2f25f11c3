"""Splits without leakage. Sequential algorithms run over one small row a group, never over rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .relational import numbered


def group_components(rows: DataFrame, group: str, client: str) -> DataFrame:
    """group, component: groups that share a client, directly or through others, have one component (the smallest group)."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = rows.where(F.col(group).isNotNull() & F.col(client).isNotNull()).select(node("g", group).alias("a"), node("h", client).alias("b")).distinct()
    found = connected_components(edges)
    return found.where(F.col("node").startswith("g")).select(F.substring("node", 2, 1 << 30).alias(group), F.substring("component", 2, 1 << 30).alias("component"))


def fixed_splits(rows: DataFrame, component: str, split: str) -> DataFrame:
    """component, split of those components that have rows with a fixed split; an error if they have two."""
    found = rows.where(F.col(split).isNotNull()).groupBy(component).agg(F.min(split).alias("low"), F.max(split).alias("high"))
    return found.select(component, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("a component has two splits"))).alias(split))


def subset_sum(weights: list[int], needed: int) -> list[int]:
    """Places of weights that sum to exactly `needed`; an error if none do."""
    last: dict[int, int | None] = {0: None}
    for i, weight in enumerate(weights):
        for total in sorted(last, reverse=True):
            if total + weight <= needed and total + weight not in last:
                last[total + weight] = i
    if needed not in last:
        raise ValueError(f"no groups sum to {needed}")
    out = []
    while needed:
        i = last[needed]
        out.append(i)
        needed -= weights[i]
    return out[::-1]


def validation_target(total: int, fraction: float, fixed: int) -> int:
    needed = ceil(total * fraction) - fixed
    if needed < 0:
        raise ValueError("the fixed groups are more than the target")
    return needed


def stratified_group_folds(counts: dict[str, dict[str, int]], n_folds: int, seed: int = 42) -> dict[str, int]:
    """Fold of each group, from its counts by stratum: the most uneven groups first, each to the fold where the strata stay
    most alike, then to the one with the fewest rows."""
    strata = sorted({s for c in counts.values() for s in c})
    totals = {s: sum(c.get(s, 0) for c in counts.values()) for s in strata}

    def spread(values: list[float]) -> float:
        mean = sum(values) / len(values)
        return sum((v - mean) ** 2 for v in values) / len(values)

    order = sorted(counts, key=lambda g: (-spread([counts[g].get(s, 0) for s in strata]), zlib.crc32(f"{seed}:{g}".encode()), g))
    folds = [defaultdict(int) for _ in range(n_folds)]
    out = {}
    for group in order:
        def cost(k: int) -> tuple[float, int, int]:
            uneven = 0.0
            for s in strata:
                shares = [(folds[j][s] + (counts[group].get(s, 0) if j == k else 0)) / totals[s] for j in range(n_folds)]
                uneven += spread(shares)
            return round(uneven / len(strata), 12), sum(folds[k].values()), k

        best = min(range(n_folds), key=cost)
        out[group] = best
        for s, n in counts[group].items():
            folds[best][s] += n
    return out


def assign_folds(rows: DataFrame, group: str, stratum: str, n_folds: int, seed: int = 42, most_exact: int = 50_000) -> DataFrame:
    """group, fold. Up to most_exact rows of (group, stratum) counts are balanced one by one on the driver, as for data sets of labelled
    pairs. Beyond that nothing is collected: groups are dealt within classes of alike groups (their largest stratum and the order of
    magnitude of their rows), by a hash of their name, in turn by number within the class, so that each class is spread evenly."""
    sizes = rows.groupBy(F.col(group).cast("string").alias("g"), F.col(stratum).cast("string").alias("s")).agg(F.count("*").alias("n"))
    small = sizes.limit(most_exact + 1).collect()
    if len(small) > most_exact:
        alike = sizes.groupBy("g").agg(F.max_by("s", F.struct("n", "s")).alias("kind"), F.floor(F.log2(F.sum("n"))).alias("scale"))
        dealt = numbered(alike, [F.col("kind"), F.col("scale"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("g")))], "__number", 0)
        return dealt.select(F.col("g").alias(group), (F.col("__number") % n_folds).cast("int").alias("fold"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in small:
        counts[r["g"]][r["s"]] = r["n"]
    folds = stratified_group_folds(counts, n_folds, seed)
    return rows.sparkSession.createDataFrame(sorted(folds.items()), f"{group} string, fold int")


def greedy_groups(sizes: list[tuple[str, str, int]], fraction: float, seed: int = 42) -> set[str]:
    """Groups to set aside: class by class in order of name, groups in hash order are added until the class has the fraction
    of its rows; groups chosen for an earlier class count. sizes: class, group, rows."""
    by_class: dict[str, dict[str, int]] = defaultdict(dict)
    for name, group, n in sizes:
        by_class[name][group] = by_class[name].get(group, 0) + n
    chosen: set[str] = set()
    for name in sorted(by_class):
        groups = by_class[name]
        target, have = fraction * sum(groups.values()), 0
        for group in sorted(groups, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g)):
            if have >= target:
                break
            chosen.add(group)
            have += groups[group]
    return chosen


def greedy_split(rows: DataFrame, class_col: str, group_col: str, percent: int, seed: int = 42) -> DataFrame:
    """greedy_groups() over a table: as all classes take groups in one order, each takes those that begin before it has its percent of
    rows, and what is set aside is the union. Groups are counted first, so a window sees a row for each group of a class."""
    sizes = rows.where(F.col(group_col).isNotNull()).groupBy(class_col, group_col).agg(F.count("*").alias("n"))
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(group_col).cast("string"))), F.col(group_col)]
    whole = Window.partitionBy(class_col)
    before = F.coalesce(F.sum("n").over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumns({"__before": before, "__total": F.sum("n").over(whole)}).where(100 * F.col("__before") < percent * F.col("__total")).select(group_col).distinct()


def remove_leaks(rows: DataFrame, client: str, source: str, priorities: list[str]) -> DataFrame:
    """Rows of each client from its most important source alone."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(source))
    best = rows.withColumn("__rank", rank).groupBy(client).agg(F.min("__rank").alias("__best"))
    return rows.join(best, client).where(rank == F.col("__best")).drop("__best")
