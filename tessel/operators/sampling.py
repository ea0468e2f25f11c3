"""Allocations and reproducible samples. Random order is a hash of the identifier and a seed: the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int = 42) -> list[Column]:
    """By the MD5 of seed and identifier, which any engine can recompute."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(*hash_order(id_col, seed))


def quotas(groups: DataFrame, order: list[Column], total: int) -> DataFrame:
    """total over the groups as evenly as can be: the first ones in order get one more. groups has one row a group."""
    n, place = F.count("*").over(Window.partitionBy(F.lit(0))), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return groups.withColumn("quota", (F.floor(F.lit(total) / n) + F.when(place <= F.lit(total) % n, 1).otherwise(0)).cast("bigint"))


def largest_remainder(counts: DataFrame, n: str, size: int, within: list[str], tie: list[Column]) -> DataFrame:
    """size shared in proportion to n: floors first, what is left to the largest remainders. Remainders are whole numbers.
    A group gets at most its n; counts has one row a group."""
    whole = Window.partitionBy(*(within or [F.lit(0)]))
    total = F.sum(n).over(whole)
    wanted = F.least(F.lit(size).cast("bigint"), total)
    floors = counts.withColumns({"__floor": F.floor(wanted * F.col(n) / total).cast("bigint"), "__rest": (wanted * F.col(n)) % total, "__wanted": wanted})
    place = F.row_number().over(whole.orderBy(F.desc("__rest"), *tie))
    return floors.withColumn("allocated", F.col("__floor") + F.when(place <= F.col("__wanted") - F.sum("__floor").over(whole), 1).otherwise(0)).drop("__floor", "__rest", "__wanted")


def stratified_sizes(counts: DataFrame, n: str, size: int | None, tie: list[Column]) -> DataFrame:
    """One row of every class first, the rest in proportion to what each class has left, never above it; all rows if size is
    None or no less than there are. counts has one row a class."""
    whole = Window.partitionBy(F.lit(0))
    total, classes = F.sum(n).over(whole), F.count("*").over(whole)
    if size is None:
        return counts.withColumn("allocated", F.col(n))
    rows = counts.withColumns({"__total": total, "__classes": classes})
    rows = rows.withColumn("__ok", F.when(F.col("__classes") > size, F.raise_error(F.lit("fewer rows than classes"))).cast("boolean"))
    rows = rows.withColumn("__capacity", F.col(n) - 1)
    capacity = F.sum("__capacity").over(whole)
    spare = F.lit(size) - F.col("__classes")
    rows = rows.withColumns({"__floor": F.when(capacity > 0, F.floor(spare * F.col("__capacity") / capacity)).otherwise(0).cast("bigint"), "__rest": F.when(capacity > 0, (spare * F.col("__capacity")) % capacity).otherwise(0)})
    place = F.row_number().over(whole.orderBy(F.desc("__rest"), *tie))
    rows = rows.withColumn("__more", F.when(place <= spare - F.sum("__floor").over(whole), 1).otherwise(0))
    allocated = F.when(F.coalesce(F.col("__ok"), F.lit(True)) & (F.col("__total") <= size), F.col(n)).otherwise(1 + F.col("__floor") + F.col("__more"))
    return rows.select(*counts.columns, allocated.cast("bigint").alias("allocated"))


def take(df: DataFrame, strata: list[str], sizes: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """`allocated` rows of each stratum, in hash order."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*hash_order(id_col, seed)))
    chosen = df.withColumn("__place", place).join(sizes.select(*strata, "allocated"), strata).where("__place <= allocated")
    return chosen.drop("__place", "allocated")


def sequential_samples(pools: list[tuple[str, DataFrame, int]], key: str, seed: int = 42) -> DataFrame:
    """A sample from each pool in turn; keys that an earlier sample took aren't taken again."""
    out, seen = None, None
    for name, pool, size in pools:
        free = pool if seen is None else pool.join(seen, key, "left_anti")
        part = free.orderBy(*hash_order(key, seed)).limit(size).withColumn("sample", F.lit(name))
        seen = part.select(key) if seen is None else seen.union(part.select(key))
        out = part if out is None else out.unionByName(part)
    return out
