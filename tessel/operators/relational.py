"""Joins, dedup and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match; the keys are left's."""
    renamed = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    condition = None
    for key in keys:
        one = left[key].eqNullSafe(renamed[f"__{key}"])
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def priority_dedup(df: DataFrame, keys: list[str], source: str, priorities: list[str], order: list[Column]) -> DataFrame:
    """The row from the most important source, then the first in order."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(source)), F.lit(0))
    return keep_first(df, keys, [F.when(rank == 0, len(priorities) + 1).otherwise(rank), *order])


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n_rows")).where("low <> high")


def drop_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of keys whose values agree. Conflicting keys are found by pre-aggregation, so a frequent key isn't gathered."""
    return df.join(conflicts(df, keys, value).select(*keys), keys, "left_anti")


def link_exactly_one(left: DataFrame, right: DataFrame, keys: list[str], right_id: str, order: list[Column], excluded: Column, known: Column) -> DataFrame:
    """left with right_id where the keys match exactly one row, and `reason`: excluded, unknown, no match, several matches,
    duplicate of an earlier linked row with the same keys, or null for linked rows. `excluded` and `known` are conditions over left."""
    matches = right.groupBy(*keys).agg(F.count("*").alias("n_matches"), F.min(right_id).alias(right_id))
    joined = null_safe_join(left, matches, keys).withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    reason = F.when(excluded, "excluded").when(~known, "unknown").when(F.col("n_matches") == 0, "no match").when(F.col("n_matches") > 1, "several matches")
    marked = joined.withColumn("reason", reason)
    # rejected rows aren't what a later row can repeat
    place = F.row_number().over(Window.partitionBy(*keys, F.col("reason").isNull()).orderBy(*order))
    return marked.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(place > 1, "duplicate"))


def join_validated(left: DataFrame, right: DataFrame, key: str, agree: list[str] = (), subset: bool = False) -> tuple[DataFrame, DataFrame]:
    """A 1:1 join, and one row of counts that are all 0 if it is sound: repeated keys on either side, left rows without a
    partner (unless subset), right rows without one, and rows that disagree in one of the columns `agree`."""
    other = right.select(*[F.col(c).alias(f"right_{c}" if c != key and c in left.columns else c) for c in right.columns])
    joined = left.join(other, key)
    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n"))
    differs = F.lit(False)
    for c in agree:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"right_{c}"))
    counts = (
        repeated(left).select(F.col("n").alias("repeated_left"))
        .crossJoin(repeated(right).select(F.col("n").alias("repeated_right")))
        .crossJoin(left.join(right, key, "left_anti").agg((F.lit(0) if subset else F.count("*")).cast("bigint").alias("left_without")))
        .crossJoin(right.join(left, key, "left_anti").agg(F.count("*").alias("right_without")))
        .crossJoin(joined.agg(F.count_if(differs).alias("disagree")))
    )  # five one-row tables
    return joined, counts


def coalesced_match(left: DataFrame, right: DataFrame, id_col: str, text_keys: list[str], order: list[Column]) -> DataFrame:
    """left with matched_id and method: by identifier, else the first right row with the same text keys, else null."""
    by_id = right.select(F.col(id_col).alias("__id")).distinct()
    first = keep_first(right, text_keys, order).select(*text_keys, F.col(id_col).alias("__first"))
    joined = left.join(by_id, F.col(id_col) == F.col("__id"), "left").join(first, text_keys, "left")
    method = F.when(F.col("__id").isNotNull(), "id").when(F.col("__first").isNotNull(), "text")
    return joined.withColumns({"matched_id": F.coalesce("__id", "__first"), "method": method}).drop("__id", "__first")


def anti_either(rows: DataFrame, known: DataFrame, group: str, one: str, two: str) -> DataFrame:
    """rows whose group has neither the one nor the other key among known rows."""
    return rows.join(known.select(group, one).distinct(), [group, one], "left_anti").join(known.select(group, two).distinct(), [group, two], "left_anti")


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """With the row's number in the order given: a range-partitioned sort, written, then the partitions' offsets (a row each) joined
    to it. No task sees all rows."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = df.orderBy(*order) if order else df
    rows = written(rows.withColumns({"__partition": F.spark_partition_id(), "__place": place}), "numbered")
    sizes = rows.groupBy("__partition").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__partition").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = sizes.select("__partition", F.coalesce(before, F.lit(0)).alias("__before"))
    number = (F.col("__before") + F.col("__place") + F.lit(start)).cast("bigint")
    return rows.join(offsets, "__partition").withColumn(name, number).drop("__partition", "__place", "__before")


def padded_ids(df: DataFrame, prefix: str, width: int, order: list[Column], name: str = "id", group: list[str] = ()) -> DataFrame:
    """Sequential identifiers such as N0001, within each group or over all rows."""
    if not group:
        rows = numbered(df, order, "__number")
        return rows.withColumn(name, F.format_string(f"{prefix}%0{width}d", "__number")).drop("__number")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.row_number().over(window)))


def join_indicated(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A 1:1 left join with `matched`, and one row of counts that are all 0 if every row has exactly one partner: keys that are
    repeated on either side, and left rows without a partner."""
    marked = right.withColumn("matched", F.lit(True))
    joined = left.join(marked, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    repeated = lambda df: df.groupBy(*keys).count().where("count > 1")
    counts = counted(repeated(left), "repeated_left").crossJoin(counted(repeated(right), "repeated_right")).crossJoin(joined.agg(F.count_if(~F.col("matched")).alias("unmatched")))  # one-row tables
    return joined, counts


def join_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of the first table that have a partner in all others, with the columns of all; a key is taken once on each side."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, keys)
    return out


def link_two_hops(left: DataFrame, middle: DataFrame, right: DataFrame, first: list[str], second: list[str], right_id: str, order: list[Column], unanimous: bool = False) -> DataFrame:
    """left with the `right_id` that it reaches through middle: rows of middle with equal `first` keys, each of which must find
    exactly one row of right by the `second` keys (null keys match), else null. Of several middle rows the first in `order` counts;
    with unanimous all count, and must reach one and the same id. Keys are met as distinct groups, so repeated rows multiply nothing."""
    reach = right.groupBy(*second).agg(F.count("*").alias("__n"), F.min(right_id).alias("__id"))
    hops = null_safe_join(middle, reach, second).withColumn("__sound", F.coalesce(F.col("__n") == 1, F.lit(False)))
    if unanimous:
        found = hops.groupBy(*first).agg(F.every("__sound").alias("__all"), F.min("__id").alias("__low"), F.max("__id").alias("__high"))
        found = found.select(*first, F.when(F.col("__all") & (F.col("__low") == F.col("__high")), F.col("__low")).alias(right_id))
    else:
        found = keep_first(hops, first, order).select(*first, F.when(F.col("__sound"), F.col("__id")).alias(right_id))
    return null_safe_join(left, found, first)
