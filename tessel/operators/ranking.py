"""Rankings of candidates within a class, and what is mined from them, for any table of ranked pairs; blocks.py has the same for all pairs of a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine


def class_pairs(items: DataFrame, id_col: str, class_col: str, vector_col: str, clients: DataFrame | None = None) -> DataFrame:
    """client_id, candidate_id, class, similarity: each client with every other item of its class (a join blocked by class).

    Only ids and vectors are carried. The similarity is rounded to 9 digits, ties are for the candidate's id to break."""
    clients = items if clients is None else clients
    left = clients.select(F.col(id_col).alias("client_id"), F.col(class_col).alias("class"), F.col(vector_col).alias("__a"))
    right = items.select(F.col(id_col).alias("candidate_id"), F.col(class_col).alias("class"), F.col(vector_col).alias("__b"))
    joined = left.join(right, "class").where("client_id <> candidate_id")
    return joined.select("client_id", "candidate_id", "class", cosine(F.col("__a"), F.col("__b")).alias("similarity"))


def by_client(*order: Column) -> Window:
    return Window.partitionBy("client_id").orderBy(*order)


def distance_ranks(pairs: DataFrame) -> DataFrame:
    """With distance and distance_rank (1: nearest)."""
    rank = F.row_number().over(by_client(F.desc("similarity"), F.asc("candidate_id"))).cast("bigint")
    return pairs.withColumns({"distance": F.round(1 - F.col("similarity"), 9), "distance_rank": rank})


def top_k(ranked: DataFrame, k: int, rank: str = "distance_rank") -> DataFrame:
    return ranked.where(F.col(rank) <= k)


def first_relevant(ranked: DataFrame, relevant: Column) -> DataFrame:
    """client_id, first_rank: the best rank of a relevant candidate; null without one."""
    return ranked.groupBy("client_id").agg(F.min(F.when(relevant, F.col("distance_rank"))).alias("first_rank"))


def competition_rank(pairs: DataFrame, correct: DataFrame) -> DataFrame:
    """client_id, rank: 1 + the wrong candidates that score higher than the correct one. Ties and other correct candidates don't count.

    correct: client_id, candidate_id, is_target (the one whose rank is asked for)."""
    marked = pairs.join(correct, ["client_id", "candidate_id"], "left")
    target = marked.where("is_target").select("client_id", F.col("similarity").alias("__target"))
    return marked.join(target, "client_id").groupBy("client_id").agg((1 + F.count_if((F.col("similarity") > F.col("__target")) & F.col("is_target").isNull())).cast("bigint").alias("rank"))


def competition_by_client(pairs: DataFrame, correct: str) -> DataFrame:
    """client_id, class, n_candidates, rank of the correct candidate with the smallest id, as competition_rank() has it, for pairs in which
    the column `correct` marks the correct ones. One shuffle, by client; clients without a correct candidate are left out."""
    target = F.min_by("similarity", F.when(F.col(correct), F.col("candidate_id"))).over(Window.partitionBy("client_id"))
    marked = pairs.withColumn("__target", target).where(F.col("__target").isNotNull())
    better = F.count_if((F.col("similarity") > F.col("__target")) & ~F.col(correct))
    return marked.groupBy("client_id", "class").agg((1 + better).cast("bigint").alias("rank"), F.count("*").alias("n_candidates"))


def scoped_pairs(items: DataFrame, id_col: str, class_col: str, source_col: str, vector_col: str, clients: DataFrame | None = None) -> DataFrame:
    """client_id, candidate_id, class, similarity, scope: candidates of the client's class (scope class), and those of its class and
    source again (scope class+source)."""
    side = lambda rows, name, vector: rows.select(F.col(id_col).alias(name), F.col(class_col).alias("class"), F.col(source_col).alias(f"__source_{name}"), F.col(vector_col).alias(vector))
    pairs = side(items if clients is None else clients, "client_id", "__a").join(side(items, "candidate_id", "__b"), "class").where("client_id <> candidate_id")
    near = F.col("__source_client_id").eqNullSafe(F.col("__source_candidate_id"))
    scopes = F.explode(F.when(near, F.array(F.lit("class"), F.lit("class+source"))).otherwise(F.array(F.lit("class"))))
    return pairs.select("client_id", "candidate_id", "class", cosine(F.col("__a"), F.col("__b")).alias("similarity"), scopes.alias("scope"))


def distance_columns(ranked: DataFrame, k: int = 10) -> DataFrame:
    """client_id, class, n_candidates, d1 .. dk (null where there are fewer)."""
    columns = [F.max(F.when(F.col("distance_rank") == i, F.col("distance"))).alias(f"d{i}") for i in range(1, k + 1)]
    return ranked.groupBy("client_id", "class").agg(F.count("*").alias("n_candidates"), *columns)


def outside_pick(ranked: DataFrame, text: str, nearest: int, beyond: Column) -> DataFrame:
    """The `nearest` first candidates with different texts (kind semi_hard), and of the candidates with none of those texts the
    first beyond the rank `beyond` (outside_k95), else the last (farthest_fallback). Ranks are those of the whole list."""
    twins = Window.partitionBy("client_id", text)
    rows = ranked.withColumn("__first", F.min("distance_rank").over(twins))
    heads = rows.where("distance_rank = __first").withColumn("__place", F.row_number().over(by_client(F.asc("distance_rank"))))
    near = heads.where(F.col("__place") <= nearest).select("client_id", "candidate_id", "distance_rank", F.lit("semi_hard").alias("kind"))
    rest = rows.join(heads.where(F.col("__place") > nearest).select("client_id", text), ["client_id", text], "left_semi")
    outside = F.min(F.when(F.col("distance_rank") > beyond, F.struct("distance_rank", "candidate_id")))
    last = F.max(F.struct("distance_rank", "candidate_id"))
    easy = rest.groupBy("client_id").agg(outside.alias("outside"), last.alias("last"))
    pick = F.coalesce("outside", "last")
    easy = easy.select("client_id", pick["candidate_id"].alias("candidate_id"), pick["distance_rank"].alias("distance_rank"), F.when(F.col("outside").isNotNull(), "outside_k95").otherwise("farthest_fallback").alias("kind"))
    return near.union(easy)


def outside_order(ranked: DataFrame, beyond: Column) -> DataFrame:
    """With candidate_order: if a client has candidates beyond the rank, those alone, nearest first; else all, farthest first."""
    flagged = ranked.withColumn("__outside", F.col("distance_rank") > beyond)
    flagged = flagged.withColumn("__any", F.max("__outside").over(Window.partitionBy("client_id"))).where("__outside OR NOT __any")
    key = F.when(F.col("__any"), F.col("distance_rank")).otherwise(-F.col("distance_rank"))
    return flagged.withColumn("candidate_order", F.row_number().over(by_client(key)).cast("bigint")).drop("__outside", "__any")


def semi_hard(pairs: DataFrame, positive: DataFrame, text: str, least_margin: float = 1e-4) -> DataFrame:
    """Candidates whose similarity is under the positive's by more than least_margin, one a text, by margin, then rank: with margin and order.

    positive: client_id, positive_similarity."""
    joined = pairs.join(positive, "client_id").withColumn("margin", F.round(F.col("positive_similarity") - F.col("similarity"), 9)).where(F.col("margin") > least_margin)
    order = [F.asc("margin"), F.asc("distance_rank")]
    first = F.row_number().over(Window.partitionBy("client_id", text).orderBy(*order))
    heads = joined.withColumn("__first", first).where("__first = 1").drop("__first")
    return heads.withColumn("semi_hard_order", F.row_number().over(by_client(*order)).cast("bigint"))


def early_stop(candidates: DataFrame, order: str, skipped: Column, stops: Column, most: int | None = 3) -> DataFrame:
    """The rows that an ordered search looks at: up to `most` candidates that aren't skipped, ending with the first that stops it.
    Skipped rows are logged with a null position and use none."""
    before = by_client(F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.withColumns({
        "__used": F.coalesce(F.sum(F.when(skipped, 0).otherwise(1)).over(before), F.lit(0)),
        "__stopped": F.coalesce(F.max(F.when(stops & ~skipped, 1).otherwise(0)).over(before), F.lit(0)),
    })
    rows = rows.where("__stopped = 0") if most is None else rows.where(f"__stopped = 0 AND __used < {most}")
    return rows.withColumn("position", F.when(~skipped, F.col("__used") + 1).cast("bigint")).drop("__used", "__stopped")


def chunks(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """With position (from 1) and chunk (from 0) within the group."""
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")
    return rows.withColumn("position", position).withColumn("chunk", F.floor((F.col("position") - 1) / size).cast("bigint"))


def first_chunks(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """The first chunk of each group."""
    return chunks(rows, group, order, size).where("chunk = 0").drop("chunk")
