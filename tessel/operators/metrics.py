"""Classification and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _round(c: Column) -> Column:
    return F.round(c, 6)


def retrieval(ranks: DataFrame, grouping_sets: list[list[str]], rank: str = "rank", candidates: str = "n_candidates") -> DataFrame:
    """Top-1/5/10, mean reciprocal rank, mean rank and mean candidates, for several lists of grouping columns in one pass."""
    columns = list(dict.fromkeys(c for group in grouping_sets for c in group))
    top = [_round(F.avg((F.col(rank) <= k).cast("int"))).alias(f"top_{k}") for k in (1, 5, 10)]
    return ranks.groupingSets([[F.col(c) for c in group] for group in grouping_sets], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), *top, _round(F.avg(1 / F.col(rank))).alias("mrr"), _round(F.avg(rank)).alias("mean_rank"), _round(F.avg(candidates)).alias("mean_candidates"))


def random_baseline(sizes: DataFrame, n: str = "n_candidates") -> DataFrame:
    """What a random order would reach: mean 1/n, mean min(3, n)/n, mean H_n/n."""
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col(n).cast("int")), F.lit(0.0), lambda total, i: total + 1 / i)
    rows = sizes.where(F.col(n) > 0).groupBy(n).agg(F.count("*").alias("__times")).withColumn("__mrr", harmonic / F.col(n))
    total = F.sum("__times")
    weighted = lambda c: _round(F.sum(c * F.col("__times")) / total)
    return rows.agg(weighted(1 / F.col(n)).alias("recall_1"), weighted(F.least(F.lit(3), F.col(n)) / F.col(n)).alias("recall_3"), weighted(F.col("__mrr")).alias("mrr"))


def confusion(label: Column, predicted: Column) -> list[Column]:
    hit = lambda y, p: F.count_if((label == y) & (predicted == p))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")]


def rates(df: DataFrame, undefined_is_null: bool = False) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp, fp, fn, tn. A ratio without cases is 0; with undefined_is_null, slices of
    one class have no precision and F1, and slices without positives no recall."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall, f1 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)
    if undefined_is_null:
        both = (tp + fn > 0) & (fp + tn > 0)
        precision, f1, recall = F.when(both, precision), F.when(both, f1), F.when(tp + fn > 0, recall)
    return df.withColumns({"precision": _round(precision), "recall": _round(recall), "f1": _round(f1), "accuracy": _round(ratio(tp + tn, tp + fp + fn + tn))})


def threshold_curve(scored: DataFrame, label: str, score: str, steps: int = 100) -> DataFrame:
    """Confusion counts and rates at 0.00, 0.01 .. 1.00. Scores are counted by the last threshold they reach, then summed
    downwards: one pass over the rows, not one a threshold."""
    reached = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(F.round(F.col(score) * steps, 7)))).cast("int")
    counted = scored.groupBy(reached.alias("step")).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    grid = scored.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    filled = grid.join(counted, "step", "left").na.fill(0)
    down, whole = Window.orderBy(F.desc("step")), Window.partitionBy(F.lit(0))  # steps + 2 rows
    at = lambda c: F.sum(c).over(down)
    total = lambda c: F.sum(c).over(whole)
    out = filled.select("step", at("ones").alias("tp"), at("zeros").alias("fp"), (total("ones") - at("ones")).alias("fn"), (total("zeros") - at("zeros")).alias("tn"))
    return rates(out.where("step >= 0")).withColumn("threshold", F.round(F.col("step") / steps, 2)).drop("step")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the best F1, the highest on ties (F1 as tp / (2 tp + fp + fn): the same counts, the same double)."""
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return curve.orderBy(f1.desc(), F.desc("threshold")).limit(1)


def by_score(scored: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    """Counts of both labels at each score: what AUC and AP need, without a window over rows."""
    return scored.groupBy(*group, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))


def roc_auc(scored: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    """Share of pairs of a positive and a negative in the right order, ties half; null with one class."""
    before = Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("zeros").over(before), F.lit(0))
    counted = by_score(scored, label, score, group).withColumn("__won", F.col("ones") * (lower + F.col("zeros") / 2))
    n1, n0 = F.sum("ones"), F.sum("zeros")
    return counted.groupBy(*group).agg(n1.alias("n_pos"), n0.alias("n_neg"), _round(F.when((n1 > 0) & (n0 > 0), F.sum("__won") / (n1 * n0))).alias("roc_auc"))


def average_precision(scored: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    """Sum over falling scores of the gain in recall times the precision; equal scores are one step."""
    down = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = by_score(scored, label, score, group)
    stepped = counted.withColumn("__part", F.col("ones") * F.sum("ones").over(down) / F.sum(F.col("ones") + F.col("zeros")).over(down))
    return stepped.groupBy(*group).agg(_round(F.when(F.sum("ones") > 0, F.sum("__part") / F.sum("ones"))).alias("average_precision"))
