"""Each item with all others of its class, in blocks: what is asked of a client's ranked list is worked out in the task that makes the list.

The pairs of a class grow with its square, so they are made as matrices in Python and, but for the queries that return them, never
become rows. A class is no key by itself: its clients are dealt into blocks by a hash, and each block meets the whole class in one
task, which holds the class's vectors and the lists of a few clients. Similarities are whole numbers of 1e-9 here, as
functions.vector.cosine rounds them: the product of matrices is used where its error can't change the rounding, the others are
summed in order. Halves are rounded as SQL's round() does."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from ..shipping import ship

UNIT, MOST_PAIRS = 10**9, 1 << 17


@dataclass
class Lists:
    """The ranked lists of some clients of a class: a row for each, nearest first, ties by the order of the candidates' ids."""

    label: pa.Scalar
    clients: np.ndarray
    candidates: np.ndarray  # clients x candidates
    units: np.ndarray  # similarities
    place: np.ndarray  # the candidates' places in the order of ids
    client_place: np.ndarray
    extra: np.ndarray  # codes of the extra column, by place

    @property
    def ranks(self) -> np.ndarray:
        return np.arange(1, self.units.shape[1] + 1)

    def classes(self, n: int) -> pa.Array:
        return pa.repeat(self.label, n)


def round_half(x: np.ndarray) -> np.ndarray:
    """To whole numbers, halves away from zero."""
    whole = np.rint(x)
    half = np.trunc(x)
    return np.where(np.abs(x - half) == 0.5, half + np.sign(x), whole)


def rounded(units: np.ndarray, digits: int = 9) -> np.ndarray:
    """Units as numbers of so many digits."""
    return units / UNIT if digits == 9 else round_half(units / UNIT * 10**digits) / 10**digits


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """A matrix, and the vectors' lengths where they differ. A vector that is null or has a null is all NaN."""
    values, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    if len(numbers) == width * len(column):
        return numbers.reshape(len(column), width), None
    out, ends = np.zeros((len(column), width)), np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends, sizes)):
        out[i, :size] = numbers[end - size : end]
    out[column.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return out, sizes


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first number to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.fmax(-1.0, np.fmin(1.0, x)) * UNIT  # as greatest() and least() do, NaN becomes 1


class Group:
    """A class, in the order of ids, and the clients of one block (their places)."""

    def __init__(self, label: pa.Scalar, rows: pa.Table):
        self.label, rows = label, rows.combine_chunks()
        column = lambda name: rows.column(name).chunk(0)
        self.ids = column("id").to_numpy(zero_copy_only=False)
        self.clients = np.flatnonzero(column("own").to_numpy(zero_copy_only=False))
        self.vectors, self.sizes = _vectors(column("vector"))
        extra = column("extra")
        self.named = extra[0].as_py()  # what all rows of a class have, for what is asked by class
        self.extra = extra.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        self.most = float(np.sqrt(np.fmax.reduce(np.einsum("ij,ij->i", self.vectors, self.vectors), initial=0.0)))

    def units(self, clients: np.ndarray) -> np.ndarray:
        mine = self.vectors[clients]
        with np.errstate(all="ignore"):
            scaled = _scaled(mine @ self.vectors.T)
            off = 2 * (self.vectors.shape[1] + 1) * 1.2e-16 * UNIT * self.most * self.most + 1e-6
            a, b = np.nonzero(~(np.abs(scaled - np.floor(scaled) - 0.5) > off))
            for k in range(0, len(a), 1 << 15):
                i, j = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                scaled[i, j] = _scaled(_in_order(mine[i], self.vectors[j]))
        if self.sizes is not None:
            scaled[self.sizes[clients][:, None] != self.sizes[None, :]] = UNIT
        return round_half(scaled).astype(np.int64)

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some clients, and their similarities to the whole class."""
        step = max(1, MOST_PAIRS // max(1, len(self.ids)))
        for k in range(0, len(self.clients), step):
            some = self.clients[k : k + step]
            yield some, self.units(some)

    def lists(self) -> Iterator[Lists]:
        """For clients whose id no other row has."""
        if len(self.ids) < 2:
            return
        order = np.arange(len(self.ids))
        for some, units in self.tiles():
            key = (UNIT - units) << 32 | order
            key[np.arange(len(some)), some] = np.iinfo(np.int64).max  # itself: last
            key.sort(axis=1)
            key = key[:, :-1]
            place = key & 0xFFFFFFFF
            yield Lists(self.label, self.ids[some], self.ids[place], UNIT - (key >> 32), place, some, self.extra)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Rows come in the order of class, block, id."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        label, block = batch.column("class"), batch.column("block")
        new = pc.or_(pc.not_equal(label[1:], label[:-1]), pc.not_equal(block[1:], block[:-1])) if batch.num_rows > 1 else pa.array([], pa.bool_())
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            found = label[int(a)], block[int(a)]
            if parts and found != key:
                yield Group(key[0], pa.Table.from_batches(parts))
                parts = []
            key = found
            parts.append(batch.slice(a, b - a))
    if parts:
        yield Group(key[0], pa.Table.from_batches(parts))


def by_group(items: DataFrame, id_col: str, class_col: str, vector_col: str, make: Callable[[], Callable[[Group], Iterator[list]]], schema: str, extra: str | None = None, clients: str = "true", blocks: int = 16) -> DataFrame:
    """What make() yields for each group: lists of columns (arrays), in the order of the schema, in which {id} and {label} are the types of
    these columns. clients: a condition on items."""
    spark = items.sparkSession
    ship(spark)
    kept = items.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull())
    kept = kept.select(F.col(class_col).alias("class"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), (F.col(extra) if extra else F.lit(0)).alias("extra"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("home"), F.coalesce(F.expr(clients), F.lit(False)).alias("client"))
    dealt = kept.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    dealt = dealt.select("class", "block", "id", "vector", "extra", (F.col("client") & (F.col("home") == F.col("block"))).alias("own"))
    parts = max(4 * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    types = spark.createDataFrame([], schema.format(id=items.schema[id_col].dataType.simpleString(), label=items.schema[class_col].dataType.simpleString())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, found = to_arrow_schema(types), make()
        for group in _groups(batches):
            for columns in found(group):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, out)], schema=out)

    return dealt.repartition(parts, "class", "block").sortWithinPartitions("class", "block", "id").mapInArrow(run, types)


def by_client(items: DataFrame, id_col: str, class_col: str, vector_col: str, take: Callable[[Lists], list], schema: str, plain: Callable[[DataFrame], DataFrame], extra: str | None = None, blocks: int = 16) -> DataFrame:
    """What `take` yields for the ranked lists of all clients. plain(items with the column __client): the same by joins and windows, for
    the marked clients; it is used for those whose id is repeated, as their lists may span classes."""
    repeated = items.groupBy(id_col).count().where("count > 1").select(id_col, F.lit(True).alias("__client"))
    make = lambda: lambda group: map(take, group.lists())
    if repeated.isEmpty():
        return by_group(items, id_col, class_col, vector_col, make, schema, extra, blocks=blocks)
    marked = items.join(repeated, id_col, "left").withColumn("__client", F.coalesce("__client", F.lit(False)))
    return by_group(marked, id_col, class_col, vector_col, make, schema, extra, "NOT __client", blocks).unionByName(plain(marked))


def _nullable(values: np.ndarray, given: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~given)


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row has a hit, and the place of the first."""
    return hit.any(axis=1), hit.argmax(axis=1)


def _rows(x: np.ndarray) -> np.ndarray:
    return np.arange(len(x))[:, None]


Condition = Callable[[np.ndarray, np.ndarray], np.ndarray]  # of the ids of clients (a column) and of candidates


def all_ranks(digits: int) -> Callable[[Lists], list]:
    """client_id, candidate_id, class, similarity, distance, distance_rank"""

    def take(x: Lists) -> list:
        n, m = x.units.shape
        units = x.units.ravel()
        return [np.repeat(x.clients, m), x.candidates.ravel(), x.classes(n * m), rounded(units, digits), rounded(UNIT - units, digits), np.tile(x.ranks, n)]

    return take


def distance_columns(k: int, digits: int) -> Callable[[Lists], list]:
    """client_id, class, n_candidates, d1 .. dk"""

    def take(x: Lists) -> list:
        n, m = x.units.shape
        near = rounded(UNIT - x.units[:, :k], digits)
        return [x.clients, x.classes(n), np.full(n, m), *[near[:, i] if i < m else pa.nulls(n, pa.float64()) for i in range(k)]]

    return take


def first_relevant(relevant: Condition) -> Callable[[Lists], list]:
    """client_id, class, n_candidates, best_id, first_rank (null without a relevant candidate)"""

    def take(x: Lists) -> list:
        n, m = x.units.shape
        some, first = _places(relevant(x.clients[:, None], x.candidates))
        return [x.clients, x.classes(n), np.full(n, m), x.candidates[:, 0], _nullable(first + 1, some)]

    return take


def first_of(kinds: list[Condition]) -> Callable[[Lists], list]:
    """client_id, the nearest candidate of each kind; clients that lack one are left out"""

    def take(x: Lists) -> list:
        found = [_places(kind(x.clients[:, None], x.candidates)) for kind in kinds]
        kept = np.logical_and.reduce([some for some, _ in found])
        return [x.clients[kept], *[x.candidates[np.arange(len(first)), first][kept] for _, first in found]]

    return take


def competition(correct: Condition) -> Callable[[Lists], list]:
    """client_id, class, n_candidates, rank, as ranking.competition_by_client() has them"""

    def take(x: Lists) -> list:
        hit = correct(x.clients[:, None], x.candidates)
        target = np.where(hit, x.place, np.iinfo(np.int64).max).argmin(axis=1)
        better = ((x.units > x.units[_rows(hit), target[:, None]]) & ~hit).sum(axis=1)
        kept = hit.any(axis=1)
        n = int(kept.sum())
        return [x.clients[kept], x.classes(n), np.full(n, x.units.shape[1]), 1 + better[kept]]

    return take


def nearest(k: int, kept: Condition | None, digits: int) -> Callable[[Lists], list]:
    """client_id, candidate_id, similarity, distance_rank, rank among those that are kept: the first k of these"""

    def take(x: Lists) -> list:
        if kept is None:
            at = np.broadcast_to(x.ranks <= k, x.units.shape)
            rank = np.broadcast_to(x.ranks, x.units.shape)
        else:
            hit = kept(x.clients[:, None], x.candidates)
            rank = hit.cumsum(axis=1)
            at = hit & (rank <= k)
        i, j = np.nonzero(at)
        return [x.clients[i], x.candidates[i, j], rounded(x.units[i, j], digits), j + 1, rank[i, j]]

    return take


def early_stop(skipped: Condition, stops: Condition, most: int | None) -> Callable[[Lists], list]:
    """client_id, candidate_id, position, as ranking.early_stop() has them"""

    def take(x: Lists) -> list:
        skip, stop = skipped(x.clients[:, None], x.candidates), stops(x.clients[:, None], x.candidates)
        used = (~skip).cumsum(axis=1) - ~skip
        end = stop & ~skip
        stopped = end.cumsum(axis=1) - end
        i, j = np.nonzero((stopped == 0) & (True if most is None else used < most))
        return [x.clients[i], x.candidates[i, j], _nullable(used[i, j] + 1, ~skip[i, j])]

    return take


def _first_of_text(x: Lists, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The texts' codes, and the least rank of each text in each list (or among the valid places)."""
    codes = x.extra[x.place]
    n, size = len(codes), int(x.extra.max()) + 1
    at, ranks = (codes + size * _rows(codes)).ravel(), np.tile(x.ranks, n)
    if valid is not None:
        at, ranks = at[valid.ravel()], ranks[valid.ravel()]
    first = np.full(n * size, np.iinfo(np.int64).max)
    first[at[::-1].copy()] = ranks[::-1].copy()  # of several the last stays
    first = first.reshape(n, size)
    return codes, first


def outside_pick(nearest: int, beyond: Callable[[np.ndarray], np.ndarray]) -> Callable[[Lists], list]:
    """client_id, candidate_id, distance_rank, kind, as ranking.outside_pick() has them; the extra column is the text"""

    def take(x: Lists) -> list:
        codes, first = _first_of_text(x)
        first = first[_rows(codes), codes]
        head = first == x.ranks
        place = head.cumsum(axis=1)
        near = head & (place <= nearest)
        full = place[:, -1] > nearest
        last_near = np.where(near, x.ranks, 0).max(axis=1)
        rest = first > last_near[:, None]
        outside, at = _places(rest & (x.ranks > beyond(x.clients)[:, None]))
        last = rest.shape[1] - 1 - rest[:, ::-1].argmax(axis=1)
        at = np.where(outside, at, last)[full]
        i, j = np.nonzero(near)
        clients, picked = np.flatnonzero(full), np.where(outside[full], "outside_k95", "farthest_fallback")
        i, j = np.concatenate([i, clients]), np.concatenate([j, at])
        return [x.clients[i], x.candidates[i, j], j + 1, np.concatenate([np.full(len(i) - len(clients), "semi_hard", object), picked.astype(object)])]

    return take


def outside_order(beyond: Callable[[np.ndarray], np.ndarray]) -> Callable[[Lists], list]:
    """client_id, candidate_id, candidate_order, as ranking.outside_order() has them"""

    def take(x: Lists) -> list:
        m = x.units.shape[1]
        after = np.maximum(beyond(x.clients), 0)
        lists = [row[k:] if k < m else row[::-1] for row, k in zip(x.candidates, after)]
        sizes = [len(a) for a in lists]
        return [np.repeat(x.clients, sizes), np.concatenate(lists), np.concatenate([x.ranks[:n] for n in sizes])]

    return take


def _semi_hard(x: Lists, positive: Condition, least_margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and margins (units) of the candidates that ranking.semi_hard() has, in order; the extra column is the text."""
    some, at = _places(positive(x.clients[:, None], x.candidates))
    margin = x.units[_rows(at), at[:, None]] - x.units
    valid = (margin / UNIT > least_margin) & some[:, None]
    codes, first = _first_of_text(x, valid)
    i, j = np.nonzero(valid & (first[_rows(codes), codes] == x.ranks))
    return i, j, margin[i, j]


def semi_hard(positive: Condition, digits: int, least_margin: float = 1e-4) -> Callable[[Lists], list]:
    """client_id, candidate_id, margin, semi_hard_order: of candidates below the best positive one"""

    def take(x: Lists) -> list:
        i, j, margin = _semi_hard(x, positive, least_margin)
        starts = np.searchsorted(i, np.arange(len(x.clients)))
        return [x.clients[i], x.candidates[i, j], rounded(margin, digits), np.arange(len(i)) - starts[i] + 1]

    return take


def margin_counts(positive: Condition, edges: list[float], least_margin: float = 1e-4) -> Callable[[Lists], list]:
    """k, n, ranks: candidates of semi_hard() with a margin in (edges[k], edges[k + 1]], and the sum of their ranks"""

    def take(x: Lists) -> list:
        _, j, margin = _semi_hard(x, positive, least_margin)
        k = np.searchsorted(edges, margin / UNIT, side="left")  # 0: at or under the first edge
        n, ranks = np.bincount(k, minlength=len(edges) + 1), np.bincount(k, weights=j + 1, minlength=len(edges) + 1)
        at = np.flatnonzero(n)
        return [at - 1, n[at], ranks[at].astype(np.int64)]

    return take


def scopes() -> Callable[[Lists], list]:
    """client_id, candidate_id, scope, rank: all candidates of the class, and again those with the client's extra value"""

    def take(x: Lists) -> list:
        n, m = x.units.shape
        i, j = np.nonzero(x.extra[x.place] == x.extra[x.client_place][:, None])
        starts = np.searchsorted(i, np.arange(n))
        scope = pa.concat_arrays([pa.repeat(pa.scalar("class"), n * m), pa.repeat(pa.scalar("class+source"), len(i))])
        return [np.concatenate([np.repeat(x.clients, m), x.clients[i]]), np.concatenate([x.candidates.ravel(), x.candidates[i, j]]), scope, np.concatenate([np.tile(x.ranks, n), np.arange(len(i)) - starts[i] + 1])]

    return take


BIN = 1 << 15


def similarity_bins(above: float) -> Callable[[Group], Iterator[list]]:
    """class, bin, n, total, low, high, above: of all pairs of a group with different ids, by similarity in bins of BIN units."""

    def run(group: Group) -> Iterator[list]:
        size = 2 * UNIT // BIN + 1
        n, total, low, high, over = np.zeros(size, np.int64), np.zeros(size), np.full(size, UNIT), np.full(size, -UNIT), np.zeros(size, np.int64)
        for some, units in group.tiles():
            units = np.sort(units[group.ids[some][:, None] != group.ids[None, :]])
            if not len(units):
                continue
            bins = (units + UNIT) // BIN
            starts = np.flatnonzero(np.diff(bins, prepend=-1))
            at, ends = bins[starts], np.append(starts[1:], len(units))
            n[at] += ends - starts
            total[at] += np.add.reduceat(units, starts)
            low[at], high[at] = np.minimum(low[at], units[starts]), np.maximum(high[at], units[ends - 1])
            over[at] += np.add.reduceat((units / UNIT >= above).astype(np.int64), starts)
        at = np.flatnonzero(n)
        yield [pa.repeat(group.label, len(at)), at, n[at], total[at], low[at], high[at], over[at]]

    return run


def similarity_values() -> Callable[[Group], Iterator[list]]:
    """class, units, n: of the pairs of a group whose bin is one of the two that the extra column names (as low * 2^20 + high)."""

    def run(group: Group) -> Iterator[list]:
        if not len(group.ids):
            return
        low, high = divmod(group.named, 1 << 20)
        for some, units in group.tiles():
            units = units[group.ids[some][:, None] != group.ids[None, :]]
            bins = (units + UNIT) // BIN
            values, n = np.unique(units[(bins == low) | (bins == high)], return_counts=True)
            yield [pa.repeat(group.label, len(values)), values, n]

    return run


def similarity_summary(items: DataFrame, id_col: str, class_col: str, vector_col: str, above: float, digits: int) -> DataFrame:
    """Per class: n, mean, median, least and largest similarity of its pairs, and the share of similarities of `above` or more.

    The exact median takes two passes: counts in bins say which one or two hold it, and of these all values are counted."""
    bins = by_group(items, id_col, class_col, vector_col, lambda: similarity_bins(above), "class {label}, bin bigint, n bigint, total double, low bigint, high bigint, above bigint")
    bins = bins.groupBy("class", "bin").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "total"), (F.min, "low"), (F.max, "high"), (F.sum, "above"))])
    bins = written(bins, "similarity-bins")  # at most 61,036 rows a class
    placed = bins.withColumns({"until": F.sum("n").over(Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy("class"))})
    one, two = F.expr("(all + 1) div 2"), F.expr("all div 2 + 1")  # the ranks of the middle
    holds = lambda rank: (F.col("until") >= rank) & (F.col("until") - F.col("n") < rank)
    of = lambda rank, c: F.max(F.when(holds(rank), F.col(c)))
    classes = placed.groupBy("class").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("above").alias("above"),
        of(one, "bin").alias("bin_one"), of(two, "bin").alias("bin_two"), F.max(F.when(holds(one), F.col("until") - F.col("n"))).alias("before"),
    )
    named = classes.select(F.col("class").alias(class_col), (F.col("bin_one") * (1 << 20) + F.col("bin_two")).alias("__bins"))
    values = by_group(items.join(named, class_col), id_col, class_col, vector_col, similarity_values, "class {label}, units bigint, n bigint", "__bins")
    values = values.groupBy("class", "units").agg(F.sum("n").alias("k")).join(classes.select("class", "before", F.col("n").alias("all")), "class")
    values = values.withColumn("until", F.col("before") + F.sum("k").over(Window.partitionBy("class").orderBy("units").rowsBetween(Window.unboundedPreceding, 0)))  # at most two bins' values a class
    at = lambda rank: F.min(F.when(F.col("until") >= rank, F.col("units"))) / UNIT
    middle = values.groupBy("class").agg(at(one).alias("one"), at(two).alias("two"))
    r = lambda c: F.round(c, digits)
    return classes.join(middle, "class").select(
        "class", "n", r(F.col("total") / UNIT / F.col("n")).alias("mean_similarity"), r((F.col("one") + F.col("two")) / 2).alias("median_similarity"), r(F.col("low") / UNIT).alias("min_similarity"),
        r(F.col("high") / UNIT).alias("max_similarity"), r(F.col("above") / F.col("n")).alias("above"),
    )
