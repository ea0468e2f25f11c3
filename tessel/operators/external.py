"""Encoders, judges and generators behind plain callables, with caches and resumption.

A callable is made once a partition, on its first row, and gets batches. Only keys that a cache lacks reach it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from ..shipping import ship

Encode = Callable[[list[str]], list[list[float]]]
Judge = Callable[[list[dict]], list[dict]]


def with_retries(call: Callable[[], object], attempts: int = 3, wait: float = 5.0) -> object:
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait)


def encode_distinct(rows: DataFrame, text: str, make: Callable[[], Encode], cache: DataFrame | None = None, batch: int = 16) -> DataFrame:
    """text_hash, embedding for every distinct text of rows: from the cache, or from the encoder."""
    ship(rows.sparkSession)
    wanted = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().withColumn("text_hash", F.sha2("text", 256))
    missing = wanted if cache is None else wanted.join(cache.select("text_hash"), "text_hash", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for part in parts:
            if len(part):
                encode = encode or make()
            vectors = [v for at in range(0, len(part), batch) for v in encode(part["text"].iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"text_hash": part["text_hash"], "embedding": vectors})

    made = missing.select("text", "text_hash").mapInPandas(run, "text_hash string, embedding array<float>")
    return made if cache is None else cache.join(wanted.select("text_hash"), "text_hash", "left_semi").select("text_hash", "embedding").union(made)


def judge_rows(rows: DataFrame, key: str, make: Callable[[], Judge], batch: int = 10, attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """key, verdict, reason, error: what the judge says of each row; a call that fails to the end is a row with an error, not a failed job."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = None
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch].to_dict("records")
                judge = judge or make()
                try:
                    said = with_retries(lambda: judge(piece), attempts, wait)
                    if len(said) != len(piece):
                        raise ValueError(f"{len(said)} replies to {len(piece)} rows")
                    out += [(r[key], s.get("verdict"), s.get("reason"), None) for r, s in zip(piece, said)]
                except Exception as error:
                    out += [(r[key], None, None, str(error)) for r in piece]
            yield pd.DataFrame(out, columns=[key, "verdict", "reason", "error"])

    return rows.mapInPandas(run, f"{key} {kind}, verdict string, reason string, error string")


def generate_rows(seeds: DataFrame, key: str, make: Callable[[], Callable[[dict], str]], field: str, columns: list[str], expected: str) -> DataFrame:
    """key, issue, and the columns of each item that the generator's JSON reply has in `field`; a reply that can't be read or
    has another number of items than seeds[expected] gives a row with the issue."""
    ship(seeds.sparkSession)
    kind = seeds.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None
        for part in parts:
            out = []
            for seed in part.to_dict("records"):
                generate = generate or make()
                try:
                    items = json.loads(generate(seed))[field]
                    issue = None if len(items) == seed[expected] else f"{len(items)} items, {seed[expected]} expected"
                    out += [(seed[key], None, *[i.get(c) for c in columns]) for i in items]
                except Exception as error:
                    issue = str(error)
                if issue:
                    out.append((seed[key], issue, *[None] * len(columns)))
            yield pd.DataFrame(out, columns=[key, "issue", *columns])

    return seeds.mapInPandas(run, f"{key} {kind}, issue string, " + ", ".join(f"{c} string" for c in columns))


def parse_reply(rows: DataFrame, reply: str, schema: str) -> DataFrame:
    """rows with `parsed` (null if the reply is no such JSON) from a reply that may stand in a code fence."""
    return rows.withColumn("parsed", F.from_json(strip_fence(F.col(reply)), schema))


def first_verdicts(log: DataFrame, order: str, keys: tuple[str, ...] = ("fingerprint", "prompt_hash")) -> DataFrame:
    """The first entry of each key in an append log."""
    columns = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(order)).alias("first")).select(*keys, "first.*")


def look_up(requests: DataFrame, log: DataFrame, order: str, keys: tuple[str, ...] = ("fingerprint", "prompt_hash")) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached verdicts, requests without one)."""
    known = first_verdicts(log, order, keys)
    return requests.join(known, list(keys)), requests.join(known.select(*keys), list(keys), "left_anti")


def add_verdicts(log: DataFrame, new: DataFrame, order: str, keys: tuple[str, ...] = ("fingerprint", "prompt_hash")) -> DataFrame:
    """The log with the first new entry of each key that it lacks: what was written first stays."""
    fresh = first_verdicts(new, order, keys).join(log.select(*keys), list(keys), "left_anti")
    return log.unionByName(fresh)


def token_lengths(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[int]]], name: str = "n_tokens", batch: int = 1000) -> DataFrame:
    """rows with the number of tokens of the text by a tokenizer, made once a task (null text: 0)."""
    ship(rows.sparkSession)

    @F.pandas_udf("bigint")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for part in parts:
            given = part.fillna("").tolist()
            yield pd.Series([n for at in range(0, len(given), batch) for n in count(given[at : at + batch])], dtype="int64")

    return rows.withColumn(name, lengths(F.col(text)))


def encode_rows(rows: DataFrame, text: str, make: Callable[[], Encode], cache: DataFrame | None = None, batch: int = 16) -> DataFrame:
    """rows with the embedding of their text: every distinct text is encoded once, then joined back (null text: null)."""
    made = encode_distinct(rows, text, make, cache, batch).withColumnRenamed("text_hash", "__hash")
    return rows.withColumn("__hash", F.sha2(F.col(text), 256)).join(made, "__hash", "left").drop("__hash")


def checked_embeddings(cache: DataFrame, size: int, rows: int | None = None, column: str = "embedding", tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """A cache of embeddings, and one row of counts that are all 0 if it is sound: vectors of another size, with values that aren't
    finite, or not of unit length, and rows too many or too few."""
    vector = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x * x))
    bad = lambda flag: F.count_if(~F.coalesce(flag, F.lit(False)))
    missing = (F.abs(F.count("*") - rows) if rows is not None else F.lit(0)).cast("bigint")
    return cache, cache.agg(bad(F.size(column) == size).alias("wrong_size"), bad(finite).alias("not_finite"), bad(F.abs(length - 1) <= tolerance).alias("not_unit"), missing.alias("wrong_rows"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has finished."""
    return rows.join(done.select(key), key, "left_anti")


def one_call_a_position(candidates: DataFrame, client: str, order: str, most: int) -> DataFrame:
    """Candidates with the round in which a live search would ask about them."""
    return candidates.withColumn("round", F.row_number().over(Window.partitionBy(client).orderBy(order))).where(F.col("round") <= most)
