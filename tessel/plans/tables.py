"""What the queries share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, ranking

#: name to (query, DuckDB SQL or None), filled by the decorator.
REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def register(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a client, with the distance ranks of the other vectors of its label."""
    return ranking.distance_ranks(ranking.class_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))


def per_client(spark: SparkSession, sf_dir: str, take, schema: str, plain, items: DataFrame | None = None, extra: str | None = None) -> DataFrame:
    """What is asked of each client's part of ranked(), worked out where its list is made; plain: the same of a table like ranked(),
    for clients that several vectors have."""
    items = table(spark, sf_dir, "embeddings") if items is None else items
    listed = lambda marked: plain(ranking.distance_ranks(ranking.class_pairs(marked, "vec_id", "label", "embedding", marked.where("__client"))))
    return blocks.by_client(items, "vec_id", "label", "embedding", take, schema, listed, extra)


#: The same in SQL: `ranked`, of client_id, candidate_id, class, similarity, distance, distance_rank.
RANKED = """
pairs AS (SELECT a.vec_id AS client_id, b.vec_id AS candidate_id, a.label AS class,
  round(greatest(-1, least(1, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS similarity
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, round(1 - similarity, 9) AS distance, row_number() OVER (PARTITION BY client_id ORDER BY similarity DESC, candidate_id) AS distance_rank FROM pairs)
"""


def remainder(x, n: int):
    """Of a column or an array, with the sign of x, as in SQL."""
    return np.fmod(x, n) if isinstance(x, np.ndarray) else x % n


def positive(client, candidate):
    """The known positives of a client: those with the next higher remainder by 7."""
    return remainder(candidate, 7) == remainder(client + 1, 7)


def known_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, class, n_candidates, rank: the rank of the client's known positive, which is its label's vector with the next
    higher remainder of vec_id by 7 (null if there is none)."""
    rank = F.min(F.when(positive(F.col("client_id"), F.col("candidate_id")), F.col("distance_rank")))
    plain = lambda rows: rows.groupBy("client_id", "class").agg(F.count("*").alias("n_candidates"), F.min_by("candidate_id", "distance_rank").alias("best_id"), rank.alias("rank"))
    return per_client(spark, sf_dir, blocks.first_relevant(positive), "client_id {id}, class {label}, n_candidates bigint, best_id {id}, rank bigint", plain).drop("best_id")


KNOWN = RANKED + """,
known AS (SELECT client_id, class, count(*) AS n_candidates, min(distance_rank) FILTER (WHERE candidate_id % 7 = (client_id + 1) % 7) AS rank FROM ranked GROUP BY ALL)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, y, score: labelled documents with the share of letters e in them as a score."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.round((F.char_length("text") - F.char_length(F.replace("text", F.lit("e"), F.lit("")))) / F.char_length("text") * 5, 6)
    return documents.join(labels, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), score.alias("score"))


SCORED = "scored AS (SELECT doc_id, lang, source, quality AS y, round((length(text) - length(replace(text, 'e', ''))) / length(text) * 5, 6) AS score FROM documents JOIN labels USING (doc_id))"
