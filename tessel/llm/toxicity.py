"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the presence of hashed n-grams of 4, 6 and 8 bytes of its text with A-Z in lower case. From the labelled
training texts, each bucket gets the log ratio of its smoothed document shares among toxic and other texts. Presence is scaled by
the ratio, and logistic regression with an L2 penalty is fitted on all buckets whose shares differ by 5 standard errors or more, by coordinate descent on the dual: one number a
training text, so that the features are never gathered in one matrix. A score is the logistic of the sum of the weights of the
buckets present, so it does not depend on length or on where in the text an n-gram stands.

Training uses at most `most_rows` labelled rows (a documented bound; chosen by the hash of the identifier), which are the
only ones broadcast; what is sent to the driver is their buckets that have a weight. What is broadcast for scoring is a weight for each of 2 ** 22 buckets
(20 MB, whatever the data). Scoring is narrow.

Defined cases: null text is scored as the empty text (the bias alone); a null identifier is not held out; labels that are
null are ignored, and of several labels of one identifier the largest counts; without labels of both classes every
score is the smoothed share of toxic rows; repeated rows give one result row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, drop, groups, id_type, texts, written

SIZES = (4, 6, 8)
BITS = 22
SLICE = 1 << 20
_FACTOR = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def buckets(text: bytes):
    """Bucket numbers of all n-grams, slice by slice of the text (slices overlap, so that no n-gram is lost)."""
    text = text.lower()
    for at in range(0, len(text), SLICE):
        part = np.frombuffer(text[at : at + SLICE + max(SIZES) - 1], np.uint8).astype(np.uint32)
        rolled = part
        for size in range(2, max(SIZES) + 1):
            if len(rolled) < 2:
                break
            rolled = rolled[:-1] * _FACTOR + part[size - 1 :]
            if size in SIZES:
                yield ((rolled ^ (rolled >> np.uint32(15)) ^ np.uint32(size)) * _SPREAD) >> np.uint32(32 - BITS)


def present(text: bytes) -> np.ndarray:
    """Distinct buckets of a text."""
    found = list(buckets(text))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # by bucket, float32
    used: np.ndarray  # by bucket, whether it has a weight: small enough for a processor's cache

    def score(self, text: bytes) -> float:
        used = [found[self.used[found]] for found in buckets(text)]
        total = self.bias
        if used:
            total += float(self.weights[np.unique(np.concatenate(used))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def held_out(identifier: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(identifier.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Features(NamedTuple):
    """The buckets that a model uses, in order of their numbers, and their log-count ratios."""

    chosen: np.ndarray
    ratio: np.ndarray

    def number(self, found: np.ndarray) -> np.ndarray:
        """Places in `chosen` of those buckets that are in it."""
        if not len(self.chosen):
            return np.zeros(0, np.int32)
        at = np.searchsorted(self.chosen, found)
        at[at == len(self.chosen)] = 0
        return at[self.chosen[at] == found].astype(np.int32)


def choose(sample: DataFrame, n_one: int, n: int, apart: float = 5.0, smoothing: float = 1.0) -> Features:
    """The buckets whose smoothed shares among toxic and other texts are `apart` standard errors apart or more (a smaller difference may be
    chance), and the log ratios of the shares. sample has found, label; buckets are counted by task, then summed."""

    def count(batches):
        for batch in batches:
            rows = list(zip(batch.column("found").to_pylist(), batch.column("label").to_pylist()))
            for part in groups(rows, lambda r: len(r[0]), 16 << 20):
                for label in (0, 1):
                    found = [np.frombuffer(f, np.int32) for f, y in part if y == label]
                    if found:
                        bucket, n_texts = np.unique(np.concatenate(found), return_counts=True)
                        none = np.zeros_like(n_texts)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n_texts if label else none), pa.array(none if label else n_texts)], ["bucket", "ones", "zeros"])

    counted = sample.mapInArrow(count, "bucket int, ones bigint, zeros bigint").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    one = (F.col("ones") + smoothing) / (n_one + 2 * smoothing)
    zero = (F.col("zeros") + smoothing) / (n - n_one + 2 * smoothing)
    pooled = (one * n_one + zero * (n - n_one)) / n
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_one + 1 / (n - n_one)))
    best = counted.where(F.abs(one - zero) >= apart * error).select("bucket", F.log(one / zero).alias("ratio")).collect()
    best.sort(key=lambda r: r["bucket"])
    return Features(np.array([r["bucket"] for r in best], np.int64), np.array([r["ratio"] for r in best], np.float64))


def _dual_step(alpha: float, margin: float, square: float, cost: float) -> float:
    """The new alpha of one text, between 0 and cost: square * (new - alpha) + margin + log(new / (cost - new)) = 0. The left side rises, so halving finds it."""
    low, high = 0.0, cost
    for _ in range(40):
        new = (low + high) / 2
        if square * (new - alpha) + margin + math.log(new / (cost - new)) > 0:
            high = new
        else:
            low = new
    return (low + high) / 2


def fit(features: Features, rows: list[tuple[np.ndarray, int]], cost: float = 0.3, rounds: int = 20) -> Model:
    """rows: places in features.chosen, and the label, of each training text; both labels occur. cost: of a text's loss against half the squared weights."""
    ratio = features.ratio
    w, bias = np.zeros(len(ratio)), 0.0  # of scaled features, and of a feature that all texts have
    alpha = [cost / 2] * len(rows)
    squares = []
    for found, y in rows:
        scaled = ratio[found]
        squares.append(float((scaled * scaled).sum()) + 1)
        w[found] += (cost / 2) * (2 * y - 1) * scaled
        bias += (cost / 2) * (2 * y - 1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            found, y = rows[i]
            scaled, sign = ratio[found], 2 * y - 1
            new = _dual_step(alpha[i], sign * (float((w[found] * scaled).sum()) + bias), squares[i], cost)
            change = sign * (new - alpha[i])
            w[found] += change * scaled
            bias += change
            alpha[i] = new
    weights = np.zeros(1 << BITS, np.float32)
    weights[features.chosen] = w * ratio
    return Model(bias, weights, weights != 0)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows that aren't held out, at most `most_rows` of them."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def extract(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([present(t).tobytes() for t in byte_rows(batch)], pa.binary()), batch.column("label")], ["found", "label"])

    # at most most_rows rows are broadcast
    sample = written(texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(extract, "found binary, label int"), "toxicity-sample")

    by_label = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_one, n = by_label.get(1, 0), sum(by_label.values())
    if not 0 < n_one < n:
        drop(sample)
        return Model(float(np.log((n_one + 1) / (n - n_one + 1))), np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool))
    features = choose(sample, n_one, n)

    def select(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features.number(np.frombuffer(f, np.int32)).tobytes() for f in batch.column("found").to_pylist()], pa.binary()), batch.column("label")], ["found", "label"])

    # in an order of their own, as rows come in any
    rows = sorted((bytes(r["found"]), r["label"]) for r in sample.mapInArrow(select, "found binary, label int").collect())
    drop(sample)
    return fit(features, [(np.frombuffer(found, np.int32), label) for found, label in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""
    rows = texts(docs, id_col, text_col)
    held = rows.sparkSession.sparkContext.broadcast(model)  # 20 MB, whatever the data

    def run(batches):
        model = held.value
        for batch in batches:
            scores = [model.score(t) for t in byte_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, score double, predicted int")
