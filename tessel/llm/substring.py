"""Substring dedup with a log-structured fingerprint index.

A window is 35 consecutive words of one document. Of the shingles of 8 words in a window, the one with the smallest hash (the
leftmost of equal ones) is its minimizer: equal windows have equal minimizers at equal offsets, and neighbouring
windows mostly share theirs. The index holds the minimizers' fingerprints with the number of their places, as sorted
immutable runs in the shared folder: a new batch is merge-joined with every run, written as a run of its own, and runs are
compacted into one when there are too many. A table is put in as several batches, dealt by a hash of the text, so that each is
joined with the runs before it.

A fingerprint that has been seen at two places makes its windows candidates. Verification compares the candidates' whole
windows: the words from the first to the last window of one minimizer place are digested at once (copies of long
passages agree there, and one of them stands for all), and the single windows of what differs are compared one by one within their
fingerprint. Fingerprints and digests are made of two hashes of each word with different seeds, 64 bits each, so two windows are
taken as equal on 128 bits.

Bounded memory and skew: documents are streamed; the repeated fingerprints are broadcast as a filter where they are at most Filter.LIMIT
(16 MB), and beyond that joined with the places' fingerprints, so that each text comes with its own ones; equal places are counted
with pre-aggregation, and joins on digests are plain equi-joins that adaptive execution can split. A text is known by its
MD5, so copies of one text share one verdict.

Defined cases: null text has no words; documents under 35 words lose nothing; windows don't cross documents; repeated rows are copies like any
others; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remove
from .common import Filter, byte_rows, drop, groups, id_type, mix, new_path, settled, shingles, texts, word_hashes, written

SHINGLE = 8
#: Places that are handled at once within one long text.
STRIP = 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Digests:
    """Digests of any stretch of one text's words."""

    def __init__(self, hashes: np.ndarray, base: int = _ODD[1]):
        n = len(hashes)
        inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes) * _powers(n, base), out=self.sums[1:])
        self.back = _powers(n + 1, inverse)

    def __call__(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts] + np.asarray(lengths).astype(np.uint64))


def minimizers(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of each minimizer, its fingerprint, and the first and last window that it is the minimizer of."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    marks, span = shingles(hashes, SHINGLE), window - SHINGLE + 1
    places = np.empty(n, np.int64)
    for at in range(0, n, STRIP):
        part = np.lib.stride_tricks.sliding_window_view(marks[at : min(n, at + STRIP) + span - 1], span)
        places[at : at + len(part)] = part.argmin(1) + np.arange(at, at + len(part))
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    last = np.r_[first[1:], n] - 1
    return places[first], marks[places[first]], first, last


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, number of places) below one path."""

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = 4):
        self.spark, self.path, self.most_runs = spark, path or new_path(spark, "fingerprints"), most_runs

    def _folder(self):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of each live run; a compacted run covers those it was made of, which may still lie there after a crash."""
        target, files = self._folder()
        found = []
        if files.exists(target):
            for status in files.listStatus(target):
                folder = status.getPath()
                if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                    found.append(tuple(map(int, folder.getName().split("-")[1:])))
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _read(self, run: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("fp bigint, n bigint").parquet(f"{self.path}/run-{run[0]:06d}-{run[1]:06d}")

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        summed = rows.groupBy("fp").agg(F.sum("n").alias("n")).sortWithinPartitions("fp")
        summed.write.mode("overwrite").parquet(f"{self.path}/run-{run[0]:06d}-{run[1]:06d}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Put a batch (fp, n) in as a new run. Gives fp of those that now have two places or more and at least one in this batch."""
        history = self.runs()
        number = history[-1][1] + 1 if history else 0
        self._write(batch, (number, number))
        new = self._read((number, number))
        repeated = new.where("n > 1").select("fp")
        for run in history:
            repeated = repeated.union(new.join(self._read(run).select("fp").hint("merge"), "fp").select("fp"))
        repeated = written(repeated, "seen")
        if len(history) + 1 > self.most_runs:
            self.compact()
        return repeated

    def compact(self) -> None:
        """Merge all runs into one."""
        runs = self.runs()
        if len(runs) > 1:
            rows = self._read(runs[0])
            for run in runs[1:]:
                rows = rows.union(self._read(run))
            self._write(rows, (runs[0][0], runs[-1][1]))
            target, files = self._folder()
            for run in runs:
                files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, f"run-{run[0]:06d}-{run[1]:06d}"), True)


def fingerprints(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """batch, fp, n: fingerprints of the minimizer places of all documents, summed by group of rows; batch: a hash of the text, below `batches`."""
    rows = texts(docs, id_col, text_col).select("text", F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"))

    def run(arrived):
        for batch in arrived:
            numbers = batch.column("batch").to_numpy()
            data = byte_rows(batch)
            for number in np.unique(numbers).tolist():
                for part in groups([data[i] for i in np.flatnonzero(numbers == number).tolist()], len, 32 << 20):
                    found = [minimizers(one, window)[1] for one in word_hashes(part)]
                    fp, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), number, np.int32)), pa.array(fp.view(np.int64)), pa.array(n)], ["batch", "fp", "n"])

    return rows.mapInArrow(settled(run, 16 << 20), "batch int, fp bigint, n bigint")


def _with_own(corpus: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """text, own (those of its fingerprints that are repeated) of the distinct texts that have any: by joins, for any number of them."""

    def run(batches):
        for batch in batches:
            for part in groups(byte_rows(batch), len, 32 << 20):
                keys, found = [], []
                for text, one in zip(part, word_hashes(part)):
                    fp = np.unique(minimizers(one, window)[1])
                    keys += [hashlib.md5(text).digest()] * len(fp)
                    found.append(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(found).view(np.int64))], ["key", "fp"])

    places = corpus.mapInArrow(run, "key binary, fp bigint").join(repeated.hint("merge"), "fp", "left_semi")
    own = places.groupBy("key").agg(F.collect_set("fp").alias("own"))
    return corpus.withColumn("key", F.unhex(F.md5("text"))).join(own.hint("merge"), "key").select("text", "own")


def _places(corpus: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """One row for each minimizer place whose fingerprint may be repeated: text (MD5), first window, how many windows, fp, digest of their stretch, digests of each window."""
    known = Filter.of(repeated)
    held = None if known is None else corpus.sparkSession.sparkContext.broadcast(known)
    source = corpus.withColumn("own", F.lit(None).cast("array<bigint>")) if held else _with_own(corpus, repeated, window)

    def place_rows(data: list[bytes], owns: list) -> pa.RecordBatch | None:
        with_hits, found = [], []
        for i, one in enumerate(word_hashes(data)):
            place, fp, first, last = minimizers(one, window)
            keep = held.value.has(fp) if held else np.isin(fp, np.array(owns[i], np.int64).view(np.uint64))
            if keep.any():
                with_hits.append(data[i])
                found.append((place[keep], fp[keep], first[keep], last[keep]))
        if not found:
            return None
        keys, firsts, counts, fps, wholes, singles = [], [], [], [], [], []
        for text, one, (place, fp, first, last) in zip(with_hits, word_hashes(with_hits, seed=1), found):
            digest = Digests(one)
            many = last - first + 1
            wholes.append(digest(first, many + (window - 1)) + mix((place - first).astype(np.uint64)))
            ends = np.cumsum(many)
            starts = np.repeat(first - (ends - many), many) + np.arange(ends[-1])
            single = digest(starts, window).tobytes()
            keys += [hashlib.md5(text).digest()] * len(fp)
            firsts.append(first)
            counts.append(many)
            fps.append(fp)
            singles += [single[8 * (e - m) : 8 * e] for e, m in zip(ends.tolist(), many.tolist())]
        columns = [pa.array(keys, pa.binary()), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(wholes).view(np.int64)), pa.array(singles, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "first", "many", "fp", "whole", "singles"])

    def run(batches):
        for part in batches:
            rows = place_rows(byte_rows(part), part.column("own").to_pylist() if not held else [])
            if rows is not None:
                yield rows

    return source.mapInArrow(settled(run), "key binary, first bigint, many bigint, fp bigint, whole bigint, singles binary")


def _masks(places: DataFrame) -> DataFrame:
    """fp, whole, mask (bit i: window i of the stretch also starts elsewhere) for the stretches with any such window."""
    stretches = written(places.groupBy("fp", "whole").agg(F.count("*").alias("n"), F.first("many").alias("many"), F.first("singles").alias("singles")), "stretches")
    full = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(many AS INT)) - 1")
    same = stretches.where("n > 1").select("fp", "whole", full.alias("mask"))
    # windows are compared one by one only where a fingerprint has different stretches
    mixed = stretches.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fp")

    def windows(batches):
        for batch in batches:
            fp, whole, n, singles = (batch.column(c) for c in ("fp", "whole", "n", "singles"))
            many = np.array([len(s) // 8 for s in singles.to_pylist()], np.int64)
            data = np.frombuffer(b"".join(singles.to_pylist()), np.int64)
            place = np.arange(len(data)) - np.repeat(np.cumsum(many) - many, many)
            repeat = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), many))
            yield pa.RecordBatch.from_arrays([repeat(fp), repeat(whole), repeat(n), pa.array(place), pa.array(data)], ["fp", "whole", "n", "place", "window"])

    mixed = written(mixed, "mixed")
    single = written(stretches.join(mixed, "fp").select("fp", "whole", "n", "singles").mapInArrow(windows, "fp bigint, whole bigint, n bigint, place bigint, window bigint"), "single-windows")
    twice = single.groupBy("fp", "window").agg(F.sum("n").alias("times")).where("times > 1").select("fp", "window")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place AS INT))")
    differing = single.where("n = 1").join(twice, ["fp", "window"]).groupBy("fp", "whole").agg(F.bit_or(bit).alias("mask"))
    masks = written(same.union(differing), "masks")
    drop(stretches, mixed, single)
    return masks


def deduplicate(docs: DataFrame, window: int = 35, history: DataFrame | None = None, index: FingerprintIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space) of docs: each word in a window whose words also start
    anywhere else in docs, or in `history`, whose fingerprints `index` already holds, is removed. Afterwards the index holds docs too, put in as so many batches."""
    if not 2 * SHINGLE <= window <= 62 + SHINGLE:
        raise ValueError("windows are of 16 to 70 words")
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    corpus = rows.select("text")
    if history is not None:
        corpus = corpus.union(texts(history, id_col, text_col).select("text"))
    own_index = index is None
    index = index or FingerprintIndex(spark, most_runs=2)
    found = written(fingerprints(docs, window, id_col, text_col, batches), "fingerprints")
    seen = [index.add(found.where(F.col("batch") == number).select("fp", "n")) for number in range(batches)]
    repeated = written(reduce(DataFrame.union, seen).distinct(), "repeated")
    drop(found, *seen)
    if own_index:
        remove(spark, index.path)
    places = written(_places(corpus, repeated, window), "places")
    drop(repeated)
    masks = _masks(places)
    # bits of the windows, above them the first window: one number a place
    packed = F.shiftleft(F.col("first"), window - SHINGLE + 1).bitwiseOR(F.col("mask"))
    hit = places.select("key", "first", "fp", "whole").join(masks, ["fp", "whole"]).groupBy("key").agg(F.collect_set(packed).alias("hits"))
    hit = written(hit, "hits")
    drop(places, masks)

    def run(batches):
        width = window - SHINGLE + 1
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, hits in zip(byte_rows(batch), batch.column("hits")):
                words = text.split()
                n_words.append(len(words))
                if hits.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    values = hits.values.to_numpy(zero_copy_only=False)
                    for i in range(width):
                        starts = (values[values >> i & 1 == 1] >> width) + i
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + window, -1)
                    left = np.flatnonzero(np.cumsum(edges)[: len(words)] == 0).tolist()
                    words = [words[i] for i in left]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    keyed = rows.withColumn("key", F.unhex(F.md5("text"))).join(hit, "key", "left").select("doc_id", "text", "hits")
    return keyed.mapInArrow(settled(run), f"doc_id {id_type(rows)}, n_words bigint, n_removed bigint, kept string")
