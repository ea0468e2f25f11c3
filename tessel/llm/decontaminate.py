"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every item yields windows of 13 consecutive words (a shorter item is one window). A window is seen as the set
of its shingles of a few words. A document can only contain the window if it contains all of them, so the
necessary prefix of the window, with its shingles ordered by rarity, is the rarest one alone: the document
side is joined with that token. Rarity is the number of occurrences in all documents, counted by one pass and
pre-aggregated by task before its shuffle. A match gives the only place where the window can stand; it must lie inside the
document (length and positional bounds), and its words are then compared (exact containment).

Windows of at most `broadcast_bytes` together are broadcast as an index by token, and documents are only streamed past it. A larger
benchmark is never broadcast: documents give the places of shingles that a filter of bounded size lets through, with the words
around them, and these are joined with the prefix tokens by a shuffle; adaptive execution can split a hot token.

Defined cases: null text has no words; a document without words is clean; an item without words has no window;
items with a null id mark words, but aren't listed; items that share an id are listed once; repeated document
rows and null ids give one result row each; empty tables on either side give no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, byte_rows, drop, plain, shingles, texts, word_hashes, written

#: A-Z in lower case; the bytes that are in no word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def item_windows(items: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (string), words (joined by a space) of each distinct window: a written table."""
    rows = items.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), byte_rows(batch)):
                words = words_of(text)
                if words:
                    for at in range(max(1, len(words) - window + 1)):
                        ids.append(item)
                        found.append(b" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "words"])

    return written(rows.mapInArrow(run, "item_id string, words binary").distinct(), "windows")


def _tokens(words: bytes, shingle: int) -> np.ndarray:
    found = next(word_hashes([words]))
    return shingles(found, min(shingle, len(found)))


def _rarest(tokens: np.ndarray, rarity: dict[int, int]) -> int:
    """The place of the prefix: the rarest token, of equally rare ones the one with the smallest hash."""
    return min(range(len(tokens)), key=lambda i: (rarity.get(int(tokens[i]), 0), int(tokens[i])))


class _Known:
    """Membership of shingles in a sorted array."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted

    def has(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.wanted, found)
        at[at == len(self.wanted)] = 0
        return self.wanted[at] == found if len(self.wanted) else np.zeros(len(found), bool)


def _counts(rows: DataFrame, known, sizes: list[int]) -> DataFrame:
    """token, n: occurrences in all documents of the shingles that `known` (None: any) has. Summed by batch before the shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            found = [part if held.value is None else part[held.value.has(part)] for one in word_hashes([t.translate(_WORD_BYTES) for t in byte_rows(batch)]) for part in (shingles(one, size) for size in sizes)]
            token, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return rows.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class _Index:
    """Prefix tokens of the windows: by token, the place of the token in the window, the window's length and words, and the items that have it."""

    def __init__(self, windows: list[tuple[str | None, bytes]], shingle: int, rarity: dict[int, int]):
        items: dict[bytes, set] = defaultdict(set)
        for item, words in windows:
            items[words] |= {item} if item is not None else set()
        self.by_token: dict[int, list] = defaultdict(list)
        for words, having in items.items():
            tokens = _tokens(words, shingle)
            at = _rarest(tokens, rarity)
            self.by_token[int(tokens[at])].append((at, words.count(b" ") + 1, words, tuple(sorted(having))))
        self.sizes = sorted({min(shingle, n) for found in self.by_token.values() for _, n, _, _ in found})
        self.known = _Known(np.array(sorted(self.by_token), np.uint64))

    def find(self, text: bytes, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Places of all windows in a text of words and spaces, and the items that have them."""
        spans, items, words = [], set(), None
        for size in self.sizes:
            here = shingles(hashes, size)
            for place in np.flatnonzero(self.known.has(here)).tolist():
                words = words or text.split()
                for offset, n, window, having in self.by_token[int(here[place])]:
                    start = place - offset
                    if start >= 0 and start + n <= len(words) and b" ".join(words[start : start + n]) == window:
                        spans.append((start, start + n))
                        items.update(having)
        return spans, items


def find(documents: DataFrame, items: DataFrame, window: int = 13, shingle: int = 4, broadcast_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), n_words, n_hit (words inside any occurrence of a window), item_ids (items with such a window, sorted as strings)."""
    if keep is None:
        source, kept = texts(documents, id_col, text_col).withColumnRenamed("text", "__text"), ["doc_id"]
    else:
        source, kept = documents.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")), keep
    rows, table = texts(documents, id_col, text_col).select("text"), item_windows(items, window)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + ", n_words bigint, n_hit bigint, item_ids array<string>"
    if table.agg(F.coalesce(F.sum(F.length("words") + 64), F.lit(0))).first()[0] > broadcast_bytes:
        return _find_by_join(source, kept, rows, table, window, shingle, schema)
    windows = [(r["item_id"], bytes(r["words"])) for r in table.collect()]  # at most broadcast_bytes
    tokens = [_tokens(w, shingle) for _, w in windows]
    rarity = {}
    if tokens:
        sizes = sorted({min(shingle, w.count(b" ") + 1) for _, w in windows})
        rarity = {r["token"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in _counts(rows, _Known(np.unique(np.concatenate(tokens))), sizes).collect()}
    held = rows.sparkSession.sparkContext.broadcast(_Index(windows, shingle, rarity))

    def run(batches):
        for batch in batches:
            counts, hits, found_items = [], [], []
            data = [t.translate(_WORD_BYTES) for t in byte_rows(batch, "__text")]
            for text, one in zip(data, word_hashes(data)):
                spans, items = held.value.find(text, one)
                counts.append(len(one))
                hits.append(covered(spans))
                found_items.append(sorted(items))
            columns = [batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(found_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "n_hit", "item_ids"])

    return source.mapInArrow(run, schema)


def _find_by_join(source: DataFrame, kept: list[str], rows: DataFrame, table: DataFrame, window: int, shingle: int, schema: str) -> DataFrame:
    """find() for windows of any number: nothing is broadcast but a filter of bounded size."""

    def window_tokens(batches):
        for batch in batches:
            found = [(words, _tokens(words, shingle)) for words in batch.column("words").to_pylist()]
            n = [len(t) for _, t in found]
            columns = [pa.array([w for w, t in found for _ in t], pa.binary()), pa.array([i for k in n for i in range(k)], pa.int64()), pa.array(np.concatenate([t for _, t in found]).view(np.int64) if found else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["words", "offset", "token"])

    tokens = written(table.select("words").distinct().mapInArrow(window_tokens, "words binary, offset bigint, token bigint"), "window-tokens")
    sizes = list(range(1, shingle + 1))
    wanted = written(tokens.select("token").distinct(), "tokens")
    counted = tokens.join(_counts(rows, Filter.of(wanted), sizes).hint("merge"), "token", "left").fillna(0, "n")
    # the smallest hash as an unsigned number, as in the broadcast index
    unsigned = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))
    prefixes = counted.groupBy("words").agg(F.min_by(F.struct("token", "offset"), F.struct("n", unsigned, "offset")).alias("rarest")).select("words", "rarest.*")
    prefixes = written(prefixes, "prefixes")
    chosen = written(prefixes.select("token").distinct(), "chosen")
    held = rows.sparkSession.sparkContext.broadcast(Filter.of(chosen))
    drop(tokens, wanted, chosen)

    def places(batches):
        for batch in batches:
            keys, found, left, around = [], [], [], []
            for text in byte_rows(batch):
                plain_text = text.translate(_WORD_BYTES)
                one, words = next(word_hashes([plain_text])), None
                for size in sizes:
                    here = shingles(one, size)
                    for place in (np.flatnonzero(held.value.has(here)) if held.value else np.arange(len(here))).tolist():
                        words = words or plain_text.split()
                        first = max(0, place - window)
                        keys.append((hashlib.md5(text).digest(), place))
                        found.append(int(here[place].view(np.int64)))
                        left.append(place - first)
                        around.append(b" ".join(words[first : place + window]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.binary()), pa.array([p for _, p in keys], pa.int64()), pa.array(found, pa.int64()), pa.array(left, pa.int64()), pa.array(around, pa.binary())], ["key", "place", "token", "left", "around"])

    met = rows.distinct().mapInArrow(places, "key binary, place bigint, token bigint, left bigint, around binary").join(prefixes.hint("merge"), "token")
    inside = F.slice(F.split(F.col("around").cast("string"), " "), (F.col("left") - F.col("offset") + 1).cast("int"), F.size(F.split(F.col("words").cast("string"), " ")))
    met = met.where("left >= offset").where(F.array_join(inside, " ") == F.col("words").cast("string"))
    start = F.col("place") - F.col("offset")
    spans = met.select("key", "words", start.alias("start"), (start + F.size(F.split(F.col("words").cast("string"), " "))).alias("end"))
    spans = written(spans.distinct(), "spans")
    per_text = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    having = spans.select("key", "words").distinct().join(table.where("item_id IS NOT NULL").hint("merge"), "words").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    keyed = source.withColumn("__key", F.unhex(F.md5("__text"))).join(per_text.hint("merge").withColumnRenamed("key", "__key"), "__key", "left").join(having.hint("merge").withColumnRenamed("key", "__key"), "__key", "left")

    def run(batches):
        for batch in batches:
            data = [t.translate(_WORD_BYTES) for t in byte_rows(batch, "__text")]
            hits = [covered([(s["start"], s["end"]) for s in spans or ()]) for spans in batch.column("spans").to_pylist()]
            found = [sorted(items or ()) for items in batch.column("items").to_pylist()]
            counts = [len(one) for one in word_hashes(data)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string()))], [*kept, "n_words", "n_hit", "item_ids"])

    return keyed.select(*kept, "__text", "spans", "items").mapInArrow(run, schema)


def covered(spans: list[tuple[int, int]]) -> int:
    """Places inside any of the half-open spans."""
    total = end = 0
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def verdicts(found: DataFrame) -> DataFrame:
    """find()'s rows with n_items and contaminated: a twentieth of the words or more are hit."""
    return found.withColumns({"n_items": F.size("item_ids").cast("bigint"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def items_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with their own columns."""
    rows, names = plain(docs)
    found = verdicts(find(rows, items, id_col=names[0], text_col=names[docs.columns.index(text_col)], keep=names))
    return found.where("NOT contaminated").select(*names).toDF(*docs.columns)
