"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct shingles of 4 words. All shingles have one global order: rare before frequent, by a
count sketch over all documents (a fixed number of counters, read as logarithms, so a rough rarity; any total order is right), then by hash.
The order is cut into fragments of about equal weight, at places that the sketch gives. Each fragment of a document's set is a row of its
own; for a pair of documents the overlap is counted in each fragment separately and summed per pair, so no task needs a whole set and no
set is sent around for a pair twice.

Which pairs are counted:

1. Equal sets are one node (by a digest); what follows runs over nodes.
2. Nodes that agree in one of several min-hashes are compared with one leader of that group (a star, never all pairs of a group): the
   node whose shingles are the most frequent by the sketch, which among edited copies is the least edited one. The links found this
   way contract most near copies into components.
3. What can still be missing is a link between two different components. Such a pair shares a shingle among the first
   n - ceil(0.85 n) + 1 of both sets in the global order (the prefix filter). Prefix shingles are grouped by shingle with the smallest and
   largest component as pre-aggregated values; only those with two components or more give pairs, only across components. Pairs of one
   shingle are made within classes of size (sets of which one has less than 0.85 of the other's shingles never meet), and only where the
   places of the shared shingle in both orders leave room for the overlap that is wanted.

Both joins let a pair through only if it can still be similar enough: by the sizes, and by parity signatures of 1024 bits, whose
differing bits are a lower bound of the sets' symmetric difference. As 1024 bits fill up, sets of more than 512 shingles have a second
signature of two to four bits a shingle, which is asked before whole sets are sent.

Components of all links together are exact: steps 2 and 3 only save work. Sets are compared by 64-bit hashes of shingles, so
an overlap is off by one with a chance of about n * n / 2 ** 64 a pair.

Defined cases: null text or no words: the empty set, linked with nothing (component: the document itself); fewer than 4
words: the sequence is the one shingle; repeated rows are equal sets; rows that share a doc_id stay rows of their own; a null doc_id comes
after all others when the smallest is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Filter, byte_rows, drop, id_type, plain, settled, shingles, texts, word_hashes, written

FRAGMENTS = 4
MIN_HASHES = 8
#: 64-bit words of a signature.
WORDS = 16
#: Sets of more shingles have a signature of their own length too.
LONG = 512
#: Counters of the sketch: 256 slices of 65,536.
SKETCH_BITS, SKETCH_SLICES = 24, 256
#: A counter is read as one byte, 8 log2(1 + count): up to 2 ** 31.
_COUNTS = np.minimum(np.exp2(np.arange(256) / 8) - 1, 255).round().astype(np.int64)
_SEEDS = np.array([0x8EBC6AF09C88C6E3 + 2 * i * 0x589965CC75374CC3 & 0xFFFFFFFFFFFFFFFF | 1 for i in range(MIN_HASHES)], np.uint64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    return np.unique(shingles(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    for words in word_hashes([t.lower() for t in texts]):  # bytes: A-Z alone
        yield shingle_set(words, size)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes()).digest()


def _copy(text: bytes) -> int:
    """A number of the text itself, signed."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _min_hashes(found: np.ndarray) -> list[int]:
    """Signed 64-bit numbers, told apart by which hash function they are of."""
    out = []
    for i, seed in enumerate(_SEEDS):
        mixed = found * seed
        least = int((mixed ^ (mixed >> np.uint64(32))).min())
        value = (least * MIN_HASHES + i) & 0xFFFFFFFFFFFFFFFF
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def _signature(found: np.ndarray) -> list[int]:
    """Bit i is the parity of the shingles that fall on i."""
    parity = np.bincount((found >> np.uint64(17)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(parity.astype(bool), bitorder="little").view(np.int64).tolist()


def _long_signature(found: np.ndarray) -> bytes | None:
    """Parities over the least power of two that has two bits for each shingle; half of the bits folded on the other half is the signature of half the length."""
    if len(found) <= LONG:
        return None
    bits = 1 << (2 * len(found) - 1).bit_length()
    parity = np.bincount((found >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Differing bits of two long signatures, at the length of the shorter."""
    length = min(len(a), len(b))
    one, two = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, length)) for x in (a, b))
    return int(np.bitwise_count(one ^ two).sum())


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that long signatures don't rule out; those of short sets all stay."""
    long = nodes.where("long IS NOT NULL").select("key", "long")
    both = pairs.where((F.col("na") > LONG) & (F.col("nb") > LONG))
    for side in "ba":
        both = both.join(long.select(F.col("key").alias(side), F.col("long").alias(f"long_{side}")).hint("merge"), side)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "long_a", "long_b")]
            stay = [(100 + percent) * _differ(a, b) <= (100 - percent) * (na + nb) for na, nb, a, b in zip(*columns)]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(stay, pa.bool_()))

    asked = both.select("a", "b", "na", "nb", "long_a", "long_b").mapInArrow(run, "a binary, b binary, na bigint, nb bigint")
    return asked.union(pairs.where((F.col("na") <= LONG) | (F.col("nb") <= LONG)).select("a", "b", "na", "nb"))


def _packed_slice(counts: np.ndarray) -> bytes:
    """Most counters of a task are zero: a bit for each counter, then the others' values, of one or two bytes."""
    some = counts[counts > 0]
    wide = int(some.max()) > 255
    return bytes([wide]) + zlib.compress(np.packbits(counts > 0, bitorder="little").tobytes() + some.astype("<u2" if wide else "u1").tobytes(), 1)


def _unpacked_slice(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed[1:])
    length = (1 << SKETCH_BITS) // SKETCH_SLICES
    out = np.zeros(length, np.uint16)
    out[np.unpackbits(np.frombuffer(data, np.uint8, length // 8), bitorder="little").astype(bool)] = np.frombuffer(data, "<u2" if packed[0] else "u1", -1, length // 8)
    return out


def _possible(percent: int, a: str, b: str):
    """Whether the columns n{a}, n{b}, s0{a}, s0{b}, ... leave room for the similarity."""
    differ = sum((F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(WORDS)), F.lit(0))
    one, two = F.col(f"n{a}"), F.col(f"n{b}")
    return (100 * F.least(one, two) >= percent * F.greatest(one, two)) & ((100 + percent) * differ <= (100 - percent) * (one + two))


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """One row a document (doc_id, n, key, least, signature, long, copy), and after them the slices of each task's count sketch (slice, counts)."""

    def run(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.uint16)
        names = ["doc_id", "n", "key", "least", "signature", "long", "copy", "slice", "counts"]
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            n, keys, least, signatures, longs = [], [], [], [], []
            data = byte_rows(batch)
            for found in shingle_sets(data, size):
                n.append(len(found))
                keys.append(_digest(found) if len(found) else None)
                least.append(_min_hashes(found) if len(found) else None)
                signatures.append(_signature(found) if len(found) else None)
                longs.append(_long_signature(found))
                places = (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                counters[places] = np.minimum(counters[places], 0xFFF0) + 1
            none = pa.nulls(len(n))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64())), pa.array(longs, pa.binary()), pa.array(map(_copy, data), pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        if kind is not None:
            slices = [(i, _packed_slice(part)) for i, part in enumerate(counters.reshape(SKETCH_SLICES, -1)) if part.any()]
            none = pa.nulls(len(slices))
            columns = [none.cast(kind), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int64())), none.cast(pa.binary()), none.cast(pa.int64()), pa.array([i for i, _ in slices], pa.int32()), pa.array([c for _, c in slices], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(settled(run), f"doc_id {id_type(docs)}, n bigint, key binary, least array<bigint>, signature array<bigint>, long binary, copy bigint, slice int, counts binary")


def _sketch(survey: DataFrame) -> np.ndarray:
    """Sums of the tasks' sketches as one byte a counter: 16 MB, whatever the data."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                part = _unpacked_slice(packed)
                if number in sums:
                    sums[number] += part
                else:
                    sums[number] = part.astype(np.int64)
        codes = [np.minimum(8 * np.log2(1 + s), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(codes, pa.binary())], ["slice", "counts"])

    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.uint8)
    summed = survey.where("slice IS NOT NULL").select("slice", "counts").repartition(32, "slice").mapInArrow(add, "slice int, counts binary")
    for row in summed.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def _rarity(found: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _ordered(found: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the shingles in the global order, as numbers: the count above, the hash below it. Shingles that agree here are told apart by nothing else."""
    return codes.astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)


def _cuts(sketch: np.ndarray) -> np.ndarray:
    """Places that cut the global order into fragments of about equal weight."""
    weight = np.bincount(sketch, minlength=256) * (np.exp2(np.arange(256) / 8) - 1)
    along = np.r_[0, np.cumsum(weight)]
    out = []
    for i in range(1, FRAGMENTS):
        wanted = along[-1] * i / FRAGMENTS
        code = min(255, int(np.searchsorted(along, wanted, side="right")) - 1)
        share = (wanted - along[code]) / weight[code] if weight[code] else 0
        out.append(code << 56 | min(int(share * (1 << 56)), (1 << 56) - 1))
    return np.array(out, np.uint64)


def _prefixes(docs: DataFrame, size: int, percent: int, held) -> DataFrame:
    """key, n, prefix (shingles of the prefix, in the global order), score (mean count of the set's shingles in the sketch, times a million: of edited copies, the least edited has the highest)."""

    def run(batches):
        for batch in batches:
            keys, ns, prefixes, scores = [], [], [], []
            for found in shingle_sets(byte_rows(batch), size):
                if len(found):
                    codes = _rarity(found, held.value)
                    length = len(found) - -(-percent * len(found) // 100) + 1
                    keys.append(_digest(found))
                    ns.append(len(found))
                    places = _ordered(found, codes)
                    first = np.argpartition(places, length - 1)[:length]
                    # equal places in the order of the hashes
                    prefixes.append(found[first[np.lexsort((found[first], places[first]))]].view(np.int64))
                    scores.append(int(_COUNTS[codes].sum()) * 1_000_000 // len(found))
            columns = [pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "prefix", "score"])

    return docs.select("text").mapInArrow(settled(run), "key binary, n bigint, prefix array<bigint>, score bigint")


def _sets(docs: DataFrame, size: int, pairs: DataFrame, nodes: DataFrame, held_sketch) -> DataFrame:
    """key, fragments (the whole set, cut), first, second (whether the key may be the a or the b of a pair), for keys that may be either. Sets are
    made of one text of each node alone: texts are told by their own hash first."""
    sides = [written(pairs.select(F.col(side).alias("key")).distinct().join(nodes.select("key", "copy").hint("merge"), "key").select("copy"), "wanted") for side in "ab"]
    held = docs.sparkSession.sparkContext.broadcast(tuple(Filter.of(side) for side in sides))
    drop(*sides)
    cuts = _cuts(held_sketch.value)

    def run(batches):
        for batch in batches:
            data = byte_rows(batch)
            copies = np.fromiter(map(_copy, data), np.int64, len(data)).view(np.uint64)
            # None: too many for a filter, so any may be
            asked = np.stack([np.ones(len(data), bool) if wanted is None else wanted.has(copies) for wanted in held.value], 1)
            some = np.flatnonzero(asked.any(1)).tolist()
            keys, fragments, sides = [], [], []
            for i, found in zip(some, shingle_sets([data[i] for i in some], size)):
                if len(found):
                    keys.append(_digest(found))
                    sides.append(asked[i].tolist())
                    places = _ordered(found, _rarity(found, held_sketch.value))
                    number = np.searchsorted(cuts, places, side="right")
                    fragments.append([found[number == k].tobytes() for k in range(FRAGMENTS)])
            columns = [pa.array(keys, pa.binary()), pa.array(fragments, pa.list_(pa.binary())), *(pa.array([s[i] for s in sides], pa.bool_()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "fragments", "first", "second"])

    return docs.select("text").mapInArrow(settled(run), "key binary, fragments array<binary>, first boolean, second boolean")


def _links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, na, nb) whose sets are similar enough: overlaps are counted fragment by fragment and summed per pair."""
    sets = rows.select("key", "first", "second", F.posexplode("fragments").alias("fragment", "part"))
    sets = sets.groupBy("key", "fragment").agg(F.first("part").alias("part"), F.first("first").alias("first"), F.first("second").alias("second"))
    sets = written(sets, "sets")
    # merged at every size: pairs and sets grow with the documents
    left = pairs.hint("merge").join(sets.where("first").select(F.col("key").alias("a"), "fragment", F.col("part").alias("part_a")), "a")
    both = left.hint("merge").join(sets.where("second").select(F.col("key").alias("b"), "fragment", F.col("part").alias("part_b")), ["b", "fragment"])

    def count(batches):
        for batch in batches:
            shared = []
            for a, b in zip(batch.column("part_a").to_pylist(), batch.column("part_b").to_pylist()):
                shared.append(len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(shared, pa.int64())], ["a", "b", "na", "nb", "shared"])

    partial = both.select("a", "b", "na", "nb", "part_a", "part_b").mapInArrow(count, "a binary, b binary, na bigint, nb bigint, shared bigint")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    out = written(summed.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"), "links")
    drop(sets)
    return out


def components(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), and representative (a digest of the document's
    set: rows with the same one are equal; null for empty sets)."""
    rows = texts(docs, id_col, text_col)
    survey = written(_survey(rows, size), "survey")
    documents = survey.where("slice IS NULL")
    signature = [F.col("signature")[i].alias(f"s{i}") for i in range(WORDS)]
    nodes = written(documents.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("signature").alias("signature"), F.first("long").alias("long"), F.min("copy").alias("copy")), "nodes")

    # stars: each node with the leader of each min-hash that it shares
    sketch = rows.sparkSession.sparkContext.broadcast(_sketch(survey))
    prefixes = written(_prefixes(rows, size, percent, sketch), "prefixes")
    scores = prefixes.groupBy("key").agg(F.first("score").alias("score"))
    members = nodes.select("key", "least").join(scores.hint("merge"), "key").select("key", F.explode("least").alias("value"), "score")
    members = written(members, "members")
    leaders = members.groupBy("value").agg(F.max(F.struct("score", "key"))["key"].alias("leader"), F.count("*").alias("times")).where("times > 1")
    leaders = written(leaders.select("value", "leader"), "leaders")
    stars = members.join(leaders.hint("merge"), "value").where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), *[F.col("signature")[i].alias(f"s{i}{c}") for i in range(WORDS)]).hint("merge")
    stars = written(written(stars, "stars").join(side("b"), "b").join(side("a"), "a").where(_possible(percent, "a", "b")).select("a", "b", "na", "nb"), "possible-stars")
    stars = written(_plausible(stars, nodes, percent), "plausible-stars")
    drop(members, leaders)
    first_links = _links(stars, _sets(rows, size, stars, nodes, sketch), percent)
    drop(stars)
    labels = connected_components(first_links)

    # prefixes: pairs across components
    once = prefixes.select("key", "n", "prefix").dropDuplicates(["key"])
    labelled = once.join(labels.hint("merge"), F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("component", "key").alias("component"), "prefix")
    labelled = written(labelled, "labelled-prefixes")
    drop(prefixes)
    prefixes = labelled
    group = F.xxhash64("component")
    tokens = prefixes.select(F.explode("prefix").alias("token"), group.alias("group"))
    across = tokens.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    across = written(across, "across")
    shared = written(_only(prefixes, across), "shared-tokens")
    drop(across)
    shared = shared.join(nodes.select("key", *signature).hint("merge"), "key")
    # sets that can be similar are of the same class of size or of neighbouring ones
    shared = shared.withColumn("class", F.floor(F.log("n") / max(1.000001 * math.log(100 / percent), 1e-6)).cast("bigint"))
    one, two = (shared.select(*[F.col(c).alias(f"{c}{s}") for c in ("key", "n", "component", "place", *(f"s{i}" for i in range(WORDS)))], "token", "class") for s in "ab")
    two = two.withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    # the shared shingle and what comes after it in both orders
    room = (100 + percent) * F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb")) >= percent * (F.col("na") + F.col("nb"))
    pairs = one.join(two, ["token", "class"]).where((F.col("componenta") < F.col("componentb")) & room & _possible(percent, "a", "b"))
    pairs = written(pairs.select(F.col("keya").alias("a"), F.col("keyb").alias("b"), "na", "nb").distinct(), "pairs")
    pairs = written(_plausible(pairs, nodes, percent), "plausible-pairs")
    drop(prefixes, shared)
    second_links = _links(pairs, _sets(rows, size, pairs, nodes, sketch), percent)

    sketch.destroy()

    # the links between components, contracted; then the nodes' components and the documents'
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")).hint("merge")
    between = second_links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    further = connected_components(between).withColumnRenamed("component", "whole")
    labelled = nodes.join(labels.hint("merge"), F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("component", "key").alias("component"))
    labelled = labelled.join(further.hint("merge"), F.col("component") == F.col("node"), "left").select("key", "least_id", F.coalesce("whole", "component").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_key = labelled.join(smallest, "component").select("key", "component_id")
    out = documents.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key.hint("merge"), "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.hex("key").alias("representative"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component, with its own columns: of the smallest doc_id (null comes last), then of the smallest digest of
    the text, then of the smallest hash of the row. Texts without words are alike to none: of them only rows with the same
    doc_id and text become one."""
    rows, names = plain(docs)
    own_id, own_text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    known = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), F.unhex(F.md5(own_text.cast("string"))).alias("text"))
    keyed = rows.withColumn("stay_key", known)
    found = components(keyed.select(F.col("stay_key").alias("doc_id"), own_text.cast("string").alias("text")), size, percent)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("times"))
    stay = written(stay.select(F.col("doc_id").alias("stay_id"), "times"), "stay")
    same = F.col("stay_key").eqNullSafe(F.col("stay_id"))
    once = keyed.join(stay.where("times = 1"), same, "left_semi").drop("stay_key")
    again = keyed.join(stay.where("times > 1"), same, "left_semi")
    again = again.groupBy("stay_key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
    return once.union(again).toDF(*docs.columns)


def _only(prefixes: DataFrame, across: DataFrame) -> DataFrame:
    """key, n, component, token, place (in the prefix) of the tokens in `across`, and of few others."""
    known = Filter.of(across)
    if known is None:
        return prefixes.select("key", "n", "component", F.posexplode("prefix").alias("place", "token")).join(across.hint("merge"), "token", "left_semi").select("key", "n", "component", "token", "place")
    held = prefixes.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            column = batch.column("prefix")
            rows, parts, places = [], [], []
            for i, tokens in enumerate(column):
                values = tokens.values.to_numpy(zero_copy_only=False)
                left = np.flatnonzero(held.value.has(values.view(np.uint64)))
                if len(left):
                    rows.append(np.full(len(left), i))
                    parts.append(values[left])
                    places.append(left)
            if rows:
                taken = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(taken) for c in ("key", "n", "component")] + [pa.array(np.concatenate(x)) for x in (parts, places)], ["key", "n", "component", "token", "place"])

    return prefixes.select("key", "n", "component", "prefix").mapInArrow(run, "key binary, n bigint, component binary, token bigint, place bigint")
