"""What several operators share: texts as Arrow batches, hashes of words and shingles, a filter of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, drop_written, new_path, written  # noqa: F401
from ..shipping import ship

#: The complement of the word class `[^\x20\x09-\x0D]`, as a regular expression.
SPACE = r"[\x20\x09-\x0D]"

def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (any type) and the text (null: empty) of docs, as `doc_id` and `text`."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns named own_0, own_1, ..., so that no name meets one of ours; and the new names."""
    names = [f"own_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def byte_rows(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8, without decoding them."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def utf8(column: pa.Array) -> pa.Array:
    """The column's texts; bytes that are no UTF-8 become U+FFFD."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()], pa.string())


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which the column has at most `most` bytes, or which are one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(ends):
        after = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, after - at)
        at, done = after, int(ends[after - 1])


def arrow_schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over parts of the batches with at most `most` bytes of text; at the end of a task, memory that isn't used any more goes back to the
    system, as the worker may stay idle beside others."""

    def parts(batches):
        for batch in batches:
            column = "text" if "text" in batch.schema.names else "__text"
            yield from slices(batch, column, most)

    def settled_run(batches):
        yield from run(parts(batches))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return settled_run


def groups(rows: list, weight: Callable[[object], int], most: int) -> Iterator[list]:
    """Consecutive rows whose weights sum to about `most`; every row is in one group."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += weight(row)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once; longer texts are cut at white space.
STRIP_BYTES = 1 << 17
#: Words of more bytes are hashed one by one.
SHORT_WORD = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    out = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def _hash_strip(strip: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a strip that ends with white space, and where they begin. Eight bytes of a word after the other are
    mixed in, over all words at once: no two words of one length up to 8 bytes agree."""
    data = np.frombuffer(strip, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    lengths = ends - starts
    # the eight bytes from each place
    eight = np.ndarray(len(data), "<u8", strip + bytes(8), strides=(1,))
    out = mix((lengths.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[starts] & _MASK[np.minimum(lengths, 8)]))
    left, at = np.flatnonzero(lengths > 8), 8
    while len(left) and at < SHORT_WORD:
        part = eight[starts[left] + at] & _MASK[np.minimum(lengths[left] - at, 8)]
        out[left] = mix((out[left] + np.uint64(at)) * np.uint64(0xD6E8FEB86659FD93) ^ part)
        at += 8
        left = left[lengths[left] > at]
    for i in left.tolist():
        out[i] = xxhash.xxh3_64_intdigest(strip[starts[i] : ends[i]], seed)
    return out, starts


def word_hashes(texts: list[bytes], seed: int = 0) -> Iterator[np.ndarray]:
    """For each text the hashes of its words `[^\x20\x09-\x0D]+`, without making the words: of many short texts at once, or of a strip of
    a long one. Hashes with different seeds are independent."""
    for part in groups(texts, lambda t: len(t) + 1, STRIP_BYTES):
        joined = b"\n".join(part) + b"\n"
        found, at = [], 0
        while at < len(joined):
            end = len(joined)
            if end - at > 2 * STRIP_BYTES:
                window = joined[at : at + STRIP_BYTES]
                cut = max(window.rfind(b) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut < 0:
                    cut = min(x for x in (joined.find(b, at + STRIP_BYTES) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0) - at
                end = at + cut + 1
            hashes, starts = _hash_strip(joined[at:end], seed)
            found.append((hashes, starts + at))
            at = end
        hashes, starts = found[0] if len(found) == 1 else (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in part]))
        yield from np.split(hashes, ends[:-1])


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] + np.uint64(size)
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _STEP + hashes[i : n + i]
    out = (out ^ (out >> np.uint64(32))) * _STEP
    return out ^ (out >> np.uint64(29))


class Filter:
    """A Bloom filter of 64 slices with 16 bits a key: at most LIMIT keys and so 16 MB. It lets a few more through, and never too little."""

    SLICES, LIMIT = 64, 8 << 20

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # slices x bytes

    @classmethod
    def _places(cls, values: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = values * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return ((values >> np.uint64(8)) % np.uint64(slice_bits)).astype(np.int64), (mixed % np.uint64(slice_bits)).astype(np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        width = self.bits.shape[1]
        rows = (values % np.uint64(self.SLICES)).astype(np.int64) * width
        flat, out = self.bits.reshape(-1), None
        for place in self._places(values, 8 * width):
            bit = (flat[rows + (place >> 3)] >> (place & 7).astype(np.uint8)) & np.uint8(1)
            out = bit if out is None else out & bit
        return out.astype(bool)

    @classmethod
    def of(cls, values: DataFrame) -> Filter | None:
        """From a written table with one bigint column; None if it has more than LIMIT rows, for which the caller joins instead. Each
        slice is built in one task, as a bitmap; what comes to the driver is at most 16 MB."""
        name, n = values.columns[0], values.count()
        if n > cls.LIMIT:
            return None
        slice_bits = max(1 << 10, 1 << (16 * n // cls.SLICES).bit_length())

        def build(batches):
            slices: dict[int, np.ndarray] = {}
            for batch in batches:
                found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                numbers = (found % np.uint64(cls.SLICES)).astype(np.int64)
                one, two = cls._places(found, slice_bits)
                for number in np.unique(numbers).tolist():
                    bits = slices.setdefault(number, np.zeros(slice_bits, bool))
                    mine = numbers == number
                    bits[one[mine]] = True
                    bits[two[mine]] = True
            for number, bits in slices.items():
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

        # the low 6 bits are the slice, for negative numbers too
        dealt = values.where(F.col(name).isNotNull()).repartition(4 if n < 100_000 else cls.SLICES, F.col(name).bitwiseAND(cls.SLICES - 1))
        out = np.zeros((cls.SLICES, slice_bits // 8), np.uint8)
        for row in dealt.mapInArrow(build, "slice bigint, bits binary").collect():
            out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
        return cls(out)
