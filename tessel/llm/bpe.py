"""Byte-level BPE encoding and decoding.

Encoding runs a finite-state transducer that is compiled from the merges and determinised lazily. It rests on two facts about BPE: the
encoding of every prefix of a text has one last token, and a token sequence is an encoding exactly if each adjacent pair of tokens is
(merging the bytes of the two gives back the two). A state of the transducer holds, for each place in the input where a token may
still be open, the token before it and the open token's bytes (a node of the vocabulary's trie); reading one byte advances all of
them, and names the last token of the encoding up to there. States and moves are made when first needed.

Lookahead is bounded: pre-tokens of up to 64 bytes are read to their end, and then walked back from last token to last token; of longer
ones, the tokens that all open places agree on are emitted after every 64 bytes.

The distinct pre-tokens of many texts run through the transducer side by side, one byte of each at a time, by look-ups in one table of moves;
only moves that aren't in the table are made one by one. There are at most 300,000 states; beyond that the table begins anew. Nothing
else is remembered from one group of texts to the next, so a worker's memory follows the size of the group (16 MB of text).

Decoding is streaming: chunks of ids become text through an incremental UTF-8 state machine that
holds back at most three bytes of an unfinished character.

Defined cases: null text is encoded as the empty text (no ids; the SHA-256 of nothing); bytes that are no UTF-8 are read as U+FFFD;
repeated rows and null ids give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_type, settled, texts, utf8

#: Texts are encoded together until they have this many bytes.
GROUP_BYTES = 16 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Moves:
    """Numbers by non-negative key in one table with open addressing, for many keys at once."""

    def __init__(self, size: int = 1 << 14):
        self.keys, self.values, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(33)).astype(np.int64) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        out, left, place = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._place(keys)
        while len(left):
            there = self.keys[place]
            hit = there == keys[left]
            out[left[hit]] = self.values[place[hit]]
            on = ~hit & (there >= 0)
            left, place = left[on], (place[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            held = self.keys >= 0
            keys, values = np.r_[self.keys[held], keys], np.r_[self.values[held], values]
            size = len(self.keys)
            while size < 4 * self.n:
                size *= 2
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]
            mine = self.keys[place] == keys
            self.values[place[mine]] = values[mine]
            keys, values, place = keys[~mine], values[~mine], (place[~mine] + 1) & (len(self.keys) - 1)


class Transducer:
    """Bytes of one pre-token to ids. `merge(a, b)` is the rank of the merge of two parts, or NEVER."""

    NEVER = 1 << 60
    #: Bytes of a long pre-token between looks at what can be emitted.
    STEP = 64
    #: Pieces side by side; remembered states and borders.
    LANES, MOST_STATES, MOST_BORDERS = 8192, 300_000, 200_000
    _NODE = 24

    def __init__(self, vocabulary: dict[bytes, int], merge: Callable[[bytes, bytes], int]):
        self.merge, self.bytes_of = merge, {number: token for token, number in vocabulary.items()}
        self.lengths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.child: dict[int, int] = {}
        self.token_at, self.depth = [-1], [0]  # by node of the trie
        for token, number in vocabulary.items():
            self.lengths[number] = len(token)
            node = 0
            for byte in token:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.depth)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token_at[node] = number
        self.inner = {key >> 8 for key in self.child}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.borders: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.places: list[bytes] = []  # by state, its open places as 64-bit integers
        self.last = np.zeros(1024, np.int32)  # by state, the last token before it
        self.moves, self.single_moves = Moves(), {}
        self.start = self._state(array("q", (0,)))

    def _state(self, places: array) -> int:
        packed = places.tobytes()
        number = self.numbers.get(packed)
        if number is None:
            number = self.numbers[packed] = len(self.places)
            self.places.append(packed)
            if number == len(self.last):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[number] = (places[-1] >> self._NODE) - 1
        return number

    def _merged(self, text: bytes) -> list[tuple]:
        """BPE by its definition, as merge trees (bytes, left, right, rank): again and again the lowest pair merges, the leftmost first."""
        parts: list[tuple] = [(text[i : i + 1], None, None, self.NEVER) for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.merge(a[0], b[0]), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == self.NEVER:
                break
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1], rank)]
        return parts

    def _spine(self, token: int) -> tuple[list, list] | None:
        """Left and right edge of the token's merge tree as (part, rank of the merge that takes it up); None if no encoding has the token."""
        if token not in self.spines:
            trees = self._merged(self.bytes_of[token])
            edges: tuple[list, list] | None = None
            if len(trees) == 1:
                edges = ([], [])
                for side in (0, 1):
                    tree, taken = trees[0], self.NEVER
                    while tree is not None:
                        edges[side].append((tree[0], taken))
                        tree, taken = tree[1 + side], tree[3]
            self.spines[token] = edges
        return self.spines[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives back both: no merge over the border comes before the merges on its two sides."""
        key = left << self._NODE | right
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) >= self.MOST_BORDERS:
                self.borders.clear()
            known = self.borders[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        ends, starts, merge, never = self._spine(left)[1], self._spine(right)[0], self.merge, self.NEVER
        for a, taken_a in ends:
            for b, taken_b in starts:
                rank = merge(a, b)
                if rank < taken_a and rank <= taken_b and rank != never:
                    return False
        return True

    def _move(self, state: int, byte: int) -> int:
        """The state after a byte. A place is (the token before it + 1) << 24 | node of the open token."""
        going, closed, child = array("q"), -1, self.child
        for place in memoryview(self.places[state]).cast("q"):
            node = child.get((place & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            before = place >> self._NODE
            if closed < 0:
                token = self.token_at[node]
                if token >= 0 and self._spine(token) is not None and (not before or self.adjacent(before - 1, token)):
                    closed = token
            if node in self.inner:
                going.append(before << self._NODE | node)
        if closed < 0:
            raise ValueError("a byte that the vocabulary doesn't have")
        going.append((closed + 1) << self._NODE)
        return self._state(going)

    def _begin_anew(self, states: np.ndarray) -> np.ndarray:
        """Forget all states but these; gives their new numbers."""
        held, back = np.unique(states, return_inverse=True)
        places = [array("q", self.places[s]) for s in held.tolist()]
        self._reset()
        return np.array([self._state(p) for p in places], np.int64)[back]

    def encode_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces data[start : start + length], one after the other, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        order = np.flatnonzero((lengths <= self.STEP) & (lengths > 0))
        order = order[np.argsort(-lengths[order], kind="stable")]
        done = []
        for at in range(0, len(order), self.LANES):
            block = order[at : at + self.LANES]
            ids, counts[block] = self._side_by_side(data, starts[block], lengths[block])
            done.append((block, ids))
        for i in np.flatnonzero(lengths > self.STEP).tolist():
            ids = np.array(self.encode(data[starts[i] : starts[i] + lengths[i]].tobytes()), np.uint32)
            counts[i] = len(ids)
            done.append((np.array([i]), ids))
        firsts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for block, ids in done:
            out[ragged(firsts[block], counts[block])] = ids
        return out, counts

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For at most LANES pieces of at most STEP bytes, in order of falling length."""
        at = np.cumsum(lengths) - lengths
        lasts = np.zeros(int(lengths.sum()), np.int32)
        states = np.full(len(starts), self.start, np.int64)
        longer = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # how many pieces have more than i bytes
        for i, n in enumerate(longer.tolist()):
            states = states[:n]
            if len(self.places) > self.MOST_STATES:
                states = self._begin_anew(states)
            keys = states << 8 | data[starts[:n] + i]
            states = self.moves.get(keys)
            missing = np.flatnonzero(states < 0)
            if len(missing):
                new, back = np.unique(keys[missing], return_inverse=True)
                made = np.array([self._move(key >> 8, key & 255) for key in new.tolist()], np.int64)
                self.moves.put(new, made)
                states[missing] = made[back]
            lasts[at[:n] + i] = self.last[states]
        # back from last token to last token
        ends, left = at + lengths, np.arange(len(starts))
        steps, counts = [], np.zeros(len(starts), np.int64)
        while len(left):
            token = lasts[ends[left] - 1]
            steps.append((left, token))
            counts[left] += 1
            ends[left] -= self.lengths[token]
            left = left[ends[left] > at[left]]
        stops = np.cumsum(counts)
        ids = np.zeros(int(stops[-1]), np.uint32)
        for k, (left, token) in enumerate(steps):
            ids[stops[left] - 1 - k] = token
        return ids, counts

    def step(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        after = self.single_moves.get(key)
        if after is None:
            after = self.single_moves[key] = self._move(state, byte)
        return after

    def encode(self, piece: bytes) -> list[int]:
        """One pre-token: what all open places agree on leaves after every STEP bytes."""
        out: list[int] = []
        lasts: list[int] = []
        state = self.start
        for at in range(0, len(piece), self.STEP):
            if len(self.places) > self.MOST_STATES or len(self.single_moves) > self.MOST_STATES:
                state = int(self._begin_anew(np.array([state]))[0])
            if at:
                self._emit(lasts, self._agreed(state, lasts), out)
            for byte in piece[at : at + self.STEP]:
                state = self.step(state, byte)
                lasts.append(int(self.last[state]))
        self._emit(lasts, len(lasts), out)
        return out

    def _agreed(self, state: int, lasts: list[int]) -> int:
        """The last border that the encodings up to all open places have in common."""
        borders = {len(lasts) - self.depth[place & 0xFFFFFF] for place in memoryview(self.places[state]).cast("q")}
        while len(borders) > 1:
            last = max(borders)
            borders.remove(last)
            borders.add(last - int(self.lengths[lasts[last - 1]]))
        return borders.pop()

    def _emit(self, lasts: list[int], end: int, out: list[int]) -> None:
        """Moves the tokens up to a border from lasts (for each byte, the last token) to out."""
        tokens, at = [], end
        while at:
            tokens.append(lasts[at - 1])
            at -= int(self.lengths[lasts[at - 1]])
        out += reversed(tokens)
        del lasts[:end]


class Encoder:
    """Whole texts to ids. Pre-tokens are the matches of `pattern`, as the rank files want it."""

    #: A space between two characters that are no white space always begins a pre-token and ends one before it.
    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Chunks between spaces that meet white space: their texts are cut by CUT instead.
    IRREGULAR = r"^$|^[\t-\r\x{1C}-\x{1F}\x{85}\pZ]|[\t-\r\x{1C}-\x{1F}\x{85}\pZ]$"
    #: Letters alone, after one space or none, are one pre-token; so are signs of ENDS after them.
    LETTERS, ENDS = r"^[A-Za-zÀ-ÖØ-öø-ɏ]+$", ".,;:!?"

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s of the pattern means Unicode white space, which in Python's modules also has U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.machine = Transducer(ranks, lambda a, b: ranks.get(a + b, Transducer.NEVER))

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (a string array without nulls), one after the other, and how many each has."""
        chunks = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds, flat = chunks.offsets.to_numpy().astype(np.int64), chunks.flatten()
        bounds = bounds - bounds[0]
        odd = np.add.reduceat(pc.match_substring_regex(flat, self.IRREGULAR).to_numpy(zero_copy_only=False).astype(np.int64), bounds[:-1]) > 0 if len(flat) else np.zeros(0, bool)
        if not odd.any():
            return self._chunks(flat, bounds)
        again = [self.CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        ends = np.cumsum([len(c) for c in again])
        kept = texts.filter(pa.array(~odd))
        one, n_one = self.encode_many(kept) if len(kept) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        two, n_two = self._chunks(pa.array([c for part in again for c in part], pa.large_string()), np.r_[0, ends])
        counts, starts = np.zeros(len(odd), np.int64), np.zeros(len(odd), np.int64)
        counts[~odd], counts[odd] = n_one, n_two
        starts[~odd], starts[odd] = np.cumsum(n_one) - n_one, len(one) + np.cumsum(n_two) - n_two
        return np.concatenate([one, two])[ragged(starts, counts)], counts

    def _chunks(self, flat: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of texts; a space stands before each but a text's first one."""
        coded = flat.dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        n = len(words)
        cores = pc.utf8_rtrim(words, self.ENDS)
        tail_sizes = (pc.binary_length(words).to_numpy() - pc.binary_length(cores).to_numpy()).astype(np.int64)
        simple = pc.match_substring_regex(cores, self.LETTERS).to_numpy(zero_copy_only=False) & (tail_sizes <= 8)
        tail_sizes = tail_sizes[simple]
        core_coded = cores.filter(pa.array(simple)).dictionary_encode()
        letters = core_coded.dictionary
        # first chunks, and what isn't simple, in Python; a first chunk has a number of its own, above n
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        first_words, back = np.unique(index[firsts], return_inverse=True)
        index[firsts] = n + back
        others = [" " + w for w in words.filter(pa.array(~simple)).to_pylist()] + words.take(pa.array(first_words)).to_pylist()
        pieces: dict[str, int] = {}
        lists = [[pieces.setdefault(p, len(pieces)) for p in self.find(w)] for w in others]
        # one buffer: a space and the letters of each simple core, the ends of simple words, the other pieces
        sizes = pc.binary_length(letters).to_numpy().astype(np.int64)
        tailed = np.flatnonzero(tail_sizes)
        tails = pc.utf8_slice_codeunits(words.filter(pa.array(simple)).take(pa.array(tailed)), start=-8) if len(tailed) else pa.array([], pa.large_string())
        spelled = [p.encode() for p in pieces]
        buffer = b" " + b" ".join(letters.cast(pa.large_binary()).to_pylist()) + b"".join(tails.cast(pa.large_binary()).to_pylist()) + b"".join(spelled)
        letter_starts = np.cumsum(sizes + 1) - sizes - 1
        begin = max(1, int((sizes + 1).sum()))
        tail_ends = begin + np.cumsum(pc.binary_length(tails).to_numpy().astype(np.int64))
        begin = int(tail_ends[-1]) if len(tailed) else begin
        spelled_sizes = np.array([len(p) for p in spelled], np.int64)
        starts = np.concatenate([letter_starts, tail_ends - tail_sizes[tailed], begin + np.cumsum(spelled_sizes) - spelled_sizes])
        lengths = np.concatenate([sizes + 1, tail_sizes[tailed], spelled_sizes])
        ids, counts = self.machine.encode_many(np.frombuffer(buffer, np.uint8), starts, lengths)
        id_starts = np.cumsum(counts) - counts
        # pieces of each word: of simple ones the letters and perhaps an end, of others those found
        n_pieces = np.zeros(n + len(first_words), np.int64)
        is_other = np.r_[~simple, np.ones(len(first_words), bool)]
        n_pieces[:n][simple] = 1 + (tail_sizes > 0)
        n_pieces[is_other] = [len(x) for x in lists]
        piece_starts = np.cumsum(n_pieces) - n_pieces
        of_word = np.zeros(int(n_pieces.sum()), np.int64)
        simple_starts = piece_starts[:n][simple]
        of_word[simple_starts] = core_coded.indices.to_numpy()
        of_word[simple_starts[tailed] + 1] = len(letters) + np.arange(len(tailed))
        of_word[ragged(piece_starts[is_other], n_pieces[is_other])] = len(letters) + len(tailed) + np.fromiter((p for x in lists for p in x), np.int64)
        word_ids = ids[ragged(id_starts[of_word], counts[of_word])]
        totals = np.r_[0, np.cumsum(counts[of_word])]
        word_starts = totals[piece_starts]
        word_counts = totals[piece_starts + n_pieces] - word_starts
        out = word_ids[ragged(word_starts[index], word_counts[index])]
        along = np.r_[0, np.cumsum(word_counts[index])]
        return out, along[bounds[1:]] - along[bounds[:-1]]

    def encode(self, text: str) -> list[int]:
        return self.encode_many(pa.array([text]))[0].tolist()


class Utf8Machine:
    """Incremental UTF-8: feed() takes bytes in any pieces and gives the text that is complete so far."""

    def __init__(self, errors: str = "replace"):
        self.errors, self.held = errors, b""

    @staticmethod
    def _wanted(lead: int) -> int:
        """Length of the character that a lead byte begins; 1 for bytes that begin none."""
        return 1 if lead < 0xC2 or lead > 0xF4 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4

    @staticmethod
    def _fits(part: bytes) -> bool:
        """Whether the bytes after the lead byte can follow it."""
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(part[0], (0x80, 0xBF))
        return all((low if i == 0 else 0x80) <= b <= (high if i == 0 else 0xBF) for i, b in enumerate(part[1:]))

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                if self._wanted(lead) > back and self._fits(data[-back:]):
                    cut -= back
                break
            if lead < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", self.errors)


class Decoder:
    """Ids to bytes, and to text piece by piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def stream_bytes(self, ids: Iterable[int], step: int = 1 << 16) -> Iterator[bytes]:
        ids, table = ids if isinstance(ids, (list, memoryview)) else list(ids), self.table
        for at in range(0, len(ids), step):
            yield b"".join(map(table.__getitem__, ids[at : at + step]))

    def stream(self, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
        machine = Utf8Machine(errors)
        for chunk in self.stream_bytes(ids):
            yield machine.feed(chunk)
        yield machine.close()


_loaded: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def loaded(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a rank file, once per Python process."""
    if (path, pattern) not in _loaded:
        ranks = load_ranks(path)
        _loaded[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `ids` (array<int>) of every whole text."""
    rows = texts(docs, id_col, text_col)

    def run(batches):
        encoder, _ = loaded(ranks_path, pattern)
        for part in batches:
            ids, counts = encoder.encode_many(utf8(part.column("text")))
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "ids"])

    return rows.mapInArrow(settled(run, GROUP_BYTES), f"doc_id {id_type(rows)}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`doc_id`, `text` of encode()'s rows; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        _, decoder = loaded(ranks_path, pattern)
        for batch in batches:
            out = ["".join(decoder.stream(ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type(encoded)}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and give digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Narrow: no shuffle, and ids never leave the Python worker that made them.
    """
    rows = texts(docs, id_col, text_col)

    def run(batches):
        encoder, decoder = loaded(ranks_path, pattern)
        for part in batches:
            ids, counts = encoder.encode_many(utf8(part.column("text")))
            ids_sha, decoded_sha = [], []
            for own in np.split(ids.astype("<u4"), np.cumsum(counts)[:-1]):
                ids_sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                machine, digest = Utf8Machine("strict"), hashlib.sha256()
                for chunk in decoder.stream_bytes(own.tolist()):
                    digest.update(machine.feed(chunk).encode())
                digest.update(machine.close().encode())
                decoded_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(settled(run, GROUP_BYTES), f"doc_id {id_type(rows)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
