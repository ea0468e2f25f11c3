"""Exact token counts of every prefix of a text, by dynamic programming.

Words between ASCII white space are encoded independently of each other by the tokenizer (its pattern never crosses white space, its
normaliser neither), and so are the pre-tokens of a word. Of each prefix of a pre-token, the transducer of the merges names the last token,
both if the pre-token went on and if it ended there (a byte that no text has stands for the end of a word):

    open[i]   = 1 + open[i - length of the last token of the first i bytes]
    ended[i]  = 1 + open[i - length of the last token of the first i bytes and the end of the word]

This runs over the distinct pre-tokens of many texts side by side, and ended[] of all of them is kept as long as these texts are. A
pre-token's tokens are the last of its ended[], and the counts go on from there over the pre-tokens of a word and the words of a text:
count[i] = count[i - 1] + tokens of word i. Totals, budgets and truncations are all read from these counts. The library normalises and
finds pre-tokens, with its own tables of characters; it doesn't encode anything here (WordTokenizer.words, which gives ids, has it do so).

Cuts inside a special string, a contraction ('re) or a sequence that the normaliser composes make another text than what stands there.
Words with such strings or sequences are read by the same programme character by character, and each cut goes on from the last place that
it leaves as it is.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are handled as the library does by default
(matched as special tokens); bytes that are no UTF-8 are read as U+FFFD, though n_bytes counts the bytes that are there; repeated rows and
null ids give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import Transducer, ragged
from .common import id_type, settled, texts, utf8

#: Texts are looked up together until they have this many bytes.
GROUP_BYTES = 24 << 20


class Words(NamedTuple):
    """Texts as words: text t is the words index[bounds[t] : bounds[t + 1]]; word w has the ids ids[starts[w] : starts[w] + counts[w]]."""

    index: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    def text_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text ends."""
        along = np.r_[0, np.cumsum(self.counts[self.index])]
        return self.ids[ragged(self.starts[self.index], self.counts[self.index])], along[self.bounds[1:]]


class Counts(NamedTuple):
    """Token counts of all prefixes of texts. Text t is the words index[bounds[t] : bounds[t + 1]], and all words before the k-th have
    along[k] tokens; word w is the pre-tokens pieces[firsts[w] : firsts[w + 1]]; the first i bytes of pre-token p have ended[places[p] + i]
    tokens (-1 inside a character), and all of it ended[places[p + 1] - 1]."""

    index: np.ndarray
    bounds: np.ndarray
    along: np.ndarray
    pieces: np.ndarray
    firsts: np.ndarray
    ended: np.ndarray
    places: np.ndarray

    def totals(self) -> np.ndarray:
        return np.diff(self.along[self.bounds])

    def inside(self, word: int) -> list[np.ndarray]:
        """ended[] of each pre-token of a word."""
        return [self.ended[self.places[p] : self.places[p + 1]] for p in self.pieces[self.firsts[word] : self.firsts[word + 1]].tolist()]


class Simple(NamedTuple):
    """Distinct words by whether they are letters, perhaps with ENDS after them: simple[w]; the simple ones' letters in lower case, and the ends of
    those that have one, tailed (dictionary arrays)."""

    simple: np.ndarray
    letters: pa.DictionaryArray
    tailed: np.ndarray
    ends: pa.DictionaryArray


class WordTokenizer:
    """A `tokenizers` file whose words end with a suffix, whose tokens never cross white space, nor a border between letters and
    punctuation, and don't tell upper from lower case."""

    #: Letters of which either case is the same to the normaliser, and signs after them that are a pre-token of their own.
    LETTERS, ENDS = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?"
    #: Words that the library encodes in one call, joined by spaces.
    JOINED = 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.file = json.load(file)
        model, splits = self.file["model"], [p for p in self.file["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        self.suffix = model.get("end_of_word_suffix")
        if not self.suffix or len(splits) != 1 or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
            raise ValueError("only files with word ends, whose pattern leaves white space out")
        self.pattern = splits[0]["pattern"]["Regex"]
        self.ends_word = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends_word[[number for token, number in model["vocab"].items() if token.endswith(self.suffix)]] = True
        self._machine: PrefixMachine | None = None

    @property
    def machine(self) -> PrefixMachine:
        if self._machine is None:
            self._machine = PrefixMachine(self.file, self.pattern, self.library)
        return self._machine

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(f) for f in found], np.int64)
        return np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum())), counts

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone: each is one pre-token, so a token with the suffix ends each."""
        ids, _ = self._flat([" ".join(words[at : at + self.JOINED]) for at in range(0, len(words), self.JOINED)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _simple(self, words: pa.Array) -> Simple:
        cores = pc.utf8_rtrim(words, self.ENDS)
        tails = (pc.binary_length(words).to_numpy() - pc.binary_length(cores).to_numpy()).astype(np.int64)
        simple = pc.match_substring_regex(cores, self.LETTERS).to_numpy(zero_copy_only=False)
        coded = pc.utf8_lower(cores.filter(pa.array(simple))).dictionary_encode()
        # the ends: few distinct ones
        tailed = np.flatnonzero(simple & (tails > 0))
        whole = words.filter(pa.array(simple & (tails > 0))).cast(pa.large_binary())
        sizes = tails[tailed]
        data = np.frombuffer(b"".join(whole.to_pylist()), np.uint8)
        stops = np.cumsum(pc.binary_length(whole).to_numpy())
        cut = data[ragged(stops - sizes, sizes)].tobytes()
        offsets = np.r_[0, np.cumsum(sizes)]
        ends = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(cut)).dictionary_encode()
        return Simple(simple, coded, tailed, ends)

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts, counts of words (a large string array)."""
        simple, coded, tailed, ends = self._simple(words)
        found = [self._letters(coded.dictionary.to_pylist()), self._flat(ends.dictionary.to_pylist()), self._flat(words.filter(pa.array(~simple)).to_pylist())]
        ids, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        firsts = np.cumsum(counts) - counts
        n_letters, n_ends = len(coded.dictionary), len(ends.dictionary)
        # a simple word is its letters' ids and perhaps its end's
        head, tail = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        head[simple] = coded.indices.to_numpy()
        head[~simple] = n_letters + n_ends + np.arange(int((~simple).sum()))
        tail[tailed] = n_letters + ends.indices.to_numpy()
        parts = np.stack([head, tail], 1).ravel()
        parts = parts[parts >= 0]
        each = counts[parts]
        totals = np.r_[0, np.cumsum(each)]
        n_parts = 1 + (tail >= 0)
        last = np.cumsum(n_parts)
        return ids[ragged(firsts[parts], each)], totals[last - n_parts], totals[last] - totals[last - n_parts]

    @staticmethod
    def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of texts (without nulls), the words of all texts by their number among these, and where each text's begin."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds, flat = split.offsets.to_numpy().astype(np.int64), split.flatten()
        coded = flat.dictionary_encode()
        index, bounds = coded.indices.to_numpy(), bounds - bounds[0]
        # white space at an edge gives an empty word
        filled = (pc.binary_length(coded.dictionary).to_numpy() > 0)[index]
        return coded.dictionary, index[filled], np.r_[0, np.cumsum(filled)][bounds]

    def words(self, texts: pa.Array) -> Words:
        """Texts (without nulls) by their words; each distinct word is encoded once."""
        words, index, bounds = self._coded(texts)
        return Words(index, bounds, *self.distinct(words))

    def counts(self, texts: pa.Array) -> Counts:
        """Of all prefixes of texts (without nulls), by the programme; each distinct pre-token goes through it once."""
        words, index, bounds = self._coded(texts)
        simple, coded, tailed, ends = self._simple(words)
        n_letters, n_ends = len(coded.dictionary), len(ends.dictionary)
        # others: their pre-tokens, and last of all a special string
        pieces: dict[str, int] = {}
        lists = [[-1 if p is None else n_letters + n_ends + pieces.setdefault(p, len(pieces)) for p in self.machine.pieces(w)] for w in words.filter(pa.array(~simple)).to_pylist()]
        spelled = pa.concat_arrays([coded.dictionary, ends.dictionary, pa.array(list(pieces), pa.large_string())])
        sizes = pc.binary_length(spelled).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(spelled.cast(pa.large_binary()).to_pylist()), np.uint8)
        ended, places = self.machine.ended(data, np.cumsum(sizes) - sizes, sizes)
        ended, places = np.r_[ended, np.int32(1)], np.r_[places, len(ended) + 1]
        n_pieces = np.ones(len(words), np.int64)
        n_pieces[tailed] = 2
        n_pieces[~simple] = [len(x) for x in lists]
        firsts = np.r_[0, np.cumsum(n_pieces)]
        of_word = np.zeros(int(firsts[-1]), np.int64)
        of_word[firsts[:-1][simple]] = coded.indices.to_numpy()
        of_word[firsts[tailed] + 1] = n_letters + ends.indices.to_numpy()
        of_word[ragged(firsts[:-1][~simple], n_pieces[~simple])] = np.fromiter((p for x in lists for p in x), np.int64)
        of_word[of_word < 0] = len(places) - 2
        totals = np.r_[0, np.cumsum(ended[places[1:] - 1][of_word], dtype=np.int64)]
        along = np.r_[0, np.cumsum((totals[firsts[1:]] - totals[firsts[:-1]])[index])]
        return Counts(index, bounds, along, of_word, firsts, ended, places)


class Made(dict):
    """Makes the value of a key when it is first asked for."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class PrefixMachine:
    """Token counts of the prefixes of a word, by the merges of a tokenizer file."""

    END = 0xFF
    CONTRACTED = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
    #: Pre-tokens of more bytes are read one by one.
    LONG = 1024
    #: A character of each kind (letter, number, white space, other) that no contraction has.
    KINDS = {"L": "x", "N": "0", "S": " ", "P": "!"}
    #: Letters that are composed with what stands before them: medial and final jamo, vowel signs of Kirat Rai.
    JOINING = regex.compile("[\u1160-\u11ff\ud7b0-\ud7ff\U00016d63-\U00016d6a]")

    def __init__(self, file: dict, pattern: str, library):
        from tokenizers.normalizers import NFC

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        suffix = file["model"]["end_of_word_suffix"]

        def spelled(token: str) -> bytes:
            ended = token.endswith(suffix)
            return bytes(byte_of[c] for c in token.removesuffix(suffix)) + bytes([self.END]) * ended

        vocabulary = {spelled(token): number for token, number in file["model"]["vocab"].items()}
        vocabulary = {token: number for token, number in vocabulary.items() if self.END not in token[:-1] and token != bytes([self.END])}
        ranks = {tuple(map(spelled, pair if isinstance(pair, list) else pair.split(" "))): rank for rank, pair in enumerate(file["model"]["merges"])}
        # the end of a word belongs to its last byte before any merge
        ranks |= {(bytes([b]), bytes([self.END])): -1 for b in range(256)}
        self.machine = Transducer(vocabulary, lambda a, b: ranks.get((a, b), Transducer.NEVER))
        self.pre_tokens = regex.compile(pattern).finditer
        self.special = [t["content"] for t in file["added_tokens"]]
        if any(a != b and a in b for a in self.special for b in self.special):
            raise ValueError("only files whose special strings aren't parts of one another")
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        # the library's tables of characters, which may be of another version than Python's
        self.composed, self.normalized, self._split = NFC().normalize_str, library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.normal, self.kind = Made(self.normalized), Made(self._kind)
        self.alike = Made(lambda c: chr(c) if chr(c) == "'" or chr(c).isascii() and chr(c).isalnum() else self.KINDS[self.kind[chr(c)]])
        self.contracted = {c: int(self._piece(c.encode())[-1]) for c in self.CONTRACTED}

    def _kind(self, c: str) -> str:
        """Whether the pattern takes a character for a letter, a number, white space or something else."""
        spans = [span for _, span in self._split(c + "a")]
        if len(spans) == 1:
            return "L" if spans[0][0] == 0 else "S"
        return "P" if len(self._split(c + c)) == 1 else "N"

    def pieces(self, word: str) -> Iterator[str | None]:
        """The pre-tokens of a word as the library finds them; None for a special string."""
        at = 0
        for match in self.specials.finditer(word):
            yield from self._pieces(word[at : match.start()])
            yield None
            at = match.end()
        yield from self._pieces(word[at:])

    def _pieces(self, text: str) -> Iterator[str]:
        text = text.lower() if text.isascii() else self.normalized(text)
        for match in self.pre_tokens(text.translate(self.alike)):
            yield text[match.start() : match.end()]

    def _after(self, states: np.ndarray, bytes_: np.ndarray | int) -> np.ndarray:
        machine, keys = self.machine, states << 8 | bytes_
        after = machine.moves.get(keys)
        missing = np.flatnonzero(after < 0)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            made = np.array([machine._move(key >> 8, key & 255) for key in new.tolist()], np.int64)
            machine.moves.put(new, made)
            after[missing] = made[back]
        return after

    def ended(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ended[0], ended[1], ... of all pre-tokens data[start : start + length], one after the other, and where each one's begin."""
        places = np.r_[0, np.cumsum(lengths + 1)]
        out = np.zeros(int(places[-1]), np.int32)
        order = np.argsort(-lengths, kind="stable")
        n_long = int((lengths > self.LONG).sum())
        for i in order[:n_long].tolist():
            out[places[i] : places[i + 1]] = self._piece(data[starts[i] : starts[i] + lengths[i]].tobytes())
        for at in range(n_long, len(order), self.machine.LANES):
            block = order[at : at + self.machine.LANES]
            out[ragged(places[block], lengths[block] + 1)] = self._side_by_side(data, starts[block], lengths[block])
        return out, places

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For at most LANES pre-tokens, in order of falling length."""
        machine = self.machine
        at = np.cumsum(lengths + 1) - lengths - 1
        opened, ended = np.zeros(int((lengths + 1).sum()), np.int32), np.full(int((lengths + 1).sum()), -1, np.int32)
        ended[at] = 0
        states = np.full(len(starts), machine.start, np.int64)
        longer = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # how many have more than i bytes
        for i, n in enumerate(longer.tolist(), 1):
            states = states[:n]
            if len(machine.places) > machine.MOST_STATES:
                states = machine._begin_anew(states)
            states = self._after(states, data[starts[:n] + i - 1])
            here = at[:n] + i
            opened[here] = 1 + opened[here - machine.lengths[machine.last[states]]]
            # a character that isn't whole has no end
            whole = np.flatnonzero((lengths[:n] == i) | (data[np.minimum(starts[:n] + i, len(data) - 1)] & 0xC0 != 0x80))
            closed = self._after(states[whole], self.END)
            ended[here[whole]] = 1 + opened[here[whole] + 1 - machine.lengths[machine.last[closed]]]
        return ended

    def _piece(self, piece: bytes) -> array:
        """ended[i] for i = 0 .. len(piece), by the programme above."""
        machine, state = self.machine, self.machine.start
        opened, ended = array("i", (0,)), array("i", (0,))
        for i, byte in enumerate(piece, 1):
            if not i % machine.STEP and max(len(machine.places), len(machine.single_moves)) > machine.MOST_STATES:
                state = int(machine._begin_anew(np.array([state]))[0])
            state = machine.step(state, byte)
            opened.append(1 + opened[i - int(machine.lengths[machine.last[state]])])
            # a character that isn't whole has no end
            if i == len(piece) or piece[i] & 0xC0 != 0x80:
                closed = machine.step(state, self.END)  # may make machine.last anew
                ended.append(1 + opened[i + 1 - int(machine.lengths[machine.last[closed]])])
            else:
                ended.append(-1)
        return ended

    def _plain(self, word: str, inside: list[np.ndarray]) -> np.ndarray:
        """Counts of the prefixes (0, 1, ... characters) of a word in composed form without special strings, from its pre-tokens' ended[]."""
        lowered = [self.normal[c] for c in word]  # one by one, as the normaliser does
        places = np.r_[0, np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))]
        whole = "".join(lowered)
        counts, before, at = np.zeros(len(whole) + 1, np.int32), 0, 0
        for match, ended in zip(self.pre_tokens(whole.translate(self.alike)), inside, strict=True):
            piece = whole[match.start() : match.end()]
            counts[at : match.start()] = before
            counts[match.start() : match.end() + 1] = before + ended[ended >= 0]
            if piece in self.CONTRACTED:
                for k in range(1, len(piece)):
                    counts[match.start() + k] = before + self._piece(b"'")[-1] + (self._piece(piece[1:k].encode())[-1] if k > 1 else 0)
            before, at = int(counts[match.end()]), match.end()
        counts[at:] = before
        return counts[places]

    def clusters(self, text: str) -> Iterator[str]:
        """Parts of a text that are composed independently of each other."""
        start = 0
        for i, c in enumerate(text):
            if i > start and not (unicodedata.category(c) in ("Mn", "Mc", "Me", "Cn") or self.JOINING.match(c)):
                yield text[start:i]
                start = i
        if start < len(text):
            yield text[start:]

    def _odd(self, word: str) -> list[int]:
        """Counts of the prefixes of any word."""
        reading, counts, at = Reading(self), [0], 0
        for match in self.specials.finditer(word):
            counts += reading.through(word[at : match.start()])
            before = reading.save()
            counts += reading.through(match[0][:-1])
            reading.back(before)
            reading.special()
            counts.append(reading.now)
            at = match.end()
        return counts + list(reading.through(word[at:]))

    def prefixes(self, word: str, inside: list[np.ndarray]) -> np.ndarray:
        """Counts of the prefixes (0, 1, ... characters) of a word, whose pre-tokens' ended[] is given."""
        if word.isascii() or self.composed(word) == word:
            if not self.specials.search(word):
                return self._plain(word, inside)
        return np.array(self._odd(word), np.int32)


class Reading:
    """Reads a text character by character; `now` is the token count if it ended here. save() and back() go back to an earlier place."""

    def __init__(self, prefixes: PrefixMachine):
        self.prefixes, self.machine = prefixes, prefixes.machine
        # tokens before the open pre-token, its kind and open[]; the beginning of a contraction, and the tokens before that
        self.now = self.before = self.base = 0
        self.kind = self.held = ""
        self.opened = [0]
        self.places = self.start = self.machine.places[self.machine.start]

    def save(self) -> tuple:
        return self.now, self.before, self.base, self.kind, self.held, self.places, self.opened, len(self.opened)

    def back(self, saved: tuple) -> None:
        self.now, self.before, self.base, self.kind, self.held, self.places, self.opened, n = saved
        del self.opened[n:]

    def special(self) -> None:
        self.now += 1
        self.kind = self.held = ""

    def read(self, c: str) -> None:
        """One character of the normalised text."""
        kind, machine = self.prefixes.kind[c], self.machine
        if self.held + c in self.prefixes.contracted:
            self.now = self.base + self.prefixes.contracted[self.held + c]
            self.kind = self.held = ""
            return
        if kind == "S":
            self.kind = self.held = ""
            return
        if kind != self.kind or kind == "N":
            self.held = "'" + c if self.held == "'" and c in "rvl" else ""
            self.before, self.kind, self.opened, self.places = self.now, kind, [0], self.start
            if c == "'":
                self.base, self.held = self.now, c
        else:
            self.held = ""
        if max(len(machine.places), len(machine.single_moves)) > machine.MOST_STATES:
            machine._reset()
        state, opened = machine._state(array("q", self.places)), self.opened
        for byte in c.encode():
            state = machine.step(state, byte)
            opened.append(1 + opened[len(opened) - int(machine.lengths[machine.last[state]])])
        self.places = machine.places[state]
        closed = machine.step(state, self.prefixes.END)
        self.now = self.before + 1 + opened[len(opened) - int(machine.lengths[machine.last[closed]])]

    def through(self, text: str) -> Iterator[int]:
        """Reads a text without special strings; the counts after each of its characters."""
        for cluster in self.prefixes.clusters(text):
            done, saved = "", [self.save()]
            for i in range(1, len(cluster) + 1):
                composed = self.prefixes.composed(cluster[:i])
                same = len(done) if composed.startswith(done) else len(os.path.commonprefix([composed, done]))
                self.back(saved[same])
                del saved[same + 1 :]
                for c in composed[same:]:
                    for lowered in self.prefixes.normal[c]:
                        self.read(lowered)
                    saved.append(self.save())
                done = composed
                yield self.now


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes, and bytes after the last, of the words between ASCII white space."""
    read = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(read) + 2, bool)
    inside[1:-1] = ~((read == 32) | ((read >= 9) & (read <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


class PrefixCounts:
    """Token counts of the prefixes of one text; found: the counts of texts, of which it is the number-th."""

    def __init__(self, tokenizer: WordTokenizer, text: str, found: Counts | None = None, number: int = 0):
        self.tokenizer, self.data = tokenizer, text.encode()
        self.found = tokenizer.counts(pa.array([text])) if found is None else found
        first, last = self.found.bounds[number], self.found.bounds[number + 1]
        self.starts, self.ends = word_places(self.data)
        self.words, self.counts = self.found.index[first:last], self.found.along[first : last + 1] - self.found.along[first]
        self.inner: dict[int, np.ndarray] = {}

    def total(self) -> int:
        return int(self.counts[-1])

    def _word(self, number: int) -> str:
        return self.data[self.starts[number] : self.ends[number]].decode()

    def _inner(self, number: int) -> np.ndarray:
        if number not in self.inner:
            self.inner[number] = self.tokenizer.machine.prefixes(self._word(number), self.found.inside(int(self.words[number])))
        return self.inner[number]

    def _byte(self, n_chars: int) -> int:
        return len(self.data.decode()[:n_chars].encode())

    def at(self, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        end = self._byte(max(0, n_chars))
        k = int(np.searchsorted(self.ends, end, side="right"))
        if k == len(self.ends) or self.starts[k] >= end:
            return int(self.counts[k])
        return int(self.counts[k] + self._inner(k)[len(self.data[self.starts[k] : end].decode())])

    def fits(self, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens that ends in or at the end of a word; all, if all of it fits."""
        if self.total() <= budget:
            return len(self.data.decode())
        k = bisect_right(self.counts, budget) - 1  # so many whole words
        most = int(np.flatnonzero(self.counts[k] + self._inner(k) <= budget)[-1])
        if most:
            return len(self.data[: self.starts[k]].decode()) + most
        return len(self.data[: self.ends[k - 1]].decode()) if k else 0

    def truncated(self, budget: int) -> str:
        return self.data.decode()[: self.fits(budget)]


_loaded: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the budget), fit_chars (characters of the longest prefix that
    is within the budget, see PrefixCounts.fits). Narrow: no shuffle."""
    rows = texts(docs, id_col, text_col)

    def run(parts):
        tokenizer = loaded(tokenizer_path)
        for part in parts:
            column = utf8(part.column("text"))
            found = tokenizer.counts(column)
            totals = found.totals()
            fits = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero(totals > budget).tolist():
                fits[i] = PrefixCounts(tokenizer, column[i].as_py(), found, i).fits(budget)
            n_bytes = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, pa.array(totals), pa.array(totals > budget), pa.array(fits)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return rows.mapInArrow(settled(run, GROUP_BYTES), f"doc_id {id_type(rows)}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
