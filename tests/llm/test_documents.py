"""The operators over documents, each against brute force, with every odd case; and over an empty table."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import public_tokenizers as P
import pytest
from helpers import ODD, corpus, frame, got, want, words
from pyspark.sql import functions as F

from tessel.llm import bpe, decontaminate, jaccard, line_dedup, quality, sstable, substring, token_counts, toxicity
from tessel.scratch import new_path

RANKS, WORD_BPE = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ROWS = corpus() + ODD


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_quality(docs, nothing):
    def judged(doc_id, text):
        w, text = words(text), text or ""
        lines = [x for x in text.split("\n") if words(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 5)}
        n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
        failed = n < 10 or 100 * len(covered) > 20 * n
        kept = not (failed or 10 * symbols > n or 2 * text.count("!") > n or 2 * dup > len(lines) or chars < 3 * n or chars > 12 * n)
        trimmed = [x.strip(" \t\n\v\f\r") for x in lines]
        kept = kept and not (10 * sum(x[0] in "-*•" for x in trimmed) > 9 * len(lines) or 10 * sum(x.endswith(("...", "…")) for x in trimmed) > 3 * len(lines))
        kept = kept and 2 * sum(bool(re.search(r"^[^A-Za-z]*[A-Z][A-Z]+[^a-z]*$", x)) for x in w) <= n
        return doc_id, n, chars, symbols, dup, len(covered), failed, kept

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got(quality.judge(docs), *columns) == want(judged(*r) for r in ROWS)
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        assert got(quality.judge(docs, order=order), *columns) == want(judged(*r) for r in ROWS)
    assert quality.judge(nothing).count() == 0
    assert quality.accepted(nothing).count() == 0
    for order in ([*quality.BASE_RULES, *quality.RULES], [*quality.RULES, *quality.BASE_RULES]):
        assert got(quality.accepted(docs, order=order), "doc_id") == want((r[0],) for r in ROWS if judged(*r)[-1])
    accepted = quality.accepted(docs)
    assert accepted.columns == docs.columns and got(accepted, "doc_id") == want((r[0],) for r in ROWS if judged(*r)[-1])


def test_quality_repeats(spark):
    rows = [(1, " ".join(["Der"] * 40)), (2, " ".join(f"w{i % 7}" for i in range(30))), (3, "a b c d e x a b c d e y a b c d"), (4, "#% " * 30), (5, "A!! B!! C!! " * 5), (6, "same line of words here\n" * 9), (7, "".join(f" - point {i} of all these points\n" for i in range(9))), (8, "".join(f"this line number {i} isn't whole{'...' if i % 2 else '…'} \n" for i in range(9))), (9, " ".join(f"WORD{i} ABC" for i in range(20)))]
    test_quality.__globals__["ROWS"], kept = rows, ROWS
    try:
        test_quality(frame(spark, rows), frame(spark, []))
    finally:
        test_quality.__globals__["ROWS"] = kept


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_line_dedup(spark, docs, nothing, depth):
    lines = [(i, "\n".join(x)) for i, x in enumerate(["abcdefgh", "xabcdey", "abc", "ababab", "aabbaa", ["a", " ", "b", "", "c"], ["a", "b"], ["z"] * 9])]
    rows = [(None, "a\nb\nc"), *lines, *ODD[1:5]]

    def brute():
        seen, gone = {}, {}
        sequences = [[x for x in (t or "").split("\n") if words(x)] for _, t in rows]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
        for d in order:
            for n in range(len(sequences[d]) - depth + 1):
                key = tuple(sequences[d][n : n + depth])
                if key in seen:
                    gone.setdefault(d, set()).update(range(n, n + depth))
                seen.setdefault(key, 1)
        for d, (doc_id, text) in enumerate(rows):
            out, n = [], 0
            for x in (text or "").split("\n"):
                if not words(x):
                    out.append(x)
                else:
                    if n not in gone.get(d, ()):
                        out.append(x)
                    n += 1
            yield doc_id, text if d not in gone else "\n".join(out), len(sequences[d]), len(gone.get(d, ()))

    assert got(line_dedup.deduplicate(frame(spark, rows), depth), "doc_id", "text", "n_lines", "n_removed") == want(brute())
    if depth in (2, 3):
        sequences = {(d, i): [x for x in (t or "").split("\n") if words(x)] for i, (d, t) in enumerate(rows)}
        first = {}
        for key, row in zip(sequences, rows):
            first.setdefault(row, key)  # rows that are repeated whole are one document
        suffixes = [(key, n, sequences[key][n:]) for key in first.values() for n in range(len(sequences[key]))]

        def common(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        def longest(d, i):
            found = [common(s, t) for key, n, s in suffixes if key == first[rows[i]] for other, m, t in suffixes if (other, m) != (key, n)]
            return max([k for k in found if k >= 2], default=0)

        out = line_dedup.deduplicate(frame(spark, rows), depth, with_lengths=True)
        assert got(out, "doc_id", "text", "n_lines", "n_removed", "longest_run") == want((*r, longest(rows[i][0], i)) for i, r in enumerate(brute()))
    twice = line_dedup.deduplicate(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "q\na\nb")]), 2)
    if depth == 2:
        assert got(twice, "doc_id", "text") == want([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "q")])
        assert line_dedup.deduplicate(nothing, 2).count() == 0


def test_bpe_is_the_library(docs, nothing):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})

    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got(bpe.round_trip(docs, RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(row(*r) for r in ROWS)
    assert got(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN), "doc_id", "text") == want((d, t or "") for d, t in ROWS)
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0


def test_substring(docs, nothing):
    def brute(window):
        seen = {}
        for _, text in ROWS:
            w = words(text)
            for i in range(len(w) - window + 1):
                seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
        for doc_id, text in ROWS:
            w = words(text)
            gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
            yield doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)

    for window in (35, 16):
        assert got(substring.deduplicate(docs, window), "doc_id", "n_words", "n_removed", "kept") == want(brute(window))
    assert substring.deduplicate(nothing).count() == 0


def test_substring_batches_and_joins(docs, monkeypatch):
    """The same rows from several batches, merge-joined and compacted, and where the repeated fingerprints are too many for a filter."""
    columns = ("doc_id", "n_words", "n_removed", "kept")
    expected = got(substring.deduplicate(docs), *columns)
    assert got(substring.deduplicate(docs, batches=4), *columns) == expected
    monkeypatch.setattr(substring.Filter, "LIMIT", 0)
    assert got(substring.deduplicate(docs, batches=2), *columns) == expected


def alike_words():
    """Two words of 1,024 bytes that agree under every polynomial hash modulo 2 ** 64."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_that_polynomials_confuse(spark):
    rows = [(i, " ".join(f"w{k}" if k != 20 else word for k in range(40))) for i, word in enumerate(alike_words())]
    assert [r.n_removed for r in substring.deduplicate(frame(spark, rows)).collect()] == [0, 0]
    assert got(jaccard.components(frame(spark, rows)), "doc_id", "component_id") == want([(0, 0), (1, 1)])


def test_word_hashes(monkeypatch):
    """Strips, long words and lanes: the hash depends on the word alone."""
    from tessel.llm import common

    rng = random.Random(9)
    pool = ["a" * n for n in range(1, 200)] + ["".join(rng.choices("abé日", k=rng.randint(1, 90))) for _ in range(300)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", " \t "]) for _ in range(rng.randint(0, 400))).encode() for _ in range(20)] + [b"", b" ", b"x" * 5000]
    one = {w: common.word_hashes([w.encode()]).__next__()[0] for w in pool}
    for strip in (1 << 17, 1 << 10):
        monkeypatch.setattr(common, "STRIP_BYTES", strip)
        for text, found in zip(texts, common.word_hashes(texts)):
            assert found.tolist() == [one.get(w.decode(), common.word_hashes([w]).__next__()[0]) for w in text.split()]
    assert len(set(one.values())) == len(one) == len({common.word_hashes([w.encode()], seed=1).__next__()[0] for w in one} - set(one.values()))


def test_substring_repeats_inside(spark):
    rows = [(1, "x " * 80), (2, " ".join(f"w{i % 37}" for i in range(200))), (3, " ".join(f"v{i}" for i in range(34)))]
    out = {r.doc_id: r.n_removed for r in substring.deduplicate(frame(spark, rows)).collect()}
    assert out == {1: 80, 2: 200, 3: 0}


def test_substring_index_in_batches(spark):
    rows = corpus(5, 30)
    parts = [frame(spark, rows[i::3]) for i in range(3)]
    index = substring.FingerprintIndex(spark, most_runs=2)
    first = substring.deduplicate(parts[0], index=index)
    first.count()
    substring.deduplicate(parts[1], history=parts[0], index=index).count()
    last = substring.deduplicate(parts[2], history=parts[0].union(parts[1]), index=index)
    whole = {r.doc_id: r.kept for r in substring.deduplicate(frame(spark, rows)).collect()}
    assert {r.doc_id: r.kept for r in last.collect()} == {d: whole[d] for d, _ in rows[2::3]}
    assert len(index.runs()) == 1  # three batches, compacted


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)

    def row(doc_id, text):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        return doc_id, len((text or "").encode()), n, n > 50

    assert got(token_counts.count_tokens(docs, WORD_BPE, 50), "doc_id", "n_bytes", "n_tokens", "over_limit") == want(row(*r) for r in ROWS)
    texts = dict(r for r in ROWS if r[0] is not None)
    for r in token_counts.count_tokens(docs.where("doc_id < 48"), WORD_BPE, 50).collect():
        assert len(library.encode(texts[r.doc_id][: r.fit_chars], add_special_tokens=False).ids) <= 50
    counts = token_counts.PrefixCounts(token_counts.loaded(WORD_BPE), ROWS[3][1])
    assert all(counts.at(k) == len(library.encode(ROWS[3][1][:k], add_special_tokens=False).ids) for k in range(0, len(ROWS[3][1]), 7))
    assert token_counts.count_tokens(nothing, WORD_BPE).count() == 0


def test_shards(spark, docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    encoded = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    expected, start = [], 0
    for d, ids in encoded:
        expected.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    rolled = sstable.write_shards(docs, new_path(spark, "test-sst-rolled"), WORD_BPE, n_shards=2, shard_docs=7)
    assert len(rolled) >= len(ROWS) // 7 and got(sstable.read_shards(spark, rolled), "doc_id", "start", "n_tokens", "ids_crc32") == want(expected)
    manifest = sstable.write_shards(docs, new_path(spark, "test-sst"), WORD_BPE, n_shards=3)
    assert got(sstable.read_shards(spark, manifest), "doc_id", "start", "n_tokens", "ids_crc32") == want(expected)
    by_id = {}
    for d, ids in encoded:
        by_id.setdefault(d, []).append(ids)
    found = {}
    for m in manifest:
        shard = sstable.open_shard(m["path"])
        for d in [*by_id, -5, 1 << 40]:
            found.setdefault(d, []).extend(ids.tolist() for ids in shard.get(d))
    assert found == by_id | {-5: [], 1 << 40: []}
    assert sstable.write_and_read(nothing, WORD_BPE).count() == 0


def test_decontaminate(spark, docs, nothing):
    items = [(1, " ".join(words(ROWS[5][1])[:20])), (2, "tie TIE"), (3, ""), (4, None), (None, "日本"), (10, "no such words at all"), (2, "tie TIE")]

    def w(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = {(i, tuple(x[k : k + 13])) for i, t in items if (x := w(t)) for k in range(max(1, len(x) - 12))}

    def row(doc_id, text):
        x = w(text)
        hit, ids = set(), set()
        for i, v in windows:
            for k in range(len(x) - len(v) + 1):
                if tuple(x[k : k + len(v)]) == v:
                    hit.update(range(k, k + len(v)))
                    ids |= {str(i)} if i is not None else set()
        return doc_id, len(x), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(x)

    table = spark.createDataFrame(items, "item_id bigint, text string")
    for broadcast_bytes in (1 << 20, 300):
        found = decontaminate.verdicts(decontaminate.find(docs, table, broadcast_bytes=broadcast_bytes))
        assert got(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == want(row(*r) for r in ROWS)
    assert got(decontaminate.clean(docs, table), "doc_id") == want((r[0],) for r in ROWS if not row(*r)[-1])
    assert decontaminate.find(nothing, table).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.find(docs, table.limit(0)).collect())


def _components(rows, size, percent):
    sets = []
    for _, text in rows:
        x = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))} if x else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        yield doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id


def test_jaccard(spark, docs, nothing):
    assert got(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == want(_components(ROWS, 4, 85))
    assert jaccard.components(nothing).count() == 0
    kept = [r.doc_id for r in jaccard.one_of_each(docs, 5, 80).collect()]
    expected = {(d, c) for d, _, c in _components(ROWS, 5, 80)}
    assert sorted(map(repr, kept)) == sorted(repr(d) for d, c in expected if d == c)


def test_jaccard_chain(spark):
    """Edited copies of one text: links through the least edited ones, and chains of edits with no common hub."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):
        text = list(base)
        for e in range(k % 5):
            text[(k * 13 + e * 29) % 100] = f"e{k}-{e}"
        rows.append((k, " ".join(text)))
    for k in range(20):
        rows.append((100 + k, " ".join([f"c{i}" for i in range(100)][: 100 - k * 2] + [f"d{i}" for i in range(k * 2)])))
    assert got(jaccard.components(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == want(_components(rows, 4, 85))


def test_toxicity(spark, nothing):
    rng = random.Random(4)
    rows = corpus(8, 600)
    toxic = {d: rng.random() < 0.3 for d, _ in rows}
    rows = [(d, t + (" what a blockhead" if toxic[d] else "")) for d, t in rows]
    labels = spark.createDataFrame([(d, int(toxic[d])) for d, _ in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    frame_ = frame(spark, rows + ODD)
    model = toxicity.train(frame_, labels)
    out = toxicity.score(frame_, model).select("doc_id", "score", "predicted", toxicity.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    assert {r.doc_id for r in out if r.held_out} == {d for d in {r.doc_id for r in out} if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum((r.predicted == 1) == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    empty = toxicity.train(frame_, labels.limit(0))
    assert empty.bias == 0 and not empty.weights.any() and toxicity.score(nothing, model).count() == 0


def test_toxicity_is_a_plain_classifier(spark):
    """Features, ratios, fit and scores against an implementation without hashing tables, slices or the dual."""
    import numpy as np

    rng = random.Random(14)
    rows = corpus(9, 240)
    toxic = {d: int(rng.random() < 0.3) for d, _ in rows}
    rows = [(d, t + (rng.choice([" what a blockhead", " you utter nitwit"]) if toxic[d] else rng.choice(["", " fine weather"]))) for d, t in rows]

    def bucket(gram):
        rolled = 0
        for i, b in enumerate(gram):
            rolled = b if i == 0 else (rolled * 0x01000193 + b) & 0xFFFFFFFF
        return ((rolled ^ (rolled >> 15) ^ len(gram)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    def features(text):
        data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
        return {bucket(data[i : i + n]) for n in (4, 6, 8) for i in range(len(data) - n + 1)}

    train = [(features(t), toxic[d]) for d, t in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    n_one, n_zero = sum(y for _, y in train), sum(1 - y for _, y in train)
    ratio = {}
    for b in set().union(*(f for f, _ in train)):
        one = (sum(b in f for f, y in train if y) + 1) / (n_one + 2)
        zero = (sum(b in f for f, y in train if not y) + 1) / (n_zero + 2)
        pooled = (one * n_one + zero * n_zero) / (n_one + n_zero)
        if abs(one - zero) >= 5 * (pooled * (1 - pooled) * (1 / n_one + 1 / n_zero)) ** 0.5:
            ratio[b] = np.log(one / zero)
    chosen = sorted(ratio)
    assert len(chosen) > 10
    x = np.array([[ratio[b] if b in f else 0.0 for b in chosen] + [1.0] for f, _ in train])
    y = np.array([y for _, y in train])
    w = np.zeros(len(chosen) + 1)
    for _ in range(50):  # Newton: squared weights / 2 + 0.3 * losses
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(np.eye(len(w)) + 0.3 * (x.T * (p * (1 - p))) @ x, w + 0.3 * x.T @ (p - y))
    weight = dict(zip(chosen, w))
    expected = {d: 1 / (1 + np.exp(-w[-1] - sum(weight[b] * ratio[b] for b in features(t) if b in weight))) for d, t in rows}
    labels = spark.createDataFrame(sorted(toxic.items()), "doc_id bigint, toxic int")
    table = frame(spark, rows + [(90000, ""), (91000, None)])
    scores = {r.doc_id: r.score for r in toxicity.score(table, toxicity.train(table, labels)).collect()}
    assert all(abs(scores[d] - expected[d]) < 2e-3 for d, _ in rows)
    assert abs(scores[90000] - 1 / (1 + np.exp(-w[-1]))) < 2e-3 and scores[90000] == scores[91000]


def test_toxicity_slices(monkeypatch):
    text = "".join(random.Random(3).choices("abcdeé ", k=4000)).encode()
    whole = toxicity.present(text).tolist()
    monkeypatch.setattr(toxicity, "SLICE", 100)
    assert toxicity.present(text).tolist() == whole


@pytest.mark.parametrize("size", [3, 600])
def test_jaccard_long_sets_and_joins(spark, monkeypatch, size):
    """Long signatures, and sets and tokens beyond the filters' bound, against brute force."""
    rng = random.Random(size)
    rows = []
    for k in range(6):
        base = [f"b{k}-{i}" for i in range(size * (1 + k % 2))]
        for e in (0, 0.01, 0.02, 0.06):
            rows.append((len(rows), " ".join(w if rng.random() >= e else f"e{rng.random()}" for w in base)))
    monkeypatch.setattr(jaccard, "LONG", 100)
    expected = want(_components(rows, 4, 85))
    assert got(jaccard.components(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == expected
    monkeypatch.setattr(jaccard.Filter, "LIMIT", 0)
    assert got(jaccard.components(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == expected


@pytest.mark.parametrize("depth", [2, 3])
def test_line_dedup_long_lines(spark, nothing, depth):
    long, longer = " ".join(f"w{i}" for i in range(50)), "\t".join(f"v{i}" for i in range(60))
    short = " ".join(f"w{i}" for i in range(49))
    rows = [(1, long), (2, f"a\n{long}\nb"), (3, f"{short}\nx"), (4, short), (5, f"{longer}\n\n{longer}"), (6, f"a\n{long}"), (6, f"{longer}\nq"), (7, "\na\n" + long + "\nb\nc"), (8, long), (9, None), (10, "")]
    seen, seen_runs, expected = set(), set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], rows.index(r))):
        lines = (text or "").split("\n")
        filled = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for k, i in enumerate(filled):
            if len(words(lines[i])) >= 50:
                gone |= {i} if lines[i] in seen else set()
                seen.add(lines[i])
            run = tuple(lines[j] for j in filled[k : k + depth])
            if len(run) == depth:
                gone |= set(filled[k : k + depth]) if run in seen_runs else set()
                seen_runs.add(run)
        expected.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(filled), len(gone)))
    assert (8, "", 1, 1) in expected and (4, short, 1, 0) in expected
    assert got(line_dedup.deduplicate(frame(spark, rows), depth, long_words=50), "doc_id", "text", "n_lines", "n_removed") == want(expected)
    assert line_dedup.deduplicate(nothing, depth, long_words=50).count() == 0


def test_one_of_each_with_null_and_shared_ids(spark):
    say = lambda kind, k=60: " ".join(f"{kind}{i}" for i in range(k))
    near = lambda kind: say(kind, 59) + " edited"
    rows = [(None, say("a")), (None, near("a")), (None, ""), (None, None), (None, say("b")), (1, near("b")), (2, say("c")), (2, near("c")), (3, say("d")), (3, say("e")), (4, near("d")), (5, say("f")), (5, say("f").upper()), (5, say("f")), (6, ""), (6, "")]
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, rows), 5, 80).collect()]
    groups = [[(None, say("a")), (None, near("a"))], [(1, near("b"))], [(2, say("c")), (2, near("c"))], [(3, say("d"))], [(3, say("e"))], [(5, say("f")), (5, say("f").upper())], [(None, "")], [(None, None)], [(6, "")]]
    assert len(kept) == len(groups)
    assert all(sum(k in g for k in kept) == 1 for g in groups)
