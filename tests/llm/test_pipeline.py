"""The pipeline and each of its stages against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import re
import struct

import public_tokenizers as P
from helpers import ODD, corpus, frame, words

import corpus_pipeline
from tessel.scratch import new_path

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item")]


def documents():
    rows = corpus(11, 30) + [r for r in ODD if r[0] is not None]
    rows += [(200, "pad " + ITEMS[0][1] + " " + " ".join(f"q{i}" for i in range(30))), (201, " ".join(f"q{i}" for i in range(300)) + " short item"), (202, "### $$$ " * 20), (203, " ".join(["Die"] * 30))]
    rows += [(230, " ".join(f"near{i}" for i in range(100))), (231, " ".join(f"near{i}" for i in range(99)) + " Edited"), (232, " ".join(f"NEAR{i}" for i in range(100)))]
    shared = "a line of words that many share\nand another line right after it"
    return rows + [(210 + i, f"{shared}\n" + " ".join(f"u{i}_{k}" for k in range(20))) for i in range(3)] + [(220, shared)]


def quality(rows):
    for d, text in rows:
        w, text = words(text), text or ""
        n, windows = len(w), [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        repeated = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        chars = sum(map(len, w))
        bad = n < 10 or 100 * len(repeated) > 20 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 2 * text.count("!") > n or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 3 * n or chars > 12 * n
        if not bad:
            yield d, text


def line_dedup(rows):
    seen = set()
    for d, text in sorted(rows):
        lines = [x for x in text.split("\n") if words(x)]
        gone = set()
        for i in range(len(lines) - 1):
            if (lines[i], lines[i + 1]) in seen:
                gone |= {i, i + 1}
            seen.add((lines[i], lines[i + 1]))
        if not gone:
            yield d, text
        elif len(gone) < len(lines):
            out, n = [], 0
            for x in text.split("\n"):
                filled = bool(words(x))
                if not filled or n not in gone:
                    out.append(x)
                n += filled
            yield d, "\n".join(out)


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def near(rows):
    rows = sorted(rows)
    sets = []
    for _, text in rows:
        w = words(low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                one, two = max(label[i], label[j]), min(label[i], label[j])
                label = [two if x == one else x for x in label]
    return [r for i, r in enumerate(rows) if label[i] == i]


def clean(rows):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(w[k : k + 13]) for _, t in ITEMS if (w := split(t)) for k in range(max(1, len(w) - 12))}
    for d, text in rows:
        w = split(text)
        hit = {p for v in windows for k in range(len(w) - len(v) + 1) if tuple(w[k : k + len(v)]) == v for p in range(k, k + len(v))}
        if not hit or 20 * len(hit) < len(w):
            yield d, text


def test_stages(spark):
    import tiktoken

    sf_dir = new_path(spark, "pipeline-tables")
    rows = documents()
    table = frame(spark, rows, extra=False).selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    table.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs, expected = spark.read.parquet(f"{sf_dir}/documents.parquet"), rows
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], (quality, line_dedup, near, clean)):
        docs, before = stage(spark, docs, sf_dir), len(expected)
        expected = sorted(brute(expected))
        assert docs.columns == table.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == expected
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert len(expected) < before
    ranks = corpus_pipeline.bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = []
    for d, text in expected:
        ids = library.encode_ordinary(text)
        final.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == final
