"""Parts without Spark, URL filters and the registered queries."""

from __future__ import annotations

import codecs
import random

import numpy as np
import public_tokenizers as P
import pytest

from tessel.llm import bpe, queries, sstable, token_counts, urls


def test_transducer_is_the_library():
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, P.PATTERN)
    encoder.machine.MOST_STATES = 500  # forgets now and then
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "'", "!", "\x1c", "\x85", " ", "日本", "🙂", "́", "<|endoftext|>", "ing", "tion", "\r\n", " \n", "²", "\x0b"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 15)))
        assert encoder.encode(text) == library.encode_ordinary(text), text
    long = "ab\n" * 5000 + "z" * 20000
    assert encoder.encode(long) == library.encode_ordinary(long)


def test_many_texts_at_once(monkeypatch):
    """Regular and irregular white space, simple words, long ends and long pieces together, while states are forgotten."""
    import pyarrow as pa
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    signs = list("aAbé ß中文字'  \n\n\t.,;:!?#|0123  \x1c\x85ôöɏɐ🙂ntsverll")
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "a" * 5000, "ab" * 3000 + " " + "x" * 70 + ".........", "hello......... world,,,,,,,,,,,,", "中" * 500, "don't they'll we've I'm"]
    encoder = bpe.Encoder(ranks, P.PATTERN)
    for lanes, states in ((8192, 300_000), (16, 400)):
        monkeypatch.setattr(encoder.machine, "LANES", lanes)
        monkeypatch.setattr(encoder.machine, "MOST_STATES", states)
        ids, counts = encoder.encode_many(pa.array(texts))
        ends = counts.cumsum()
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [library.encode_ordinary(t) for t in texts]
    assert encoder.encode_many(pa.array([], pa.string()))[0].tolist() == []


def test_prefix_counts_are_the_library():
    import pyarrow as pa

    tokenizer = token_counts.loaded(P.path("word_bpe_49k.json"))
    count = lambda text: len(tokenizer.library.encode(text, add_special_tokens=False).ids)
    rng = random.Random(7)
    parts = list("aAbé ß中文字'  \n\t\v\f.,;:!?#|0123\x1c\x85ôöɏɐ🙂édntsverllİΣσſḰ가") + ["<|endoftext|>", "<|startoftext|>", "<|endo", "'re", "'ll", "internation"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(120)] + ["", " ", "we'd've 'twas <|endoftext|>ok<|endoftext|>", "".join(rng.choices("etaoinshrdlu", k=150)), "中文" * 60]
    found = tokenizer.words(pa.array(texts))
    ids, ends = found.text_ids()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [tokenizer.library.encode(t, add_special_tokens=False).ids for t in texts]
    for text in texts:
        counts = token_counts.PrefixCounts(tokenizer, text)
        each = [count(text[:k]) for k in range(len(text) + 1)]
        assert [counts.at(k) for k in range(len(text) + 1)] == each, text
        for budget in (0, 1, 4, 20):
            fit = counts.fits(budget)
            # what follows up to the next fitting prefix is white space
            assert each[fit] <= budget and all(each[k] > budget or not text[fit:k].strip(" \t\n\v\f\r") for k in range(fit + 1, len(text) + 1)), (text, budget)
    unspaced = "".join(rng.choices("etaoinshrdlu", k=20_000))
    kept = token_counts.PrefixCounts(tokenizer, unspaced).truncated(2048)
    assert count(kept) <= 2048 < count(unspaced[: len(kept) + 3]) + 2 and len(kept) > 2048


def test_counts_come_from_the_programme(monkeypatch):
    """Totals and every prefix's counts, of pre-tokens of all lengths side by side, without the library's encoding, while states are forgotten."""
    import pyarrow as pa

    tokenizer = token_counts.loaded(P.path("word_bpe_49k.json"))
    count = lambda text: len(tokenizer.library.encode(text, add_special_tokens=False).ids)
    rng = random.Random(12)
    parts = list("aAbé ß中文字'  \n.,;:!?#01ntsverll") + ["<|endoftext|>", "'re", "internation", "e\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + ["", " ", "etaoin" * 400, "中文" * 300, "." * 2000, "ab" * 500]
    expected = [count(t) for t in texts]

    def refuse(*_):
        raise AssertionError("encoded by the library")

    monkeypatch.setattr(token_counts.WordTokenizer, "_flat", refuse)
    assert [token_counts.PrefixCounts(tokenizer, t).total() for t in texts] == expected
    for lanes, states in ((8192, 300_000), (16, 400)):
        monkeypatch.setattr(tokenizer.machine.machine, "LANES", lanes)
        monkeypatch.setattr(tokenizer.machine.machine, "MOST_STATES", states)
        found = tokenizer.counts(pa.array(texts))
        assert found.totals().tolist() == expected
        last = token_counts.PrefixCounts(tokenizer, texts[-4], found, len(texts) - 4)
        assert [last.at(k) for k in range(0, 2400, 37)] == [count(texts[-4][:k]) for k in range(0, 2400, 37)]
    assert tokenizer.counts(pa.array([], pa.string())).totals().tolist() == []


def test_prefix_counts_by_the_librarys_characters():
    """Characters that are letters, signs or capitals to one version of Unicode alone."""
    tokenizer = token_counts.loaded(P.path("word_bpe_49k.json"))
    for c in "\u0558\u058b\u088f\u1c89\u208f\ua7cb\ua7dc\U00010940\U00010d50\U000105c9\u1ada\U000113c2\U00030000":
        text = f"ab{c}c1{c}{c}'{c}s B{c}\u0301e\u0301{c} 'll{c}"
        counts = token_counts.PrefixCounts(tokenizer, text)
        assert [counts.at(k) for k in range(len(text) + 1)] == [len(tokenizer.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text


def test_cuts_go_on_from_where_they_are(monkeypatch):
    """A long word that isn't composed, or has special strings, is read about once, not once for each of its prefixes."""
    import unicodedata

    tokenizer = token_counts.loaded(P.path("word_bpe_49k.json"))
    count = lambda text: len(tokenizer.library.encode(text, add_special_tokens=False).ids)
    steps, step = [0], tokenizer.machine.machine.step

    def counted(state, byte):
        steps[0] += 1
        return step(state, byte)

    monkeypatch.setattr(tokenizer.machine.machine, "step", counted)
    for text in (unicodedata.normalize("NFD", "việtnamtiếng") * 40, unicodedata.normalize("NFD", "한국어말씀") * 40, "ab<|endoftext|>" * 40):
        steps[0] = 0
        counts = token_counts.PrefixCounts(tokenizer, text)
        assert [counts.at(k) for k in range(0, len(text) + 1, 3)] == [count(text[:k]) for k in range(0, len(text) + 1, 3)]
        assert 0 < steps[0] < 10 * len(text.encode())


def test_table_of_states_grows_at_an_end():
    """The state after the end of a word may be the one for which the table of last tokens has no room yet."""
    tokenizer = token_counts.WordTokenizer(P.path("word_bpe_49k.json"))
    programme, rng = tokenizer.machine, random.Random(0)
    machine = programme.machine
    for _ in range(60):
        machine._reset()
        while len(machine.places) <= 1024:
            word = "".join(rng.choices("etaoinshrdlu", k=30))
            assert programme._piece(word.encode())[-1] == len(tokenizer.library.encode(word, add_special_tokens=False).ids)


def test_shard_of_many_blocks(tmp_path):
    rng = np.random.default_rng(8)
    entries = [(sstable.key_of(k // 3), rng.integers(0, 70_000 if k % 5 == 0 else 60_000, k % 40).astype(np.uint32)) for k in range(3000)]
    with open(tmp_path / "a.sst", "wb") as out:
        writer = sstable.ShardWriter(out, block_bytes=700)
        for key, ids in entries:
            writer.add(key, ids)
        assert writer.close()["docs"] == 3000
    shard = sstable.open_shard(str(tmp_path / "a.sst"))
    assert len(shard.index) > 100
    assert [(k, v.tolist()) for k, v in shard.entries()] == [(k, v.tolist()) for k, v in entries]
    for k in (0, 1, 7, 500, 999):
        assert [v.tolist() for v in shard.get(k)] == [v.tolist() for key, v in entries if key == sstable.key_of(k)]
    assert shard.get(1000) == shard.get(-1) == shard.get(None) == []
    assert sum(shard.may_have(sstable.key_of(k)) for k in range(5000, 7000)) < 80


def test_streaming_utf8():
    rng = random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xED, 0xA0, 0xFF, 0xC0, 0xF5]) for _ in range(rng.randint(0, 12)))
        machine, library, out, expected, at = bpe.Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace"), "", "", 0
        while at < len(data):
            step = rng.randint(1, 3)
            out += machine.feed(data[at : at + step])
            expected += library.decode(data[at : at + step])
            at += step
        assert out + machine.close() == data.decode("utf-8", "replace")


def test_shift_and():
    import fnmatch

    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["a" * 70, "*" + "b" * 70 + "*", "a*" * 40]
    automaton = urls.ShiftAnd([g.encode() for g in globs])
    assert automaton.words > 1
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(200)] + ["a" * 70, "x" + "b" * 70]
    fits = automaton.fits([t.encode() for t in texts])
    for text, row in zip(texts, fits):
        assert row.tolist() == [fnmatch.fnmatchcase(text, g) for g in globs], text


def test_urls(spark):
    rows = [(1, "http://A.Example.COM/en/71?x"), (2, "https://example.com/en/6"), (3, "http://notexample.com/en/7"), (4, "http://b.net/de/8"), (5, "http://x.example.net/de/8#t"), (6, "http://org/es/"), (7, "http://org?/es/"), (8, None), (9, "no url"), (None, "http://www.cheap-pills.example.com/fr/1"), (10, "http://c.com/x/y.com/en/"), (11, "ftp://é.com/EN/"), (11, "ftp://é.com/EN/"), (12, "://spam-farm/"), (13, "http:///en/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")
    out = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, queries.URL_RULES, queries.BLOCK_GLOBS).collect()), key=repr)
    assert out == sorted([
        (1, "a.example.com", "/en/71", "example.com/en/7", "allow"), (2, "example.com", "/en/6", "com/en/", "block"), (3, "notexample.com", "/en/7", "com/en/", "block"), (4, "b.net", "/de/8", "net/de/", "allow"),
        (5, "x.example.net", "/de/8", "example.net/de/8", "block"), (6, "org", "/es/", "org/es/", "block"), (7, "org", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (None, "www.cheap-pills.example.com", "/fr/1", None, "block"), (10, "c.com", "/x/y.com/en/", None, "allow"), (11, "é.com", "/EN/", None, "allow"), (11, "é.com", "/EN/", None, "allow"), (12, "spam-farm", "/", None, "block"), (13, "", "/en/", None, "allow"),
    ], key=repr)
    assert urls.judge(df.limit(0), queries.URL_RULES, queries.BLOCK_GLOBS).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = con.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in result.fetchall())


def test_transducer_holds_little_of_a_long_piece(monkeypatch):
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, most = bpe.Transducer(ranks, lambda a, b: ranks.get(a + b, bpe.Transducer.NEVER)), [0, 0]
    machine.MOST_STATES = 300
    agreed = machine._agreed

    def watched(state, lasts):
        most[:] = max(most[0], len(lasts)), max(most[1], len(machine.places))
        return agreed(state, lasts)

    monkeypatch.setattr(machine, "_agreed", watched)
    rng = random.Random(5)
    for piece in ("".join(rng.choice("etaoinshrdlu") for _ in range(30_000)), "z" * 20_000, "abc" * 7_000, "é日本" * 3_000):
        assert machine.encode(piece.encode()) == library.encode_ordinary(piece)
    assert 0 < most[0] < 2 * machine.STEP and most[1] <= 300 + machine.STEP + 1
