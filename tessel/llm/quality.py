"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a condition that rejects a row, over features of its text. Features are worked out inside the rules: a rule that isn't
reached costs nothing. On a sample, each rule's cost (repeated evaluations within one job, less the same job without the rule) and its
share of rejected rows are measured; the rules are then tried in order of rejection per cost inside one CASE, so that a row stops
at the first rule that rejects it. The order changes the cost alone: a row is kept exactly if no rule rejects it.

judge() is asked for five base counts of every row; there the rules over these counts read them, the base rules come first, and the cascade
works out what else its rules need. accepted() is asked for no counts: all rules are in its cascade, with their features.

Words are `[^\\x20\\x09-\\x0D]+`. Words in repeated 5-word windows are found by the 64-bit hashes of the windows of one
text (a chance of about n * n / 2 ** 65 that a text of n words gets a wrong count).

Defined cases: a null or empty text has no words and fails the base rules; one long word is one word; repeated rows and null
ids give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

SPACES = " \t\n\v\f\r"
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: a lambda's variable isn't inlined."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more in the text."""

    def covered(places: Column) -> Column:
        # sorted places of repeated windows: each covers its 5 words up to the next one's beginning
        gaps = F.transform(places, lambda p, i: F.when(i + 1 < F.size(places), F.least(F.get(places, i + 1) - p, F.lit(WINDOW))).otherwise(WINDOW))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeats(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(pairs, lambda s: F.filter(s, lambda x, k: ((k > 0) & (x.h == F.get(s, k - 1).h)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False))))
        return let(F.array_sort(F.transform(same, lambda x: x.i)), covered)

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))

    found = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: let(windows(hashes), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeats(w)).otherwise(0)),
    )
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found).cast("bigint")


class Features:
    """What rules are made of, as expressions over a text, its words and its lines that have a word; or, once the base counts are
    columns, these."""

    def __init__(self, text: Column, words: Column, lines: Column, counted: bool = False):
        self.text, self.words, self.lines, self.counted = text, words, lines, counted

    def _count(self, name: str, value: Column) -> Column:
        return F.col(name) if self.counted else value.cast("bigint")

    @property
    def n_words(self) -> Column:
        return self._count("n_words", F.size(self.words))

    @property
    def word_chars(self) -> Column:
        return self._count("word_chars", F.char_length(F.array_join(self.words, "")))

    @property
    def n_symbols(self) -> Column:
        return self._count("n_symbols", F.char_length(self.text) - F.char_length(F.regexp_replace(self.text, r"[#*$%&|<>]", "")))

    @property
    def n_lines(self) -> Column:
        return self._count("n_lines", F.size(self.lines))

    @property
    def n_dup_lines(self) -> Column:
        return self._count("n_dup_lines", F.size(self.lines) - F.size(F.array_distinct(self.lines)))

    @property
    def n_repeat_words(self) -> Column:
        return self._count("n_repeat_words", _repeated(self.words))

    @property
    def n_shouts(self) -> Column:
        return F.octet_length(self.text) - F.octet_length(F.replace(self.text, F.lit("!"), F.lit("")))

    def lines_like(self, pattern: str) -> Column:
        return F.size(F.filter(self.lines, lambda x: x.rlike(pattern)))

    def words_like(self, pattern: str) -> Column:
        return F.size(F.filter(self.words, lambda x: x.rlike(pattern)))


def _parts(text: Column) -> tuple[Column, Column]:
    """Words, and lines that have a word."""
    whole = F.btrim(text, F.lit(SPACES))
    words = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"[\x20\x09-\x0D]+"))
    return words, F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __text, __words, __lines, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    words, lines = _parts(F.col("__text"))
    f = Features(F.col("__text"), F.col("__words"), F.col("__lines"))
    return rows.withColumns({"__words": words, "__lines": lines}).withColumns({name: getattr(f, name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")})


Rule = Callable[[Features], Column]

#: Name to a column that is true where the rule rejects the row. Whole numbers only, so that any engine agrees.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda f: f.n_words < 10,
    "repeats": lambda f: 100 * f.n_repeat_words > 20 * f.n_words,
}
RULES: dict[str, Rule] = {
    "many_symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "shouting": lambda f: 2 * f.n_shouts > f.n_words,
    "repeated_lines": lambda f: 2 * f.n_dup_lines > f.n_lines,
    "odd_words": lambda f: (f.word_chars < 3 * f.n_words) | (f.word_chars > 12 * f.n_words),
    "bullets": lambda f: 10 * f.lines_like(r"^[\x20\x09-\x0D]*[-*•]") > 9 * f.n_lines,
    "unfinished_lines": lambda f: 10 * f.lines_like(r"(\.\.\.|…)[\x20\x09-\x0D]*$") > 3 * f.n_lines,
    "capitals": lambda f: 2 * f.words_like(r"^[^A-Za-z]*[A-Z][A-Z]+[^a-z]*$") > f.n_words,
}


def plan(docs: DataFrame, rules: dict[str, Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 200, sample_chars: int = 4 << 20, times: int = 10) -> list[str]:
    """Names of the rules, best rejection per cost first, as measured on a sample: the table's first rows, at most sample_rows of them, and of
    these as many as have sample_chars characters together, one row at least. Only these rows come to the driver."""
    texts, total = [], 0
    for row in docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).head(sample_rows):
        if texts and total + len(row["text"]) > sample_chars:
            break
        texts.append((row["text"],))
        total += len(row["text"])
    if not texts:
        return sorted(rules)
    words, lines = _parts(F.col("text"))
    sample = docs.sparkSession.createDataFrame(texts, "text string").coalesce(1).withColumns({"words": words, "lines": lines}).cache()
    repeated = sample.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        repeated.agg(F.count_if(condition & (F.col("time") > 0))).first()
        return time.perf_counter() - began

    f = Features(F.col("text"), F.col("words"), F.col("lines"))
    rejected = sample.agg(*[F.count_if(rule(f)).alias(name) for name, rule in rules.items()]).first()
    seconds(F.col("text").isNull())  # warms up
    nothing = seconds(F.col("text").isNull())
    worth = {name: rejected[name] / len(texts) / max(seconds(rule(f)) - nothing, 1e-4) for name, rule in rules.items()}
    sample.unpersist()
    return sorted(rules, key=lambda name: (-worth[name], name))


def _first_rejection(rules: dict[str, Rule], order: list[str], f: Features) -> Column:
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name](f), F.lit(name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, rejected_by (the first rule that rejects, `base` before all others; depends on the order) and
    kept. Narrow: no shuffle."""
    rules = RULES if rules is None else rules
    order = order or plan(docs, rules, id_col, text_col)
    f, failed = Features(F.col("__text"), F.col("__words"), F.col("__lines"), counted=True), F.lit(False)
    for rule in BASE_RULES.values():
        failed = failed | rule(f)
    counted = base_counts(docs, id_col, text_col).withColumn("base_failed", failed)
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(_first_rejection(rules, order, f))
    judged = counted.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
    return judged.drop("__text", "__words", "__lines", "n_lines")


def accepted(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns. Base rules stand in the cascade like all others."""
    rows, names = plain(docs)
    text = names[docs.columns.index(text_col)]
    rules = BASE_RULES | RULES if rules is None else rules
    order = order or plan(rows, rules, text_col=text)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words, lines = _parts(whole)
    # bound in the expression: as columns they would be put into every rule again when the filter moves below them
    parts = F.struct(whole.alias("text"), words.alias("words"), lines.alias("lines"))
    rejected = let(parts, lambda x: _first_rejection(rules, order, Features(x["text"], x["words"], x["lines"])))
    return rows.where(rejected.isNull()).toDF(*docs.columns)
