"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions alone.

A document is the sequence of its non-blank lines. Line IDs are ranks: distinct lines that occur twice or more, in
sorted order. Distributed prefix doubling then sorts the suffixes by their first 2, 4, ... lines: a suffix's pair of ranks
(its own and that of the suffix k lines further on) is ranked again, by a range-partitioned sort of the
distinct pairs, whose rank table is written to the shared folder before it is used. Suffixes that are alone at any depth
leave at once, as no longer run of theirs can repeat; doubling ends when none is left, so that all suffixes are told apart.

Longest common prefixes come from the ranks: from the deepest level down, a suffix's prefix grows by that level's depth if the grown prefix
still stands elsewhere (members of one class with equal ranks further on make a smaller class). So each suffix gets the exact length of the
longest run that begins there and is repeated, and each document the longest of them (with_lengths).

Suffixes that share a rank at the depth min_lines (the last step overlaps two halves where that is no power of two) are the LCP intervals of
that depth or more. The union of an interval's later members, min_lines lines each, is exactly the union of the later copies of the
maximal repeated runs, and is deleted; the first copy, in order of (doc_id, line), stays.

Hot lines: ranks are made of distinct pairs, counted with pre-aggregation; the joins back are plain equi-joins, which adaptive
execution can split. No group of equal lines is gathered in one task.

Defined cases: null text is empty; blank lines are never deleted and don't break a run; lines are compared exactly; runs don't cross documents; rows
that share a doc_id are told apart by their text, and exactly repeated rows by nothing: each of them gets the same
result, as one document (its lines count once); a null doc_id comes before all others; an empty table gives an empty
result; other columns pass through deduplicate() untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written
from .quality import SPACES, let

#: A run of characters that are no white space of SPACES.
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) == ""


def _ranked(groups: DataFrame, key: list[str]) -> DataFrame:
    """A number for each row in order of the key: range-partitioned sort, then written, as a second computation could number differently."""
    return written(groups.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _place() -> Column:
    return F.struct("doc", "n")


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys with two places or more, and the first. Places, not rows: a document that is there twice isn't its own copy."""
    found = rows.groupBy(*key).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    return found.where(F.col("first") < F.col("last")).drop("last")


def _single(lines: DataFrame) -> DataFrame:
    """doc, n, rank, first of the lines that stand at two places or more; each place once."""
    found = lines.join(_ranked(_repeated(lines, ["line"]), ["line"]), "line").select("doc", "n", "rank", "first")
    return written(found.distinct(), "single")


def _deeper(suffixes: DataFrame, step: int) -> DataFrame:
    """The same for `step` more lines, of suffixes at one depth (of step lines or more)."""
    ahead = suffixes.select("doc", (F.col("n") - step).alias("n"), F.col("rank").alias("ahead"))
    pairs = written(suffixes.select("doc", "n", F.col("rank").alias("own")).join(ahead, ["doc", "n"]), "pairs")
    ranks = _ranked(_repeated(pairs, ["own", "ahead"]), ["own", "ahead"])
    deeper = written(pairs.join(ranks, ["own", "ahead"]).select("doc", "n", "rank", "first"), "deeper")
    drop(pairs, ranks, collect=False)
    return deeper


def later_copies(lines: DataFrame, min_lines: int, levels: list[DataFrame] | None = None) -> DataFrame:
    """lines: doc, n (place among the document's non-blank lines), line (any sortable key of the line's text).
    Gives doc, n of the suffixes whose first min_lines lines also begin a suffix before them. levels: those of prefix_levels(), if known."""
    depth, suffixes = 1, levels[0] if levels else _single(lines)
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        known = levels[depth.bit_length()] if levels and step == depth and depth.bit_length() < len(levels) else None
        suffixes = _deeper(suffixes, step) if known is None else known
        depth += step
    return suffixes.where(_place() != F.col("first")).select("doc", "n")


def prefix_levels(lines: DataFrame) -> list[DataFrame]:
    """Prefix doubling to its end: doc, n, rank, first of the suffixes whose first 1, 2, 4, ... lines stand elsewhere too; the last level has some,
    the next one would have none."""
    levels = [_single(lines)]
    while True:
        deeper = _deeper(levels[-1], 1 << (len(levels) - 1))
        if deeper.isEmpty():
            drop(deeper, collect=False)
            return levels
        levels.append(deeper)


def run_lengths(levels: list[DataFrame]) -> DataFrame:
    """doc, n, length: the most lines, from two on, from each place that stand elsewhere too."""
    grown = None
    for j in reversed(range(len(levels))):
        level = levels[j].select("doc", "n", "rank")
        if grown is None:
            grown = level.select("doc", "n", F.lit(1 << j).cast("bigint").alias("length"), F.col("rank").alias("class")) if j else None
            continue
        ahead = level.select("doc", F.col("n").alias("at"), F.col("rank").alias("ahead"))
        tried = written(grown.withColumn("at", F.col("n") + F.col("length")).join(ahead, ["doc", "at"], "left").drop("at"), "tried")
        # classes of one length were all made at the same level, so their numbers are of one table
        key = ["length", "class", "ahead"]
        ranks = _ranked(_repeated(tried.where(F.col("ahead").isNotNull()), key).drop("first"), key)
        longer = F.col("rank").isNotNull()
        after = tried.join(ranks, key, "left").select("doc", "n", F.when(longer, F.col("length") + (1 << j)).otherwise(F.col("length")).alias("length"), F.when(longer, F.col("rank")).otherwise(F.col("class")).alias("class"))
        if j:
            new = level.join(tried.select("doc", "n"), ["doc", "n"], "left_anti")
            after = after.union(new.select("doc", "n", F.lit(1 << j).cast("bigint"), "rank"))
        grown = written(after, "grown")
        drop(tried, ranks, collect=False)
    return levels[0].select("doc", "n", F.lit(0).cast("bigint").alias("length")).limit(0) if grown is None else grown.select("doc", "n", "length")


def deduplicate(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None, with_lengths: bool = False) -> DataFrame:
    """docs with later copies of repeated runs of min_lines lines or more taken out of the text, and with n_lines
    (non-blank lines before) and n_removed. Texts that lose nothing are unchanged. With long_words, a line of so many words
    or more is a run by itself: its later copies go too, from documents of any number of lines. With with_lengths, longest_run is the number
    of lines of the document's longest run, of two lines or more, that stands elsewhere too, in it or in another one (else 0)."""
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a document is known by its doc_id and its text; plain names keep any column names of docs apart from ours
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)], F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")).alias("doc"), text.alias("whole"))
    lines = (
        keyed.select("doc", F.filter(_lines(F.col("whole")), lambda x: ~_blank(x)).alias("lines"))
        .where(F.size("lines") >= (1 if long_words is not None else min(min_lines, 2) if with_lengths else min_lines))
        .select("doc", F.posexplode("lines").alias("n", "line"))
        .select("doc", "n", F.unhex(F.left(F.sha2("line", 256), F.lit(32))).alias("line"), *([] if long_words is None else [(F.regexp_count("line", F.lit(WORD)) >= long_words).alias("long")]))
    )
    lines = written(lines, "lines")
    levels = prefix_levels(lines) if with_lengths else None
    gone = later_copies(lines, min_lines, levels)
    gone = gone.select(F.col("doc").alias("gone_doc"), F.explode(F.sequence("n", F.col("n") + (min_lines - 1))).alias("n"))
    if long_words is not None:
        gone = gone.union(later_copies(lines.where("long"), 1))
    gone = gone.select("gone_doc", F.col("n").cast("int").alias("n"), F.lit(0).cast("bigint").alias("length"))
    if levels:
        gone = gone.union(run_lengths(levels).select("doc", F.lit(None).cast("int"), "length"))
    gone = gone.groupBy("gone_doc").agg(F.collect_set("n").alias("gone"), F.max("length").alias("longest"))
    gone = written(gone.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone"))), "gone")
    drop(*(levels or []))

    def without(all_lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(all_lines) - 1)
        filled = F.filter(places, lambda i: ~_blank(F.get(all_lines, i)))
        dropped = let(filled, lambda f: F.transform("gone", lambda k: F.get(f, k)))
        return F.array_join(F.transform(F.array_except(places, dropped), lambda i: F.get(all_lines, i)), "\n")

    # null-safe on both fields: a null doc_id is an identifier too
    same = F.col("doc.id").eqNullSafe(F.col("gone_doc.id")) & (F.col("doc.text") == F.col("gone_doc.text"))
    # merged at every size: what is gone grows with the documents, so it is no table to broadcast
    out = keyed.join(gone.hint("merge"), same, "left").select(
        *[F.when(F.col("gone").isNull(), F.col(f"own_{i}")).otherwise(let(_lines(F.col("whole")), without)).alias(c) if c == text_col else F.col(f"own_{i}").alias(c) for i, c in enumerate(names)],
        F.size(F.filter(_lines(F.col("whole")), lambda x: ~_blank(x))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        *([F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest_run")] if with_lengths else []),
    )
    return out
