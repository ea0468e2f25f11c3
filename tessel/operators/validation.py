"""Checks of tables, and decision chains over rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def expectations(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row with the number of rows that break each condition (null breaks it), all in one pass."""
    return df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def missing_references(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't in the parent."""
    return df.join(parent.select(F.col(parent_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def shared_keys(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are in both: empty if there is no leak."""
    return one.select(*keys).distinct().join(two.select(*keys), keys, "left_semi")


def any_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def reasons(flags: Mapping[str, Column], default: str = "ok") -> Column:
    """The names of the flags that are true, joined by "; "."""
    joined = F.concat_ws("; ", *[F.when(flag, name) for name, flag in flags.items()])
    return F.when(joined == "", default).otherwise(joined)


def static_validate(made: DataFrame, real: DataFrame, title: str, description: str, class_col: str, ordinal: str) -> DataFrame:
    """made with four flags, static_valid and static_reason; what is compared ignores case and extra spaces.

    Both look-ups are joins on keys of the real rows; the first of equal made rows is found by a pre-aggregated minimum."""
    keys = {"__title": title, "__description": description, "__class": class_col}
    rows = made.withColumns({k: T.lower_key(F.col(c)) for k, c in keys.items()})
    known = real.select(*[T.lower_key(F.col(c)).alias(k) for k, c in keys.items()], F.col(class_col).isNotNull().alias("__has"))
    classes = known.where("__has").select("__class", F.lit(True).alias("__known_class")).distinct()
    copies = known.select(*keys, F.lit(True).alias("__copy")).distinct()
    first = rows.groupBy(*keys).agg(F.min(ordinal).alias("__first"))
    rows = rows.join(classes, "__class", "left").join(copies, list(keys), "left").join(first, list(keys))
    flags = {
        "has_empty_field": (F.col("__title") == "") | (F.col("__description") == "") | (F.col("__class") == ""),
        "invalid_expense_class": F.col("__known_class").isNull(),
        "duplicate_synthetic": F.col(ordinal) > F.col("__first"),
        "exact_real_copy": F.col("__copy").isNotNull(),
    }
    rows = rows.withColumns(flags)
    said = dict(zip(["empty required field", "unknown expense class", "duplicate synthetic example", "exact copy of real example"], map(F.col, flags)))
    rows = rows.withColumns({"static_valid": ~any_true(list(said.values())), "static_reason": reasons(said)})
    return rows.drop(*keys, "__known_class", "__copy", "__first")


def validation_status(least_confidence: float = 0.80) -> Column:
    """From static_valid, semantic_error, semantic_valid and semantic_confidence."""
    return (
        F.when(~F.col("static_valid"), "reject_static")
        .when(F.coalesce(F.col("semantic_error"), F.lit("")) != "", "validation_error")
        .when(~F.col("semantic_valid"), "reject_semantic")
        .when(F.col("semantic_confidence") < least_confidence, "manual_review")
        .otherwise("pass")
    )


def positive_check(texts: list[str], class_a: str, class_b: str, id_col: str, context: list[str]) -> Column:
    """INVALID: a blank text or class, or classes that differ; UNCERTAIN: no whole-number id, or no context; null: for the judge."""
    blank = lambda c: T.clean_value(F.col(c)) == ""
    return (
        F.when(any_true([blank(c) for c in [*texts, class_a, class_b]]), "INVALID")
        .when(T.caseless_key(F.col(class_a)) != T.caseless_key(F.col(class_b)), "INVALID")
        .when(T.to_int_or_none(F.col(id_col)).isNull(), "UNCERTAIN")
        .when(reduce(lambda a, b: a & b, [blank(c) for c in context]), "UNCERTAIN")
    )


def negative_check(texts: list[str], class_a: str, class_b: str) -> Column:
    """UNCERTAIN: something is missing; different classes are an error; null: for the judge."""
    blank = lambda c: T.clean_value(F.col(c)) == ""
    return F.when(any_true([blank(c) for c in [*texts, class_a, class_b]]), "UNCERTAIN").when(
        T.caseless_key(F.col(class_a)) != T.caseless_key(F.col(class_b)), F.raise_error(F.lit("a negative pair has two classes"))
    )


def marked_columns(columns: list[str], markers: list[str]) -> Column:
    """Names of the columns whose whole value is a marker, but for case and spaces."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), T.caseless_key(F.col(c)).alias("value")) for c in columns])
    found = [" ".join(m.casefold().split()) for m in markers]
    return F.transform(F.filter(cells, lambda x: x["value"].isin(*found)), lambda x: x["name"])


def evidence_problem(client: list[str], program: list[str], client_evidence: str, program_evidence: str, decision: str, negative: str = "NO") -> Column:
    """Blank if both quotations stand in the texts, but for case and punctuation; else what is wrong."""
    whole = lambda cs: T.match_key(F.concat_ws(" ", *[T.clean_value(F.col(c)) for c in cs]))
    given = T.clean_value(F.col(client_evidence))
    one = F.when(given == "", F.when(F.col(decision) != negative, "client_evidence missing")).when(~F.contains(whole(client), T.match_key(given)), "client_evidence not verbatim")
    two = F.when(~F.contains(whole(program), T.match_key(F.col(program_evidence))), "program_evidence not verbatim")
    return F.concat_ws("; ", one, two)


def decision_label(decision: Column, category: Column) -> Column:
    """Match or No match; a plausible match confirms a positive pair, and excludes a negative one."""
    plausible = F.when(F.contains(category, F.lit("negative")), "Excluded").otherwise("Match")
    return F.when(decision == "PLAUSIBLE", plausible).when(decision.isin("GENERIC", "DIRECT", "RESIDUAL", "MATCH"), "Match").when(decision.isin("NO", "NO_MATCH"), "No match")


def replaced(df: DataFrame, columns: list[str], names: Mapping[str, str]) -> DataFrame:
    """Substrings replaced in the columns, and `changed`."""
    def new(c: str) -> Column:
        return reduce(lambda text, kv: F.replace(text, F.lit(kv[0]), F.lit(kv[1])), names.items(), F.col(c))
    return df.withColumn("changed", any_true([~F.col(c).eqNullSafe(new(c)) for c in columns])).withColumns({c: new(c) for c in columns})


def coded(column: Column, codes: Mapping[str, int]) -> Column:
    """The code of a value; null for values without one."""
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[column]


def first_given(*columns: Column) -> Column:
    """The first value that isn't null or blank, such as a manual label before the one it corrects; else null."""
    return F.coalesce(*[F.when(T.clean_value(c) != "", T.clean_value(c)) for c in columns])


def conservation(given: DataFrame, kept: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: n_input, n_kept, n_removed, conserved (every row was kept or removed)."""
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    counts = counted(given, "n_input").crossJoin(counted(kept, "n_kept")).crossJoin(counted(removed, "n_removed"))  # one-row tables
    return counts.withColumn("conserved", F.col("n_kept") + F.col("n_removed") == F.col("n_input"))
