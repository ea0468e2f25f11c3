"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.relational import numbered
from ..scratch import remove


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df itself; an error that names what is missing, when the plan is made."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", columns: list[str] | None = None, null_texts: tuple[str, ...] = (), where: Column | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as strings; a byte-order mark, quoted separators and line breaks inside quotes are understood. Files that are known
    to have no line breaks inside quotes are split over tasks with multi_line=False; else a file is one task's.

    Blank fields are empty strings; only the texts in null_texts become null. Column pruning and the filter reach the scan."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=multi_line, escape='"', encoding="UTF-8", nullValue="\x00", emptyValue="", inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")
    if null_texts:
        df = df.select(*[F.when(~F.col(c).isin(*null_texts), F.col(c)).alias(c) for c in df.columns])
    if columns is not None:
        df = require_columns(df, columns).select(*columns)
    return df if where is None else df.where(where)


def read_files(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame], on_error: Callable[[str, Exception], None] | None = None) -> DataFrame | None:
    """The union of several files with `source_file` and `row_in_file` (from 1); columns that a file lacks are null.

    With on_error, a file that can't be read is reported to it and left out."""
    parts = []
    for path in paths:
        try:
            part = read(spark, path)
        except (AnalysisException, OSError, ValueError) as error:
            if on_error is None:
                raise
            on_error(path, error)
            continue
        name = path.rstrip("/").rpartition("/")[2]
        parts.append(with_ordinal(part, "row_in_file").withColumn("source_file", F.lit(name)))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_ordinal(df: DataFrame, name: str = "ordinal", start: int = 1) -> DataFrame:
    """Rows numbered in the order of the source, without a sort: by partition, then by place in it."""
    return numbered(df, [], name, start)


def stream_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", where: Column | None = None) -> DataFrame:
    """The rows of a folder's CSV files as they come, all columns as strings; a filter is asked before rows leave the reader."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.readStream.schema(schema).option("sep", sep).option("header", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    return df if where is None else df.where(where)


def find_name(names: Iterable[str], wanted: str) -> str:
    """The name that equals `wanted` but for case and white space."""
    key = "".join(wanted.split()).lower()
    for name in names:
        if "".join(name.split()).lower() == key:
            return name
    raise ValueError(f"no name like {wanted}")


def metadata(cells: DataFrame, group: str, row: str, column: str, value: str, keys: list[str]) -> DataFrame:
    """Key cells and their right neighbours, of a table of cells: the last occurrence of a key counts."""
    right = F.lead(value).over(Window.partitionBy(group, row).orderBy(column))
    found = cells.withColumn("__right", right).where(F.trim(value).isin(*keys) & F.col("__right").isNotNull())
    return found.groupBy(group, F.trim(value).alias("key")).agg(F.max_by("__right", F.struct(row, column)).alias("value"))


def write_csv(df: DataFrame, path: str, overwrite: bool = False, dry_run: bool = False, bom: bool = False) -> DataFrame:
    """A CSV with a header; an error if the path is there and overwrite isn't asked for; with dry_run, only the rows; with bom, each file
    begins with a byte-order mark."""
    if not dry_run:
        out = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
        out.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8")
    return df


def write_sheets(sheets: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One Parquet folder a sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/{name}")


def write_cache(df: DataFrame, path: str) -> None:
    """A table that takes the place of the one at `path` only when it is whole: written beside it, then renamed."""
    spark = df.sparkSession
    jvm, beside = spark.sparkContext._jvm, f"{path.rstrip('/')}.new"
    target, made, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, f"{path.rstrip('/')}.old"))
    df.write.mode("overwrite").parquet(beside)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    remove(spark, old.toString())
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"{path} can't be moved")
    if not files.rename(made, target):
        raise OSError(f"{beside} can't be moved")
    remove(spark, old.toString())


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of write_cache(), the one before it if a writer was lost between its two renames, or None."""
    for place in (path, f"{path.rstrip('/')}.old"):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return spark.read.parquet(place)
    return None


def append_log(df: DataFrame, path: str) -> None:
    """Rows at the end of a log; each append is committed as a whole."""
    df.write.mode("append").parquet(path)


def backup(spark: SparkSession, path: str, version: str) -> str:
    """A copy of a table beside it, made once: a version that is there isn't touched."""
    target = f"{path.rstrip('/')}.{version}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        remove(spark, target)
        spark.read.parquet(path).write.parquet(target)
    return target


def replace_text(df: DataFrame, columns: list[str], old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """df with old replaced by new in the columns, and one row with the number of occurrences."""
    count = sum((F.coalesce((F.char_length(c) - F.char_length(F.replace(F.col(c), F.lit(old), F.lit("")))) / len(old), F.lit(0)) for c in columns), F.lit(0))
    changed = df.withColumns({c: F.replace(F.col(c), F.lit(old), F.lit(new)) for c in columns})
    return changed, df.agg(F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("occurrences"))
