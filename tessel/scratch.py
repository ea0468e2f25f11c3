"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and the master is local, a folder of our own;
    on a cluster each executor would write to its own disk, so there it must be set."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tessel-shared-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; drop_written() removes it."""
    path = f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives the loss of executors, is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tessel_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame, collect: bool = True) -> None:
    """Remove written() tables that nothing reads any more, and, with collect, let Spark delete the shuffle files of plans that are gone."""
    for table in tables:
        path = getattr(table, "_tessel_path", None)
        if path:
            remove(table.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
    if tables and collect:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def drop_written() -> None:
    """Remove every intermediate table of this process. Results that still depend on them can't be read afterwards."""
    while _written:
        remove(*_written.pop())


def _at_exit() -> None:
    try:
        drop_written()
    except Exception:  # the session may be gone; the folder is a scratch folder
        _written.clear()


atexit.register(_at_exit)
