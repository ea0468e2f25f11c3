"""Resumable work as a stream: each micro-batch's results are appended, and the checkpoint remembers what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def process_stream(source: DataFrame, work: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Run `work` on whatever is new in a streaming source, append its rows to out_path, and stop when there is nothing more.

    A batch that ran before a crash is run again; rows whose key is in the output already are left out, so each is written once."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = work(batch)
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(out_path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            rows = rows.join(spark.read.schema(rows.schema).parquet(out_path).select(key), key, "left_anti")
        rows.write.mode("append").parquet(out_path)

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
