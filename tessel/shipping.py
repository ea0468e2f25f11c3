"""Makes this package importable in Python workers, whatever way the driver found it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to every executor through Spark's own file distribution; once a context."""
    context = spark.sparkContext
    if getattr(context, "_tessel_shipped", False):
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, str(path.relative_to(package.parent)))
    target = Path(tempfile.mkdtemp(prefix="tessel-source-")) / "tessel_source.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))  # served to executors by the driver; they don't read this folder
    context._tessel_shipped = True
