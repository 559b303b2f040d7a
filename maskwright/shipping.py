"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    Functions used in Arrow or pandas operators are pickled by reference, so a
    worker must be able to import them.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


#: Bytes of input below which one task is as good as many, and bytes for a task where input is spread: rows may be short, and each costs a scan.
LEAST_BYTES, TASK_BYTES = 1 << 16, 1 << 19


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input is too small to be split so far; larger inputs and streams stay as they are."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // TASK_BYTES))) if LEAST_BYTES < size < cores * split else df
