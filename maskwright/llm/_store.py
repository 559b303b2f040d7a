"""Tables written between the steps of an operator.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``, which
all executors share, so a lost executor costs no recomputation of earlier steps.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.shipping import ship_package

#: Rows in an Arrow batch. Documents of some 100 KB keep a batch near 100 MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches, as texts can be very long."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if not path:
        if conf.get("spark.master", "") != "local" and not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; this cuts its lineage."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.__dict__["_staged_at"] = path
    return back


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table needs any more: it does so when the driver's collector finds their owners gone."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    path = df.__dict__.get("_staged_at")
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with ``ord``, a distinct number in document order, and whether it is the id, as it is where ids are distinct and never null.

    Else rows are ordered by (doc_id, text), nulls last.
    """
    worst = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("n")))).first()[0]
    if worst is None or worst == 1:
        return docs.withColumn("ord", F.col("doc_id").cast("long")), True
    key = [F.col("doc_id").asc_nulls_last(), F.coalesce("text", F.lit(""))]
    return stage(docs.orderBy(*key).withColumn("ord", F.monotonically_increasing_id()), "numbered"), False


def local_file(path: str) -> str:
    """The local name of a file: URI (tests and single hosts)."""
    return os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
