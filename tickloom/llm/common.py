"""Helpers shared by the training-data operators: inputs, shared storage, null handling."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a missing doc_id orders after every real one; all rows without an id count as one document
NO_ID = 2**63 - 1
#: bytes of an Arrow batch; a task holds a few copies of one batch at a time
BATCH_BYTES = "16m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shipped(spark: SparkSession) -> None:
    """Send the package to the workers where neither their path nor their folder holds it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if root in map(os.path.abspath, known) or getattr(sc, "_tickloom_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tickloom-code-"), "tickloom"), "zip", root, "tickloom")
    sc.addPyFile(archive)
    sc._tickloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def doc_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    A private folder is used only where the session names none and runs in one JVM (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc = spark.sparkContext
        if not getattr(sc, "_tickloom_dir", None):  # the setting itself is fixed once a session runs
            sc._tickloom_dir = tempfile.mkdtemp(prefix="tickloom-llm-")
        base = sc._tickloom_dir
    return f"{base.rstrip('/')}/tickloom-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared Parquet and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now instead of at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        roots = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for root in roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
