"""Session settings shared by tests, the benchmark and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: settings every plan in this package relies on
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the plans depend on (idempotent)."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "tickloom", memory: str = "12g",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        # small local tables: keep window work spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "localhost")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder for lineage cuts, as named by the cluster; None where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def durable(df, eager: bool = True):
    """Cut lineage through reliable storage.

    The cluster's ``spark.checkpoint.dir`` is used when set; a private folder is
    chosen only where the session names none and runs in one JVM (tests).
    """
    import tempfile

    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not checkpoint_dir(spark) and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(checkpoint_dir(spark) or tempfile.mkdtemp(prefix="tickloom-ckpt-"))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``."""
    import tempfile
    import uuid

    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tickloom-")
    return f"{base.rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """Write once to the shared folder and read back: one derivation, however often it is used."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
