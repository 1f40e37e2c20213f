"""Bar and derived-table storage with point-in-time reads.

Layout: ``scale=/year=`` directories, rows range-partitioned by (scale, year, symbol,
ts) before the write.  Range partitioning balances files by size, so a symbol
holding a large share of the rows spreads over many files, and every file covers a
narrow (symbol, ts) range whose Parquet statistics skip row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.functions import clock

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False), T.StructField("ts", T.TimestampType(), False),
    T.StructField("scale", T.StringType(), False), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType())])
BAR_COLUMNS = tuple(f.name for f in BAR_SCHEMA.fields)
SAFE_SYMBOL = r"^[A-Za-z0-9&._#-]+$"


def check_bars(df: DataFrame) -> DataFrame:
    """One row of violation counts: rows, unknown scales, unsafe symbols, repeated keys, null keys."""
    keyed = df.groupBy("symbol", "scale", "ts").agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~F.col("scale").isin(*clock.SCALES), F.col("n"))), F.lit(0)).alias("unknown_scale"),
        F.coalesce(F.sum(F.when(~F.col("symbol").rlike(SAFE_SYMBOL), F.col("n"))), F.lit(0)).alias("unsafe_symbol"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("symbol").isNull() | F.col("ts").isNull() | F.col("scale").isNull(), F.col("n"))),
                   F.lit(0)).alias("null_keys"))


def write_bars(df: DataFrame, root: str, *, files: int | None = None, max_rows_per_file: int = 20_000_000,
               validate: bool = True, only: tuple[str, str] | None = None) -> None:
    """Replace the (scale, symbol) series that ``df`` holds; every other stored series stays.

    Only (scale, year) directories that the replaced series touch are rewritten.  With ``only`` =
    (scale, symbol), rows of any other series are refused.  The input is staged once beside the
    table, checked there, and then swapped in.
    """
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"bars: missing columns {missing}")
    spark = df.sparkSession
    staged_at = f"{root.rstrip('/')}.staged"
    clock.to_utc(df.select(*BAR_COLUMNS)).write.mode("overwrite").parquet(staged_at)
    out = spark.read.parquet(staged_at)
    if validate:
        bad = check_bars(out).first().asDict()
        if not bad.pop("n_rows"):
            raise ValueError("refusing to write an empty bar table")
        if any(bad.values()):
            raise ValueError(f"bars break the table contract: {bad}")
        if only and not out.filter((F.col("scale") != only[0]) | (F.col("symbol") != only[1])).isEmpty():
            raise ValueError(f"rows of another series than {only}")
    out = out.withColumn("year", F.year("ts"))
    have = open_bars(spark, root)
    series = out.select("scale", "symbol").distinct()
    old = have.join(series, ["scale", "symbol"], "left_semi").select("scale", "year").distinct()
    touched = old.unionByName(out.select("scale", "year").distinct()).distinct()
    kept = have.join(touched, ["scale", "year"], "left_semi").join(series, ["scale", "symbol"], "left_anti")
    new = out.unionByName(kept.select(*out.columns))
    # directories that lose their only series: few, as there is one per scale and year
    emptied = old.join(new.select("scale", "year").distinct(), ["scale", "year"], "left_anti").collect()
    cols = ("scale", "year", "symbol", "ts")
    ranged = new.repartitionByRange(files, *cols) if files else new.repartitionByRange(*cols)
    (ranged.sortWithinPartitions(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").option("maxRecordsPerFile", max_rows_per_file)
     .partitionBy("scale", "year").parquet(root))
    for r in emptied:
        remove(spark, f"{root.rstrip('/')}/scale={r['scale']}/year={r['year']}")
    remove(spark, staged_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def absent(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def open_bars(spark: SparkSession, root: str) -> DataFrame:
    """Every stored bar; an absent table is an empty one of the same type, any other failure is raised."""
    schema = T.StructType([*[f for f in BAR_SCHEMA.fields if f.name != "scale"],
                           T.StructField("scale", T.StringType()), T.StructField("year", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if absent(e):
            return spark.createDataFrame([], schema)
        raise


def read_bars(spark: SparkSession, root: str, *, as_of, scale: str | None = None, symbols: Sequence[str] = (),
              start=None, end=None) -> DataFrame:
    """Rows known to the store by ``as_of`` within the closed ``[start, end]``."""
    return scan(open_bars(spark, root), as_of=as_of, scale=scale, symbols=symbols, start=start, end=end).select(*BAR_COLUMNS)


def scan(bars: DataFrame, *, as_of, scale: str | None = None, symbols: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """Point-in-time filter of a bar table; every predicate is pushed to the scan."""
    cap = clock.as_instant(as_of)
    out = bars.filter(F.col("ts") <= cap)
    if "year" in bars.columns:
        out = out.filter(F.col("year") <= F.year(cap))
    if scale is not None:
        if scale not in clock.SCALES:
            raise ValueError(f"unknown scale: {scale!r}")
        out = out.filter(F.col("scale") == scale)
    if symbols:
        out = out.filter(F.col("symbol").isin(*symbols))
    if start is not None:
        out = out.filter(F.col("ts") >= clock.as_instant(start))
        if "year" in bars.columns:
            out = out.filter(F.col("year") >= F.year(clock.as_instant(start)))
    if end is not None:
        out = out.filter(F.col("ts") <= clock.as_instant(end))
        if "year" in bars.columns:
            out = out.filter(F.col("year") <= F.year(clock.as_instant(end)))
    return out


def cross_section(bars: DataFrame, *, scale: str, ts, as_of) -> DataFrame:
    """All symbols at one instant; empty while the bar is still open at ``as_of``."""
    at = clock.as_instant(ts)
    if "year" in bars.columns:
        bars = bars.filter(F.col("year") == F.year(at))
    return bars.filter((F.col("scale") == scale) & (F.col("ts") == at)
                       & (clock.effective_close_of(scale, "ts") <= clock.as_instant(as_of)))


def read_pit(df: DataFrame, *, time: str, as_of=None, strict: bool = True, min_time=None,
             closed_scale: str | None = None) -> DataFrame:
    """Derived-table loader: rows before (or at) ``as_of``, optionally closed bars only."""
    out = df
    if as_of is not None:
        cap = clock.as_instant(as_of)
        out = out.filter(F.col(time) < cap if strict else F.col(time) <= cap)
        if closed_scale:
            out = out.filter(clock.effective_close_of(closed_scale, time) <= cap)
    return out if min_time is None else out.filter(F.col(time) >= clock.as_instant(min_time))


def label_target(labels: DataFrame, *, residual_horizons: Sequence[str] = (), as_of=None) -> DataFrame:
    """Labels with ``y``: the residual for chosen horizons where the table has one, else the raw return."""
    raw = F.col("y_log_return")
    y = raw
    if residual_horizons and "y_resid" in labels.columns:
        y = F.when(F.col("horizon").isin(*residual_horizons), F.col("y_resid")).otherwise(raw)
    out = labels.withColumn("y", y)
    return out if as_of is None else out.filter(F.col("t_horizon") <= clock.as_instant(as_of))


def symbols_stored(bars: DataFrame, scale: str | None = None) -> DataFrame:
    return (bars if scale is None else bars.filter(F.col("scale") == scale)).select("symbol").distinct()


def profile(bars: DataFrame) -> DataFrame:
    """Rows and time range per (scale, symbol)."""
    return bars.groupBy("scale", "symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per scale, from file metadata."""
    f = open_bars(spark, root).select("scale", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).distinct()
    return f.groupBy("scale").agg(F.count(F.lit(1)).alias("n_files"), F.sum("b").alias("bytes"))


def missing_keys(wanted: DataFrame, existing: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Keys still to be ingested or built (all of them with ``force``)."""
    return wanted if force else wanted.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append_missing(df: DataFrame, root: str, keys: Sequence[str], partition: Sequence[str] = (), force: bool = False) -> None:
    """Idempotent build: append the rows of keys the table lacks; ``force`` rewrites their partitions."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(root)
    except AnalysisException as e:
        if not absent(e):
            raise
        have = None
    if have is not None and not set(df.columns) <= set(have.columns):
        raise ValueError(f"stored table at {root} lacks columns {sorted(set(df.columns) - set(have.columns))}")
    todo = df if have is None or force else df.join(have.select(*keys).distinct(), list(keys), "left_anti")
    w = todo.write.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(root)


def write_by_date(samples: DataFrame, root: str, time: str) -> None:
    """Assembled samples partitioned by date, for pruned range reads."""
    (samples.withColumn("date", F.to_date(time)).repartitionByRange("date", time).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root))


def read_dates(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("date").between(start, end))


def export(df: DataFrame, root: str, *, scales: Sequence[str] = (), symbols: DataFrame | None = None, start=None, end=None) -> None:
    """Filtered copy of a table as Parquet shards."""
    out = df if not scales else df.filter(F.col("scale").isin(*scales))
    if symbols is not None:
        out = out.join(symbols.select("symbol"), "symbol", "left_semi")
    if start is not None:
        out = out.filter(F.col("ts") >= clock.as_instant(start))
    if end is not None:
        out = out.filter(F.col("ts") <= clock.as_instant(end))
    out.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode("overwrite").option("compression", "zstd").parquet(root)


def stage(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def drop_stage(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def sample(df: DataFrame, n: int, fraction: float, seed: int = 0) -> DataFrame:
    """Up to ``n`` random rows (the limit is the feature)."""
    return df.sample(fraction=fraction, seed=seed).limit(n)


def write_report(df: DataFrame, path: str) -> None:
    """Small result tables (gates, cells) as JSON lines."""
    df.write.mode("overwrite").json(path)


def publish(df: DataFrame, root: str, keep: Column | None = None) -> str:
    """Write a new version of a rewritten table beside the old ones and return its path.

    Plain Parquet has no in-place update: readers follow the newest version, and an
    interrupted write leaves the previous one whole.
    """
    import time

    path = f"{root.rstrip('/')}/v={int(time.time() * 1000)}"
    out = df if keep is None else df.filter(keep)
    w = out.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy("scale", "year") if {"scale", "year"} <= set(out.columns) else w).parquet(path)
    return path


def published(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version under ``root``; versions without a success mark were interrupted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"no published table at {root}")
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("v=")]
    whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        raise FileNotFoundError(f"no whole version at {root}")
    newest = max(whole, key=lambda p: int(p.getName()[2:])).toString()
    return spark.read.option("basePath", newest).parquet(newest)
