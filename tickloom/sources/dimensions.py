"""Symbol master, sectors, universes, adjustment configuration."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.functions import clock

# Identity columns that may still be unpopulated.
PLACEHOLDERS = ("isin", "valid_from", "valid_to", "mcap_bucket", "free_float_bucket", "fno_eligible", "listed_on", "delisted_on")


def build_master(symbols: DataFrame, sectors: DataFrame, isins: DataFrame | None = None) -> DataFrame:
    """Symbols with sector data and identifiers; unknown identity columns are null."""
    out = symbols.select("symbol").distinct().join(sectors, "symbol", "left")
    if isins is not None:
        out = out.join(isins.select("symbol", "isin"), "symbol", "left")
    out = out.withColumn("symbol_id", F.col("symbol"))
    return out.withColumns({c: F.lit(None).cast("string") for c in PLACEHOLDERS if c not in out.columns})


def completeness(master: DataFrame, columns: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """Per column whether every row has a value, in one pass."""
    one = master.agg(*[((F.count(c) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("populated")) for c in columns])).alias("x")).select("x.*")


def in_group(master: DataFrame, column: str, value: str) -> DataFrame:
    """Symbols of a sector or macro sector, whatever the case."""
    return master.filter(F.lower(column) == value.lower())


def sector_map(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, sector`` from Parquet or a headerless CSV; blanks pool in ``_no_sector``."""
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema("symbol string, sector string").csv(path)
    return raw.select("symbol", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("_no_sector")).alias("sector"))


def roster(day_bars: DataFrame, *, start, end) -> DataFrame:
    """Symbols with a day bar at or after ``start`` and one at or before ``end``."""
    s, e = clock.as_instant(start), clock.as_instant(end)
    return day_bars.filter(F.col("scale") == "day").groupBy("symbol").agg(F.max("ts").alias("_hi"), F.min("ts").alias("_lo")).filter(
        (F.col("_hi") >= s) & (F.col("_lo") <= e)).select("symbol")


def with_sector_ids(master: DataFrame) -> DataFrame:
    """Dense sector numbers from 0 (the master holds one row per symbol)."""
    sec = F.coalesce("sector", F.lit("_no_sector"))
    ids = master.select(sec.alias("_s")).distinct().withColumn("sector_id", F.row_number().over(Window.orderBy("_s")) - 1)
    return master.withColumn("_s", sec).join(ids, "_s").drop("_s")


def universe(master: DataFrame | None, bars: DataFrame, strict: bool = False) -> DataFrame:
    """Master symbols with stored day bars; without a master, every symbol stored at day scale.
    ``strict`` raises where nothing is left."""
    stored = bars.filter(F.col("scale") == "day").select("symbol").distinct()
    found = stored if master is None else master.select("symbol").distinct().join(stored, "symbol", "left_semi")
    if strict and found.isEmpty():
        raise ValueError("empty universe: no master symbol has stored day bars")
    return found


def adjustments(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """Readjustment rows from configuration, validated (a driver-side list of a few entries)."""
    import datetime as dt

    rows = []
    for e in entries:
        ratio = float(e["ratio"])
        if ratio <= 0 or ratio == 1.0:
            raise ValueError(f"ratio must be positive and not 1: {e}")
        cut = e.get("cutoff_date_ist")
        cut = dt.date.fromisoformat(cut) if isinstance(cut, str) else cut
        rows.append((str(e["symbol"]), ratio, cut, str(e.get("event", "")), str(e.get("notes", ""))))
    return spark.createDataFrame(rows, "symbol string, ratio double, cutoff_date_ist date, event string, notes string")
