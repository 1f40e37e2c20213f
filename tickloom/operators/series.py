"""Ordered windows over series.

A bar table holds one row per (symbol, scale, grid slot), so a series is bounded by
the calendar however large the table is: 75 slots a day is about 0.6 million rows
in thirty years.  A window per series is then one shuffle of modest, even tasks, and
that is the default.

Where that bound does not hold, or a few long series must spread over many
executors, pass ``chunk_rows``: each series is cut into chunks of consecutive time
buckets and every chunk also receives the neighbouring buckets a row-bounded frame
can reach, so results equal the unsplit window exactly:

1. count rows per (series, time bucket)     -- partial aggregation, tiny shuffle
2. number buckets into chunks               -- window over the counts only
3. add halo targets for the frame's reach   -- equi-join on (series, chunk id)
4. send rows to their chunks, run the window on (series, chunk), drop the halo

The counts read the input a second time, so split stored tables rather than long
chains.  Frames that reach to the start of a series are covered by
:func:`running_total`, :func:`carry_forward` and :mod:`tickloom.operators.asof`, which
carry one summary row per bucket instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: default: no split (series bounded by the bar contract)
CHUNK_ROWS: int | None = None
#: rows aimed at per window task when a series is split
SPLIT_ROWS = 262_144
#: time bucket that stays atomic; one bar per grid slot bounds its size
BUCKET = "month"


def _map_chunks(df: DataFrame, keys: Sequence[str], bucket: Column, lookback: int,
                lookahead: int, chunk_rows: int) -> DataFrame:
    """(keys, _bucket) -> target chunk(s); ``_own`` marks the chunk that keeps the row."""
    per_key = Window.partitionBy(*keys).orderBy("_bucket")
    spans = (
        df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(per_key))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_chunk", F.dense_rank().over(
            Window.partitionBy(*keys).orderBy(F.floor(F.col("_start") / chunk_rows))))
    )
    if not lookback and not lookahead:
        return spans.select(*keys, "_bucket", "_chunk", F.lit(True).alias("_own"))
    # Two consecutive chunks always span more than chunk_rows rows, so the reach
    # of a frame no longer than chunk_rows ends within two chunks on either side.
    chunks = spans.groupBy(*keys, "_chunk").agg(F.min("_start").alias("_cs"),
                                                F.max("_end").alias("_ce"))
    lo, hi = (-2 if lookahead else 0), (2 if lookback else 0)
    targets = spans.withColumnRenamed("_chunk", "_home").withColumn(
        "_chunk", F.explode(F.sequence(F.col("_home") + lo, F.col("_home") + hi)))
    reach = ((F.col("_end") > F.col("_cs") - lookback)
             & (F.col("_start") < F.col("_ce") + lookahead))
    return (targets.join(chunks, [*keys, "_chunk"]).filter(reach)
            .select(*keys, "_bucket", "_chunk", (F.col("_chunk") == F.col("_home")).alias("_own")))


def over_series(df: DataFrame, build: Callable[[WindowSpec], dict[str, Column]], *,
                keys: Sequence[str] = ("symbol",), order: str = "ts", lookback: int = 0,
                lookahead: int = 0, chunk_rows: int | None = CHUNK_ROWS, bucket: str = BUCKET,
                stages: Sequence[Callable[[WindowSpec], dict[str, Column]]] = ()) -> DataFrame:
    """Add window columns over each series, ordered by ``order``.

    ``build`` receives the ordered window and returns the new columns; frames
    must stay within ``lookback``/``lookahead`` rows.  ``stages`` run after it on
    the same partitions (no further shuffle) and may use columns made earlier; the
    reaches given must cover the sum over all stages.
    """
    if chunk_rows is None:
        spec = Window.partitionBy(*keys).orderBy(order)
        for step in (build, *stages):
            df = df.withColumns(step(spec))
        return df
    chunk_rows = max(chunk_rows, lookback, lookahead, 1)
    at = F.date_trunc(bucket, F.col(order).cast("timestamp"))
    chunk_map = _map_chunks(df, keys, at, lookback, lookahead, chunk_rows)
    placed = df.withColumn("_bucket", at).join(chunk_map, [*keys, "_bucket"])
    spec = Window.partitionBy(*keys, "_chunk").orderBy(order)
    for step in (build, *stages):
        placed = placed.withColumns(step(spec))
    return placed.filter("_own").drop("_bucket", "_chunk", "_own")


def running_total(df: DataFrame, value: Column, name: str, *, keys: Sequence[str],
                  order: Sequence[str | Column], bucket: Column,
                  extra: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Running sum from the start of each series, split by ``bucket``.

    Buckets are summed first (map-side combine), their running totals come from a
    window over bucket sums, and rows add a running sum inside their own bucket.
    """
    tagged = df.withColumn("_b", bucket).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = (tagged.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
            .withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"))
    inside = (Window.partitionBy(*keys, "_b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (tagged.withColumn("_w", F.sum("_v").over(inside)).join(base, [*keys, "_b"])
            .withColumn(name, F.col("_base") + F.col("_w")).drop("_b", "_v", "_w", "_base"))


def carry_forward(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str],
                  order: str, bucket: str = BUCKET) -> DataFrame:
    """Fill nulls with the last non-null value of the series (no look-ahead).

    The last non-null value of each (series, bucket) travels to later buckets as
    one row per bucket; inside a bucket a running ``last`` does the rest.
    """
    tagged = df.withColumn("_b", F.date_trunc(bucket, F.col(order).cast("timestamp")))
    when = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in columns}
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tail = tagged.groupBy(*keys, "_b").agg(
        *[F.max_by(F.col(c), when[c]).alias(f"_last_{c}") for c in columns])
    tail = tail.select(*keys, "_b", *[
        F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
    inside = (Window.partitionBy(*keys, "_b").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = tagged.withColumns({
        f"_in_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    out = local.join(tail, [*keys, "_b"]).withColumns({
        c: F.coalesce(F.col(f"_in_{c}"), F.col(f"_carry_{c}")) for c in columns})
    return out.drop("_b", *[f"_in_{c}" for c in columns], *[f"_carry_{c}" for c in columns])
