"""As-of joins: the latest right row before (or at) each left row.

One union of all sides and one window per key: no left x right pairs are formed.
Sides that follow the bar contract (see :mod:`tickloom.operators.series`) are bounded
per key by the calendar.  With ``bucket`` (``'month'``, ``'day'``) the window runs per
(key, time bucket): right rows older than a bucket reach it as a single carried row
per source, so a long or hot key spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: a source: its rows, its time column, and the payload expressions by output name
Source = tuple[DataFrame, str, dict[str, Column]]


def _cut(bucket: str | None, time: str) -> Column:
    out = F.date_trunc(bucket, F.col(time)) if bucket else F.lit(None).cast("timestamp")
    return out.alias("_b")


def _carried(rows: DataFrame, probe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last right row before each bucket that holds left or right rows."""
    tails = rows.groupBy(*keys, "_b").agg(F.max_by("_p", "_t").alias("_p"), F.max("_t").alias("_t"))
    marks = (tails.unionByName(probe.select(*keys, "_b").distinct(), allowMissingColumns=True)
             .groupBy(*keys, "_b").agg(F.max_by("_p", "_t").alias("_p")))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (marks.withColumn("_p", F.last("_p", ignorenulls=True).over(earlier))
            .filter(F.col("_p").isNotNull()))


def asof_many(left: DataFrame, sources: dict[str, Source], *, keys: Sequence[str] = ("symbol",),
              left_time: str = "anchor_ts", strict: bool = True, forward: bool = False,
              bucket: str | None = None) -> DataFrame:
    """Left rows with the latest row of every source, in one pass over the left side.

    ``strict`` takes right rows with time ``<`` the left time, otherwise ``<=``;
    ``forward`` looks for the earliest row after (or at) the left time instead.
    Every source holds one row per (key, time).  Unmatched payloads are null.
    """
    if forward and bucket:
        raise ValueError("time buckets are carried forward in time only")
    probe = left.select(*keys, F.col(left_time).alias("_t"),
                        _cut(bucket, left_time), F.struct(*left.columns).alias("_l"))
    right_side, left_side = (1, 0) if strict else (0, 1)
    both = probe.select(*keys, "_b", "_t", F.lit(left_side).alias("_side"), "_l")
    for name, (right, time, payload) in sources.items():
        rows = right.filter(F.col(time).isNotNull()).select(
            *keys, F.col(time).alias("_t"), _cut(bucket, time),
            F.struct(*[e.alias(n) for n, e in payload.items()]).alias("_p"))
        parts = [rows.select(*keys, "_b", "_t", F.lit(right_side).alias("_side"), "_p")]
        if bucket:
            parts.append(_carried(rows, probe, keys).select(
                *keys, "_b", F.lit(None).cast("timestamp").alias("_t"), F.lit(-1).alias("_side"), "_p"))
        for part in parts:
            both = both.unionByName(part.withColumnRenamed("_p", f"_p_{name}"),
                                    allowMissingColumns=True)
    upto = (Window.partitionBy(*keys, *(["_b"] if bucket else [])).orderBy(F.col("_t").desc() if forward else F.col("_t").asc_nulls_first(), "_side")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = both.withColumns({
        f"_h_{name}": F.last(f"_p_{name}", ignorenulls=True).over(upto) for name in sources})
    return hits.filter(F.col("_l").isNotNull()).select(
        *[F.col("_l")[c].alias(c) for c in left.columns],
        *[F.col(f"_h_{name}")[n].alias(n) for name, s in sources.items() for n in s[2]])


def asof(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = ("symbol",),
         left_time: str = "anchor_ts", right_time: str = "eff_close",
         payload: dict[str, Column] | None = None, strict: bool = True,
         bucket: str | None = None) -> DataFrame:
    """As-of join with one source; default payload is every right column but the keys."""
    payload = payload or {c: F.col(c) for c in right.columns if c not in keys}
    return asof_many(left, {"r": (right, right_time, payload)}, keys=keys,
                     left_time=left_time, strict=strict, bucket=bucket)
