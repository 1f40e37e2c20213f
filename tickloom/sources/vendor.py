"""Vendor payloads and dumps as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import clock
from tickloom.operators import ranking


def _typed(rows: DataFrame, ts: Column, field) -> tuple[DataFrame, DataFrame]:
    num = lambda i, t="double": field(i).try_cast(t)
    cols = {"_ts": ts, "open": num(1), "high": num(2), "low": num(3), "close": num(4), "volume": num(5, "bigint")}
    typed = rows.withColumns(cols)
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    shifted = F.when(F.col("scale") == clock.DAY_SCALE, clock.daily_open_to_close(F.col("_ts"))).otherwise(F.col("_ts"))
    keep = [c for c in rows.columns if c not in ("_row", "payload")]
    good = typed.filter(whole).select(*keep, shifted.alias("ts"), "open", "high", "low", "close", "volume")
    return good, typed.filter(~whole).select(*keep, "_row")


def _candles(payload: Column) -> Column:
    body = "candles array<array<string>>"
    parsed = F.from_json(payload, f"{body}, payload struct<{body}>")
    return F.coalesce(parsed["candles"], parsed["payload"]["candles"])


def candle_rows(raw: DataFrame) -> DataFrame:
    """The content of payloads: one row per candle as fetched, in no order; a payload without candles stays one row."""
    rows = raw.withColumn("_row", F.explode_outer(_candles(F.col("payload"))))
    text = F.coalesce(F.to_json("_row"), F.col("payload"))
    return rows.select(*[c for c in raw.columns if c != "payload"], text.alias("candle"))


def candles_from_arrays(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``symbol, scale, chunk, payload`` (JSON) -> bars and rejected rows.

    The payload is ``{"candles": [[epoch, o, h, l, c, v, oi?], ...]}`` or the same
    inside ``payload``.  Rows that are short or not numeric are rejected, daily bars
    move from midnight to the session close.
    """
    rows = raw.withColumn("_row", F.explode(_candles(F.col("payload"))))
    at = lambda i: F.try_element_at("_row", F.lit(i + 1))
    return _typed(rows, F.timestamp_seconds(at(0).try_cast("bigint")), at)


def candles_from_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As above for ``[{"date": ..., "open": ..., ...}, ...]``; a date without a zone is exchange time."""
    rec = "array<struct<date string, open string, high string, low string, close string, volume string, oi string>>"
    rows = raw.withColumn("_row", F.explode(F.from_json("payload", rec)))
    d = F.col("_row.date")
    zoned = d.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ts = F.when(zoned, d.try_cast("timestamp")).otherwise(
        F.to_utc_timestamp(d.try_cast("timestamp_ntz").cast("timestamp"), clock.EXCHANGE_ZONE))
    names = ("date", "open", "high", "low", "close", "volume")
    return _typed(rows, ts, lambda i: F.col(f"_row.{names[i]}"))


def merge_chunks(bars: DataFrame, chunk: str = "chunk") -> DataFrame:
    """One bar per (symbol, scale, ts): the one from the latest chunk."""
    return ranking.first_per(bars, ["symbol", "scale", "ts"], chunk, last=True).drop(chunk)


def gap_plan(tokens: DataFrame, last_ts: DataFrame, scales: Sequence[str], *, floor, end, overlap_days: int = 5) -> DataFrame:
    """What to fetch: start = last stored bar minus the overlap, or the floor; nothing past ``end``.

    ``tokens`` is ``symbol, token``; ``last_ts`` is ``symbol, scale, last_ts``.
    """
    want = tokens.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    start = F.coalesce(F.col("last_ts") - F.expr(f"INTERVAL {int(overlap_days)} DAYS"), clock.as_instant(floor))
    out = want.join(last_ts, ["symbol", "scale"], "left").withColumns({"start": start, "end": clock.as_instant(end)})
    return out.filter(F.col("start") < F.col("end"))


def instrument_lookup(dump: DataFrame, wanted: DataFrame, *, exchange: str, segment: str) -> DataFrame:
    """Wanted symbols with the lowest matching token of the dump, and whether any was found."""
    hits = dump.filter((F.col("exchange") == exchange) & (F.col("segment") == segment)).groupBy("symbol").agg(F.min("token").alias("token"))
    return wanted.select("symbol").distinct().join(hits, "symbol", "left").withColumn("found", F.col("token").isNotNull())
