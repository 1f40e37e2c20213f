"""Candle clock: when a bar becomes known, session time, calendar encodings.

Intraday bars are stamped at their open; daily bars are stamped at their close
(10:00 UTC, the end of the exchange session).  All comparisons use the moment a
bar is known, ``eff_close``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Bar length in minutes per intraday scale; session clock; zone.
SCALE_MINUTES = {"5m": 5, "15m": 15, "60m": 60}
DAY_SCALE = "day"
SCALES = ("5m", "15m", "60m", "day")
EXCHANGE_ZONE = "Asia/Kolkata"
ZONE_SHIFT = "INTERVAL 330 MINUTES"  # the zone has had no daylight saving since 1945
OPEN_MINUTE = 9 * 60 + 15
CLOSE_MINUTE = 15 * 60 + 30
SESSION_MINUTES = CLOSE_MINUTE - OPEN_MINUTE
SESSION_OPEN_UTC = "03:45"
SESSION_CLOSE_UTC = "10:00"
DAILY_SHIFT = "INTERVAL '15:30' HOUR TO MINUTE"


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} MINUTES")


def effective_close(scale: Column | str, ts: Column | str) -> Column:
    """Moment a bar is known. A scale outside the known set raises at run time."""
    sc = F.col(scale) if isinstance(scale, str) else scale
    t = F.col(ts) if isinstance(ts, str) else ts
    out = F.when(sc == DAY_SCALE, t)
    for name, n in SCALE_MINUTES.items():
        out = out.when(sc == name, t + minutes(n))
    return out.otherwise(
        F.raise_error(F.concat(F.lit("unknown scale: "), F.coalesce(sc, F.lit("null"))))
        .cast("timestamp"))


def effective_close_of(scale: str, ts: Column | str) -> Column:
    """As :func:`effective_close` for a scale fixed when the plan is built."""
    t = F.col(ts) if isinstance(ts, str) else ts
    if scale == DAY_SCALE:
        return t
    if scale not in SCALE_MINUTES:
        raise ValueError(f"unknown scale: {scale!r}")
    return t + minutes(SCALE_MINUTES[scale])


def closed_by(df: DataFrame, as_of: Column) -> DataFrame:
    """Keep bars known by ``as_of`` (the boundary counts as known).

    A plain predicate on ``ts`` is added so Parquet can skip row groups; the
    exact gate is the second predicate.
    """
    return df.filter(F.col("ts") <= as_of).filter(effective_close("scale", "ts") <= as_of)


def as_instant(value) -> Column:
    """A UTC instant literal from a datetime/str/Column; naive input means UTC."""
    if isinstance(value, Column):
        return value
    import datetime as dt

    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        text = value.isoformat(sep=" ")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz").cast("timestamp")


def to_utc(df: DataFrame, column: str = "ts") -> DataFrame:
    """Uniform UTC instants from naive timestamps, dates or instants."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def daily_open_to_close(ts: Column) -> Column:
    """Midnight exchange time -> session close of the same exchange day."""
    return ts + F.expr(DAILY_SHIFT)


def exchange_time(ts: Column) -> Column:
    """Exchange wall time as an instant; a constant shift stays cheap in generated code."""
    return ts + F.expr(ZONE_SHIFT)


def exchange_date(ts: Column) -> Column:
    return F.to_date(exchange_time(ts))


def exchange_instant(day: Column, minute_of_day: Column | int) -> Column:
    """UTC instant of a minute of the exchange day."""
    m = F.lit(minute_of_day) if isinstance(minute_of_day, int) else minute_of_day
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + (m - 330) * 60)


def exchange_minute(ts: Column) -> Column:
    local = exchange_time(ts)
    return F.hour(local) * 60 + F.minute(local)


def in_session(ts: Column) -> Column:
    """Session membership by UTC clock, both ends included."""
    return F.date_format(ts, "HH:mm").between(SESSION_OPEN_UTC, SESSION_CLOSE_UTC)


def bar_clock(scale: str, ts: Column) -> dict[str, Column]:
    """Session-scaled minute and ISO weekday on the unit circle."""
    if scale == DAY_SCALE:
        sin_m, cos_m = F.lit(0.0), F.lit(1.0)
    else:
        angle = (exchange_minute(ts) - OPEN_MINUTE) / F.lit(float(SESSION_MINUTES)) * (2 * math.pi)
        sin_m, cos_m = F.sin(angle), F.cos(angle)
    dow = (F.weekday(exchange_time(ts)) + 1) * (2 * math.pi / 7)
    return {"min_of_day_sin": sin_m, "min_of_day_cos": cos_m,
            "day_of_week_sin": F.sin(dow), "day_of_week_cos": F.cos(dow)}


def anchor_circle(anchor_us: Column) -> dict[str, Column]:
    """Time of day, weekday and day of year of an anchor (epoch µs) on the unit circle."""
    day = 86_400.0
    sec = anchor_us / F.lit(1e6) + F.lit(5.5 * 3600.0)
    days = F.floor(sec / day)
    frac = (sec - days * day) / day
    dow = F.pmod(days + 3, F.lit(7)) / F.lit(7.0)
    whole = days.cast("double")
    doy = (whole - F.floor(whole / 365.25) * 365.25) / 365.25
    out: dict[str, Column] = {}
    for name, part in (("day", frac), ("week", dow), ("year", doy)):
        out[f"{name}_sin"] = F.sin(part * (2 * math.pi))
        out[f"{name}_cos"] = F.cos(part * (2 * math.pi))
    return out


def session_harmonics(ts: Column, n: int = 8, bars: int = 13) -> list[Column]:
    """sin/cos pairs of the first ``n`` harmonics of the session clock."""
    frac = (exchange_minute(ts) - OPEN_MINUTE) / F.lit(bars * 30.0)
    out = []
    for k in range(1, n + 1):
        out += [F.sin(frac * (2 * math.pi * k)).alias(f"tod_sin_{k}"),
                F.cos(frac * (2 * math.pi * k)).alias(f"tod_cos_{k}")]
    return out
