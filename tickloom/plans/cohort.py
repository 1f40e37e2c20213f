"""Cohorts: all symbols alive at an anchor, ten calendar-aware labels, market regime, pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import clock, shapes
from tickloom.operators import tradingdays
from tickloom.plans.crosssection import draw, fetch_windows, numbered_stores, with_history

# The ten horizons in head order (name, kind, minutes, trading days ahead).
HORIZONS = (
    ("intraday_30m", "intraday", 30, 0), ("intraday_60m", "intraday", 60, 0), ("intraday_120m", "intraday", 120, 0),
    ("intraday_180m", "intraday", 180, 0), ("to_close", "to_close", 0, 0), ("overnight", "next", 0, 1),
    ("next_day_1h", "next", 60, 1), ("next_day_eod", "next", 375, 1), ("day_plus_3", "next", 375, 3), ("day_plus_5", "next", 375, 5),
)
FIRST_BAR_MINUTES = 5
MIN_ALIVE = 10


def head_mask(t: Column) -> list[Column]:
    """Which horizons can still realise from the anchor's time of day."""
    m = clock.exchange_minute(t)
    return [m + n <= clock.CLOSE_MINUTE if kind == "intraday" else m < clock.CLOSE_MINUTE if kind == "to_close" else F.lit(True)
            for _, kind, n, _ in HORIZONS]


def endpoints(anchors: DataFrame, trading: DataFrame, *, overnight_first_bar: bool = True) -> DataFrame:
    """``t, head, endpoint`` per anchor and horizon; null endpoints mean no such trading day.

    A bar closing exactly at the open does not exist, so the overnight endpoint is the
    first bar of the next session unless ``overnight_first_bar`` is off.
    """
    days = anchors.select("t").distinct().withColumn("_d", clock.exchange_date(F.col("t")))
    civil = days.select(F.col("_d").alias("day")).distinct()
    for n in sorted({h[3] for h in HORIZONS if h[3]}):
        moves = tradingdays.shift_table(trading, n, dates=civil).select(F.col("day").alias("_d"), F.col("target").alias(f"_d{n}"))
        days = days.join(moves, "_d", "left")
    ends = []
    for i, ((name, kind, minutes, ahead), ok) in enumerate(zip(HORIZONS, head_mask(F.col("t")))):
        if kind == "intraday":
            at = F.col("t") + clock.minutes(minutes)
        elif kind == "to_close":
            at = clock.exchange_instant(F.col("_d"), clock.CLOSE_MINUTE)
        else:
            into = FIRST_BAR_MINUTES if name == "overnight" and overnight_first_bar else minutes
            at = clock.exchange_instant(F.col(f"_d{ahead}"), clock.OPEN_MINUTE + into)
        ends.append(F.struct(F.lit(i).alias("head"), F.when(ok, at).alias("endpoint")))
    return days.select("t", F.explode(F.array(*ends)).alias("e")).select("t", "e.head", "e.endpoint")


def closes(bars: DataFrame) -> DataFrame:
    """``symbol, at, close``: 5m closes keyed by the moment they are known."""
    return bars.filter((F.col("scale") == "5m") & (F.col("close") > 0)).select(
        "symbol", clock.effective_close_of("5m", "ts").alias("at"), "close")


def alive(anchors: DataFrame, bars: DataFrame, stores: dict[str, DataFrame], *, window_bars: dict[str, int],
          channels: Sequence[str] | None = ("close",), min_alive: int = MIN_ALIVE) -> DataFrame:
    """``t, symbol, c0`` of the symbols with full histories and a close at the anchor, and their windows.

    Cohorts are counted on bar numbers; windows are fetched for the rows that stay, or not at all without ``channels``.
    """
    here = closes(bars).withColumnsRenamed({"at": "t", "close": "c0"}).join(anchors.select("t").distinct(), "t", "left_semi")
    numbered = numbered_stores(stores, channels or ())
    hits = with_history(here, numbered, strict=False, window_bars=window_bars)
    rows = hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("t"))).filter(F.col("_n") >= min_alive).drop("_n")
    if channels is None:
        return rows.select("t", "symbol", "c0")
    return fetch_windows(rows, numbered, window_bars=window_bars, channels=channels)


def label_arrays(rows: DataFrame, bars: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with ``labels array<float>`` and ``label_valid array<boolean>`` in head order."""
    base = rows.select("t", "symbol", "c0")
    hit = base.join(ends.filter(F.col("endpoint").isNotNull()), "t").join(
        closes(bars).withColumnsRenamed({"at": "endpoint", "close": "c1"}), ["symbol", "endpoint"])
    per = hit.groupBy("t", "symbol").agg(*[
        F.max(F.when(F.col("head") == i, F.log(F.col("c1") / F.col("c0")))).cast("float").alias(f"_y{i}") for i in range(len(HORIZONS))])
    ys = [F.col(f"_y{i}") for i in range(len(HORIZONS))]
    return rows.join(per, ["t", "symbol"], "left").withColumns({
        "labels": F.array(*ys), "label_valid": F.array(*[y.isNotNull() for y in ys])}).drop(*[f"_y{i}" for i in range(len(HORIZONS))])


def regime(rows: DataFrame, bars: DataFrame, trading: DataFrame, sectors: DataFrame) -> DataFrame:
    """Ten market-state numbers per anchor from the alive symbols' closes at earlier moments."""
    t = F.col("t")
    days = rows.select("t").distinct().withColumn("_d", clock.exchange_date(t))
    civil = days.select(F.col("_d").alias("day")).distinct()
    for n in (1, 5):
        days = days.join(tradingdays.shift_table(trading, -n, dates=civil).select(F.col("day").alias("_d"), F.col("target").alias(f"_p{n}")), "_d", "left")
    first_close = clock.OPEN_MINUTE + FIRST_BAR_MINUTES
    moments = {"r5": clock.exchange_instant(F.col("_p5"), clock.CLOSE_MINUTE), "r1": clock.exchange_instant(F.col("_p1"), clock.CLOSE_MINUTE),
               "r30": t - clock.minutes(30), "r60": t - clock.minutes(60),
               "today": F.when(clock.exchange_minute(t) > first_close, clock.exchange_instant(F.col("_d"), first_close))}
    when = days.select("t", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("at")) for k, e in moments.items()])).alias("m")).select("t", "m.*")
    past = rows.select("t", "symbol", "c0").join(when.filter(F.col("at").isNotNull()), "t").join(closes(bars), ["symbol", "at"])
    r = past.withColumn("r", F.log(F.col("c0") / F.col("close"))).join(
        sectors.select("symbol", F.coalesce("sector", F.lit("_no_sector")).alias("sector")), "symbol", "left")
    of = lambda k: F.when(F.col("kind") == k, F.col("r"))
    per_sector = r.groupBy("t", "sector").agg(F.avg(of("r1")).alias("m")).groupBy("t").agg(
        F.when(F.count("m") > 1, F.stddev_pop("m")).alias("_disp"))
    agg = r.groupBy("t").agg(F.avg(of("r5")).alias("_r5"), F.avg((of("r1") > 0).cast("double")).alias("_breadth"),
                             F.when(F.count(of("r1")) > 1, F.stddev_pop(of("r1"))).alias("_xs"), F.avg(of("r1")).alias("_r1"),
                             F.avg(of("r30")).alias("_r30"), F.avg(of("r60")).alias("_r60"), F.avg(of("today")).alias("_today"))
    import math
    angle = (clock.exchange_minute(t) - clock.OPEN_MINUTE) * (2 * math.pi / clock.SESSION_MINUTES)
    z = lambda c, d=0.0: F.coalesce(c, F.lit(d))
    return rows.select("t").distinct().join(agg, "t", "left").join(per_sector, "t", "left").select(
        "t", z("_r5").alias("univ_5d_ret"), z("_breadth", 0.5).alias("univ_breadth"), z("_xs").alias("univ_xs_vol"), z("_r1").alias("univ_1d_ret"),
        z("_disp").alias("sector_disp_1d"), z("_r30").alias("cohort_30m"), z("_r60").alias("cohort_1h"), z("_today").alias("cohort_today"),
        F.sin(angle).alias("min_sin"), F.cos(angle).alias("min_cos"))


def assemble(anchors: DataFrame, bars: DataFrame, stores: dict[str, DataFrame], trading: DataFrame, *, window_bars: dict[str, int],
             channels: Sequence[str] | None = ("close",), min_alive: int = MIN_ALIVE) -> DataFrame:
    """Alive rows with their labels, and their windows unless ``channels`` is None."""
    rows = alive(anchors, bars, stores, window_bars=window_bars, channels=channels, min_alive=min_alive)
    return label_arrays(rows, bars, endpoints(anchors, trading))


def facts(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """``anchor_us, date, anchor_minute, stock, sector_id, labels, label_valid``."""
    return rows.join(sectors.select("symbol", "sector_id"), "symbol").select(
        F.unix_micros("t").alias("anchor_us"), clock.exchange_date(F.col("t")).alias("date"), clock.exchange_minute(F.col("t")).alias("anchor_minute"),
        F.col("symbol").alias("stock"), "sector_id", "labels", "label_valid")


PAIR_SCHEMA = "anchor_us bigint, sector_id int, stock_a string, stock_b string, cosine double"


def sector_pairs(fact_rows: DataFrame, *, threshold: float = 0.5, top: int = 50, block: int = 512) -> DataFrame:
    """Best ``top`` pairs per (anchor, sector) by cosine of the masked label vectors above ``threshold``.

    A group is cut into blocks of about ``block`` stocks and every pair of blocks is one
    matrix product in an Arrow group that keeps only its own ``top`` pairs; the best of
    the group are among the best of its block pairs.  Groups of up to ``block`` rows are
    a single product, so nothing is replicated.
    """
    keys = ["anchor_us", "sector_id"]
    unit = fact_rows.select(*keys, "stock", shapes.masked_unit(F.col("labels"), F.col("label_valid")).alias("v"))
    size = unit.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb")).filter("_nb > 0")
    placed = unit.join(size, keys).withColumn("_b", F.pmod(F.xxhash64("stock"), F.col("_nb")).cast("int"))
    # block i meets blocks i..n-1: a row goes to its own (b, x>=b) and (x<=b, b) products
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    spread = placed.withColumn("_x", other).select(*keys, "stock", "v", "_b", F.least("_b", "_x").alias("_lo"), F.greatest("_b", "_x").alias("_hi"))

    def product(pdf):
        import numpy as np
        import pandas as pd

        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        a = pdf[pdf["_b"] == lo].sort_values("stock")
        b = a if lo == hi else pdf[pdf["_b"] == hi].sort_values("stock")
        empty = pd.DataFrame({"anchor_us": [], "sector_id": [], "stock_a": [], "stock_b": [], "cosine": []})
        if not len(a) or not len(b):
            return empty.astype({"anchor_us": "int64", "sector_id": "int32", "cosine": "float64"})
        cos = np.vstack(a["v"].to_numpy()) @ np.vstack(b["v"].to_numpy()).T
        if lo == hi:
            cos[np.tril_indices(len(a))] = -2.0
        i, j = np.nonzero(cos > threshold)
        sa, sb = a["stock"].to_numpy()[i], b["stock"].to_numpy()[j]
        swap = sa > sb
        out = pd.DataFrame({"anchor_us": np.full(len(i), pdf["anchor_us"].iloc[0], dtype="int64"),
                            "sector_id": np.full(len(i), pdf["sector_id"].iloc[0], dtype="int32"),
                            "stock_a": np.where(swap, sb, sa), "stock_b": np.where(swap, sa, sb), "cosine": cos[i, j]})
        return out.sort_values(["cosine", "stock_a", "stock_b"], ascending=[False, True, True]).head(top)

    best = spread.withColumn("sector_id", F.col("sector_id").cast("int")).groupBy(*keys, "_lo", "_hi").applyInPandas(product, PAIR_SCHEMA)
    w = Window.partitionBy(*keys).orderBy(F.col("cosine").desc(), "stock_a", "stock_b")
    return best.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= top).select(
        "stock_a", F.col("anchor_us").alias("anchor_a_us"), "stock_b", F.col("anchor_us").alias("anchor_b_us"),
        F.lit("sector_alpha").alias("pair_type"), "cosine", F.col("sector_id").alias("sector_id_a"), F.col("sector_id").alias("sector_id_b"))


def same_stock_pairs(fact_rows: DataFrame, *, per_stock: int = 20, min_days: int = 1, max_days: int = 60, seed: int = 0) -> DataFrame:
    """Up to ``per_stock`` anchor pairs per stock with a gap inside the range, chosen by hash.

    Partners are counted with a range frame and addressed by position, so no pair is
    formed that is not kept.
    """
    day = 86_400_000_000
    w = Window.partitionBy("stock").orderBy("anchor_us")
    base = fact_rows.select("stock", "anchor_us", "sector_id").withColumns({
        "_pos": F.row_number().over(w), "_near": F.count(F.lit(1)).over(w.rangeBetween(0, min_days * day - 1)),
        "_m": F.count(F.lit(1)).over(w.rangeBetween(min_days * day, max_days * day))})
    pick = draw(seed, F.col("stock"), F.col("anchor_us"))
    ranked = base.filter("_m > 0").withColumn("_h", pick).withColumn(
        "_p", F.row_number().over(Window.partitionBy("stock").orderBy("_h"))).filter(F.col("_p") <= per_stock)
    step = F.pmod(F.conv(F.substring("_h", 9, 8), 16, 10).cast("long"), F.col("_m"))
    chosen = ranked.select("stock", "sector_id", F.col("anchor_us").alias("anchor_a_us"), (F.col("_pos") + F.col("_near") + step).alias("_pos"))
    partner = base.select("stock", "_pos", F.col("anchor_us").alias("anchor_b_us"))
    return chosen.join(partner, ["stock", "_pos"]).select(
        F.col("stock").alias("stock_a"), "anchor_a_us", F.col("stock").alias("stock_b"), "anchor_b_us", F.lit("same_stock").alias("pair_type"),
        F.lit(1.0).alias("cosine"), F.col("sector_id").cast("int").alias("sector_id_a"), F.col("sector_id").cast("int").alias("sector_id_b"))


def pair_windows(pairs: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs with both sides' assembled columns."""
    for side in ("a", "b"):
        part = rows.select(F.col("symbol").alias(f"stock_{side}"), F.unix_micros("t").alias(f"anchor_{side}_us"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(part, [f"stock_{side}", f"anchor_{side}_us"])
    return pairs


def anchor_grid(trading: DataFrame, *, start: int = 615, end: int = 925, step: int = 5) -> DataFrame:
    """Anchor instants: minutes of the exchange day on every trading day."""
    m = F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step)))
    return trading.select("trade_date", m.alias("m")).select(clock.exchange_instant(F.col("trade_date"), F.col("m")).alias("t"))
