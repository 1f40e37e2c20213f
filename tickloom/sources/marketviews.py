"""Market tables derived from the star-schema test tables.

``lineitem`` joined to ``part`` gives one price bar per brand and ship date; the
same bars read on a compressed clock (75 consecutive ship dates form one session
of five-minute slots) give intraday series.  ``events`` gives order-book
snapshots.  Everything is derived by Spark from the given tables; bars are
pre-aggregated by part before the join, so a part owning a large share of the
lines reaches the shuffle as one row per day.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.functions import clock
from tickloom.session import stored

# Fixed values of the mapping (shared with the oracle SQL).
EPOCH_DAY = "1995-01-02"
FIRST_SESSION = "1996-01-01"
SLOTS = 75
PRICE_TICKS = 100_000  # price ticks per unit
DAY_SECONDS = 86_400
OPEN_SECONDS = 13_500  # 03:45 UTC


@functools.lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scan; kept per session so its footer is read once."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Market(str):
    """An input folder whose brand days are stored: every table derived from them reads those instead of the lines."""

    days: DataFrame


def market(spark: SparkSession, sf_dir: str) -> str:
    """The folder with its brand days derived once, for queries that derive several tables from them."""
    if isinstance(sf_dir, Market):
        return sf_dir
    out = Market(sf_dir)
    out.days = stored(brand_days(spark, sf_dir), "brand-days")
    return out


def brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, d, open/high/low/close, volume: one row per brand and ship date."""
    if isinstance(sf_dir, Market):
        return sf_dir.days
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    # order of trades inside a day: order, line, price, packed in one long (36 + 3 + 24 bits)
    # so that every aggregate has a primitive buffer and stays in hash aggregation
    seq = (F.pmod("l_orderkey", F.lit(1 << 36)) * 8 + F.col("l_linenumber")) * (1 << 24) + cents
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("d"), cents.alias("cents"), "l_quantity", seq.alias("seq"))
    per_part = line.groupBy("l_partkey", "d").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.max("cents").alias("hi"), F.min("cents").alias("lo"),
        F.sum("l_quantity").cast("long").alias("volume"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    days = (per_part.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("symbol", "d").agg(
                F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
                F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("volume").alias("volume")))
    base = 100 * PRICE_TICKS
    price = lambda t: (t + base) / F.lit(float(PRICE_TICKS))
    last = lambda c: F.col(c).bitwiseAND(F.lit((1 << 24) - 1))
    return days.select(
        "symbol", "d", price(last("first_seq")).alias("open"),
        price(F.col("hi") + F.pmod(F.col("volume"), F.lit(7)) * 1000).alias("high"),
        price(F.col("lo") - F.pmod(F.col("volume"), F.lit(5)) * 1000).alias("low"),
        price(last("last_seq")).alias("close"), "volume")


def is_trading(d: Column) -> Column:
    """Weekdays except a fixed rule of holidays."""
    return (F.weekday(d) < 5) & (F.dayofyear(d) % 41 != 0)


_BAR = ("symbol", "ts", "scale", "open", "high", "low", "close", "volume")


def bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = brand_days(spark, sf_dir).filter(is_trading(F.col("d")))
    return days.select(
        "symbol", F.timestamp_seconds(F.unix_date("d").cast("long") * DAY_SECONDS + 36_000).alias("ts"),
        F.lit("day").alias("scale"), "open", "high", "low", "close", "volume")


def bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.datediff("d", F.lit(EPOCH_DAY).cast("date"))
    session = F.floor(pos / SLOTS).cast("int")
    day = F.date_add(F.lit(FIRST_SESSION).cast("date"),
                     (F.floor(session / 5) * 7 + session % 5).cast("int"))
    ts = F.timestamp_seconds(F.unix_date(F.col("_day")).cast("long") * DAY_SECONDS + OPEN_SECONDS + F.pmod(pos, F.lit(SLOTS)) * 300)
    return (brand_days(spark, sf_dir).withColumn("_day", day).filter(is_trading(F.col("_day")))
            .select("symbol", ts.alias("ts"), F.lit("5m").alias("scale"),
                    "open", "high", "low", "close", "volume"))


def coarser(bars: DataFrame, scale: str) -> DataFrame:
    """Longer intraday bars on the session grid (test tables only)."""
    sec = F.unix_seconds("ts")
    start = F.timestamp_seconds(sec - F.pmod(sec - OPEN_SECONDS, F.lit(60 * clock.SCALE_MINUTES[scale])))
    return (bars.withColumn("_s", start).groupBy("symbol", "_s").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"))
        .select("symbol", F.col("_s").alias("ts"), F.lit(scale).alias("scale"),
                "open", "high", "low", "close", "volume"))


def bars(spark: SparkSession, sf_dir: str, *scales: str) -> DataFrame:
    """Bars of the chosen scales in one long table."""
    out = None
    for scale in scales or clock.SCALES:
        if scale == "day":
            part = bars_day(spark, sf_dir)
        elif scale == "5m":
            part = bars_5m(spark, sf_dir)
        else:
            part = coarser(bars_5m(spark, sf_dir), scale)
        out = part if out is None else out.unionByName(part)
    return out


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date of every trading day that has a shipped line."""
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))
    return d.filter(is_trading(F.col("trade_date"))).distinct()


def symbol_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("p_brand", 7, 10).cast("int")
    return (table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("_c"))
            .select(F.col("p_brand").alias("symbol"), n.alias("symbol_no"),
                    F.when(n % 11 != 0, F.concat(F.lit("SEC"), n % 5)).alias("sector"),
                    F.when(n % 11 != 0, F.concat(F.lit("IND"), n % 3)).alias("industry"),
                    F.concat(F.lit("MAC"), n % 2).alias("macro_sector"),
                    F.when(n % 7 != 0, F.concat(F.lit("IN"), F.lpad(n.cast("string"), 10, "0")))
                    .alias("isin")))


HORIZON_STEPS = {"h1": 1, "h3": 3, "h5": 5}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, anchor_us, stock, horizon, pred_lr, real_lr, vol from daily bars."""
    from tickloom.operators.series import over_series

    def cols(w):
        ret = lambda a, b: F.log(a / b)
        out = {"_r1": ret(F.col("close"), F.lag("close", 1).over(w))}
        for h, n in HORIZON_STEPS.items():
            out[f"_p_{h}"] = -ret(F.col("close"), F.lag("close", n).over(w))
            out[f"_y_{h}"] = ret(F.lead("close", n).over(w), F.col("close"))
        return out

    def vol(w):
        f = w.rowsBetween(-9, 0)
        return {"vol": F.when(F.count("_r1").over(f) == 10, F.stddev_samp("_r1").over(f))}

    base = over_series(bars_day(spark, sf_dir), cols, lookback=15, lookahead=5, stages=[vol])
    h = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_p_{h}").alias("pred_lr"),
                                     F.col(f"_y_{h}").alias("real_lr")) for h in HORIZON_STEPS]))
    return (base.select(F.to_date("ts").alias("date"), F.unix_micros("ts").alias("anchor_us"),
                        F.col("symbol").alias("stock"), "vol", h.alias("h"))
            .select("date", "anchor_us", "stock", "h.horizon", "h.pred_lr", "h.real_lr", "vol")
            .filter("pred_lr IS NOT NULL AND real_lr IS NOT NULL AND vol IS NOT NULL"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide five-level snapshots, one per event type and minute."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"), "value",
        F.from_json("props", "k int")["k"].cast("long").alias("k"))
    s = ev.groupBy("symbol", "ts").agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("volume"),
                                       F.sum("k").alias("k"))
    empty = F.col("k") % 13 == 0
    cols = [F.col("symbol"), F.col("ts"), (F.col("v") + 100).alias("ltp"), F.col("volume"),
            (F.col("k") * 3 + 10).alias("total_buy_qty"), (F.col("k") * 2 + 15).alias("total_sell_qty")]
    step = (F.col("k") % 3 + 1) / F.lit(100.0)
    for i in range(1, 6):
        qty = {"bid": (F.col("k") * i) % 40 + 5, "ask": (F.col("k") + 7 * i) % 40 + 5}
        for side, sign in (("bid", -1.0), ("ask", 1.0)):
            cols.append(F.when(~empty, F.col("v") + 100 + step * (sign * i)).alias(f"{side}{i}_price"))
            cols.append(F.when(~empty, qty[side]).alias(f"{side}{i}_qty"))
    out = s.select(*cols)
    mid = (F.col("bid1_price") + F.col("ask1_price")) * 0.5
    return out.withColumn("spread_bps", (F.col("ask1_price") - F.col("bid1_price")) / mid * 10000)


def book_for_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots keyed like the prediction table: two per brand and trading day."""
    b = bars_day(spark, sf_dir)
    k = F.col("volume")
    snap = F.explode(F.sequence(F.lit(0), F.lit(1)))
    s = b.select("symbol", "ts", "open", "close", "volume", snap.alias("n")).select(
        "symbol", (F.date_trunc("day", "ts") + F.make_interval(mins=F.lit(240) + F.col("n") * 60))
        .alias("ts"), F.when(F.col("n") == 0, F.col("open")).otherwise(F.col("close")).alias("px"),
        (k + F.col("n") * 11).alias("k"))
    cols = [F.col("symbol"), F.col("ts"), F.col("px").alias("ltp")]
    step = (F.col("k") % 3 + 1) / F.lit(20.0)
    for i in range(1, 6):
        for side, sign, qty in (("bid", -1.0, (F.col("k") * i) % 40 + 5),
                                ("ask", 1.0, (F.col("k") + 7 * i) % 40 + 5)):
            cols.append((F.col("px") + step * (sign * i)).alias(f"{side}{i}_price"))
            cols.append(qty.alias(f"{side}{i}_qty"))
    return s.select(*cols)


def production_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with some days missing (the table a refresh repairs)."""
    return bars_day(spark, sf_dir).filter(F.dayofyear("ts") % 31 != 0)


def staged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh vendor pull: rescaled history for some symbols, some drifted closes."""
    n = F.substring("symbol", 7, 10).cast("int")
    factor = F.when((n % 5 == 1) & (F.col("ts") < F.lit("1998-01-01").cast("timestamp")), 2.0).otherwise(1.0)
    drift = F.when(F.dayofyear("ts") % 17 == 0, 1.02).otherwise(1.0)
    return (bars_day(spark, sf_dir).filter(F.dayofyear("ts") % 29 != 0)
            .withColumns({"open": F.col("open") * factor, "high": F.col("high") * factor,
                          "low": F.col("low") * factor, "close": F.col("close") * factor * drift}))
