"""Table audits: coverage, freshness, staleness, jumps, cadence, clock alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import clock
from tickloom.operators import ranking, tradingdays
from tickloom.operators.series import over_series


def last_bar(bars: DataFrame, scales: Sequence[str] = ()) -> DataFrame:
    src = bars.filter(F.col("scale").isin(*scales)) if scales else bars
    return src.groupBy("symbol", "scale").agg(F.max("ts").alias("last_ts"))


def freshness(bars: DataFrame, days: DataFrame, *, today: Column, min_lead: int = 30, max_stale: int = 5,
              scales: Sequence[str] = clock.SCALES) -> DataFrame:
    """Calendar lead and trading days stale per scale, with OK / STALE / FAIL."""
    cal = days.agg(F.max("trade_date").alias("last_day")).select(
        F.lit("calendar").alias("check"), F.datediff("last_day", today).cast("long").alias("got"), F.lit(min_lead).cast("long").alias("limit"),
        F.when(F.col("last_day").isNull(), "FAIL").when(F.datediff("last_day", today) >= min_lead, "OK").otherwise("STALE").alias("status"))
    want = bars.sparkSession.createDataFrame([(s,) for s in scales], "scale string")
    last = want.join(bars.groupBy("scale").agg(F.max("ts").alias("_ts")), "scale", "left").withColumns({
        "_from": F.date_add(F.to_date("_ts"), 1), "_to": today})
    n = tradingdays.count_between(last, days, "_from", "_to", "got")
    per = n.select(F.concat(F.lit("bars_"), "scale").alias("check"), F.when(F.col("_ts").isNotNull(), F.col("got")).alias("got"),
                   F.lit(max_stale).cast("long").alias("limit"),
                   F.when(F.col("_ts").isNull() | F.col("got").isNull(), "FAIL").when(F.col("got") <= max_stale, "OK").otherwise("STALE").alias("status"))
    return cal.unionByName(per)


def profile(bars: DataFrame) -> DataFrame:
    """Rows per scale and year with time range; distinct symbols are exact per cell."""
    return bars.groupBy("scale", F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def approximate_profile(bars: DataFrame) -> DataFrame:
    """One pass over the whole table with a sketch for distinct symbols."""
    return bars.agg(F.approx_count_distinct("symbol").alias("approx_symbols"), F.count(F.lit(1)).alias("n_rows"),
                    F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def staleness(bars: DataFrame, limits: Sequence[int] = (30, 90, 180, 365)) -> DataFrame:
    """Symbols whose last bar is older than each limit, against the newest bar of all."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_t"))
    top = last.agg(F.max("_t").alias("_top")).withColumn("_j", F.lit(0))
    age = F.datediff(F.col("_top"), F.col("_t"))
    return last.withColumn("_j", F.lit(0)).join(top, "_j").agg(
        *[F.count_if(age > n).alias(f"stale_{n}d") for n in limits], F.count(F.lit(1)).alias("total_symbols"))


def jump_probe(bars: DataFrame) -> DataFrame:
    """Daily close moves: counts above 30 % and 50 %, and extreme percentiles."""
    day = bars.filter((F.col("scale") == "day") & (F.col("close") > 0))
    rows = over_series(day, lambda w: {"_r": F.abs(F.try_divide("close", F.lag("close", 1).over(w)) - 1)}, lookback=1).select("_r").filter("_r IS NOT NULL")
    q = ranking.pool_quantiles(rows, [], "_r", {"abs_ret_p99_5": 0.995, "abs_ret_p99_9": 0.999}).withColumn("_j", F.lit(0))
    a = rows.agg(F.count_if(F.col("_r") > 0.30).alias("n_over_30pct"), F.count_if(F.col("_r") > 0.50).alias("n_over_50pct"),
                 F.count(F.lit(1)).alias("n_returns")).withColumn("_j", F.lit(0))
    return a.join(q, "_j", "left").drop("_j")


def _with_book() -> Column:
    return F.col("bid1_price").isNotNull() & F.col("ask1_price").isNotNull()


def book_census(book: DataFrame) -> DataFrame:
    """Distinct symbol-days, those with a filled book, and fill counts (two-step distinct)."""
    per = book.groupBy("symbol", clock.exchange_date(F.col("ts")).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_with_book()).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("symbol_days"), F.count_if(F.col("k") > 0).alias("symbol_days_with_book"),
                   F.sum("k").alias("n_with_book"), (F.sum("n") - F.sum("k")).alias("n_without_book"), F.sum("n").alias("n_total"))


def book_daily(book: DataFrame) -> DataFrame:
    per = book.groupBy(clock.exchange_date(F.col("ts")).alias("date"), "symbol").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("date").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("n_rows"))


def book_levels(book: DataFrame, levels: int = 5) -> DataFrame:
    """Rows per level and side of the long layout, from the wide one."""
    one = book.agg(*[F.count(f"{s}{i}_price").alias(f"{s}{i}") for i in range(1, levels + 1) for s in ("bid", "ask")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("side"), F.col(f"{s}{i}").alias("n_rows"))
                                          for i in range(1, levels + 1) for s in ("bid", "ask")])).alias("x")).select("x.*")


def cadence(book: DataFrame) -> DataFrame:
    """Seconds between snapshots of a symbol-day: 5th, 50th and 95th percentile."""
    w = Window.partitionBy("symbol", clock.exchange_date(F.col("ts"))).orderBy("ts")
    rows = book.select(((F.unix_micros("ts") - F.unix_micros(F.lag("ts", 1).over(w))) / 1e6).alias("dt")).filter("dt IS NOT NULL")
    return ranking.pool_quantiles(rows, [], "dt", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def coverage(bars: DataFrame) -> DataFrame:
    """Per scale: series, rows, time range; and whether every known symbol is present."""
    per = bars.groupBy("scale", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    n_all = per.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_n")).withColumn("_j", F.lit(0))
    out = per.groupBy("scale").agg(F.count(F.lit(1)).alias("n_series"), F.sum("n").alias("n_rows"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))
    return out.withColumn("_j", F.lit(0)).join(n_all, "_j").withColumn("complete", F.col("n_series") == F.col("_n")).drop("_j", "_n")


def alignment(bars: DataFrame) -> DataFrame:
    """Rows off the expected clock per scale: daily bars at 10:00 UTC, intraday bars on the session grid."""
    since = F.hour("ts") * 60 + F.minute("ts") - (3 * 60 + 45)
    step = F.when(F.col("scale") == "5m", 5).when(F.col("scale") == "15m", 15).otherwise(60)
    off = F.when(F.col("scale") == "day", F.date_format("ts", "HH:mm:ss") != "10:00:00").otherwise(
        (since % step != 0) | ~clock.in_session(F.col("ts")) | (F.second("ts") != 0))
    return bars.groupBy("scale").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(off).alias("n_off_clock"))


def sectors(master: DataFrame) -> DataFrame:
    return master.groupBy(F.coalesce("sector", F.lit("_no_sector")).alias("sector")).agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count("isin").alias("n_with_isin"))


def traded_value(bars: DataFrame, days: int = 10, top: int = 10) -> DataFrame:
    """Median daily traded value per symbol, largest and smallest ``top``, with staleness in days."""
    day = bars.filter(F.col("scale") == "day").withColumn("_v", F.col("close") * F.col("volume"))
    med = ranking.pool_quantiles(day, ["symbol"], "_v", {"median_value": 0.5})
    last = day.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    newest = last.agg(F.max("last_ts").alias("_m")).withColumn("_j", F.lit(0))
    rows = med.join(last, "symbol").withColumn("_j", F.lit(0)).join(newest, "_j").withColumn(
        "stale", F.datediff(F.col("_m"), F.col("last_ts")) > days).drop("_j", "_m")
    hi = rows.orderBy(F.col("median_value").desc(), "symbol").limit(top).withColumn("end", F.lit("top"))
    lo = rows.orderBy("median_value", "symbol").limit(top).withColumn("end", F.lit("bottom"))
    return hi.unionByName(lo)


def report(bars: DataFrame, book: DataFrame) -> DataFrame:
    """Bar and book audits as named JSON rows."""
    parts = [("profile", approximate_profile(bars)), ("staleness", staleness(bars)), ("jumps", jump_probe(bars)),
             ("coverage", coverage(bars)), ("clock", alignment(bars)), ("book_census", book_census(book)), ("book_cadence", cadence(book))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))
        out = row if out is None else out.unionByName(row)
    return out
