"""Trading-calendar navigation as joins on a dense day index.

A calendar holds one row per trading day, so at most a few hundred rows per year:
its windows and the civil-day table are small whatever the market data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def indexed(days: DataFrame) -> DataFrame:
    """``trade_date, idx`` with idx dense from 0."""
    return days.select("trade_date").distinct().withColumn(
        "idx", F.row_number().over(Window.orderBy("trade_date")) - 1)


def civil_days(days: DataFrame, margin: int = 40) -> DataFrame:
    """``day``: every civil day of the calendar and around it."""
    span = days.agg(F.date_sub(F.min("trade_date"), margin).alias("lo"),
                   F.date_add(F.max("trade_date"), margin).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))


def shift_table(days: DataFrame, n: int, *, as_of: Column | None = None, dates: DataFrame | None = None) -> DataFrame:
    """``day -> target``: the trading day ``n`` steps away.

    From a closed day the snap to the neighbouring trading day is the first step;
    ``n = 0`` keeps trading days only.  Targets after ``as_of`` are absent.  Given ``dates`` (a column ``day``) exactly
    these are shifted, however far they lie from the calendar; otherwise every civil day around it.
    """
    at, idx = days_up_to(civil_days(days) if dates is None else dates, days), indexed(days)
    if n == 0:
        at = at.filter(F.col("upto") > F.col("before"))
    goal = F.col("upto") + (n - 1) if n > 0 else F.col("before") + n
    to = idx.select(F.col("idx").alias("_goal"), F.col("trade_date").alias("target"))
    out = at.withColumn("_goal", goal).join(to, "_goal").select("day", "target")
    return out if as_of is None or n <= 0 else out.filter(F.col("target") <= as_of)


def between(days: DataFrame, start: Column, end: Column, *, as_of: Column | None = None) -> DataFrame:
    """Trading days in the closed range, capped by ``as_of``."""
    hi = F.least(end, as_of) if as_of is not None else end
    return days.select("trade_date").filter(F.col("trade_date").between(start, hi))


def navigation(days: DataFrame, *, dates: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Per civil day (or per day of ``dates``): membership, next and previous trading day, none of them after ``as_of``."""
    known = days if as_of is None else days.filter(F.col("trade_date") <= as_of)
    idx = indexed(known)
    at = days_up_to(civil_days(days) if dates is None else dates, known)
    to = lambda c, n: idx.select(F.col("idx").alias(c), F.col("trade_date").alias(n))
    return (at.withColumns({"_next": F.col("upto"), "_prev": F.col("before") - 1})
            .join(to("_next", "next_day"), "_next", "left").join(to("_prev", "prev_day"), "_prev", "left")
            .select("day", (F.col("upto") > F.col("before")).alias("is_trading"), "next_day", "prev_day"))


def days_up_to(dates: DataFrame, days: DataFrame) -> DataFrame:
    """``day, upto, before``: trading days on or before each date, and before it, whatever the
    date's distance from the calendar.  The window runs over distinct dates, which civil days bound."""
    marks = dates.select("day", F.lit(0).alias("_t")).unionByName(
        days.select(F.col("trade_date").alias("day"), F.lit(1).alias("_t"))).filter(F.col("day").isNotNull())
    per = marks.groupBy("day").agg(F.max("_t").alias("_t"), (F.min("_t") == 0).alias("_asked"))
    upto = F.sum("_t").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("day", upto.alias("upto"), (upto - F.col("_t")).alias("before"), "_asked").filter("_asked").drop("_asked")


def count_between(pairs: DataFrame, days: DataFrame, start: str, end: str, name: str, *, as_of: Column | None = None) -> DataFrame:
    """Number of trading days in ``[start, end]`` for each row, not beyond ``as_of``; dates outside
    the calendar count what the calendar has inside the range, a null date gives null."""
    known = days.select("trade_date") if as_of is None else days.select("trade_date").filter(F.col("trade_date") <= as_of)
    dates = pairs.select(F.col(start).alias("day")).unionByName(pairs.select(F.col(end).alias("day"))).distinct()
    at = days_up_to(dates, known)
    a = at.select(F.col("day").alias(start), F.col("before").alias("_lo"))
    b = at.select(F.col("day").alias(end), F.col("upto").alias("_hi"))
    return (pairs.join(a, start, "left").join(b, end, "left")
            .withColumn(name, F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0)))
                        .cast("long")).drop("_lo", "_hi"))


def holidays(table: DataFrame, year: int | None = None) -> DataFrame:
    return table if year is None else table.filter(F.col("source_year") == year)


# ------------------------------------------------------------------------ folds

FOLD_COLUMNS = ("name", "train_start", "train_end", "val_start", "val_end", "test_start",
                "test_end", "embargo_days")


def walk_forward(days: DataFrame, *, first_test_end: Column, last_test_end: Column | None = None,
                 as_of: Column | None = None, history_start: Column | None = None,
                 embargo: int = 5, val: int = 20, test: int = 20, roll: int = 20) -> DataFrame:
    """Expanding-train folds by index arithmetic: one row per test end, ``roll`` days apart.

    Between train, validation and test lie ``embargo`` full trading days.  Folds
    without room for a train window are left out.
    """
    whole = Window.partitionBy(F.lit(0))
    bounds = [c for c in (last_test_end, as_of) if c is not None]
    final = F.max("trade_date").over(whole)
    start = F.lit(None).cast("date") if history_start is None else history_start
    ends = indexed(days).withColumns({
        "_last": F.least(*bounds, final) if bounds else final,
        "_first": F.min(F.when(F.col("trade_date") >= first_test_end, F.col("idx"))).over(whole),
        "_t0": F.min(F.when(start.isNull() | (F.col("trade_date") >= start), F.col("idx"))).over(whole)})
    ends = ends.filter((F.col("idx") >= F.col("_first")) & (F.col("trade_date") <= F.col("_last"))
                       & ((F.col("idx") - F.col("_first")) % roll == 0))
    e = F.col("idx")
    test_start = e - (test - 1)
    val_end = test_start - (embargo + 1)
    val_start = val_end - (val - 1)
    train_end = val_start - (embargo + 1)
    folds = ends.select(F.col("_t0").alias("train_start"), train_end.alias("train_end"),
                        val_start.alias("val_start"), val_end.alias("val_end"),
                        test_start.alias("test_start"), e.alias("test_end")).filter(
        (F.col("train_end") >= F.col("train_start")) & (F.col("train_end") >= 0))
    edges = ("train_start", "train_end", "val_start", "val_end", "test_start", "test_end")
    long = folds.select(F.col("test_end").alias("_fold"), F.explode(F.array(*[
        F.struct(F.lit(x).alias("edge"), F.col(x).alias("idx")) for x in edges])).alias("x"))
    dated = long.select("_fold", "x.edge", "x.idx").join(indexed(days), "idx")
    out = dated.groupBy("_fold").agg(*[
        F.max(F.when(F.col("edge") == x, F.col("trade_date"))).alias(x) for x in edges])
    return out.select(F.concat(F.lit("fold_"), F.col("test_end").cast("string")).alias("name"), *edges,
                      F.lit(embargo).alias("embargo_days"))


def by_interval(rows: DataFrame, intervals: DataFrame, date_col: str) -> DataFrame:
    """Rows with every interval (columns ``lo``, ``hi``, both inside it, and others) that holds their date.

    Overlapping intervals are cut into disjoint segments; a civil day has one segment, a segment the intervals that cover
    it. Both tables are as small as the calendar, and rows meet them by two equi-joins.
    """
    others = [c for c in intervals.columns if c not in ("lo", "hi")]
    whole = intervals.filter(F.col("lo") <= F.col("hi")).withColumn("_past", F.date_add("hi", 1))
    edges = (whole.select(F.col("lo").alias("_start")).unionByName(whole.select(F.col("_past").alias("_start"))).distinct()
             .select("_start", F.row_number().over(Window.orderBy("_start")).alias("_seg"),
                     F.lead("_start").over(Window.orderBy("_start")).alias("_next")))
    day = edges.filter(F.col("_next").isNotNull()).select(
        "_seg", F.explode(F.sequence("_start", F.date_sub("_next", 1))).alias("_day"))
    number = lambda of, name: edges.select(F.col("_start").alias(of), F.col("_seg").alias(name))
    cover = (whole.join(number("lo", "_a"), "lo").join(number("_past", "_b"), "_past")
             .select(*others, F.explode(F.sequence("_a", F.col("_b") - 1)).alias("_seg")))
    return rows.join(day, F.col(date_col) == F.col("_day")).join(cover, "_seg").drop("_seg", "_day")


def assign_folds(rows: DataFrame, folds: DataFrame, date_col: str) -> DataFrame:
    """Rows with the part (train/val/test) they play in every fold that uses them."""
    parts = folds.select("name", F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("lo"), F.col(f"{p}_end").alias("hi"))
        for p in ("train", "val", "test")])).alias("p")).select("name", "p.part", "p.lo", "p.hi")
    return by_interval(rows, parts, date_col)
