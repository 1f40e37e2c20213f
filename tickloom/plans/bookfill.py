"""Executability from five-level book snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import shapes
from tickloom.operators import ranking
from tickloom.plans import strategy

LEVELS = 5
UNSOLD_FACTOR = 0.995  # fixed value: residual sold half a percent under the last bid


def levels(side: str) -> Column:
    """The side's levels as an array of (p, q)."""
    return F.array(*[F.struct(F.col(f"{side}{i}_price").cast("double").alias("p"), F.col(f"{side}{i}_qty").cast("double").alias("q"))
                     for i in range(1, LEVELS + 1)])


def _acc(**values) -> Column:
    return F.struct(*[v.alias(n) for n, v in values.items()])


def buy_value(book: Column, target: Column | float) -> Column:
    """Buy up to ``target`` of notional: struct(qty, vwap, filled)."""
    goal = F.lit(float(target)) if not isinstance(target, Column) else target
    zero = F.lit(0.0)

    def step(a, x):
        live = ~a["done"] & (x["p"] > 0) & (x["q"] > 0)
        value = x["p"] * x["q"]
        last = live & (a["spent"] + value >= goal)
        qty = F.when(last, (goal - a["spent"]) / x["p"]).when(live, x["q"]).otherwise(zero)
        use = F.coalesce(qty, zero)
        return _acc(spent=a["spent"] + F.when(F.coalesce(live, F.lit(False)), use * x["p"]).otherwise(zero), qty=a["qty"] + use,
                    cost=a["cost"] + F.when(use > 0, use * x["p"]).otherwise(zero), done=a["done"] | F.coalesce(last, F.lit(False)))

    return F.aggregate(book, _acc(spent=zero, qty=zero, cost=zero, done=F.lit(False)), step,
                       lambda a: _acc(qty=a["qty"], vwap=F.try_divide(a["cost"], a["qty"]), filled=a["done"]))


def sell_quantity(book: Column, quantity: Column) -> Column:
    """Sell up to ``quantity``: struct(qty, vwap, filled, last)."""
    zero = F.lit(0.0)

    def step(a, x):
        live = F.coalesce((a["left"] > 0) & (x["p"] > 0) & (x["q"] > 0), F.lit(False))
        take = F.when(live, F.least(x["q"], a["left"])).otherwise(zero)
        return _acc(left=a["left"] - take, qty=a["qty"] + take, cash=a["cash"] + F.when(live, take * x["p"]).otherwise(zero),
                    last=F.when(live, x["p"]).otherwise(a["last"]))

    return F.aggregate(book, _acc(left=quantity, qty=zero, cash=zero, last=F.lit(None).cast("double")), step,
                       lambda a: _acc(qty=a["qty"], vwap=F.try_divide(a["cash"], a["qty"]),
                                      filled=(a["left"] <= 0) & (a["qty"] > 0), last=a["last"]))


def first_snapshots(book: DataFrame, not_before: str | None = None) -> DataFrame:
    """First snapshot per symbol and UTC date (optionally from a clock time on)."""
    rows = book.withColumn("date", F.to_date("ts"))
    if not_before:
        rows = rows.filter(F.date_format("ts", "HH:mm") >= not_before)
    return ranking.first_per(rows, ["symbol", "date"], "ts").withColumnRenamed("symbol", "stock")


def fill_audit(picks: DataFrame, book: DataFrame, target: float) -> DataFrame:
    """Per pick: top ask, fill price, quantity, slippage and what stood in the way."""
    have = book.select(F.col("symbol").alias("stock")).distinct().withColumn("_known", F.lit(True))
    snap = first_snapshots(book).select("stock", "date", F.col("ask1_price").cast("double").alias("top_ask"),
                                        buy_value(levels("ask"), target).alias("f"))
    rows = picks.select("date", "stock").join(have, "stock", "left").join(snap, ["date", "stock"], "left")
    ok = F.coalesce(F.col("f.filled") & (F.col("top_ask") > 0), F.lit(False))
    status = (F.when(F.col("_known").isNull(), "no_book").when(F.col("f").isNull(), "no_snapshot").when(ok, "filled").otherwise("unfillable"))
    return rows.select("date", "stock", "top_ask", status.alias("status"), F.when(ok, F.col("f.vwap")).alias("vwap"),
                       F.when(ok, F.col("f.qty")).alias("qty"),
                       F.when(ok, (F.col("f.vwap") / F.col("top_ask") - 1) * 10000.0).alias("slip_bps"))


def fill_summary(audit: DataFrame, budget_bps: float = 20.0) -> DataFrame:
    q = ranking.pool_quantiles(audit, [], "slip_bps", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}).withColumn("_j", F.lit(0))
    st = F.col("status")
    a = audit.agg(F.count(F.lit(1)).alias("n_picks"), *[F.count_if(st == v).alias(f"n_{v}") for v in ("no_book", "no_snapshot", "filled", "unfillable")],
                  F.count_if(F.col("slip_bps") <= budget_bps).alias("n_in_budget"), F.avg("slip_bps").alias("mean"),
                  F.max("slip_bps").alias("max")).withColumn("_j", F.lit(0))
    return a.join(q, "_j", "left").drop("_j")


def slippage_by_stock(audit: DataFrame, top: int = 15) -> DataFrame:
    """Stocks with the highest mean slippage (a report)."""
    return audit.filter("slip_bps IS NOT NULL").groupBy("stock").agg(
        F.avg("slip_bps").alias("avg_slip"), F.count("slip_bps").alias("n"), F.max("slip_bps").alias("max_slip")).orderBy(
        F.col("avg_slip").desc(), "stock").limit(top)


def unfillable_stocks(audit: DataFrame, top: int = 10) -> DataFrame:
    return audit.filter("status = 'unfillable'").groupBy("stock").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "stock").limit(top)


def executed_picks(preds: DataFrame, book: DataFrame, *, hold: int, k: int, position: float) -> DataFrame:
    """Per rebalance pick: buy and sell walks at the first snapshots of entry and exit dates.

    Only rebalances whose both dates lie in the book's date range are kept.
    """
    dates = strategy.dated(preds)
    snaps = first_snapshots(book)
    span = book.agg(F.to_date(F.min("ts")).alias("_lo"), F.to_date(F.max("ts")).alias("_hi")).withColumn("_j", F.lit(0))
    ideal = preds.join(dates, "date").withColumn("ideal_lr", F.sum("real_lr").over(
        Window.partitionBy("stock").orderBy("date_no").rangeBetween(0, hold - 1)))
    picks = strategy.rebalances(ideal.drop("date_no"), hold, k)
    exits = dates.select(F.col("date").alias("exit_date"), F.col("date_no").alias("exit_no"))
    picks = picks.join(exits, "exit_no").withColumn("_j", F.lit(0)).join(span, "_j").filter(
        (F.col("date") >= F.col("_lo")) & (F.col("exit_date") <= F.col("_hi")))
    buy = snaps.select("stock", "date", buy_value(levels("ask"), position).alias("b"))
    sell = snaps.select("stock", F.col("date").alias("exit_date"), levels("bid").alias("_bids"))
    rows = picks.join(buy, ["stock", "date"], "left").join(sell, ["stock", "exit_date"], "left")
    return rows.withColumn("s", F.when(F.col("b.qty") > 0, sell_quantity(F.col("_bids"), F.col("b.qty")))).select(
        "offset", F.col("date").alias("entry"), F.col("exit_date").alias("exit"), "stock", "ideal_lr", "b", "s",
        F.when(F.col("b.filled"), sell_quantity(F.col("_bids"), position / F.col("b.vwap"))).alias("full"))


def executed_full(picks: DataFrame, cost_bps: float = 30.0) -> DataFrame:
    """Per rebalance: only fully bought and fully sold picks count, equal weight, against ideal."""
    ok = F.coalesce(F.col("b.filled") & F.col("full.filled"), F.lit(False))
    lr = F.when(ok, F.log(F.col("full.vwap") / F.col("b.vwap")))
    out = picks.groupBy("offset", "entry", "exit").agg(
        F.count_if(ok).alias("n_filled"), F.count_if(~ok).alias("n_dropped"), shapes.log_mean_exp(lr).alias("ob_port_lr"),
        shapes.log_mean_exp(F.when(ok, F.col("ideal_lr"))).alias("ideal_lr")).filter("n_filled > 0")
    return _against_ideal(out, cost_bps)


def executed_partial(picks: DataFrame, *, k: int, position: float, cost_bps: float = 30.0) -> DataFrame:
    """Per rebalance: whatever depth allowed, weighted by money deployed; the unsold rest is marked down."""
    bought = (F.col("b.qty") > 0) & (F.col("s.qty") > 0)
    deployed = F.col("b.qty") * F.col("b.vwap")
    rest = F.col("b.qty") - F.col("s.qty")
    terminal = F.col("s.qty") * F.col("s.vwap") + F.when(rest > 1e-9, rest * F.col("s.last") * UNSOLD_FACTOR).otherwise(0.0)
    live = picks.filter(F.coalesce(bought, F.lit(False))).withColumns({"deployed": deployed, "terminal": terminal})
    out = live.groupBy("offset", "entry", "exit").agg(
        F.count(F.lit(1)).alias("n_picks"), F.sum("deployed").alias("total_deployed"), F.sum("terminal").alias("total_terminal"),
        shapes.log_mean_exp(F.col("ideal_lr")).alias("ideal_lr"))
    out = out.withColumns({"fill_pct": F.col("total_deployed") / (k * position) * 100,
                           "ob_port_lr": F.log(F.col("total_terminal") / F.col("total_deployed"))})
    return _against_ideal(out, cost_bps)


def _against_ideal(df: DataFrame, cost_bps: float) -> DataFrame:
    return df.withColumns({"ideal_net": F.col("ideal_lr") - cost_bps / 10000.0,
                           "ob_vs_ideal_bps": (F.col("ob_port_lr") - F.col("ideal_lr")) * 10000.0})


def pick_fill_stats(picks: DataFrame, position: float) -> DataFrame:
    """Fill percent of each pick: mean, quartiles, fully filled count."""
    rows = picks.filter((F.col("b.qty") > 0) & (F.col("s.qty") > 0)).select(
        (F.col("b.qty") * F.col("b.vwap") / position * 100).alias("fill_pct"))
    q = ranking.pool_quantiles(rows, [], "fill_pct", {"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumn("_j", F.lit(0))
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("fill_pct").alias("mean"),
                 F.count_if(F.col("fill_pct") >= 99).alias("n_full")).withColumn("_j", F.lit(0))
    return a.join(q, "_j", "left").drop("_j")


def annual_ratio(rebalances: DataFrame, hold: int) -> DataFrame:
    """Annualised ratio of executed and ideal rebalance returns."""
    def one(c):
        s = F.stddev_samp(c)
        return F.when((F.count(c) >= 2) & (s != 0), F.avg(c) / s * F.sqrt(F.lit(250.0 / hold))).otherwise(0.0)

    return rebalances.agg(F.count(F.lit(1)).alias("n"), one("ob_port_lr").alias("ob_sharpe"), one("ideal_net").alias("ideal_sharpe"))
