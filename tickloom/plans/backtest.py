"""Independent-trade backtests, exits along the bar path, tearsheets."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import clock, shapes
from tickloom.operators import ranking, tradingdays
from tickloom.operators.asof import asof, asof_many
from tickloom.operators.series import over_series, running_total


@dataclasses.dataclass(frozen=True)
class Rules:
    """Entry, sizing and cost settings."""

    side: str = "both"
    long_top_k: int = 5
    short_top_k: int = 5
    long_threshold: float = 0.0
    short_threshold: float = 0.0
    long_gate: float = 0.0
    short_gate: float = 0.0
    min_valid: int = 50
    alpha: float = 0.0
    short_veto: float = 1.0
    capital: float = 100_000.0
    size_pct: float = 0.02
    size_mode: str = "flat"
    size_min: float = 0.02
    size_max: float = 0.20
    fixed_per_leg: float = 5.0
    statutory: float = 0.0005
    slippage: float = 0.0005
    round_trip_cost: float = 0.0


def ensemble_rank(first: str, second: str, weight: float, by: Sequence[str] = ("t",), tie: str = "symbol") -> Column:
    """Mix of two scores by their unit ranks inside the cross-section."""
    return ranking.unit_rank(first, by, tie) * (1.0 - weight) + ranking.unit_rank(second, by, tie) * weight


def _side(rows: DataFrame, score: Column, keep: Column, k: int, threshold: float, gate: float,
          direction: int, rules: Rules) -> DataFrame:
    w = Window.partitionBy("t")
    el = rows.filter(keep).withColumn("score", score)
    n = F.count(F.lit(1)).over(w)
    cols = {"_pos": F.row_number().over(w.orderBy(F.col("score").desc(), F.col("symbol"))), "_n": n,
            "_below": ranking.share_below("score", ["t"])}
    if gate > 0:
        cols["_cut"] = F.when(n > 1, F.percentile("score", F.lit(1.0 - gate)).over(w))
    el = el.withColumns(cols).filter((F.col("_pos") <= k) & (F.col("score") >= threshold))
    if gate > 0:
        el = el.filter(F.col("_cut").isNull() | (F.col("score") >= F.col("_cut")))
    flat = F.lit(rules.size_pct)
    pct = flat if rules.size_mode == "flat" else F.when(
        F.col("_n") > 1, rules.size_min + (rules.size_max - rules.size_min) * F.col("_below")).otherwise(flat)
    return el.select("t", "symbol", F.lit(direction).alias("direction"), "score", "ret",
                     (pct * rules.capital).alias("notional"))


def entries(scored: DataFrame, rules: Rules) -> DataFrame:
    """``t, symbol, direction, score, ret, notional`` of every entry taken.

    ``scored`` holds ``t, symbol, long_p, short_p, valid, ret``; cross-sections with
    fewer than ``min_valid`` valid rows are passed over.
    """
    n_valid = F.count_if(F.col("valid")).over(Window.partitionBy("t"))
    rows = scored.withColumn("_v", n_valid).filter((F.col("_v") >= rules.min_valid) & F.col("valid")).drop("_v")
    sides = []
    if rules.side in ("both", "long_only"):
        sides.append(_side(rows, F.col("long_p") - rules.alpha * F.col("short_p"), F.col("short_p") <= rules.short_veto,
                           rules.long_top_k, rules.long_threshold, rules.long_gate, 1, rules))
    if rules.side in ("both", "short_only"):
        sides.append(_side(rows, F.col("short_p"), F.lit(True), rules.short_top_k, rules.short_threshold,
                           rules.short_gate, -1, rules))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def book_trades(taken: DataFrame, raw: Column, rules: Rules) -> DataFrame:
    """Trades with costs from entries and their raw (direction-signed) return."""
    cost = shapes.trade_cost(F.col("notional"), rules.fixed_per_leg, rules.statutory + rules.slippage, rules.round_trip_cost)
    net = F.col("raw_return") - F.col("cost")
    return (taken.withColumn("raw_return", raw).withColumn("cost", cost).withColumn("net_return", net)
            .withColumn("pnl", F.col("net_return") * F.col("notional"))
            .select("t", "symbol", "direction", "score", "raw_return", "cost", "net_return", "notional", "pnl"))


def backtest(scored: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Trades realised at the label horizon."""
    return book_trades(entries(scored, rules), F.col("ret") * F.col("direction"), rules)


def equity_curve(trades: DataFrame, *, time: str = "t", value: str = "pnl",
                 order: Sequence[Column] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Running sum, running peak and drawdown in trade order.

    Split by day: each day starts from the total and the peak of earlier days, which
    are windows over one row per day.
    """
    order = order or [F.col(time), F.col("direction").desc(), F.col("score").desc(), F.col("symbol")]
    src = trades if keys else trades.withColumn("_all", F.lit(0))
    by = list(keys) or ["_all"]
    curve = running_total(src, F.col(value), "cum", keys=by, order=order, bucket=F.to_date(time))
    curve = curve.withColumn("_d", F.to_date(time))
    before = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    tops = curve.groupBy(*by, "_d").agg(F.max("cum").alias("_top")).withColumn("_prior", F.max("_top").over(before))
    inside = Window.partitionBy(*by, "_d").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = curve.withColumn("_run", F.max("cum").over(inside)).join(tops.drop("_top"), [*by, "_d"])
    out = out.withColumn("peak", F.greatest("_run", "_prior")).withColumn("drawdown", F.col("peak") - F.col("cum"))
    return out.drop("_d", "_run", "_prior", "_all")


def tearsheet(trades: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """One row: counts, win rate, winner and loser means, daily ratio, worst drawdown."""
    win = F.col("pnl") > 0
    base = trades.agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("direction") == 1).alias("n_long"),
        F.count_if(F.col("direction") == -1).alias("n_short"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        F.count_if(win).alias("_w"), (F.avg(F.when(win, F.col("pnl"))) / capital).alias("_aw"),
        (F.avg(F.when(~win, F.col("pnl"))) / capital).alias("_al")).withColumn("_j", F.lit(0))
    daily = trades.groupBy(F.to_date("t").alias("d")).agg(F.sum("pnl").alias("p")).agg(
        F.avg("p").alias("_dm"), F.stddev_pop("p").alias("_ds")).withColumn("_j", F.lit(0))
    worst = equity_curve(trades).agg(F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("_dd")).withColumn("_j", F.lit(0))
    aw, al = F.coalesce("_aw", F.lit(0.0)), F.coalesce("_al", F.lit(0.0))
    return base.join(daily, "_j").join(worst, "_j").select(
        "n_trades", "n_long", "n_short", "total_pnl", (F.col("total_pnl") / capital).alias("total_return_pct"),
        F.coalesce(F.try_divide("_w", "n_trades"), F.lit(0.0)).alias("win_rate"), aw.alias("avg_winner"), al.alias("avg_loser"),
        F.when(al != 0, F.abs(aw / al)).otherwise(F.lit(float("inf"))).alias("win_loss_ratio"),
        F.when(F.col("_ds") > 0, F.col("_dm") / F.col("_ds")).otherwise(0.0).alias("sharpe_daily"),
        (F.col("_dd") / capital).alias("max_drawdown_pct"))


# ----------------------------------------------------------------- exits on a path

def path_exits(taken: DataFrame, bars: DataFrame, *, target: float, stop: float, minutes: int,
               rule: str = "stop_first", mode: str = "triple_barrier", scores: DataFrame | None = None,
               rerank_k: int = 10, floor: float = 0.0, curve: Sequence[tuple[float, int]] = ()) -> DataFrame:
    """Entries with ``raw_return, outcome, minutes_held`` from the first event on their bars.

    The entry price is the close of the first bar opening at or after ``t``; later
    bars of the same day up to ``t + minutes`` are searched.  Without an event the
    last close counts (the bar after entry when none qualifies).

    ``mode``: ``triple_barrier`` (target and stop), ``score_rerank``, ``score_floor``
    (target plus score exits at cross-section times), ``hybrid_rerank``,
    ``hybrid_floor`` (also the stop).  A ``curve`` of (return, max rank) replaces
    target and score checks with a rank limit at every bar.  ``scores`` holds
    ``t, symbol, score`` of the valid cross-sections.

    The path join is on (symbol, day): at most one session of bars per entry.
    """
    five = bars.filter(F.col("scale") == "5m").select("symbol", "ts", "high", "low", "close")
    five = over_series(five, lambda w: {"_nts": F.lead("ts", 1).over(w), "_nc": F.lead("close", 1).over(w)}, lookahead=1)
    first = asof_many(taken, {"e": (five, "ts", {"_ets": F.col("ts"), "_px": F.col("close"),
                                                 "_nts": F.col("_nts"), "_nc": F.col("_nc")})},
                      left_time="t", strict=False, forward=True)
    first = first.filter((F.col("_px") > 0) & F.col("_nts").isNotNull())
    end = F.col("t") + clock.minutes(minutes)
    path = five.select("symbol", F.to_date("ts").alias("_day"), F.col("ts").alias("_bts"), F.col("high").alias("_h"),
                       F.col("low").alias("_l"), F.col("close").alias("_c"))
    joined = first.withColumn("_day", F.to_date("t")).join(path, ["symbol", "_day"], "left")
    live = (F.col("_bts") > F.col("_ets")) & (F.col("_bts") <= end)
    up = F.col("direction") == 1
    px, h, lo, c = F.col("_px"), F.col("_h"), F.col("_l"), F.col("_c")
    has_target = mode == "triple_barrier" or not curve
    has_stop = mode in ("triple_barrier", "hybrid_rerank", "hybrid_floor")
    hit_t = F.lit(has_target) & F.when(up, h >= px * (1 + target)).otherwise(lo <= px * (1 - target))
    hit_s = F.lit(has_stop) & F.when(up, lo <= px * (1 - stop)).otherwise(h >= px * (1 + stop))
    drift = F.col("direction") * (c - px) / px
    code = (F.when(hit_t & hit_s, "ambig").when(hit_t, "target").when(hit_s, "stop"))
    if mode != "triple_barrier":
        ranks = scores.select(F.col("t").alias("_at"), "symbol", F.col("score").alias("_sc"), F.rank().over(
            Window.partitionBy("t").orderBy(F.col("score").desc())).alias("_rank"))
        if curve:
            # the cross-section in force at each bar time: one row per time, not per bar
            grid = path.select("_bts").distinct().withColumn("_k", F.lit(0))
            anchors = scores.select(F.col("t").alias("_at")).distinct().withColumn("_k", F.lit(0))
            in_force = asof(grid, anchors, keys=["_k"], left_time="_bts", right_time="_at",
                            payload={"_at": F.col("_at")}, strict=False, bucket="day").drop("_k")
            joined = joined.join(in_force, "_bts", "left").join(ranks, ["symbol", "_at"], "left")
            limit = shapes.step_curve(list(curve), drift)
            code = code.when(F.col("_rank") > limit, "curve_exit")
        else:
            joined = joined.join(ranks.withColumnRenamed("_at", "_bts"), ["symbol", "_bts"], "left")
            if mode.endswith("rerank"):
                code = code.when(F.col("_rank") > rerank_k, "score_rerank_exit")
            else:
                code = code.when(F.col("_sc") < floor, "score_floor_exit")
    gain = (F.when(F.col("_code") == "ambig", shapes.ambiguous_return(rule, target, stop, h, lo, px))
            .when(F.col("_code") == "target", float(target)).when(F.col("_code") == "stop", -float(stop)).otherwise(drift))
    rows = joined.withColumn("_live", F.coalesce(live, F.lit(False))).withColumn("_code", F.when(F.col("_live"), code))
    rows = rows.withColumn("_ev", F.struct(F.col("_bts").alias("ts"), gain.alias("r"), F.col("_code").alias("o")))
    out = rows.groupBy(*taken.columns, "_px", "_nts", "_nc").agg(
        F.min_by("_ev", F.when(F.col("_code").isNotNull(), F.col("_bts"))).alias("_hit"),
        F.max_by(F.struct(F.col("_bts").alias("ts"), F.col("_c").alias("c")), F.when(F.col("_live"), F.col("_bts"))).alias("_last"))
    close = F.coalesce(F.col("_last.c"), F.col("_nc"))
    at = F.coalesce(F.col("_hit.ts"), F.col("_last.ts"), F.col("_nts"))
    return out.select(*taken.columns,
                      F.coalesce(F.col("_hit.r"), F.col("direction") * (close - px) / px).alias("raw_return"),
                      F.coalesce(F.col("_hit.o"), F.lit("timeout")).alias("outcome"),
                      ((F.unix_seconds(at) - F.unix_seconds("t")) / 60.0).alias("minutes_held"))


# Exit clock (exchange minute of day) and trading days ahead per horizon;
# intraday horizons exit a number of minutes after the anchor.
EXITS = {
    "intraday_30m": ("after", 30, 0), "intraday_60m": ("after", 60, 0), "intraday_120m": ("after", 120, 0),
    "intraday_180m": ("after", 180, 0), "to_close": ("at", 930, 0), "overnight": ("at", 555, 1),
    "next_day_1h": ("at", 615, 1), "next_day_eod": ("at", 930, 1), "day_plus_3": ("at", 930, 3), "day_plus_5": ("at", 930, 5),
}


def stop_exits(days: DataFrame, bars: DataFrame, trading: DataFrame, *, horizon: str, anchor_minute: int,
               stop_bps: float, cost_bps: float = 15.0) -> DataFrame:
    """Strategy days re-priced along their picks' bars with a stop.

    ``days``: ``test_date, today_pnl_bps, chosen_stocks array<string>``.  Each pick enters
    at the first bar's open from the anchor on, leaves at the stop price once a low
    reaches it, else at the last close before the exit.  Bars meet picks on (symbol,
    day) over the trading days of the hold.
    """
    kind, at, ahead = EXITS[horizon]
    d = F.col("test_date")
    base = days.withColumn("_in", clock.exchange_instant(d, anchor_minute))
    if kind == "after":
        base = base.withColumn("_out", F.col("_in") + clock.minutes(at))
    else:
        # every civil day: from a closed day the next trading day is the first step
        to = tradingdays.shift_table(trading, ahead) if ahead else trading.select(
            F.col("trade_date").alias("day"), F.col("trade_date").alias("target"))
        base = base.join(to, d == F.col("day"), "left").withColumn(
            "_out", clock.exchange_instant(F.col("target"), at)).drop("day", "target")
    picks = base.filter(F.size("chosen_stocks") > 0).select(
        "test_date", "today_pnl_bps", "_in", "_out", F.explode("chosen_stocks").alias("symbol"))
    span = picks.filter(F.col("_out").isNotNull()).withColumn("_day", F.explode(F.sequence(F.to_date("_in"), F.to_date("_out"))))
    path = bars.filter(F.col("scale") == "5m").select("symbol", "ts", F.to_date("ts").alias("_day"), "open", "low", "close")
    hit = span.join(path, ["symbol", "_day"]).filter(F.col("ts").between(F.col("_in"), F.col("_out")))
    per = hit.groupBy("test_date", "symbol").agg(
        F.min_by("open", "ts").alias("_e"), F.min("low").alias("_lo"), F.max_by("close", "ts").alias("_x"))
    level = 1.0 - stop_bps / 10000.0
    stopped = (F.col("_lo") <= F.col("_e") * level) if level < 1.0 else F.lit(False)
    known = F.col("_e").isNotNull()
    all_picks = picks.join(per, ["test_date", "symbol"], "left").withColumns({
        "_r": F.when(~known, F.col("today_pnl_bps") / 10000.0 + cost_bps / 10000.0).when(
            stopped, (F.col("_e") * level - F.col("_e")) / F.col("_e")).otherwise((F.col("_x") - F.col("_e")) / F.col("_e")),
        "_why": F.when(~known, "no_bars").when(stopped, "stop").otherwise("target")})
    day = all_picks.groupBy("test_date").agg(
        F.avg("_r").alias("_avg"), F.count_if(F.col("_why") == "stop").alias("_ns"),
        F.count_if(F.col("_why") == "no_bars").alias("_nb"), F.count(F.lit(1)).alias("_np"))
    out = base.join(day, "test_date", "left")
    sat, lost = F.col("_np").isNull(), F.col("_out").isNull()
    return out.select(
        "test_date", "today_pnl_bps",
        F.when(sat, 0.0).when(lost, F.col("today_pnl_bps")).otherwise(F.col("_avg") * 10000.0 - cost_bps).alias("today_pnl_bps_stop"),
        F.when(sat, "sitout").when(lost, "no_exit_day").when(F.col("_ns") > 0, "stop")
        .when(F.col("_nb") == F.col("_np"), "no_bars").otherwise("target").alias("exit_reason"))
