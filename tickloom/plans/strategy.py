"""Prediction tables to strategy days: sweeps, gates, rolling rebalances, ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import shapes
from tickloom.operators import ranking
from tickloom.operators.series import over_series


def dated(df: DataFrame, date: str = "date", name: str = "date_no") -> DataFrame:
    """Distinct dates with a dense number from 0 (one row per trading day)."""
    return df.select(date).distinct().withColumn(name, F.row_number().over(Window.orderBy(date)) - 1)


def wide_table(preds: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """One row per (date, stock): ``pred_<h>`` and ``real_<h>`` columns."""
    agg = []
    for h in horizons:
        for kind in ("pred", "real"):
            agg.append(F.max_by(f"{kind}_lr", F.when(F.col("horizon") == h, F.lit(1))).alias(f"{kind}_{h}"))
    return preds.filter(F.col("horizon").isin(list(horizons))).groupBy("date", "stock").agg(*agg)


def regime_columns(wide: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Mean and deviation of each prediction over the day's universe."""
    w = Window.partitionBy("date")
    cols: dict[str, Column] = {}
    for h in horizons:
        cols[f"univ_mean_pred_{h}"] = F.avg(f"pred_{h}").over(w)
        cols[f"univ_std_pred_{h}"] = F.stddev_samp(f"pred_{h}").over(w)
    return wide.withColumns(cols)


def first_anchor_of_day(preds: DataFrame) -> DataFrame:
    w = Window.partitionBy("date")
    return preds.withColumn("_first", F.min("anchor_us").over(w)).filter("anchor_us = _first").drop("_first")


def net_bps(log_return: Column, cost_bps: float) -> Column:
    return (F.exp(log_return) - 1.0) * 10000.0 - cost_bps


def day_results(preds: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per (date, horizon, k): width and mean prediction/realisation of the top k, one pass."""
    w = Window.partitionBy("date", "horizon")
    pos = preds.withColumn("_pos", F.row_number().over(w.orderBy(F.col("pred_lr").desc(), F.col("stock"))))
    per = pos.groupBy("date", "horizon").agg(F.count(F.lit(1)).alias("n_alive"), *[
        F.avg(F.when(F.col("_pos") <= k, F.col(f"{c}_lr"))).alias(f"_{c}{k}") for k in ks for c in ("pred", "real")])
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("top_k"), F.col(f"_pred{k}").alias("pred_mean"),
                                     F.col(f"_real{k}").alias("real_mean")) for k in ks]))
    return per.select("date", "horizon", "n_alive", x.alias("x")).select("date", "horizon", "n_alive", "x.*")


def top_k_days(preds: DataFrame, k: int, cost_bps: float) -> DataFrame:
    """Net result of the day's top k per horizon, with running total."""
    d = day_results(preds, [k]).filter(F.col("n_alive") >= k).withColumn("net_bps", net_bps(F.col("real_mean"), cost_bps))
    w = Window.partitionBy("horizon").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("date", "horizon", "n_alive", "net_bps", (F.col("net_bps") > 0).cast("int").alias("win"),
                    F.sum("net_bps").over(w).alias("cum_bps"))


def rolling_best_config(preds: DataFrame, *, ks: Sequence[int], horizons: Sequence[str], thresholds: Sequence[float],
                        lookback: int, cost_bps: float = 5.0) -> DataFrame:
    """Each date trades the configuration with the best ratio over the previous ``lookback`` dates.

    Days without a trade do not count; fewer than three trades disqualify; ties go to
    the configuration listed first.
    """
    configs = [(i, k, h, t) for i, (k, h, t) in enumerate((k, h, t) for k in ks for h in horizons for t in thresholds)]
    dates = dated(preds)
    grid = dates.select("date", "date_no", F.explode(F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(k).alias("top_k"), F.lit(h).alias("horizon"), F.lit(float(t)).alias("threshold"))
        for i, k, h, t in configs])).alias("c")).select("date", "date_no", "c.*")
    days = day_results(preds.filter(F.col("horizon").isin(list(horizons))), ks)
    rows = grid.join(days, ["date", "horizon", "top_k"], "left")
    ok = (F.col("n_alive") >= F.col("top_k")) & (F.col("pred_mean") >= F.col("threshold"))
    rows = rows.withColumn("bps", F.when(ok, net_bps(F.col("real_mean"), cost_bps)))
    w = Window.partitionBy("no").orderBy("date_no").rowsBetween(-lookback, -1)
    n, sd = F.count("bps").over(w), F.stddev_pop("bps").over(w)
    ratio = F.avg("bps").over(w) / F.when(sd == 0, 1e-9).otherwise(sd) * F.sqrt(F.lit(252.0))
    rows = rows.withColumns({"_n": n, "_ratio": F.when(n >= 3, ratio)}).filter(
        (F.col("date_no") >= lookback) & F.col("_ratio").isNotNull())
    best = rows.groupBy("date").agg(F.max(F.struct(
        F.col("_ratio").alias("lookback_sharpe"), (-F.col("no")).alias("_o"), "top_k", "horizon", "threshold",
        F.col("_n").alias("lookback_n_trades"), "bps", F.coalesce("n_alive", F.lit(0)).alias("n_alive"))).alias("b"))
    return best.select("date", F.col("b.top_k").alias("tuned_k"), F.col("b.horizon").alias("tuned_horizon"),
                       F.col("b.threshold").alias("tuned_threshold"), "b.lookback_sharpe", "b.lookback_n_trades",
                       F.col("b.bps").isNotNull().alias("traded"), F.coalesce("b.bps", F.lit(0.0)).alias("net_bps"), "b.n_alive")


def config_frequency(tuned: DataFrame, top: int = 10) -> DataFrame:
    """Most frequently chosen configurations (a report)."""
    keys = ["tuned_k", "tuned_horizon", "tuned_threshold"]
    return tuned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *keys).limit(top)


def threshold_gate(rows: DataFrame, *, offset: int, fit_days: int, holdout: int, thresholds: Sequence[float], top_k: int,
                   cost_bps: float, min_rows: int = 100) -> DataFrame:
    """Trade a day only if some probability threshold earned on the last realised days.

    ``rows``: ``date, stock, prob, real``.  For a day, labels of days at least
    ``offset`` trading days old are known; the last ``holdout`` of them choose the
    threshold by mean result over its traded days, and the mean must be positive.
    """
    dates = dated(rows)
    valid = rows.filter(F.col("prob").isNotNull() & F.col("real").isNotNull())
    w = Window.partitionBy("date")
    ordered = valid.withColumn("_pos", F.row_number().over(w.orderBy(F.col("prob").desc(), F.col("stock"))))
    per = ordered.groupBy("date").agg(
        F.count(F.lit(1)).alias("width"), *[F.count_if(F.col("prob") > t).alias(f"_n{i}") for i, t in enumerate(thresholds)],
        F.avg(F.when(F.col("_pos") <= top_k, F.col("real"))).alias("_top"),
        F.array_sort(F.collect_list(F.when(F.col("_pos") <= top_k, F.struct("_pos", "stock")))).alias("_picks"))
    # above any threshold the k best are the same rows, so one mean serves all
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(float(t)).alias("thr"), F.col(f"_n{i}").alias("n_above"))
                               for i, t in enumerate(thresholds)]))
    days = per.select("date", "width", "_top", "_picks", cell.alias("c")).select("date", "width", "_top", "_picks", "c.*")
    fires = (F.col("width") >= top_k) & (F.col("n_above") >= top_k)
    days = days.withColumn("bps", F.when(F.col("width") >= top_k, F.when(fires, net_bps(F.col("_top"), cost_bps)).otherwise(0.0)))

    known = per.select("date", "width").withColumn("v", F.row_number().over(Window.orderBy("date")) - 1).withColumn(
        "rows_to", F.sum("width").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cap = dates.select((F.col("date_no") + offset).alias("date_no"), F.col("date").alias("_cap"))
    # last known valid date strictly before the cap: positions on one row per date
    upto = dates.join(known.select("date", "v", "rows_to"), "date", "left").withColumns({
        "_v": F.max("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)),
        "_rows": F.max("rows_to").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))})
    tests = (dates.join(cap, "date_no").join(upto.select(F.col("date").alias("_cap"), "_v", "_rows"), "_cap")
             .filter((F.col("_v") + 1 >= fit_days + holdout) & (F.col("_rows") >= min_rows)))
    hold = tests.select("date", F.explode(F.sequence(F.col("_v") - holdout + 1, F.col("_v"))).alias("v"))
    # means are compared to a millionth of a basis point, so that thresholds choosing the
    # same trades tie whatever order the rows arrive in
    past = hold.join(known.select("v", F.col("date").alias("_pd")), "v").join(
        days.select(F.col("date").alias("_pd"), "no", "thr", F.col("bps").alias("_b")), "_pd")
    traded = F.when(F.abs("_b") > 1e-9, F.col("_b"))
    scored = past.groupBy("date", "no", "thr").agg(
        F.round(F.avg(traded), 6).alias("m"), F.stddev_pop(traded).alias("sd"), F.count(traded).alias("k")).filter("k > 0")
    best = scored.groupBy("date").agg(F.max(F.struct("m", (-F.col("no")).alias("o"), "thr", "sd", "k")).alias("b"))
    out = tests.select("date").join(best, "date", "left").withColumn("_go", F.coalesce(F.col("b.m") > 0, F.lit(False)))
    today = days.select("date", "thr", "bps", (fires).alias("_fires"), "_picks")
    out = out.withColumn("thr", F.when(F.col("_go"), F.col("b.thr"))).join(today, ["date", "thr"], "left")
    act = F.coalesce("_fires", F.lit(False))
    year = F.sqrt(F.lit(252.0 / max(1, offset)))
    return out.select(
        F.col("date").alias("test_date"), F.col("thr").alias("chosen_threshold"), F.col("b.m").alias("lookback_pnl_bps"),
        (F.col("b.m") / F.when(F.col("b.sd") == 0, 1e-9).otherwise(F.col("b.sd")) * year).alias("lookback_sharpe"),
        F.coalesce(F.col("b.k"), F.lit(0)).alias("n_lookback_trades"), F.when(act, top_k).otherwise(0).alias("n_today_trades"),
        F.when(act, F.col("bps")).otherwise(0.0).alias("today_pnl_bps"),
        F.when(act, F.transform("_picks", lambda p: p["stock"])).otherwise(F.array().cast("array<string>")).alias("chosen_stocks"))


def clock_gate(preds: DataFrame, *, fit_days: int, holdout: int, top_k: int, cost_bps: float,
               percents: Sequence[float] = (0.5, 1, 2, 5), min_fit_rows: int = 50) -> DataFrame:
    """Per clock time, trade when some top-percent rule earned on the last days at that time.

    ``preds``: ``date, anchor_us, stock, pred_lr, real_lr`` of one horizon.
    """
    p = preds.withColumn("clock", F.pmod(F.col("anchor_us"), F.lit(86_400_000_000)))
    w = Window.partitionBy("date", "clock")
    ranked = p.withColumns({"_pos": F.row_number().over(w.orderBy(F.col("pred_lr").desc(), F.col("stock"))),
                            "_w": F.count(F.lit(1)).over(w)})
    cut = lambda q: F.greatest(F.lit(1), F.floor(F.col("_w") * float(q) / 100))
    day = ranked.groupBy("clock", "date").agg(
        F.max("_w").alias("width"), F.avg(F.when(F.col("_pos") <= top_k, F.col("real_lr"))).alias("_top"),
        *[F.avg(F.when(F.col("_pos") <= cut(q), F.col("real_lr"))).alias(f"_r{i}") for i, q in enumerate(percents)])
    by = Window.partitionBy("clock").orderBy("date")
    held, fit = by.rowsBetween(-holdout, -1), by.rowsBetween(-(fit_days + holdout), -(holdout + 1))
    day = day.withColumns({"_hist": F.row_number().over(by) - 1, "_fit": F.sum("width").over(fit),
                           **{f"_m{i}": F.when(F.count(f"_r{i}").over(held) >= 2, F.avg(net_bps(F.col(f"_r{i}"), cost_bps)).over(held))
                              for i in range(len(percents))}})
    best = F.array_max(F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.lit(-i).alias("o"), F.lit(float(q)).alias("q"))
                                 for i, q in enumerate(percents)]))
    out = day.filter((F.col("_hist") >= fit_days + holdout) & (F.col("_fit") >= min_fit_rows)).withColumn("_b", best)
    go = F.coalesce(F.col("_b.m") > 0, F.lit(False))
    return out.select("clock", "date", F.when(go, F.col("_b.q")).alias("percent"), F.col("_b.m").alias("holdout_bps"),
                      go.alias("traded"), F.when(go, net_bps(F.col("_top"), cost_bps)).alias("net_bps"))


# ------------------------------------------------------------- rolling rebalances

def hold_returns(preds: DataFrame, hold: int) -> DataFrame:
    """Forward sum of each stock's own next ``hold`` rows, the current one included."""
    return over_series(preds, lambda w: {"hold_lr": F.sum("real_lr").over(w.rowsBetween(0, hold - 1))},
                       keys=["stock"], order="date", lookahead=hold)


def rebalances(preds: DataFrame, hold: int, k: int) -> DataFrame:
    """Picks at every rebalance of every offset: ``date_no, offset, exit_no`` added.

    A date's offset is its number modulo the hold; the hold must end inside the data.
    """
    dates = dated(preds)
    last = dates.withColumn("_last", F.max("date_no").over(Window.partitionBy(F.lit(0)))).filter(
        F.col("date_no") + hold <= F.col("_last")).drop("_last")
    rows = preds.join(last, "date")
    return ranking.top_k(rows, ["date"], "pred_lr", k, tie="stock", full_only=True).withColumns({
        "offset": (F.col("date_no") % hold).cast("int"), "exit_no": F.col("date_no") + hold}).drop("pos")


def rolling_rebalance(preds: DataFrame, *, holds: Sequence[int], ks: Sequence[int], cost_bps: float = 30.0) -> DataFrame:
    """Per (hold, k, offset): ratio, compounded sleeve and hit rate of the rebalances."""
    parts = []
    for hold in holds:
        base = hold_returns(preds, hold)
        for k in ks:
            port = rebalances(base, hold, k).groupBy("offset", "date").agg(
                (shapes.log_mean_exp(F.col("hold_lr")) - cost_bps / 10000.0).alias("r"))
            s = port.groupBy("offset").agg(
                F.count(F.lit(1)).alias("n"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"),
                ((F.exp(F.sum("r")) - 1) * 100).alias("sleeve_pct"), F.avg((F.col("r") > 0).cast("double")).alias("hit")).filter("n >= 2")
            parts.append(s.select(
                F.lit(hold).alias("hold"), F.lit(k).alias("k"), "offset", "n",
                F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") + 1e-12) * F.sqrt(F.lit(250.0 / hold))).otherwise(0.0).alias("sharpe"),
                "sleeve_pct", "hit"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def over_offsets(scores: DataFrame) -> DataFrame:
    return scores.groupBy("hold", "k").agg(
        F.count(F.lit(1)).alias("n_offsets"), F.avg("sharpe").alias("sharpe_mean"), F.median("sharpe").alias("sharpe_median"),
        F.stddev_samp("sharpe").alias("sharpe_std"), F.min("sharpe").alias("sharpe_min"), F.max("sharpe").alias("sharpe_max"),
        F.avg("sleeve_pct").alias("sleeve_mean"), F.stddev_samp("sleeve_pct").alias("sleeve_std"), F.avg("hit").alias("hit_mean"))


# ----------------------------------------------------------------------- ensembles

def zscore_by_day(preds: DataFrame) -> DataFrame:
    w = Window.partitionBy("date")
    z = (F.col("pred_lr") - F.avg("pred_lr").over(w)) / (F.stddev_pop("pred_lr").over(w) + 1e-9)
    return preds.withColumn("pred_lr", z)


def ensemble(sets: Sequence[DataFrame], standardise: bool = False) -> DataFrame:
    """Mean prediction over sets, for (date, stock) present in all; realisation of the first set."""
    parts = []
    for i, s in enumerate(sets):
        s = s.select("date", "stock", "pred_lr", "real_lr")
        parts.append((zscore_by_day(s) if standardise else s).withColumn("_set", F.lit(i)))
    long = reduce(lambda a, b: a.unionByName(b), parts)
    out = long.groupBy("date", "stock").agg(
        F.count_distinct("_set").alias("_n"), F.avg("pred_lr").alias("pred_lr"),
        F.max(F.when(F.col("_set") == 0, F.col("real_lr"))).alias("real_lr"))
    return out.filter(F.col("_n") == len(sets)).drop("_n")


# ------------------------------------------------------------------- result series

def series_stats(days: DataFrame, *, hold: int = 1, bps: str = "today_pnl_bps", date: str = "test_date") -> DataFrame:
    """Mean, annualised ratio, compounded sleeve and hit rate per quarter, and a TOTAL row."""
    x = days.select(F.concat(F.year(date), F.lit("-Q"), F.quarter(date)).alias("quarter"), F.col(bps).alias("b"))
    traded = F.col("b") != 0
    out = x.rollup("quarter").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(traded).alias("traded"), F.avg("b").alias("mean_bps"), F.stddev_pop("b").alias("_sd"),
        ((F.exp(F.sum(F.log1p(F.col("b") / 10000.0 / hold))) - 1) * 100).alias("sleeve_pct"),
        F.count_if(traded & (F.col("b") > 0)).alias("_hit"))
    sd = F.when(F.col("_sd") == 0, 1e-9).otherwise(F.col("_sd"))
    return out.select(F.coalesce("quarter", F.lit("TOTAL")).alias("quarter"), "n", "traded", "mean_bps",
                      (F.col("mean_bps") / sd * F.sqrt(F.lit(252.0 / hold))).alias("sharpe"), "sleeve_pct",
                      (F.col("_hit") / F.greatest(F.col("traded"), F.lit(1)) * 100).alias("hit_pct"))


def running_sleeve(days: DataFrame, *, hold: int = 1, bps: str = "today_pnl_bps", date: str = "test_date") -> DataFrame:
    """Compounded return to date (one row per day)."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select(date, bps, ((F.exp(F.sum(F.log1p(F.col(bps) / 10000.0 / hold)).over(w)) - 1) * 100).alias("cum_sleeve_pct"))
