"""Prediction quality: rank IC, spreads, top-k hits, calibration, win rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators import ranking
from tickloom.session import stored


def rank_ic_by_group(df: DataFrame, by: Sequence[str] = ("t",), pred: str = "pred_lr",
                     real: str = "real_lr", valid: Column | None = None,
                     min_size: int = 10) -> DataFrame:
    """Spearman correlation per cross-section: ``by, n, ic``.

    ``ic`` is null where the cross-section is narrower than ``min_size`` or either
    side is constant.
    """
    rows = df if valid is None else df.filter(valid)
    ranked = rows.withColumns({"_rp": ranking.average_rank(pred, by), "_rr": ranking.average_rank(real, by)})
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_rp", "_rr").alias("_ic"),
        ((F.min("_rp") < F.max("_rp")) & (F.min("_rr") < F.max("_rr"))).alias("_varies"))
    ok = (F.col("n") >= min_size) & F.col("_varies")
    return out.select(*by, "n", F.when(ok, F.col("_ic")).alias("ic"))


def ic_summary(per_group: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and t-statistic of the per-group IC, with group and row counts."""
    out = per_group.groupBy(*by).agg(
        F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s"),
        F.count("ic").alias("n_cross_sections"), F.sum("n").alias("n_observations"))
    m, s = F.coalesce("_m", F.lit(0.0)), F.when(F.col("n_cross_sections") > 1, F.col("_s")).otherwise(0.0)
    return out.select(*by, m.alias("mean_ic"), s.alias("std_ic"), F.when(
        s > 0, m * F.sqrt(F.col("n_cross_sections")) / s).otherwise(0.0).alias("t_stat"),
        "n_cross_sections", "n_observations")


def ic_spread(per_group: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles and sign counts of the per-group IC (one row per instant upstream)."""
    q = F.percentile("ic", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = per_group.filter("ic IS NOT NULL").groupBy(*by).agg(
        q.alias("_q"), F.count_if(F.col("ic") > 0).alias("n_pos"), F.count_if(F.col("ic") < 0).alias("n_neg"))
    return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "n_pos", "n_neg")


def pooled_ic(df: DataFrame, by: Sequence[str] = ("horizon",), pred: str = "pred_lr", real: str = "real_lr",
              group: Sequence[str] = (), min_group: int = 5, min_rows: int = 50) -> DataFrame:
    """Spearman over all rows of a pool; groups narrower than ``min_group`` are left out.

    Pools grow with the table, so ranks come from :func:`ranking.pool_average_rank`.
    """
    if group:
        wide = df.groupBy(*by, *group).agg(F.count(F.lit(1)).alias("_w")).filter(F.col("_w") >= min_group)
        df = df.join(wide.drop("_w"), [*by, *group], "left_semi")
    pairs = stored(df.select(*by, pred, real), "pairs")
    ranked = ranking.pool_average_rank(ranking.pool_average_rank(pairs, by, pred, "_rp"), by, real, "_rr")
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rp", "_rr").alias("_ic"))
    return out.select(*by, "n", F.when(F.col("n") >= min_rows, F.coalesce(F.nanvl("_ic", F.lit(0.0)), F.lit(0.0))).alias("ic"))


def decile_spread_bps(df: DataFrame, by: Sequence[str] = ("t",), pred: str = "pred_lr", real: str = "real_lr",
                      tie: str = "symbol", out_by: Sequence[str] = ()) -> DataFrame:
    """Mean top-decile minus bottom-decile return per cross-section, averaged, in bps."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    rows = df.withColumns({"_n": n, "_k": ranking.ordinal_rank(pred, by, tie)}).filter("_n >= 10")
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    per = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("_k") >= F.col("_n") - k, F.col(real))).alias("_top"),
        F.avg(F.when(F.col("_k") < k, F.col(real))).alias("_bot"))
    return per.groupBy(*out_by).agg(F.coalesce(F.avg((F.col("_top") - F.col("_bot")) * 10000.0), F.lit(0.0))
                                    .alias("spread_bps"), F.count(F.lit(1)).alias("n_cross_sections"))


def hits_at_k(df: DataFrame, by: Sequence[str], ks: Sequence[int], *, score: Column, label: str = "tradeable_label",
              target: int = 1, tie: str = "symbol", out_by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at k averaged over cross-sections.

    Recall leaves out cross-sections without the target class.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    hit = (F.col(label) == target).cast("int")
    rows = df.withColumn("_s", score).withColumns({
        "_pos": F.row_number().over(w.orderBy(F.col("_s").desc(), F.col(tie))), "_hit": hit})
    per = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_t"),
        *[F.sum(F.when(F.col("_pos") <= k, F.col("_hit"))).alias(f"_h{k}") for k in ks])
    long = per.select(*by, "_n", "_t", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"_h{k}").alias("h")) for k in ks])).alias("x"))
    k, h = F.col("x.k"), F.col("x.h")
    return long.groupBy(*out_by, k.alias("k")).agg(
        F.avg(h / F.least(k, F.col("_n"))).alias("precision"),
        F.coalesce(F.avg(F.when(F.col("_t") > 0, h / F.col("_t"))), F.lit(0.0)).alias("recall"),
        F.count(F.lit(1)).alias("n_cross_sections"), F.avg("_t").alias("n_target_in_universe"))


def pnl_at_k(df: DataFrame, by: Sequence[str], ks: Sequence[int], *, score: str, pnl: str,
             tie: str = "symbol") -> DataFrame:
    """Mean realised result of the top k per cross-section; mean, deviation and ratio across them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    rows = df.filter(F.col(pnl).isNotNull()).withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= max(ks))
    per = rows.groupBy(*by).agg(*[F.avg(F.when(F.col("_pos") <= k, F.col(pnl))).alias(f"_m{k}") for k in ks])
    long = per.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"_m{k}").alias("m")) for k in ks])).alias("x")).select("x.k", "x.m")
    sd = F.coalesce("_sd", F.lit(0.0))
    return long.groupBy("k").agg(F.avg("m").alias("mean_pnl"), F.stddev_samp("m").alias("_sd"),
                                 F.count("m").alias("n_cross_sections")).select(
        "k", "mean_pnl", sd.alias("pnl_std"),
        F.when(sd > 1e-12, F.col("mean_pnl") / sd).otherwise(0.0).alias("sharpe"), "n_cross_sections")


def lift_over_base(hits: DataFrame, base: DataFrame, rate: str) -> DataFrame:
    """Precision divided by the class share in the evaluation window (a one-row table)."""
    return hits.withColumn("_j", F.lit(0)).join(base.withColumn("_j", F.lit(0)), "_j").withColumn(
        "lift", F.try_divide("precision", rate)).drop("_j")


def base_rates(labels: DataFrame, label: str = "tradeable_label") -> DataFrame:
    return labels.agg(F.avg((F.col(label) == 1).cast("double")).alias("base_long"),
                      F.avg((F.col(label) == -1).cast("double")).alias("base_short"))


def t_stat(value: str) -> Column:
    """One-sample t (aggregate): 0 below two values, ±inf when they agree on a non-zero mean."""
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    flat = F.max(value) == F.min(value)
    inf = F.lit(float("inf"))
    return (F.when(n < 2, 0.0).when(flat, F.when(m > 0, inf).when(m < 0, -inf).otherwise(0.0))
            .otherwise(m / (s / F.sqrt(n))))


# ------------------------------------------------------------ pools: calibration

def _edges(df: DataFrame, by: Sequence[str], pred: str, bins: int) -> DataFrame:
    """Distinct interpolated quantile edges per pool."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    q = ranking.pool_quantiles(df, by, pred, probs)
    return q.select(*by, F.array_sort(F.array_distinct(F.array(*probs))).alias("_edges")).filter(F.size("_edges") >= 3)


def prediction_bins(df: DataFrame, by: Sequence[str] = ("horizon",), pred: str = "pred_lr", bins: int = 10) -> DataFrame:
    """Rows with ``bin``: how many inner edges lie at or below the prediction."""
    joined = df.join(_edges(df, by, pred, bins), list(by))
    inner = F.slice("_edges", F.lit(2), F.size("_edges") - 2)
    return joined.withColumn("bin", F.aggregate(inner, F.lit(0), lambda n, e: n + (e <= F.col(pred)).cast("int"))).drop("_edges")


def decile_lift(df: DataFrame, by: Sequence[str] = ("horizon",), pred: str = "pred_lr", real: str = "real_lr",
                bins: int = 10) -> DataFrame:
    return prediction_bins(df, by, pred, bins).groupBy(*by, "bin").agg(
        F.avg(pred).alias("mean_pred"), F.avg(real).alias("mean_real"), F.count(F.lit(1)).alias("n"))


def decile_win_rate(df: DataFrame, win: Column, by: Sequence[str] = ("horizon",), pred: str = "pred_lr",
                    bins: int = 10) -> DataFrame:
    return prediction_bins(df.withColumn("_y", win.cast("double")), by, pred, bins).groupBy(*by, "bin").agg(
        F.avg("_y").alias("win_rate"), F.avg(pred).alias("mean_pred"), F.count(F.lit(1)).alias("n"))


def win_rate_summary(df: DataFrame, win: Column, by: Sequence[str] = ("horizon",), pred: str = "pred_lr",
                     tops: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Base rate, ROC AUC and win rate among the best share of predictions.

    Everything follows from value positions; rows tied at a cut count pro rata.
    """
    pos = ranking.value_positions(df, by, pred, {"wins": win.cast("long")})
    above = F.col("total") - F.col("before") - F.col("cnt")
    aggs = [F.max("total").alias("n_test"), F.max("total_wins").alias("_w"),
            F.sum(F.col("wins") * (F.col("before") + (F.col("cnt") + 1) / F.lit(2.0))).alias("_ranksum")]
    for p in tops:
        m = F.greatest(F.floor(F.col("total") * F.lit(float(p))), F.lit(1))
        part = F.greatest(F.least(m - above, F.col("cnt")), F.lit(0)) / F.col("cnt")
        aggs.append((F.sum(F.col("wins") * part) / F.max(m)).alias(f"top{round(p * 100)}pct_winrate"))
    out = pos.groupBy(*by).agg(*aggs)
    w, losses = F.col("_w"), F.col("n_test") - F.col("_w")
    return out.select(*by, "n_test", (w / F.col("n_test")).alias("base_rate"),
                      F.try_divide(F.col("_ranksum") - w * (w + 1) / F.lit(2.0), w * losses).alias("auc"),
                      *[f"top{round(p * 100)}pct_winrate" for p in tops])


def signed_consistency(df: DataFrame, by: Sequence[str], weights: DataFrame, pred: str = "pred_lr") -> DataFrame:
    """Weighted mean prediction per entity and the share of horizons agreeing in sign.

    ``weights`` is ``horizon, weight``; horizons absent for an entity drop out of
    the denominator.
    """
    rows = df.join(weights, "horizon").filter(F.col("weight") != 0)
    score = rows.groupBy(*by).agg((F.sum(F.col(pred) * F.col("weight")) / F.sum("weight")).alias("score"))
    return (rows.join(score, list(by)).groupBy(*by, "score")
            .agg(F.avg((F.signum(pred) == F.signum("score")).cast("double")).alias("consistency")))
