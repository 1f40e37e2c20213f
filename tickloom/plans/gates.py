"""Acceptance gates over per-fold results (a few rows per fold and horizon)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.plans.metrics import t_stat

# Gate thresholds.
DELTA = 0.005
T_STAT = 1.5
FOLDS_POSITIVE = 3
FOLDS_BEATEN = 3
HORIZONS_NEEDED = 2
COVERAGE_BAND = (0.75, 0.85)


def _of(results: DataFrame, mode: str, name: str, best: bool = False) -> DataFrame:
    ic = F.max("rank_ic_mean") if best else F.max_by("rank_ic_mean", F.col("seed"))
    return results.filter(F.col("mode") == mode).groupBy("horizon", "fold_id").agg(ic.alias(name))


def horizon_gate(results: DataFrame, *, model: str = "ssl_heads", baseline: str = "xgboost", delta: float = DELTA,
                 t_min: float = T_STAT, min_positive: int = FOLDS_POSITIVE, min_beat: int = FOLDS_BEATEN) -> DataFrame:
    """Per horizon: t of the fold deltas, folds above zero, folds above the baseline."""
    pairs = _of(results, model, "a").join(_of(results, baseline, "b"), ["horizon", "fold_id"]).withColumn("d", F.col("a") - F.col("b"))
    out = pairs.groupBy("horizon").agg(
        F.avg("a").alias("mean_model_ic"), F.avg("b").alias("mean_baseline_ic"), t_stat("d").alias("delta_t_stat"),
        F.count_if(F.col("a") > 0).alias("folds_positive"), F.count_if(F.col("d") > 0).alias("folds_beat"),
        F.count(F.lit(1)).alias("n_folds"))
    out = out.withColumn("mean_delta", F.col("mean_model_ic") - F.col("mean_baseline_ic")).withColumns({
        "passed_t_stat": F.col("delta_t_stat") > t_min, "passed_mean_delta": F.col("mean_delta") >= delta,
        "passed_folds_positive": F.col("folds_positive") >= min_positive, "passed_folds_beat": F.col("folds_beat") >= min_beat})
    return out.withColumn("passed", F.col("passed_t_stat") & F.col("passed_folds_positive") & F.col("passed_folds_beat"))


def random_init_gate(results: DataFrame, *, model: str = "ssl_heads", noise: str = "random_init", delta: float = DELTA,
                     t_min: float = T_STAT) -> DataFrame:
    """Per horizon: model against the best seed of the untrained model in every fold."""
    pairs = _of(results, model, "a").join(_of(results, noise, "b", best=True), ["horizon", "fold_id"]).withColumn(
        "d", F.col("a") - F.col("b"))
    out = pairs.groupBy("horizon").agg(F.avg("a").alias("mean_model_ic"), F.avg("b").alias("mean_random_ic"),
                                       t_stat("d").alias("delta_t_stat"))
    out = out.withColumn("mean_delta", F.col("mean_model_ic") - F.col("mean_random_ic"))
    return out.withColumns({"passed_mean_delta": F.col("mean_delta") >= delta, "passed": F.col("delta_t_stat") > t_min})


def coverage_gate(per_fold: DataFrame, band: tuple[float, float] = COVERAGE_BAND) -> DataFrame:
    """``horizon, coverage`` per fold -> mean coverage and whether it lies in the band."""
    out = per_fold.groupBy("horizon").agg(F.avg("coverage").alias("mean_coverage"), F.count(F.lit(1)).alias("n_folds"))
    return out.withColumn("in_band", F.col("mean_coverage").between(*band))


def overall(results: DataFrame, per_fold_coverage: DataFrame | None = None, *, needed: int = HORIZONS_NEEDED) -> DataFrame:
    """One row: every gate, where the noise gate must clear on horizons that also passed the first."""
    tri = horizon_gate(results).select("horizon", F.col("passed").alias("tri"))
    rand = random_init_gate(results).select("horizon", F.col("passed").alias("rand"))
    rows = tri.join(rand, "horizon", "full")
    if per_fold_coverage is not None:
        rows = rows.join(coverage_gate(per_fold_coverage).select("horizon", "in_band"), "horizon", "left")
    else:
        rows = rows.withColumn("in_band", F.lit(None).cast("boolean"))
    t, r = F.coalesce("tri", F.lit(False)), F.coalesce("rand", F.lit(False))
    cover = F.coalesce("in_band", F.lit(False))
    have = F.lit(per_fold_coverage is not None)
    return rows.agg(
        F.count_if(t).alias("n_horizons_passed"), (F.count_if(t) >= needed).alias("gate_1"),
        (have & (F.count_if(t) > 0) & (F.count_if(t & ~cover) == 0)).alias("gate_3"),
        ((F.count_if(r) >= needed) & (F.count_if(t & r) >= needed)).alias("gate_4"),
        F.array_sort(F.collect_list(F.when(t, F.col("horizon")))).alias("horizons_passed"))


def report(results: DataFrame, per_fold_coverage: DataFrame | None = None) -> DataFrame:
    """The whole outcome as one JSON document (the inputs hold one row per fold and horizon)."""
    def as_array(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*sorted(df.columns)))).alias(name)).withColumn("_j", F.lit(0))

    parts = as_array(horizon_gate(results), "tri_criterion")
    for df, name in ((random_init_gate(results), "random_init"), (results, "folds"),
                     (overall(results, per_fold_coverage), "gates")):
        parts = parts.join(as_array(df, name), "_j")
    return parts.select(F.to_json(F.struct("gates", "tri_criterion", "random_init", "folds")).alias("report"))
