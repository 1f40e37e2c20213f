"""Split-conformal calibration of prediction bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.operators import ranking
from tickloom.session import durable

QUANTILES = ("q10", "q25", "q50", "q75", "q90")
EPS = 1e-9          # fixed value: guard in the score denominators
POOLED = -1         # fixed value: bucket id of the pooled cell
LEVELS = (0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50)  # fixed values: alphas of the coverage curve


def scores(y: str = "y") -> dict[str, Column]:
    """Scaled quantile distance (quantiles put in order first) and absolute residual."""
    q = F.array_sort(F.array("q10", "q50", "q90"))
    lo, mid, hi = q[0], q[1], q[2]
    v = F.col(y)
    return {"s_cqr": F.greatest((lo - v) / (mid - lo + EPS), (v - hi) / (hi - mid + EPS)),
            "s_vanilla": F.abs(v - F.col("q50"))}


def finite_sample_k(alpha: float) -> Column:
    """1-based order statistic giving coverage 1 - alpha on ``total`` scores."""
    k = F.ceil((F.col("total") + 1) * F.lit(1.0 - alpha))
    return F.least(F.greatest(k, F.lit(1)), F.col("total"))


def calibrate(df: DataFrame, *, by: Sequence[str] = ("horizon",), bucket: str = "vol_bucket", y: str = "y",
              alpha: float = 0.2, min_cell_size: int = 1000, min_pooled: int = 10) -> DataFrame:
    """One row per cell: chosen score, its threshold, size and in-sample coverage.

    Buckets under ``min_cell_size`` share the pooled cell.  The score whose
    coverage is nearer to the target wins; a tie goes to the scaled one.
    """
    cell = [*by, "cell"]
    sizes = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, bucket, F.when(F.col("_n") >= min_cell_size, F.col(bucket)).otherwise(F.lit(POOLED)).alias("cell"))
    rows = df.join(sizes, [*by, bucket]).withColumns(scores(y)).select(*cell, "s_cqr", "s_vanilla")
    # both scores are ordered in one pass, as two groups of a long table
    long = rows.select(*cell, F.explode(F.array(F.struct(F.lit("cqr").alias("fn"), F.col("s_cqr").alias("s")),
                                                F.struct(F.lit("vanilla").alias("fn"), F.col("s_vanilla").alias("s")))).alias("x"))
    found = ranking.kth_smallest(long.select(*cell, "x.fn", "x.s"), [*cell, "fn"], "s", {"t": finite_sample_k(alpha)})
    cut = found.groupBy(*cell).agg(F.max(F.when(F.col("fn") == "cqr", F.col("t"))).alias("t_cqr"),
                                   F.max(F.when(F.col("fn") == "vanilla", F.col("t"))).alias("t_vanilla"))
    out = rows.join(cut, cell).groupBy(*cell, "t_cqr", "t_vanilla").agg(
        F.count(F.lit(1)).alias("n_calibration"),
        F.avg((F.col("s_cqr") <= F.col("t_cqr")).cast("double")).alias("_c1"),
        F.avg((F.col("s_vanilla") <= F.col("t_vanilla")).cast("double")).alias("_c2"))
    first = F.abs(F.col("_c1") - (1.0 - alpha)) <= F.abs(F.col("_c2") - (1.0 - alpha))
    return out.filter((F.col("cell") != POOLED) | (F.col("n_calibration") >= min_pooled)).select(
        *by, F.col("cell").alias(bucket), F.when(first, "cqr").otherwise("vanilla").alias("score_fn"),
        F.when(first, F.col("t_cqr")).otherwise(F.col("t_vanilla")).alias("s_star"), "n_calibration",
        F.when(first, F.col("_c1")).otherwise(F.col("_c2")).alias("coverage_in_sample"), F.lit(alpha).alias("alpha"))


def bands(df: DataFrame, cells: DataFrame, *, by: Sequence[str] = ("horizon",), bucket: str = "vol_bucket") -> DataFrame:
    """Calibrated band per row; buckets without a cell use the pooled one, else raise.

    Cells are one row per (horizon, bucket): the horizon registry times five.
    """
    own = cells.select(*by, bucket, F.col("score_fn").alias("_f"), F.col("s_star").alias("_s"))
    pool = cells.filter(F.col(bucket) == POOLED).select(*by, F.col("score_fn").alias("_pf"), F.col("s_star").alias("_ps"))
    rows = df.join(own, [*by, bucket], "left").join(pool, list(by), "left")
    fn = F.coalesce("_f", "_pf", F.raise_error("no calibrated cell and no pooled cell").cast("string"))
    s = F.coalesce("_s", "_ps")
    lo, mid, hi = F.col("q10"), F.col("q50"), F.col("q90")
    cqr = fn == "cqr"
    return rows.withColumns({
        "band_lo": F.when(cqr, mid - (1.0 + s) * (mid - lo)).otherwise(mid - s),
        "band_hi": F.when(cqr, mid + (1.0 + s) * (hi - mid)).otherwise(mid + s)}).drop("_f", "_s", "_pf", "_ps")


def coverage(df: DataFrame, by: Sequence[str] = ("horizon",), y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(y).between(F.col("band_lo"), F.col("band_hi")).cast("double")).alias("coverage"),
                               F.count(F.lit(1)).alias("n_test"))


def chronological_parts(df: DataFrame, *, by: Sequence[str] = ("horizon",), time: str = "date", frac: float = 0.5) -> DataFrame:
    """Rows with ``part``: 'cal' up to the first instant reaching ``frac`` of the rows, then 'test'.

    Only per-instant counts are ordered; an instant is never torn.
    """
    counts = df.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    cum = F.sum("_n").over(w.orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    goal = F.floor(F.sum("_n").over(w) * F.lit(float(frac)))
    marks = counts.select(*by, time, F.when(F.coalesce(cum, F.lit(0)) < goal, "cal").otherwise("test").alias("part"))
    return df.join(marks, [*by, time])


def calibrate_and_score(df: DataFrame, *, by: Sequence[str] = ("horizon",), bucket: str = "vol_bucket",
                        time: str = "date", y: str = "y", alpha: float = 0.2, frac: float = 0.5,
                        min_cell_size: int = 1000) -> DataFrame:
    """Calibrate on the earlier part, report coverage on the later part.

    The split rows feed several aggregations, so they are written to the checkpoint
    folder once instead of being derived again for each.
    """
    keep = [*by, time, bucket, y, "q10", "q50", "q90"]
    parts = durable(chronological_parts(df.select(*dict.fromkeys(keep)), by=by, time=time, frac=frac))
    cells = calibrate(parts.filter("part = 'cal'"), by=by, bucket=bucket, y=y, alpha=alpha, min_cell_size=min_cell_size)
    return coverage(bands(parts.filter("part = 'test'"), cells, by=by, bucket=bucket), by, y)


def coverage_curve(cal: DataFrame, test: DataFrame, *, by: Sequence[str] = ("horizon",), pred: str = "pred_lr",
                   real: str = "real_lr", alphas: Sequence[float] = LEVELS) -> DataFrame:
    """Half-width and test coverage of symmetric bands at each nominal level."""
    resid = cal.select(*by, F.abs(F.col(real) - F.col(pred)).alias("_r"))
    cut = ranking.kth_smallest(resid, by, "_r", {f"q{i}": finite_sample_k(a) for i, a in enumerate(alphas)})
    err = F.abs(F.col(real) - F.col(pred))
    hit = test.join(cut, list(by)).groupBy(*by).agg(
        *[F.avg((err <= F.col(f"q{i}")).cast("double")).alias(f"c{i}") for i in range(len(alphas))],
        *[F.max(f"q{i}").alias(f"q{i}") for i in range(len(alphas))])
    return hit.select(*by, F.explode(F.array(*[
        F.struct(F.lit(1.0 - a).alias("nominal"), F.col(f"c{i}").alias("actual"), (F.col(f"q{i}") * 2).alias("width"))
        for i, a in enumerate(alphas)])).alias("x")).select(*by, "x.nominal", "x.actual", "x.width")


def residual_profile(cal: DataFrame, test: DataFrame, *, by: Sequence[str] = ("horizon",), pred: str = "pred_lr",
                     real: str = "real_lr") -> DataFrame:
    """Residual median and p90 on calibration rows, correlations on test rows."""
    from tickloom.plans.metrics import pooled_ic

    resid = cal.select(*by, F.abs(F.col(real) - F.col(pred)).alias("_r"))
    q = ranking.pool_quantiles(resid, by, "_r", {"residual_p50": 0.5, "residual_p90": 0.9})
    pearson = test.groupBy(*by).agg(F.corr(pred, real).alias("pearson"))
    return q.join(pearson, list(by)).join(
        pooled_ic(test, by, pred, real).select(*by, F.col("n").alias("n_test"), F.col("ic").alias("spearman")), list(by))
