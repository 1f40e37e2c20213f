"""Keeping bar tables correct: overlap checks, merges, key shifts, corporate actions.

Merges are joins that return the new version of the table; :func:`tickloom.sources.store.publish`
writes it beside the old one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import clock, shapes
from tickloom.operators import ranking

KEYS = ("symbol", "ts", "scale")
VALUES = ("open", "high", "low", "close", "volume")


def insert_missing(production: DataFrame, staged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Staged rows whose key production lacks (append these)."""
    return staged.join(production.select(*keys), list(keys), "left_anti")


def merge_insert(production: DataFrame, staged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return production.unionByName(insert_missing(production, staged, keys).select(*production.columns))


def _paired(production: DataFrame, staged: DataFrame, how: str) -> DataFrame:
    p = production.select(*KEYS, F.struct(*VALUES).alias("p"))
    s = staged.select(*KEYS, F.struct(*VALUES).alias("s"))
    return p.join(s, list(KEYS), how).withColumn("gap", shapes.relative_gap(F.col("s.close"), F.col("p.close")))


def merge_update(production: DataFrame, staged: DataFrame, *, threshold: float) -> DataFrame:
    """New table: diverging rows take the staged values, missing rows are added, the rest stay.

    ``action`` says what happened to each row.
    """
    both = _paired(production, staged, "full")
    diverges = F.coalesce(F.col("gap") > threshold, F.lit(False))
    action = (F.when(F.col("p").isNull(), "inserted").when(diverges, "updated").otherwise("kept"))
    pick = F.when(F.col("p").isNull() | diverges, F.col("s")).otherwise(F.col("p"))
    return both.select(*KEYS, pick.alias("v"), action.alias("action")).select(*KEYS, "v.*", "action")


def overlap_check(production: DataFrame, staged: DataFrame, *, tolerance: float) -> DataFrame:
    """Rows in both tables: count, count over tolerance, worst and 95th percentile gap."""
    rows = _paired(production, staged, "inner").select("gap")
    q = ranking.pool_quantiles(rows, [], "gap", {"p95_rel_diff": 0.95}).withColumn("_j", F.lit(0))
    a = rows.agg(F.count(F.lit(1)).alias("n_overlap"), F.count_if(F.col("gap") > tolerance).alias("n_diff"),
                 F.max("gap").alias("max_rel_diff")).withColumn("_j", F.lit(0))
    return a.join(q, "_j", "left").drop("_j")


def diff_summary(production: DataFrame, staged: DataFrame, *, threshold: float) -> DataFrame:
    """Per scale: staged rows missing in, diverging from and matching production."""
    rows = _paired(production, staged, "right")
    known = F.col("p.close").isNotNull()
    return rows.groupBy("scale").agg(
        F.count(F.lit(1)).alias("n_staged"), F.count_if(~known).alias("n_missing_in_prod"),
        F.count_if(known & (F.col("gap") > threshold)).alias("n_diverge"),
        F.count_if(known & (F.col("gap") <= threshold)).alias("n_match"))


# ------------------------------------------------------------- misplaced daily stamps

# Clock of daily bars stamped at midnight exchange time.
ROGUE_HOUR, ROGUE_MINUTE = 18, 30


def rogue() -> Column:
    return (F.col("scale") == "day") & (F.hour("ts") == ROGUE_HOUR) & (F.minute("ts") == ROGUE_MINUTE)


def rogue_summary(bars: DataFrame) -> DataFrame:
    d = clock.exchange_date(F.col("ts"))
    return bars.filter(rogue()).agg(F.count(F.lit(1)).alias("n_rogue"), F.count_distinct("symbol").alias("n_symbols"),
                                    F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def rogue_sample(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.filter(rogue()).select("symbol", clock.exchange_date(F.col("ts")).alias("date"), "ts", "close").orderBy("symbol", "ts").limit(n)


def shift_collisions(bars: DataFrame) -> DataFrame:
    """How many shifted rows would land on an existing daily bar."""
    moved = bars.filter(rogue()).select("symbol", clock.daily_open_to_close(F.col("ts")).alias("ts"))
    return moved.join(bars.filter(F.col("scale") == "day").select("symbol", "ts"), ["symbol", "ts"]).agg(F.count(F.lit(1)).alias("n_collisions"))


def shift_rogue(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ts", F.when(rogue(), clock.daily_open_to_close(F.col("ts"))).otherwise(F.col("ts")))


# -------------------------------------------------------------------- calendar refresh

def calendar_diff(existing: DataFrame, refresh: DataFrame) -> DataFrame:
    """Days only in the refresh (``new``) and days it lacks inside the common range (``discrepancy``)."""
    e, r = existing.select("trade_date").distinct(), refresh.select("trade_date").distinct()
    new = r.join(e, "trade_date", "left_anti").withColumn("kind", F.lit("new"))
    lim = lambda df, n: df.agg(F.min("trade_date").alias(f"{n}_lo"), F.max("trade_date").alias(f"{n}_hi")).withColumn("_j", F.lit(0))
    span = lim(e, "e").join(lim(r, "r"), "_j")
    gone = e.join(r, "trade_date", "left_anti").withColumn("_j", F.lit(0)).join(span, "_j").filter(
        F.col("trade_date").between(F.greatest("e_lo", "r_lo"), F.least("e_hi", "r_hi")))
    return new.unionByName(gone.select("trade_date", F.lit("discrepancy").alias("kind")))


# ------------------------------------------------------------------ corporate actions

def close_ratios(vendor: DataFrame, production: DataFrame) -> DataFrame:
    """Daily vendor / production close per symbol and exchange date."""
    side = lambda df, n: df.filter(F.col("scale") == "day").select(
        "symbol", clock.exchange_date(F.col("ts")).alias("dt"), F.col("close").alias(n))
    return side(vendor, "v").join(side(production, "p"), ["symbol", "dt"]).select(
        "symbol", "dt", F.round(F.try_divide("v", "p"), 6).alias("ratio")).filter("ratio IS NOT NULL")


SEGMENT_SCHEMA = "symbol string, start_date date, end_date date, n_rows bigint, median_ratio double"


def ratio_segments(ratios: DataFrame, *, noise: float) -> DataFrame:
    """Runs of days whose ratio stays within ``noise`` of the run's own median so far.

    The rule is sequential, so each symbol's daily series (one row per trading day)
    runs in one Arrow group.
    """
    def split(pdf):
        import bisect
        import pandas as pd

        pdf = pdf.sort_values("dt")
        out, run, start, prev = [], [], None, None
        for d, x in zip(pdf["dt"], pdf["ratio"]):
            if run and abs(x - run[len(run) // 2]) > noise:
                out.append((pdf["symbol"].iloc[0], start, prev, len(run), run[len(run) // 2]))
                run = []
            if not run:
                start = d
            bisect.insort(run, x)
            prev = d
        if run:
            out.append((pdf["symbol"].iloc[0], start, prev, len(run), run[len(run) // 2]))
        return pd.DataFrame(out, columns=["symbol", "start_date", "end_date", "n_rows", "median_ratio"])

    return ratios.groupBy("symbol").applyInPandas(split, SEGMENT_SCHEMA)


def propose(segments: DataFrame, *, dividend_band: float, min_days: int = 3) -> DataFrame:
    """Readjustments that bring each older segment onto the scale of the next one."""
    w = Window.partitionBy("symbol").orderBy("start_date")
    nxt = segments.withColumns({"_m": F.lead("median_ratio").over(w), "_n": F.lead("n_rows").over(w), "_s": F.lead("start_date").over(w)})
    ratio = F.when(F.col("_m") != 0, F.col("median_ratio") / F.col("_m")).otherwise(0.0)
    return nxt.filter(F.col("_s").isNotNull()).withColumn("_r", ratio).filter(
        (F.abs(F.col("_r") - 1.0) > dividend_band) & (F.col("n_rows") >= min_days) & (F.col("_n") >= min_days)).select(
        "symbol", F.round("_r", 6).alias("ratio"), F.col("_s").alias("cutoff_date_ist"),
        F.format_string("level shift on %s: %.4f before, %.4f after", F.col("_s").cast("string"), "median_ratio", "_m").alias("event"),
        F.lit("proposed from close ratios, not yet reviewed").alias("notes"))


def ledger_key() -> Column:
    return F.concat_ws("|", "symbol", F.coalesce(F.col("cutoff_date_ist").cast("string"), F.lit("ALL")), F.format_string("%.10g", F.col("ratio")))


def pending(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adjustments not yet in the ledger."""
    return plan.withColumn("_k", ledger_key()).join(ledger.select(ledger_key().alias("_k")), "_k", "left_anti").drop("_k")


def ledger_append(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    return ledger.unionByName(pending(plan, ledger).dropDuplicates(["symbol", "cutoff_date_ist", "ratio"]).select(*ledger.columns))


def _affected(bars: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    p = plan.select(F.col("symbol").alias("_s"), F.col("ratio"), F.col("cutoff_date_ist"))
    day = clock.exchange_date(F.col("ts"))
    return bars.join(p, (F.col("symbol") == F.col("_s")) & (F.col("cutoff_date_ist").isNull() | (day < F.col("cutoff_date_ist"))), how)


def adjustment_preview(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """Per adjustment: rows, scales, dates and date range it would touch."""
    d = clock.exchange_date(F.col("ts"))
    return _affected(bars, plan).groupBy("symbol", "ratio", "cutoff_date_ist").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("scale").alias("n_scales"), F.count_distinct(d).alias("n_dates"),
        F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def apply_adjustments(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """Prices times the product of the ratios that apply, volume divided by it (whole shares).

    Per symbol the plan is a short ordered list held in one array, so every bar meets
    one plan row and takes the product over later cutoffs.
    """
    per = plan.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("cutoff_date_ist", F.lit("9999-12-31").cast("date")).alias("c"), F.col("ratio").alias("r")))).alias("_plan"))
    day = clock.exchange_date(F.col("ts"))
    out = bars.join(per, "symbol", "left").withColumn("_f", F.coalesce(F.aggregate(
        "_plan", F.lit(1.0), lambda f, x: F.when(day < x["c"], f * x["r"]).otherwise(f)), F.lit(1.0)))
    changed = F.col("_f") != 1.0
    cols = {c: F.col(c) * F.col("_f") for c in ("open", "high", "low", "close")}
    cols["volume"] = F.when(changed, F.round(F.col("volume") / F.col("_f")).cast("long")).otherwise(F.col("volume"))
    return out.withColumns(cols).drop("_plan", "_f")
