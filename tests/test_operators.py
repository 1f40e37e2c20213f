"""Ordering, as-of and ranking helpers against brute force."""

import datetime as dt

import numpy as np
import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from tickloom.operators import ranking, tradingdays as td
from tickloom.operators.asof import asof
from tickloom.operators.series import carry_forward, over_series, running_total


def test_split_series_equals_one_window(spark, bars_factory):
    bars = bars_factory(days=6)

    def cols(w):
        f = w.rowsBetween(-4, 3)
        return {"lagged": F.lag("close", 5).over(w), "led": F.lead("close", 7).over(w), "s": F.sum("volume").over(f), "n": F.count("*").over(f)}

    plain = over_series(bars, cols, lookback=5, lookahead=7)
    for bucket, rows in (("day", 20), ("hour", 9), ("hour", 40)):
        split = over_series(bars, cols, lookback=5, lookahead=7, chunk_rows=rows, bucket=bucket)
        assert as_rows(split.select(plain.columns), "symbol", "ts") == as_rows(plain, "symbol", "ts")


def test_carry_and_running_total(spark, bars_factory):
    bars = bars_factory().withColumn("x", F.when(F.col("volume") % 4 == 0, F.col("close")))
    got = carry_forward(bars, ["x"], keys=["symbol"], order="ts", bucket="hour").toPandas().sort_values(["symbol", "ts"])
    want = bars.toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(got["x"].to_numpy(), want.groupby("symbol")["x"].ffill().to_numpy(), equal_nan=True)
    tot = running_total(bars, F.col("volume"), "cum", keys=["symbol"], order=["ts"], bucket=F.date_trunc("hour", "ts"))
    tot = tot.toPandas().sort_values(["symbol", "ts"])
    assert (tot["cum"].to_numpy() == want.groupby("symbol")["volume"].cumsum().to_numpy()).all()


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("bucket", [None, "hour"])
def test_asof(spark, strict, bucket):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=int(m))
    left = [(i, "ab"[i % 2], at(rng.integers(0, 600))) for i in range(120)]
    right = sorted({("ab"[int(rng.random() < 0.9)], at(rng.integers(30, 500))) for _ in range(80)})
    right = [(s, t, i) for i, (s, t) in enumerate(right)]
    out = asof(spark.createDataFrame(left, "id int, symbol string, t timestamp"), spark.createDataFrame(right, "symbol string, rt timestamp, v int"),
               left_time="t", right_time="rt", strict=strict, bucket=bucket)
    got = {r["id"]: r["v"] for r in out.collect()}
    for i, s, t in left:
        fit = [(rt, v) for rs, rt, v in right if rs == s and (rt < t if strict else rt <= t)]
        assert got[i] == (max(fit)[1] if fit else None)


def test_pool_parts_stay_even_under_outliers(spark):
    rng = np.random.default_rng(8)
    odd = [1e18, float("inf"), float("-inf"), float("nan"), -1e300]
    df = spark.createDataFrame([(float(v),) for v in [*rng.normal(size=20_000), *odd]], "v double").withColumn("g", F.lit("all"))
    ranking.PARTS = 40
    try:
        parts = [r["count"] for r in ranking.layout(df, ["g"], "v", {}).groupBy("_part").count().collect()]
        top = ranking.value_positions(df, [], "v").orderBy(F.col("before").desc()).limit(3).collect()
    finally:
        ranking.PARTS = None
    assert len(parts) == 40 and max(parts) < 3 * 20_005 / 40
    assert [r["before"] for r in top] == [20_004, 20_003, 20_002] and top[1]["v"] == float("inf") and top[0]["v"] != top[0]["v"]


def test_pool_order_statistics(spark):
    rng = np.random.default_rng(5)
    big = np.concatenate([rng.normal(size=3000), np.zeros(1500), rng.normal(size=10) * 1e6])
    rows = [("hot", float(v)) for v in big] + [("small", float(v)) for v in rng.normal(size=7)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranking.PARTS = 20
    try:
        q = {r["g"]: r for r in ranking.pool_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}).collect()}
        k = {r["g"]: r["x"] for r in ranking.kth_smallest(df, ["g"], "v", {"x": F.ceil(F.col("total") * 0.8)}).collect()}
        pr = ranking.pool_average_rank(df, ["g"], "v", "r").toPandas()
    finally:
        ranking.PARTS = None
    for g in ("hot", "small"):
        v = np.array([x for gg, x in rows if gg == g])
        assert np.allclose([q[g][c] for c in "abcd"], np.quantile(v, [0, 0.37, 0.95, 1]))
        assert k[g] == np.sort(v)[int(np.ceil(len(v) * 0.8)) - 1]
        mine = pr[pr.g == g].sort_values("v")
        import pandas as pd
        assert np.allclose(mine["r"].to_numpy(), pd.Series(np.sort(v)).rank().to_numpy())


def test_calendar_shift_counts_the_snap(spark):
    days = [dt.date(2026, 1, 5) + dt.timedelta(days=i) for i in range(19)]
    days = [d for d in days if d.weekday() < 5 and d != dt.date(2026, 1, 14)]
    cal = spark.createDataFrame([(d,) for d in days], "trade_date date")

    def shift(n):
        return {r["day"]: r["target"] for r in td.shift_table(cal, n).collect()}

    sat = dt.date(2026, 1, 10)
    assert shift(1)[sat] == dt.date(2026, 1, 12) and shift(2)[sat] == dt.date(2026, 1, 13)
    assert shift(-1)[sat] == dt.date(2026, 1, 9) and sat not in shift(0)
    assert shift(1)[dt.date(2026, 1, 13)] == dt.date(2026, 1, 15)
    assert dt.date(2026, 1, 23) not in shift(1)
    capped = td.shift_table(cal, 1, as_of=F.lit("2026-01-12").cast("date"))
    assert max(r["target"] for r in capped.collect()) == dt.date(2026, 1, 12)


def test_folds_keep_the_embargo(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    days = [d for d in days if d.weekday() < 5]
    pos = {d: i for i, d in enumerate(days)}
    folds = td.walk_forward(spark.createDataFrame([(d,) for d in days], "trade_date date"),
                            first_test_end=F.lit("2024-08-03").cast("date"), embargo=5, val=10, test=10, roll=15).collect()
    assert folds
    for f in folds:
        assert pos[f["val_start"]] - pos[f["train_end"]] == 6 and pos[f["test_start"]] - pos[f["val_end"]] == 6
        assert pos[f["test_end"]] - pos[f["test_start"]] == 9 and f["train_start"] == days[0]
