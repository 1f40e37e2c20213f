"""Nothing may depend on rows that were not known by ``as_of``."""

import datetime as dt

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.plans import features as ft, labels as lb

MOMENTS = [dt.datetime(2024, 6, 4, 5, 2), dt.datetime(2024, 6, 5, 9, 55), dt.datetime(2024, 6, 6, 3, 45)]


def rounded(df):
    return as_rows(df.select(*[F.round(c, 9).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]))


@pytest.mark.parametrize("cap", MOMENTS)
def test_truncated_history_gives_the_same_answer(spark, bars_factory, cap):
    bars = bars_factory().cache()
    known = bars.filter(clock.effective_close("scale", "ts") <= clock.as_instant(cap))
    far = "2100-01-01"
    for f in (lambda b, t: ft.compute_features(b, scale="5m", as_of=t), lambda b, t: lb.intraday_labels(b, "30m", as_of=t)):
        assert rounded(f(bars, cap)) == rounded(f(known, far))
    out = lb.intraday_labels(bars, "15m", as_of=cap)
    assert out.filter(F.col("t_horizon") > clock.as_instant(cap)).count() == 0


def test_anchor_features_are_strictly_before(spark, bars_factory):
    bars = bars_factory(days=3, drop=0.0)
    store = bars.withColumn("x", F.unix_seconds("ts").cast("double"))
    anchors = bars.select("symbol", clock.effective_close_of("5m", "ts").alias("anchor_ts"))
    m = ft.anchor_matrix({"5m": store}, anchors, as_of="2100-01-01", window_bars={"5m": 2}, channels=("x",), keep=("5m__x__last",))
    # the newest usable bar closed before the anchor, i.e. opened at least ten minutes before it
    late = m.filter(F.col("5m__x__last") > F.unix_seconds("anchor_ts") - 600)
    assert m.count() > 0 and late.count() == 0


def test_split_features_equal_unsplit(spark, bars_factory):
    bars = bars_factory(days=5)
    a = ft.compute_features(bars, scale="5m", as_of="2100-01-01")
    b = ft.compute_features(bars, scale="5m", as_of="2100-01-01", chunk_rows=64)
    assert rounded(a) == rounded(b.select(a.columns))


def test_label_arithmetic(spark):
    t0 = dt.datetime(2024, 6, 3, 3, 45)
    closes = [100.0, 101.0, 99.0, 102.0, 103.0]
    rows = [("A", t0 + dt.timedelta(minutes=5 * i), "5m", c - 0.05, c + 0.1, c - 0.1, c, 0 if i == 2 else 1000) for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, scale string, open double, high double, low double, close double, volume long")
    out = {r["t"]: r for r in lb.intraday_labels(bars, "15m", as_of="2100-01-01").collect()}
    first = out[t0 + dt.timedelta(minutes=5)]
    assert len(out) == 2 and abs(first["y_log_return"] - 0.0198026) < 1e-6
    assert first["halt_count"] == 1 and not first["valid_label"]
