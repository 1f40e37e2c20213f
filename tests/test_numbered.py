"""Windows and statistics by bar number, versioned tables, interval joins and far calendar dates."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import numbered as nb, tradingdays as td
from tickloom.plans import features as ft
from tickloom.sources import store, versioned


def series(spark, n=230, symbols=("A", "B"), seed=1, holes=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        for i in range(n):
            at = dt.datetime(2024, 1, 28) + dt.timedelta(hours=7 * i)
            x = None if holes and rng.random() < 0.02 else float(rng.normal(1e6, 1.0))
            rows.append((s, at, x, float(rng.integers(0, 3))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double, y double").repartition(5)


def test_number_rows(spark):
    got = nb.number_rows(series(spark)).orderBy("symbol", "ts").select("symbol", "n").collect()
    assert [(r.symbol, r.n) for r in got] == [(s, i) for s in "AB" for i in range(230)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 230, 500])
def test_stats_at_equals_rolling(spark, size):
    rows = nb.number_rows(series(spark)).withColumn("size", F.lit(size).cast("long"))
    wanted = rows.filter("n % 3 <> 1").select("symbol", "size", F.col("n").alias("k"))
    lags = [k for k in (1, 3) if k < size]
    got = {(r.symbol, r.k): r for r in nb.stats_at(rows, wanted.unionByName(wanted), ["x", "y"], lags=lags).collect()}
    want = {}
    for s, part in rows.orderBy("ts").toPandas().groupby("symbol"):
        part = part.reset_index(drop=True)[["x", "y"]].astype(float)
        roll = part.rolling(size, min_periods=size)
        for k in range(size - 1, len(part)):
            if k % 3 != 1:
                want[s, k] = {"mean": roll.mean().iloc[k], "std": roll.std().iloc[k], "min": roll.min().iloc[k], "max": roll.max().iloc[k],
                              "last": part.iloc[k], "first": part.iloc[k - size + 1], **{f"lag{b}": part.iloc[k - b] for b in lags}} if k < size + 40 else None
    assert set(got) == set(want)
    for key, stats in want.items():
        for name, values in (stats or {}).items():
            np.testing.assert_allclose(np.array(got[key][name], float), values.to_numpy(), rtol=1e-9, atol=1e-7 if name == "std" else 0)


def test_windows_at(spark):
    rows = nb.number_rows(series(spark, holes=False))
    left = spark.createDataFrame([(s, k, f"row{k}") for s in "ABC" for k in (None, 0, 5, 6, 7, 13, 100, 229)], "symbol string, k long, n string")
    plain = {(r.symbol, r.n): r.x for r in rows.collect()}
    want = {(s, k): [plain[s, i] for i in range(k - 6, k + 1)] for s in "AB" for k in (6, 7, 13, 100, 229)}
    got = nb.windows_at(left, rows, ["x"], size=7, at="k", name="w").collect()
    assert {(r.symbol, r.k): [v.x for v in r.w] for r in got} == want
    partial = nb.windows_at(left, rows, ["x"], size=7, at="k", name="w", partial=True).collect()
    assert len(partial) == 24 and sum(r.w is not None for r in partial) == len(want)
    assert nb.windows_at(left.filter("false"), rows, ["x"], size=7, at="k", name="w").count() == 0


def test_matrix_by_number_equals_frames(spark, bars_factory):
    bars = bars_factory(days=6, drop=0.05)
    stores = {"5m": ft.feature_store(bars, scale="5m", as_of="2100-01-01")}
    anchors = stores["5m"].select("symbol", F.col("ts").alias("anchor_ts"))
    kw = dict(as_of="2024-06-07 06:00:00", window_bars={"5m": 40})
    names = ft.matrix_columns(["5m"])
    a = ft.anchor_matrix(stores, anchors, **kw).select("symbol", "anchor_ts", *names).toPandas().sort_values(["symbol", "anchor_ts"])
    b = ft.full_anchor_matrix(stores, anchors, **kw).select("symbol", "anchor_ts", *names).toPandas().sort_values(["symbol", "anchor_ts"])
    assert len(a) > 50 and len(names) == 133 and len(ft.matrix_columns()) == 457
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), rtol=1e-9, atol=1e-9)


def test_versioned_merge_reads_only_touched_files(spark, bars_factory, tmp_path):
    bars, root = bars_factory(symbols=("AA", "BB", "CC", "DD")), str(tmp_path / "t")
    assert versioned.create(bars, root, files=8) == 1
    late = bars.filter("symbol = 'BB' AND ts > '2024-06-05'").withColumn("close", F.col("close") * 2)
    old = versioned.manifest(spark, root)
    paths = {r.path for r in versioned.touched(old, late).collect()}
    assert 0 < len(paths) < old.select("path").distinct().count() / 2
    assert versioned.merge(late, root, versioned.replaced_by(0.01), files=2) == 2
    kept = {r.path for r in versioned.manifest(spark, root).collect()}
    assert not kept & paths and {r.path for r in old.collect()} - paths <= kept
    want = bars.join(late.select("symbol", "ts", F.col("close").alias("c2")), ["symbol", "ts"], "left").withColumn("close", F.coalesce("c2", "close")).drop("c2")
    rows = lambda df: sorted(map(tuple, df.select(*store.BAR_COLUMNS).collect()))
    assert rows(versioned.open_table(spark, root)) == rows(want)
    assert rows(versioned.open_table(spark, root, 1)) == rows(bars)
    # rows of a series the table lacks become files of their own
    versioned.merge(bars_factory(symbols=("EE",)), root, versioned.replaced_by(0.01), files=1)
    assert versioned.open_table(spark, root).filter("symbol = 'EE'").count() == bars_factory(symbols=("EE",)).count()
    versioned.vacuum(spark, root)
    assert versioned.versions(spark, root) == [3] and versioned.open_table(spark, root).filter("symbol <> 'EE'").count() == bars.count()
    with pytest.raises(ValueError):
        versioned.open_table(spark, root, 1)


def test_versioned_crash_and_conflict(spark, bars_factory, tmp_path, monkeypatch):
    bars, root = bars_factory(symbols=("AA", "BB")), str(tmp_path / "t")
    versioned.create(bars, root, files=4)
    late = bars.filter("symbol = 'AA'").withColumn("close", F.col("close") * 3)
    before = sorted(map(tuple, versioned.open_table(spark, root).collect()))
    with monkeypatch.context() as m:  # dies after the new files are written, before the commit
        m.setattr(versioned, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versioned.merge(late, root, versioned.replaced_by(0.01))
    assert sorted(map(tuple, versioned.open_table(spark, root).collect())) == before and versioned.versions(spark, root) == [1]
    versioned.merge(late, root, versioned.replaced_by(0.01))
    with pytest.raises(versioned.Conflict):  # a second writer that also started from version 1
        versioned.merge(late, root, versioned.replaced_by(0.01), base=1)
    assert versioned.versions(spark, root) == [1, 2]
    assert versioned.open_table(spark, str(tmp_path / "none")).count() == 0


def test_view(spark, bars_factory, tmp_path):
    bars = bars_factory(symbols=("AA",))
    path = store.publish(bars, str(tmp_path / "p"))
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    assert versioned.create_view(spark, "bars_view_test", path, kinds).count() == bars.count()
    assert spark.sql("SELECT count(*) AS n FROM bars_view_test WHERE volume >= 0").first().n == bars.count()
    with pytest.raises(ValueError):
        versioned.create_view(spark, "bars_view_test", path, {**kinds, "volume": "double"})
    with pytest.raises(ValueError):
        versioned.create_view(spark, "bars_view_test", os.path.join(str(tmp_path), "absent"), kinds)
    spark.sql("DROP VIEW bars_view_test")


def test_by_interval_equals_range_join(spark):
    rng = np.random.default_rng(2)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=int(n))
    rows = [(i, day(rng.integers(0, 90)) if i % 11 else None) for i in range(300)]
    spans = [(f"f{i}", day(a), day(a + b)) for i, (a, b) in enumerate(zip(rng.integers(5, 60, 12), rng.integers(-3, 40, 12)))]
    got = td.by_interval(spark.createDataFrame(rows, "i int, d date"), spark.createDataFrame(spans, "name string, lo date, hi date"), "d")
    assert sorted((r.i, r.name) for r in got.collect()) == sorted((i, n) for i, d in rows for n, a, b in spans if d and a <= d <= b)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_far_dates(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-01", "2024-02-29")]
    cal = spark.createDataFrame([(d,) for d in days], "trade_date date")
    asked = [dt.date(2019, 5, 5), days[0], days[3], dt.date(2024, 1, 6), days[-1], dt.date(2030, 1, 1)]
    dates = spark.createDataFrame([(d,) for d in asked], "day date")
    for n in (-3, -1, 0, 1, 4):
        want = {}
        for d in asked:
            upto, before = sum(x <= d for x in days), sum(x < d for x in days)
            at = upto + n - 1 if n > 0 else before + n
            if (n or d in days) and 0 <= at < len(days):
                want[d] = days[at]
        assert {r.day: r.target for r in td.shift_table(cal, n, dates=dates).collect()} == want
    nav = {r.day: r for r in td.navigation(cal, dates=dates).collect()}
    assert set(nav) == set(asked) and nav[dt.date(2030, 1, 1)].prev_day == days[-1] and nav[dt.date(2030, 1, 1)].next_day is None
