import os
"""Storage, vendor payloads, merges, corporate actions, pairs."""

import datetime as dt
import itertools
import json

import numpy as np
import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from tickloom.plans import backtest as bt, cohort as co, maintenance as mn
from tickloom.plans import audit
from tickloom.sources import dimensions as dm, store, vendor


def test_bar_store_round_trip(spark, bars_factory, tmp_path):
    root = str(tmp_path / "bars")
    bars = bars_factory()
    store.write_bars(bars, root)
    assert as_rows(store.read_bars(spark, root, as_of="2100-01-01"), "symbol", "ts") == as_rows(bars, "symbol", "ts")
    cut = store.read_bars(spark, root, as_of="2024-06-04 05:00:00", scale="5m", symbols=["AA"])
    assert cut.agg(F.max("ts")).first()[0] <= dt.datetime(2024, 6, 4, 5) and [r[0] for r in cut.select("symbol").distinct().collect()] == ["AA"]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "LessThanOrEqual(ts" in plan
    assert store.read_bars(spark, str(tmp_path / "none"), as_of="2100-01-01").count() == 0
    with pytest.raises(ValueError):
        store.write_bars(bars.unionByName(bars.limit(1)), root)
    with pytest.raises(ValueError):
        store.write_bars(bars.filter("false"), root)
    store.write_bars(bars.filter("symbol = 'AA'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 YEAR")), root)
    # the whole series is replaced, in the years it leaves too; the others stay
    assert store.open_bars(spark, root).count() == bars.count()
    assert store.read_bars(spark, root, as_of="2024-12-31").filter("symbol = 'AA'").count() == 0


def test_write_bars_keeps_other_symbols(spark, bars_factory, tmp_path):
    root, bars = str(tmp_path / "bars"), bars_factory(symbols=("AA", "BB"))
    store.write_bars(bars, root)
    store.write_bars(bars.filter("symbol = 'AA'").limit(3), root, only=("5m", "AA"))
    left = {r["symbol"]: r["count"] for r in store.open_bars(spark, root).groupBy("symbol").count().collect()}
    assert left == {"AA": 3, "BB": bars.filter("symbol = 'BB'").count()}
    with pytest.raises(ValueError):
        store.write_bars(bars, root, only=("5m", "AA"))
    assert store.open_bars(spark, root).count() == 3 + left["BB"]


def test_published_reads_the_newest_whole_version(spark, bars_factory, tmp_path):
    root, bars = str(tmp_path / "p"), bars_factory()
    with pytest.raises(FileNotFoundError):
        store.published(spark, root)
    store.publish(bars, root)
    second = store.publish(bars.filter("symbol = 'AA'"), root)
    assert store.published(spark, root).count() == bars.filter("symbol = 'AA'").count()
    os.remove(f"{second}/_SUCCESS")
    assert as_rows(store.published(spark, root), "symbol", "ts") == as_rows(bars, "symbol", "ts")


def test_only_an_absent_path_reads_as_empty(spark, bars_factory, tmp_path):
    root = str(tmp_path / "bad")
    bars_factory().withColumn("ts", F.lit("not a time")).write.partitionBy("scale").parquet(root)
    assert store.open_bars(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        store.open_bars(spark, root).select("ts").collect()


def test_freshness_far_from_the_calendar(spark, bars_factory):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-02-29', INTERVAL 1 DAY)) AS trade_date").filter("weekday(trade_date) < 5")
    bars = bars_factory(days=1, scale="day").withColumn("ts", F.lit("2024-01-05 10:00:00").cast("timestamp"))
    for today in ("2024-03-20", "2024-06-20", "2034-01-01"):
        row = audit.freshness(bars, days, today=F.lit(today).cast("date"), scales=("day",)).filter("check = 'bars_day'").first()
        assert (row["got"], row["status"]) == (39, "STALE")


def test_append_missing_is_idempotent(spark, bars_factory, tmp_path):
    root, bars = str(tmp_path / "t"), bars_factory()
    store.append_missing(bars.filter("symbol = 'AA'"), root, ["symbol"])
    for _ in range(2):
        store.append_missing(bars, root, ["symbol"])
    assert spark.read.parquet(root).count() == bars.count()


def test_vendor_rows(spark):
    good = [1717372800, 100.0, 110.0, 99.0, 105.0, 1000]
    raw = spark.createDataFrame([
        ("A", "5m", 1, json.dumps({"candles": [good, good[:3], [good[0], "x", 1, 1, 1, 1], [*good, None]]})),
        ("B", "day", 1, json.dumps({"payload": {"candles": [[1717353000, 1, 2, 0.5, 1.5, 7]]}}))], "symbol string, scale string, chunk int, payload string")
    ok, bad = vendor.candles_from_arrays(raw)
    rows = {(r["symbol"], r["ts"]) for r in ok.collect()}
    assert rows == {("A", dt.datetime(2024, 6, 3)), ("B", dt.datetime(2024, 6, 3, 10))} and ok.count() == 3 and bad.count() == 2
    rec = spark.createDataFrame([("A", "5m", 1, json.dumps([{"date": "2024-06-03 09:15:00", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3},
                                                            {"date": "2024-06-03T03:45:00Z", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3}]))],
                                "symbol string, scale string, chunk int, payload string")
    assert {r["ts"] for r in vendor.candles_from_records(rec)[0].collect()} == {dt.datetime(2024, 6, 3, 3, 45)}


def segments_brute(ratios, noise):
    out, run = [], []
    for x in ratios:
        if run and abs(x - sorted(run)[len(run) // 2]) > noise:
            out.append((len(run), sorted(run)[len(run) // 2]))
            run = []
        run.append(x)
    return out + [(len(run), sorted(run)[len(run) // 2])]


def test_ratio_segments_and_proposals(spark):
    rng = np.random.default_rng(2)
    series = {"A": [0.5] * 5 + [1.0] * 6, "B": list(1 + rng.normal(0, 0.004, 40)), "C": [1.0] * 5 + [1.3] * 2 + [1.0] * 5}
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x)) for s, v in series.items() for i, x in enumerate(v)]
    seg = mn.ratio_segments(spark.createDataFrame(rows, "symbol string, dt date, ratio double"), noise=0.005)
    got = {}
    for r in seg.orderBy("symbol", "start_date").collect():
        got.setdefault(r["symbol"], []).append((r["n_rows"], r["median_ratio"]))
    assert got == {s: segments_brute(v, 0.005) for s, v in series.items()}
    plan = mn.propose(seg, dividend_band=0.05).collect()
    assert [(p["symbol"], p["ratio"], p["cutoff_date_ist"]) for p in plan if p["symbol"] != "B"] == [("A", 0.5, dt.date(2024, 1, 6))]


def test_adjustments_validate_and_apply_once(spark, bars_factory):
    for bad in (0, 1.0, -2):
        with pytest.raises(ValueError):
            dm.adjustments(spark, [dict(symbol="AA", ratio=bad)])
    plan = dm.adjustments(spark, [dict(symbol="AA", ratio=0.5, cutoff_date_ist="2024-06-05"), dict(symbol="BB", ratio=2.0)])
    ledger = plan.limit(0)
    once = mn.ledger_append(plan, ledger)
    assert mn.pending(plan, ledger).count() == 2 and mn.pending(plan, once).count() == 0 and mn.ledger_append(plan, once).count() == 2
    bars = bars_factory()
    out = mn.apply_adjustments(bars, plan).alias("n").join(bars.alias("o"), ["symbol", "ts"])
    f = F.when((F.col("symbol") == "AA") & (F.col("ts") < F.lit("2024-06-04 18:30:00").cast("timestamp")), 0.5).when(F.col("symbol") == "BB", 2.0).otherwise(1.0)
    assert out.filter(F.abs(F.col("n.close") - F.col("o.close") * f) > 1e-9).count() == 0


def test_sector_pairs_blocks_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], []
    for us, sec, n in ((1, 0, 23), (1, 1, 2), (2, 0, 1)):
        vec = rng.normal(size=(n, 10))
        ok = rng.random((n, 10)) < 0.8
        rows += [(us, sec, f"S{i:02d}", [float(x) for x in vec[i]], [bool(x) for x in ok[i]]) for i in range(n)]
        m = np.where(ok, vec, 0)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        pairs = [(round(float(m[i] @ m[j]), 9), f"S{i:02d}", f"S{j:02d}") for i, j in itertools.combinations(range(n), 2) if m[i] @ m[j] > 0.2]
        truth += [(us, sec, *p) for p in sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))[:6]]
    df = spark.createDataFrame(rows, "anchor_us long, sector_id int, stock string, labels array<double>, label_valid array<boolean>")
    for block in (512, 5):
        got = co.sector_pairs(df, threshold=0.2, top=6, block=block).collect()
        assert sorted((r["anchor_a_us"], r["sector_id_a"], round(r["cosine"], 9), r["stock_a"], r["stock_b"]) for r in got) == sorted(truth)


def test_drawdown_over_days(spark):
    rng = np.random.default_rng(4)
    pnl = rng.normal(size=300)
    t0 = dt.datetime(2024, 1, 1)
    trades = spark.createDataFrame([(t0 + dt.timedelta(hours=5 * i), f"S{i}", 1, float(-i), float(p)) for i, p in enumerate(pnl)],
                                   "t timestamp, symbol string, direction int, score double, pnl double")
    cum = np.cumsum(pnl)
    worst = bt.equity_curve(trades).agg(F.max("drawdown")).first()[0]
    assert abs(worst - (np.maximum.accumulate(cum) - cum).max()) < 1e-9
