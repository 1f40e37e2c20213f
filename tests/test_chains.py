"""Maintenance chains: crashes between any two steps, second writers, refused inputs."""

import datetime as dt

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from tickloom.plans import chains, maintenance as mn
from tickloom.sources import ledger as lg, store, vendor, versioned


class Died(RuntimeError):
    pass


@pytest.fixture
def dies(monkeypatch):
    """Make the writing of one step's record, or the commit of a version, fail once."""

    def at(name, before_commit=False):
        real = lg.put_new

        def put(spark, path, text, scratch):
            if path.endswith("/commit/000000000002") if before_commit else path.endswith(f"/{name}"):
                monkeypatch.setattr(lg, "put_new", real)
                raise Died(name)
            return real(spark, path, text, scratch)

        monkeypatch.setattr(lg, "put_new", put)

    return at


@pytest.fixture(scope="module")
def daily(bars_factory):
    return bars_factory(scale="day", days=30, drop=0.0).cache()


def plan_of(spark, rows):
    return spark.createDataFrame([(*r, "split", "") for r in rows], "symbol string, ratio double, cutoff_date_ist date, event string, notes string")


def table(df):
    return as_rows(df.select(*store.BAR_COLUMNS), "symbol", "scale", "ts")


def test_put_new_never_replaces(spark, tmp_path):
    at = str(tmp_path / "d" / "one")
    assert lg.put_new(spark, at, "first", str(tmp_path / "s")) and not lg.put_new(spark, at, "second", str(tmp_path / "s"))
    assert lg.get_text(spark, at) == "first" and lg.names(spark, str(tmp_path / "s")) == [] and lg.names(spark, str(tmp_path / "none")) == []


def test_content_key_counts_rows_in_any_order(spark, daily):
    key = lg.content_key(daily, a=1)
    assert key == lg.content_key(daily.orderBy("close").repartition(5), a=1)
    assert len({key, lg.content_key(daily, a=2), lg.content_key(daily.unionByName(daily.limit(1)), a=1), lg.content_key(daily.limit(3), a=1)}) == 4


@pytest.mark.parametrize("step", ["planned", "adjusted", "entered", "done", "commit"])
def test_adjustments_are_applied_once_whenever_the_run_dies(spark, daily, tmp_path, dies, step):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    versioned.create(daily, root, files=4)
    plan = plan_of(spark, [("AA", 0.5, dt.date(2024, 6, 20)), ("BB", 2.0, None)])
    dies(step, before_commit=step == "commit")
    with pytest.raises(Died):
        chains.apply_once(plan, root, ledger, content="c", files=2)
    run = chains.apply_once(plan, root, ledger, content="c", files=2)
    assert run.finished and versioned.versions(spark, root) == [1, 2]
    want = mn.apply_adjustments(daily, plan)
    assert table(versioned.open_table(spark, root)) == table(want)
    entered = chains.applied(spark, ledger).collect()
    assert sorted((r.symbol, r.rows_affected) for r in entered) == [
        ("AA", daily.filter("symbol = 'AA' AND ts < '2024-06-19 18:30:00'").count()), ("BB", daily.filter("symbol = 'BB'").count())]
    # the same plan under other content: the ledger holds it, the table stays
    again = chains.apply_once(plan, root, ledger, content="other", files=2)
    assert again.steps["planned"]["n"] == 0 and versioned.versions(spark, root) == [1, 2] and chains.applied(spark, ledger).count() == 2
    twice = chains.apply_once(plan, root, ledger, content="third", files=2, allow_rerun=True)
    assert twice.steps["planned"]["n"] == 2 and table(versioned.open_table(spark, root)) == table(mn.apply_adjustments(want, plan))


def test_unsound_ratio_changes_nothing(spark, daily, tmp_path):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    versioned.create(daily, root, files=2)
    for ratio in (1.0, 0.0, -2.0, None):
        with pytest.raises(ValueError):
            chains.apply_once(plan_of(spark, [("AA", ratio, None)]), root, ledger, content=str(ratio))
    assert versioned.versions(spark, root) == [1] and chains.applied(spark, ledger).count() == 0


def test_another_writer_in_between_starts_the_run_anew(spark, daily, tmp_path, dies):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    versioned.create(daily, root, files=2)
    plan = plan_of(spark, [("CC", 0.5, None)])
    dies("planned")
    with pytest.raises(Died):
        chains.apply_once(plan, root, ledger, content="c")
    other = daily.filter("symbol = 'AA'").withColumn("close", F.col("close") * 3)
    versioned.merge(other, root, versioned.replaced_by(0.01), files=2)
    chains.apply_once(plan, root, ledger, content="c")
    stored = mn.merge_update(daily, other, threshold=0.01).select(*store.BAR_COLUMNS)
    assert versioned.versions(spark, root) == [1, 2, 3] and table(versioned.open_table(spark, root)) == table(mn.apply_adjustments(stored, plan))


def payload(bars):
    epoch = F.unix_seconds(F.col("ts") - F.expr("INTERVAL 930 MINUTES")).cast("string")
    row = F.array(epoch, *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    return bars.groupBy("symbol", "scale").agg(F.collect_list(row).alias("candles")).select(
        "symbol", "scale", F.lit(1).alias("chunk"), F.to_json(F.struct("candles")).alias("payload"))


def test_refresh_resumes_and_respects_its_window(spark, daily, tmp_path, dies):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    held = daily.filter("symbol <> 'CC' AND ts < '2024-06-20'")
    versioned.create(held, root, files=4)
    tokens = spark.createDataFrame([("AA", 1), ("BB", 2), ("CC", 3)], "symbol string, token int")
    fresh = daily.withColumn("close", F.when(F.col("symbol") == "AA", F.col("close") * 1.1).otherwise(F.col("close")))
    call = lambda **kw: chains.refresh_cycle(payload(fresh), tokens, root, ledger, scales=("day",), floor="2024-06-10",
                                             end="2024-06-28", files=2, **kw)
    with pytest.raises(chains.Discrepancy):
        call(max_diff=0)
    assert versioned.versions(spark, root) == [1]
    dies("merged")
    with pytest.raises(Died):
        call()
    run = call()
    new = fresh.join(held, ["symbol", "ts"], "left_anti").filter("ts <= '2024-06-28' AND ts >= '2024-06-10'")
    assert table(versioned.open_table(spark, root)) == table(held.unionByName(new.select(*held.columns)))
    assert run.steps["merged"] == {"version": 2, "inserted": new.count()} and run.steps["overlap"]["n_diff"] == held.filter("symbol = 'AA' AND ts >= '2024-06-14 10:00:00'").count()
    assert call().steps == run.steps and versioned.versions(spark, root) == [1, 2]


def test_refresh_takes_the_same_candles_in_another_order_for_the_same_input(spark, daily, tmp_path):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    versioned.create(daily.filter("ts < '2024-06-20'"), root, files=4)
    tokens = spark.createDataFrame([("AA", 1), ("BB", 2), ("CC", 3)], "symbol string, token int")
    call = lambda p: chains.refresh_cycle(p, tokens, root, ledger, scales=("day",), floor="2024-06-10", end="2024-06-28", files=2)
    backwards = F.expr("reverse(from_json(payload, 'candles array<array<string>>').candles)")
    sent = payload(daily)
    first = call(sent)
    again = call(sent.withColumn("payload", F.to_json(F.struct(backwards.alias("candles")))))
    assert again.key == first.key and versioned.versions(spark, root) == [1, 2]
    call(sent.withColumn("payload", F.regexp_replace("payload", "100", "101")))
    assert versioned.versions(spark, root) == [1, 2, 3]
    odd = spark.createDataFrame([("AA", "day", 1, p) for p in ("not json", '{"candles":[["1",null]]}', '{"candles":[[null,"1"]]}', None)],
                                "symbol string, scale string, chunk int, payload string")
    assert odd.count() == vendor.candle_rows(odd).distinct().count() == 4


def test_refresh_of_an_absent_table_and_of_nothing(spark, daily, tmp_path):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    tokens = spark.createDataFrame([("AA", 1)], "symbol string, token int")
    call = lambda p: chains.refresh_cycle(p, tokens, root, ledger, scales=("day",), floor="2024-01-01", end="2025-01-01", files=2)
    empty = call(payload(daily).limit(0))
    assert empty.steps["staged"]["rows"] == 0 and versioned.open_table(spark, root).count() == 0
    call(payload(daily))
    assert table(versioned.open_table(spark, root)) == table(daily.filter("symbol = 'AA'"))


def test_calendar_refresh(spark, tmp_path, dies):
    root, ledger = str(tmp_path / "c"), str(tmp_path / "l")
    days = lambda *d: spark.createDataFrame([(dt.date(2024, 1, x),) for x in d], "trade_date date")
    stored = lambda: sorted(r[0].day for r in store.published(spark, root).collect())
    chains.calendar_refresh(days(2, 3, 4), root, ledger)
    assert stored() == [2, 3, 4]
    with pytest.raises(chains.Discrepancy):
        chains.calendar_refresh(days(2, 4, 5), root, ledger)
    assert stored() == [2, 3, 4]
    dies("published")
    with pytest.raises(Died):
        chains.calendar_refresh(days(2, 4, 5), root, ledger, allow_discrepancy=True)
    run = chains.calendar_refresh(days(2, 4, 5), root, ledger, allow_discrepancy=True)
    assert run.finished and stored() == [2, 3, 4, 5]
    assert chains.calendar_refresh(days(4, 5), root, ledger).steps["published"] == {"inserted": 0} and stored() == [2, 3, 4, 5]


def test_repair_detects_and_applies_once(spark, daily, tmp_path, dies):
    root, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    cut = dt.date(2024, 6, 17)
    halved = daily.withColumn("close", F.when((F.col("symbol") == "AA") & (F.col("ts") < F.lit(cut).cast("timestamp")), F.col("close") * 2).otherwise(F.col("close")))
    versioned.create(halved, root, files=4)
    dies("adjusted")
    with pytest.raises(Died):
        chains.repair_cycle(daily, root, ledger, files=2)
    for _ in range(2):
        run = chains.repair_cycle(daily, root, ledger, files=2)
    assert versioned.versions(spark, root) == [1, 2] and run.steps["planned"] == {"n": 1}
    got = versioned.open_table(spark, root).alias("g").join(daily.alias("d"), ["symbol", "ts"])
    assert got.filter(F.abs(F.col("g.close") - F.col("d.close")) > 1e-6).count() == 0 and got.count() == daily.count()
    assert [(r.symbol, r.ratio, r.cutoff_date_ist) for r in chains.applied(spark, ledger).collect()] == [("AA", 0.5, cut)]
