"""Maintenance chains over stored tables: bar refresh, calendar refresh, corporate-action repair.

Every chain is a run of the step ledger (:mod:`tickloom.sources.ledger`). A step's effect on a table carries the run's key
in its version, so a run that died after the commit and before its record finds the version instead of
applying the step twice. A chain called again with the same input returns what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions import clock
from tickloom.plans import maintenance as mn
from tickloom.sources import ledger as lg, store, vendor, versioned

PLAN_COLUMNS = ("symbol", "ratio", "cutoff_date_ist", "event")
APPLIED = "symbol string, ratio double, cutoff_date_ist date, event string, run_id string, rows_affected long"


class Discrepancy(RuntimeError):
    """A source contradicts the stored table; nothing was changed."""


def _newest(spark: SparkSession, root: str) -> int:
    known = versioned.versions(spark, root)
    return known[-1] if known else 0


def _ours(spark: SparkSession, root: str):
    """An unfinished run goes on while its base is the newest version or a version of its own follows; otherwise
    another writer came first and the chain starts anew from the newest version."""
    def check(run: lg.Run) -> bool:
        base = run.steps["begin"]["version"]
        return _newest(spark, root) == base or versioned.find(spark, root, run.key, base) is not None

    return check


def last_bars(spark: SparkSession, root: str) -> DataFrame:
    """Last stored bar per series, from the manifest alone."""
    return versioned.manifest(spark, root).groupBy("symbol", "scale").agg(F.max("last_ts").alias("last_ts"))


def refresh_cycle(payloads: DataFrame, tokens: DataFrame, root: str, ledger: str, *, scales: Sequence[str], floor, end,
                  overlap_days: int = 5, tolerance: float = 0.005, max_diff: int | None = None, files: int | None = None) -> lg.Run:
    """Gap plan, candles inside it staged, overlap compared, missing bars inserted.

    ``payloads`` is ``symbol, scale, chunk, payload`` as fetched. Rows over ``tolerance`` are counted and reported;
    more than ``max_diff`` of them raise :class:`Discrepancy` before the table is touched.
    Steps: begin, staged, overlap, merged, done.
    """
    spark = payloads.sparkSession
    # a fetch may list the same candles in another order: the candles are the input, not their text
    content = lg.content_key(vendor.candle_rows(payloads), root=root, scales=list(scales), floor=floor, end=end, overlap=overlap_days)
    run = lg.begin(spark, ledger, "refresh", content, {"version": _newest(spark, root)}, _ours(spark, root))
    if run.finished:
        return run
    at = f"{ledger}/staged/{run.key}"

    def stage() -> dict:
        gaps = vendor.gap_plan(tokens, last_bars(spark, root), scales, floor=floor, end=end, overlap_days=overlap_days)
        good, bad = vendor.candles_from_arrays(payloads)
        window = gaps.select("symbol", "scale", "start", "end").distinct()
        wanted = vendor.merge_chunks(good).join(window, ["symbol", "scale"]).filter(F.col("ts").between(F.col("start"), F.col("end")))
        wanted.select(*store.BAR_COLUMNS).write.mode("overwrite").parquet(at)
        return {"rows": spark.read.schema(store.BAR_SCHEMA).parquet(at).count(), "rejected": bad.count()}

    run.step("staged", stage)
    staged = spark.read.schema(store.BAR_SCHEMA).parquet(at)
    base = run.steps["begin"]["version"]

    def compare() -> dict:
        stored = versioned.read_touched(spark, root, staged, base)
        return mn.overlap_check(stored, staged, tolerance=tolerance).first().asDict()

    overlap = run.step("overlap", compare)
    if max_diff is not None and overlap["n_diff"] > max_diff:
        raise Discrepancy(f"{overlap['n_diff']} of {overlap['n_overlap']} bars differ by over {tolerance}")

    def insert() -> dict:
        version = versioned.merge(staged, root, mn.merge_insert, files=files, base=base, key=run.key)
        return {"version": version, "inserted": versioned.n_rows(spark, root, version) - versioned.n_rows(spark, root, base)}

    merged = run.step("merged", insert)
    run.step("done", lambda: {"state": {"version": merged["version"]}})
    store.remove(spark, at)
    return run


def calendar_refresh(refresh: DataFrame, root: str, ledger: str, *, allow_discrepancy: bool = False) -> lg.Run:
    """New trading days appended to the published calendar at ``root``.

    A stored day inside the common range that the source lacks raises :class:`Discrepancy` unless allowed; stored days
    are never removed. Steps: begin, compared, published, done.
    """
    spark = refresh.sparkSession
    try:
        existing = store.published(spark, root).select("trade_date")
    except FileNotFoundError:
        existing = spark.createDataFrame([], "trade_date date")
    content = lg.content_key(refresh.select("trade_date"), root=root)
    state = {"days": lg.content_key(existing.distinct())}
    run = lg.begin(spark, ledger, "calendar", content, state, lambda run: run.steps["begin"] == state)
    if run.finished:
        return run

    def compare() -> dict:
        kinds = {r.kind: r for r in mn.calendar_diff(existing, refresh).groupBy("kind").agg(
            F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last")).collect()}
        part = lambda k: {"n": kinds[k].n, "first": kinds[k].first, "last": kinds[k].last} if k in kinds else {"n": 0}
        return {"new": part("new"), "discrepancy": part("discrepancy")}

    found = run.step("compared", compare)
    if found["discrepancy"]["n"] and not allow_discrepancy:
        raise Discrepancy(f"{found['discrepancy']['n']} stored trading days are missing from the source, the first {found['discrepancy']['first']}")

    def publish() -> dict:
        # a run that died after publishing finds no new day here
        both = mn.merge_insert(existing.distinct(), refresh.select("trade_date").distinct(), ["trade_date"])
        n = both.count() - existing.distinct().count()
        if n:  # days are few: one small file a version
            store.publish(both.coalesce(1), root)
        return {"inserted": n}

    run.step("published", publish)
    run.step("done", lambda: {"state": {"days": lg.content_key(store.published(spark, root).select("trade_date").distinct())}})
    return run


def applied(spark: SparkSession, ledger: str) -> DataFrame:
    """Every adjustment ever applied, with the run and the rows it changed."""
    try:
        return spark.read.schema(APPLIED).option("recursiveFileLookup", "true").parquet(f"{ledger}/applied")
    except AnalysisException as e:
        if not store.absent(e):
            raise
        return spark.createDataFrame([], APPLIED)


def apply_once(plan: DataFrame, root: str, ledger: str, *, content: str, files: int | None = None, allow_rerun: bool = False) -> lg.Run:
    """Apply the adjustments of a plan that the ledger does not hold, in one new version, and enter them.

    Only files that hold a bar before some cutoff of its symbol are read and written. Entries are one folder per run,
    written whole. Steps: begin, planned, adjusted, entered, done.
    """
    spark = plan.sparkSession
    run = lg.begin(spark, ledger, "adjust", content, {"version": _newest(spark, root)}, _ours(spark, root))
    if run.finished:
        return run
    at = f"{ledger}/plans/{run.key}"
    base = run.steps["begin"]["version"]

    def fix_plan() -> dict:
        todo = plan if allow_rerun else mn.pending(plan, applied(spark, ledger))
        todo.select(*PLAN_COLUMNS).dropDuplicates(["symbol", "ratio", "cutoff_date_ist"]).write.mode("overwrite").parquet(at)
        fixed = spark.read.parquet(at)
        sound = F.coalesce((F.col("ratio") > 0) & (F.col("ratio") != 1.0) & F.col("symbol").isNotNull(), F.lit(False))
        bad = fixed.filter(~sound).limit(1).collect()
        if bad:
            raise ValueError(f"ratio must be positive and not 1: {bad[0]}")
        return {"n": fixed.count()}

    n = run.step("planned", fix_plan)["n"]
    todo = spark.read.parquet(at)

    def adjust() -> dict:
        if not n:
            return {"version": base}
        cut = todo.groupBy("symbol").agg(F.max(F.coalesce("cutoff_date_ist", F.lit("9999-12-31").cast("date"))).alias("_cut"))
        old = versioned.manifest(spark, root, base)
        hit = old.join(cut, "symbol").filter(clock.exchange_date(F.col("first_ts")) < F.col("_cut")).select("path").distinct()
        change = lambda bars: mn.apply_adjustments(bars, todo).select(*store.BAR_COLUMNS)
        return {"version": versioned.rewrite(spark, root, hit, change, files=files, base=base, key=run.key)}

    version = run.step("adjusted", adjust)["version"]

    def enter() -> dict:
        if n:
            before = versioned.open_series(spark, root, todo.select("symbol").distinct(), base)
            counts = mn.adjustment_preview(before, todo).select("symbol", "ratio", F.col("cutoff_date_ist").alias("_c"), "n_rows")
            rows = todo.join(counts.withColumnRenamed("symbol", "_s").withColumnRenamed("ratio", "_r"), (F.col("symbol") == F.col("_s")) & (
                F.col("ratio") == F.col("_r")) & F.col("cutoff_date_ist").eqNullSafe(F.col("_c")), "left")
            rows.select(*PLAN_COLUMNS, F.lit(run.key).alias("run_id"), F.coalesce("n_rows", F.lit(0)).alias("rows_affected")).coalesce(1).write.mode(
                "overwrite").parquet(f"{ledger}/applied/{run.key}")
        return {"n": n}

    run.step("entered", enter)
    run.step("done", lambda: {"state": {"version": version}})
    return run


def repair_cycle(fresh: DataFrame, root: str, ledger: str, *, noise: float = 0.005, dividend_band: float = 0.05, min_days: int = 3,
                 review: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None) -> lg.Run:
    """Detect level shifts against a fresh pull, plan them, apply each once.

    Detection reads the version that the run began with, so a resumed run sees what the first attempt saw. ``review``
    may drop or add proposals.
    """
    spark = fresh.sparkSession
    content = lg.content_key(fresh, root=root, noise=noise, band=dividend_band, days=min_days)
    run = lg.begin(spark, ledger, "adjust", content, {"version": _newest(spark, root)}, _ours(spark, root))
    if run.finished:
        return run
    base = run.steps["begin"]["version"]
    stored = versioned.open_table(spark, root, base or None).filter(F.col("scale") == clock.DAY_SCALE)
    plan = mn.propose(mn.ratio_segments(mn.close_ratios(fresh, stored), noise=noise), dividend_band=dividend_band, min_days=min_days)
    return apply_once(review(plan) if review else plan, root, ledger, content=content, files=files)
