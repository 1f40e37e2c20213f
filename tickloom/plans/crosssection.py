"""Cross-sections: label, rank, volatility bucket and feature windows per (instant, symbol)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import clock
from tickloom.operators import ranking
from tickloom.operators.asof import asof_many
from tickloom.operators.numbered import number_rows, windows_at
from tickloom.operators.series import CHUNK_ROWS, over_series
from tickloom.plans.features import WINDOW_BARS

# Returns in the volatility estimate and the scale it uses.
VOL_LOOKBACK = {"30m": ("5m", 78), "120m": ("5m", 156), "1d": ("day", 20), "2d": ("day", 20)}
MIN_SYMBOLS = 10


def trailing_vol(features: DataFrame, *, scale: str, returns: int, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Deviation of the last ``returns`` log returns per bar, once that many exist."""
    lr = lambda w: {"_lr": F.log(F.col("close") / F.lag("close", 1).over(w))}

    def dev(w):
        f = w.rowsBetween(-(returns - 1), 0)
        return {"vol": F.when(F.count("_lr").over(f) == returns, F.stddev_samp("_lr").over(f))}

    out = over_series(features, lr, lookback=returns + 1, stages=[dev], chunk_rows=chunk_rows)
    return out.filter(F.col("vol").isNotNull()).select("symbol", clock.effective_close_of(scale, "ts").alias("eff_close"), "vol")


def numbered_stores(stores: dict[str, DataFrame], columns: Sequence[str] = ()) -> dict[str, DataFrame]:
    """``symbol, n, eff_close`` and the columns of every store, numbered per symbol."""
    return {scale: number_rows(store.select("symbol", "ts", *columns)).select(
        "symbol", "n", clock.effective_close_of(scale, "ts").alias("eff_close"), *columns) for scale, store in stores.items()}


def with_history(anchors: DataFrame, numbered: dict[str, DataFrame], *, time: str = "t", strict: bool = True,
                 window_bars: dict[str, int] | None = None, vol: DataFrame | None = None) -> DataFrame:
    """Anchors that have a full window at every scale, with ``k_<scale>``, the number of its last bar (and ``vol``).

    Bars are matched by number alone, so no window passes through the match.
    """
    window_bars = window_bars or WINDOW_BARS
    sources = {s: (rows.select("symbol", "eff_close", "n"), "eff_close", {f"k_{s}": F.col("n")}) for s, rows in numbered.items()}
    if vol is not None:
        sources["vol"] = (vol, "eff_close", {"vol": F.col("vol")})
    hits = asof_many(anchors, sources, left_time=time, strict=strict, bucket="month")
    for s in numbered:
        hits = hits.filter(F.col(f"k_{s}") >= window_bars[s] - 1)
    return hits if vol is None else hits.filter(F.col("vol").isNotNull())


def fetch_windows(hits: DataFrame, numbered: dict[str, DataFrame], *, time: str = "t", window_bars: dict[str, int] | None = None,
                  channels: Sequence[str] = ("close",)) -> DataFrame:
    """Rows of :func:`with_history` with one array column ``w_<scale>`` per scale instead of the numbers.

    Every scale's windows are cut from blocks of bars by one join, then each row's windows are put side by side.
    Rows are unique by (symbol, time).
    """
    window_bars = window_bars or WINDOW_BARS
    own = [c for c in hits.columns if c not in {f"k_{s}" for s in numbered}]
    pick = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(window_bars[s]).alias("size"), F.col(f"k_{s}").alias("k")) for s in numbered]))
    long = hits.select("*", pick.alias("_m")).select("symbol", time, F.struct(*own).alias("_own"), "_m.*")
    bars = reduce(DataFrame.unionByName, [rows.select("symbol", F.lit(s).alias("scale"), F.lit(window_bars[s]).alias("size"), "n", *channels)
                                          for s, rows in numbered.items()])
    cut = windows_at(long, bars, [F.col(c).cast("float").alias(c) for c in channels], size="size", at="k", name="w", keys=("symbol", "scale"))
    windows = [F.first(F.when(F.col("scale") == s, F.col("w")), ignorenulls=True).alias(f"w_{s}") for s in numbered]
    return cut.groupBy("symbol", time).agg(F.first("_own").alias("_own"), *windows).select("_own.*", *[f"w_{s}" for s in numbered])


def attach_windows(anchors: DataFrame, stores: dict[str, DataFrame], *, time: str = "t", strict: bool = True,
                   window_bars: dict[str, int] | None = None, channels: Sequence[str] = ("close",),
                   vol: DataFrame | None = None) -> DataFrame:
    """Anchors with one array column ``w_<scale>`` per scale; short histories drop the row."""
    numbered = numbered_stores(stores, channels)
    hits = with_history(anchors, numbered, time=time, strict=strict, window_bars=window_bars, vol=vol)
    return fetch_windows(hits, numbered, time=time, window_bars=window_bars, channels=channels)


def snapshot_windows(anchors: DataFrame, features: DataFrame, *, k: int = 64, max_stale_minutes: int = 5, time: str = "t",
                     channels: Sequence[str] = tuple(f"f_{i}" for i in range(8))) -> DataFrame:
    """Anchors with the last ``k`` snapshots strictly before them, or a false ``book_mask``.

    The mask is false when fewer than ``k`` exist or the newest is too old; windows are fetched where it is true.
    """
    rows = number_rows(features.select("symbol", "ts", *channels), bucket="day")
    out = asof_many(anchors, {"b": (rows.select("symbol", "ts", "n"), "ts", {"_k": F.col("n"), "_bts": F.col("ts")})},
                    left_time=time, strict=True, bucket="day")
    ok = F.coalesce((F.col("_k") >= k - 1) & (F.col(time) - F.expr(f"INTERVAL {int(max_stale_minutes)} MINUTES") <= F.col("_bts")), F.lit(False))
    out = out.withColumn("book_mask", ok).withColumn("_k", F.when(ok, F.col("_k"))).drop("_bts")
    items = [F.col(c).cast("float").alias(c) for c in channels]
    return windows_at(out, rows, items, size=k, at="_k", name="book_window", partial=True).drop("_k")


def cross_sections(labels: DataFrame, stores: dict[str, DataFrame], *, horizon: str, n_universe: int = 0, keep_share: float = 0.5,
                   window_bars: dict[str, int] | None = None, channels: Sequence[str] = ("close",), vol_returns: int | None = None,
                   buckets: int = 5, min_symbols: int = MIN_SYMBOLS, aux: DataFrame | None = None, book: DataFrame | None = None,
                   book_k: int = 64, book_stale_minutes: int = 5, book_channels: Sequence[str] = tuple(f"f_{i}" for i in range(8)),
                   tradeable: DataFrame | None = None, width: str | None = None, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Rows of every cross-section wide enough: ``t, symbol, y, rank, vol_bucket`` and windows.

    A row needs a valid label, full windows at every scale strictly before ``t``, a
    volatility and (if given) auxiliary features at exactly ``t``.  Book windows and
    tradeable labels are optional per row.  Rows are chosen and ranked on bar numbers;
    windows are fetched for those that stay.  ``width`` names a column for the number
    of symbols of the row's cross-section.
    """
    scale, n = VOL_LOOKBACK[horizon]
    vol = trailing_vol(stores[scale], scale=scale, returns=vol_returns or n, chunk_rows=chunk_rows)
    rows = labels.filter("valid_label").select("symbol", "t", F.col("y_log_return").alias("y"))
    numbered = numbered_stores(stores, channels)
    rows = with_history(rows, numbered, window_bars=window_bars, vol=vol)
    if aux is not None:
        rows = rows.join(aux.withColumnRenamed("anchor_ts", "t"), ["symbol", "t"])
    if tradeable is not None:
        tl = tradeable.select("symbol", "t", "tradeable_label", F.col("valid_label").alias("tradeable_valid"),
                              *[c for c in ("realized_pnl_long", "realized_pnl_short") if c in tradeable.columns])
        rows = rows.join(tl, ["symbol", "t"], "left").fillna({"tradeable_label": 0, "tradeable_valid": False})
    need = max(min_symbols, int(keep_share * n_universe))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("t"))).filter(F.col("_n") >= need)
    rows = rows.withColumnRenamed("_n", width) if width else rows.drop("_n")
    rows = rows.withColumns({"rank": ranking.unit_rank("y", ["t"]), "vol_bucket": ranking.quantile_bucket("vol", ["t"], buckets),
                             "horizon": F.lit(horizon)})
    rows = fetch_windows(rows, numbered, window_bars=window_bars, channels=channels)
    if book is not None:
        rows = snapshot_windows(rows, book, k=book_k, max_stale_minutes=book_stale_minutes, channels=book_channels)
    return rows


# ------------------------------------------------------------------------ sampling

def draw(seed: int, *parts: Column) -> Column:
    """A sortable pseudo-random text of a row, equal on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit_draw(seed: int, *parts: Column) -> Column:
    """The same as a number in (0, 1)."""
    return (F.conv(F.substring(draw(seed, *parts), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sample_by_horizon(anchors: DataFrame, weights: dict[str, float], n: int, seed: int = 0) -> DataFrame:
    """About ``n`` anchors split over horizons in proportion to ``weights`` (t, horizon).

    A horizon's cut is an order statistic of its draws, so no horizon is sorted whole.
    """
    total = sum(weights.values())
    quota = {h: max(1, round(n * w / total)) for h, w in weights.items()}
    rows = anchors.filter(F.col("horizon").isin(*weights)).withColumn("_u", unit_draw(seed, F.unix_micros("t"), F.col("horizon")))
    want = F.lit(0)
    for h, q in quota.items():
        want = F.when(F.col("horizon") == h, q).otherwise(want)
    cut = ranking.kth_smallest(rows, ["horizon"], "_u", {"_cut": F.least(want, F.col("total"))})
    return rows.join(cut, "horizon").filter(F.col("_u") <= F.col("_cut")).drop("_u", "_cut")


def sample_per_day(rows: DataFrame, per_day: int, *, time: str = "anchor_ts", seed: int = 0) -> DataFrame:
    """At most ``per_day`` rows per (symbol, day), whatever the order of the input."""
    w = Window.partitionBy("symbol", F.to_date(time)).orderBy(draw(seed, F.col("symbol"), F.unix_micros(time)))
    return rows.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= per_day).drop("_p")


def sample_windows(anchors: DataFrame, n: int, *, time: str = "t", recent_days: int = 549, recent_weight: float = 2.0, as_of: Column,
                   seed: int = 0) -> DataFrame:
    """``n`` eligible anchors without replacement, the trailing days weighted up."""
    recent = F.col(time) > as_of - F.expr(f"INTERVAL {int(recent_days)} DAYS")
    key = F.log(unit_draw(seed, F.col("symbol"), F.unix_micros(time))) / F.when(recent, float(recent_weight)).otherwise(1.0)
    return anchors.withColumn("_k", key).orderBy(F.col("_k").desc(), "symbol", time).limit(n).drop("_k")


def forward_tail(bars: DataFrame, n: int, columns: Sequence[str] = ("close",), chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Per bar the next ``n`` bars as an array; bars without a full tail are left out."""
    item = F.struct(*columns)
    out = over_series(bars, lambda w: {"tail": F.collect_list(item).over(w.rowsBetween(1, n))}, lookahead=n, chunk_rows=chunk_rows)
    return out.filter(F.size("tail") == n)


def train_test(matrix: DataFrame, labels: DataFrame, *, train: tuple, test: tuple, per_day: int | None = 5, seed: int = 0) -> DataFrame:
    """Feature rows with valid labels, ``part`` train or test; only train is thinned."""
    y = labels.filter("valid_label").select("symbol", F.col("t").alias("anchor_ts"), "y_log_return")
    rows = matrix.join(y, ["symbol", "anchor_ts"])
    inside = lambda b: F.col("anchor_ts").between(clock.as_instant(b[0]), clock.as_instant(b[1]))
    fit = rows.filter(inside(train))
    if per_day:
        fit = sample_per_day(fit, per_day, seed=seed)
    return fit.withColumn("part", F.lit("train")).unionByName(rows.filter(inside(test)).withColumn("part", F.lit("test")))
