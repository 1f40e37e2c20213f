"""Point-in-time features from bars and book snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import clock, shapes
from tickloom.operators.asof import asof_many
from tickloom.operators.numbered import matched_numbers, number_rows, stats_at
from tickloom.operators.series import CHUNK_ROWS, carry_forward, over_series, running_total

# Lags, z-score window, warm-up days per scale, locked channel order.
RETURN_LAGS = (1, 5, 15, 60)
Z_WINDOW = 20
WARMUP_DAYS = {"5m": 7, "15m": 7, "60m": 21, "day": 100}
GROUPS = ("bar_channels", "log_returns", "wicks", "volume_z", "time_covariates")
CHANNELS = (
    "open", "high", "low", "close", "volume", "ret_1", "ret_5", "ret_15", "ret_60",
    "bar_range", "body", "upper_wick_norm", "lower_wick_norm", "vol_z_20",
    "min_of_day_sin", "min_of_day_cos", "day_of_week_sin", "day_of_week_cos",
)
STORE_COLUMNS = ("symbol", "ts", "scale", *CHANNELS)
WINDOW_BARS = {"5m": 256, "15m": 192, "60m": 168, "day": 64}


def _require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def compute_features(bars: DataFrame, *, scale: str, as_of, window_start=None, window_end=None,
                     groups: Sequence[str] = GROUPS, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Feature groups for every symbol at one scale, using bars known by ``as_of``.

    With ``window_start`` the scan is bounded to the warm-up before it, so the
    time predicate reaches Parquet while rolling values stay fully warmed.
    """
    unknown = [g for g in groups if g not in GROUPS]
    if unknown:
        raise ValueError(f"unknown feature groups: {unknown}")
    _require(bars, ("symbol", "ts", "scale", "open", "high", "low", "close", "volume"), "bars")
    cap = clock.as_instant(as_of)
    src = bars.filter(F.col("scale") == scale).filter(F.col("ts") <= cap)
    src = src.filter(clock.effective_close_of(scale, "ts") <= cap)
    if window_start is not None:
        start = clock.as_instant(window_start)
        src = src.filter(F.col("ts") >= start - F.expr(f"INTERVAL {WARMUP_DAYS[scale]} DAYS"))
    if window_end is not None:
        src = src.filter(F.col("ts") <= clock.as_instant(window_end))

    def ordered(w):
        out: dict[str, Column] = {}
        if "log_returns" in groups:
            out |= {f"ret_{k}": F.log(F.col("close") / F.lag("close", k).over(w)) for k in RETURN_LAGS}
        if "volume_z" in groups:
            f = w.rowsBetween(-(Z_WINDOW - 1), 0)
            std = F.stddev_samp("volume").over(f)
            out[f"vol_z_{Z_WINDOW}"] = F.when(
                (F.count("volume").over(f) == Z_WINDOW) & (std > 0),
                (F.col("volume") - F.avg("volume").over(f)) / std)
        return out

    out = src
    if {"log_returns", "volume_z"} & set(groups):
        out = over_series(src, ordered, lookback=max(*RETURN_LAGS, Z_WINDOW), chunk_rows=chunk_rows)
    if "wicks" in groups:
        out = out.withColumns(shapes.wicks())
    if "time_covariates" in groups:
        out = out.withColumns(clock.bar_clock(scale, F.col("ts")))
    if window_start is not None:
        out = out.filter(F.col("ts") >= clock.as_instant(window_start))
    return out


def feature_store(bars: DataFrame, *, scale: str, as_of, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The 18-channel table: warmed rows only, flat-bar wicks at zero, locked order."""
    full = compute_features(bars, scale=scale, as_of=as_of, chunk_rows=chunk_rows)
    return (full.dropna(subset=["ret_60", "vol_z_20"])
            .fillna(0.0, subset=["upper_wick_norm", "lower_wick_norm"]).select(*STORE_COLUMNS))


def null_counts(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row: nulls per column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def assert_complete(df: DataFrame) -> None:
    """Raise if any column holds a null."""
    row = null_counts(df).first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError(f"unexpected nulls: {bad}")


# ------------------------------------------------------------- rolling summaries

def rolling_summary(features: DataFrame, *, scale: str, window_bars: int,
                    channels: Sequence[str] = CHANNELS, last_bars: int = 5,
                    keep: Sequence[str] | None = None, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Per bar: last, mean, std, min, max and trend of each channel over the window.

    All statistics share one window specification, hence one sort.  At 5m the
    last bars' raw OHLCV are added at lags 0..4.
    """
    n = window_bars

    def wanted(name: str) -> bool:
        return keep is None or name in keep

    def build(w):
        f = w.rowsBetween(-(n - 1), 0)
        out: dict[str, Column] = {}
        for ch in channels:
            c = F.col(ch).cast("double")
            if wanted(f"{ch}__last"):
                out[f"{ch}__last"] = c
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                if wanted(f"{ch}__{name}"):
                    out[f"{ch}__{name}"] = F.when(F.count(c).over(f) == n, fn(c).over(f))
            if wanted(f"{ch}__trend"):
                first = F.lag(c, n - 1).over(w)
                out[f"{ch}__trend"] = (c - first) / (F.abs(first) + 1e-12)
        if scale == "5m":
            for ch in channels[:5]:
                for k in range(last_bars):
                    if wanted(f"{ch}__last5_b{k}"):
                        out[f"{ch}__last5_b{k}"] = F.lag(F.col(ch).cast("double"), k).over(w)
        names.extend(out)
        return out

    names: list[str] = []
    df = over_series(features, build, lookback=max(n, last_bars), chunk_rows=chunk_rows)
    return df.select("symbol", "ts", clock.effective_close_of(scale, "ts").alias("eff_close"), *names)


def anchor_matrix(stores: dict[str, DataFrame], anchors: DataFrame, *, as_of,
                  window_bars: dict[str, int] | None = None, channels: Sequence[str] = CHANNELS,
                  keep: Sequence[str] | None = None, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Flat feature rows at anchors: summaries of every scale strictly before each.

    ``anchors`` holds ``symbol, anchor_ts`` (+ any columns to carry).  All scales
    are matched in one union pass.  ``keep`` limits the features (named
    ``{scale}__{channel}__{stat}``) before the join so unused ones are never built.
    Rows short of history at any scale are dropped.
    """
    window_bars = window_bars or WINDOW_BARS
    cap = clock.as_instant(as_of)
    sources, names = {}, []
    for scale, store in stores.items():
        known = store.filter(clock.effective_close_of(scale, "ts") <= cap)
        mine = None if keep is None else [
            k.removeprefix(f"{scale}__") for k in keep if k.startswith(f"{scale}__")]
        s = rolling_summary(known, scale=scale, window_bars=window_bars[scale],
                            channels=channels, keep=mine, chunk_rows=chunk_rows)
        payload = {f"{scale}__{c}": F.col(c) for c in s.columns
                   if c not in ("symbol", "ts", "eff_close")}
        names += payload
        if payload:
            sources[scale] = (s, "eff_close", payload)
    order = list(keep) if keep is not None else names
    wide = asof_many(anchors, sources, left_time="anchor_ts", strict=True)
    return wide.dropna(subset=order).select(*anchors.columns, *order)


SUMMARY = ("last", "mean", "std", "min", "max", "trend")
LAST_BARS = 5


def matrix_columns(scales: Sequence[str] = clock.SCALES, channels: Sequence[str] = CHANNELS) -> list[str]:
    """Names of the full matrix in stored order: 6 summaries of every channel at every scale, and the last raw bars at 5m."""
    out = []
    for scale in scales:
        out += [f"{scale}__{ch}__{stat}" for ch in channels for stat in SUMMARY]
        if scale == "5m":
            out += [f"5m__{ch}__last5_b{k}" for ch in channels[:5] for k in range(LAST_BARS)]
    return out


def full_anchor_matrix(stores: dict[str, DataFrame], anchors: DataFrame, *, as_of, window_bars: dict[str, int] | None = None,
                       channels: Sequence[str] = CHANNELS, keep: Sequence[str] | None = None) -> DataFrame:
    """The flat feature row of every anchor at full window lengths: all of :func:`matrix_columns`, or ``keep``.

    Equal to :func:`anchor_matrix`, with the work turned round: anchors are matched to bar numbers first, then
    each distinct (symbol, scale, number) gets its summaries from running aggregates of blocks, linear in the bars
    whatever the window length. All scales go through the same exchanges. Anchors are distinct rows.
    """
    window_bars = window_bars or WINDOW_BARS
    cap = clock.as_instant(as_of)
    numbered = {}
    for scale, store in stores.items():
        known = store.filter(clock.effective_close_of(scale, "ts") <= cap).select("symbol", "ts", *channels)
        numbered[scale] = number_rows(known).withColumn("eff_close", clock.effective_close_of(scale, "ts"))
    hits = matched_numbers(anchors, {s: (n, "eff_close") for s, n in numbered.items()})
    pick = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(window_bars[s]).cast("long").alias("size"),
                                        F.col(f"k_{s}").alias("k")) for s in stores])).alias("m")
    for s in stores:  # rows short of history at any scale are dropped, null numbers with them
        hits = hits.filter(F.col(f"k_{s}") >= window_bars[s] - 1)
    long = hits.select(*anchors.columns, pick).select(*anchors.columns, "m.*")
    bars = None
    for scale, n in numbered.items():
        part = n.select("symbol", F.lit(scale).alias("scale"), F.lit(window_bars[scale]).cast("long").alias("size"), "n", *channels)
        bars = part if bars is None else bars.unionByName(part)
    summary = stats_at(bars, long, channels, keys=("symbol", "scale"), lags=range(1, LAST_BARS))
    found = F.struct(*[c for c in summary.columns if c not in ("symbol", "scale", "k")])
    rows = long.join(summary, ["symbol", "scale", "k"])
    wide = rows.groupBy(*anchors.columns).agg(*[
        F.first(F.when(F.col("scale") == s, found), ignorenulls=True).alias(f"_{s}") for s in stores])
    place = {ch: i for i, ch in enumerate(channels)}

    def value(name: str) -> Column:
        scale, ch, stat = name.split("__")
        of = lambda k: F.col(f"_{scale}.{k}")[place[ch]]
        if stat == "trend":
            return ((of("last") - of("first")) / (F.abs(of("first")) + 1e-12)).alias(name)
        back = stat.removeprefix("last5_b")
        return of(stat if back == stat else "last" if back == "0" else f"lag{back}").alias(name)

    names = list(keep) if keep is not None else matrix_columns(list(stores), channels)
    return wide.select(*anchors.columns, *[value(n) for n in names]).dropna(subset=names)


# The fifty auxiliary features, in stored order f_0..f_49.
AUX_FEATURES = (
    "15m__min_of_day_sin__std", "15m__bar_range__std", "5m__low__last5_b0", "5m__low__last",
    "5m__vol_z_20__last", "5m__upper_wick_norm__std", "60m__volume__last",
    "5m__min_of_day_cos__mean", "15m__volume__last", "15m__high__std", "15m__close__std",
    "15m__body__last", "15m__bar_range__max", "15m__min_of_day_cos__std", "day__body__last",
    "5m__volume__last5_b0", "5m__day_of_week_cos__mean", "5m__volume__last5_b1",
    "60m__ret_15__std", "5m__bar_range__trend", "60m__lower_wick_norm__last", "5m__high__max",
    "60m__low__last", "5m__volume__last", "15m__min_of_day_sin__mean", "day__vol_z_20__last",
    "5m__vol_z_20__min", "60m__ret_60__std", "5m__day_of_week_cos__std", "5m__bar_range__mean",
    "5m__day_of_week_sin__last", "5m__day_of_week_sin__min", "5m__volume__trend",
    "5m__min_of_day_sin__mean", "5m__bar_range__last", "15m__ret_1__max", "60m__ret_5__std",
    "5m__volume__last5_b3", "day__bar_range__last", "5m__open__max", "15m__open__std",
    "5m__open__last", "day__ret_1__min", "5m__day_of_week_sin__mean",
    "15m__min_of_day_cos__trend", "15m__day_of_week_cos__std", "15m__upper_wick_norm__max",
    "15m__day_of_week_sin__mean", "60m__close__std", "15m__low__std",
)


def aux_features(stores: dict[str, DataFrame], *, as_of, window_bars: dict[str, int] | None = None,
                 precise: bool = False, chunk_rows: int | None = CHUNK_ROWS, by_number: bool = False) -> DataFrame:
    """``symbol, anchor_ts, f_0..f_49`` at the close of every 5m bar (float unless ``precise``).

    ``by_number`` takes the plan of :func:`full_anchor_matrix`, for windows of full length (dozens of bars or more:
    with very short ones its groups are too many to pay).
    """
    cap = clock.as_instant(as_of)
    anchors = stores["5m"].select("symbol", clock.effective_close_of("5m", "ts").alias("anchor_ts")).filter(F.col("anchor_ts") <= cap)
    if by_number:
        wide = full_anchor_matrix(stores, anchors, as_of=as_of, window_bars=window_bars, keep=AUX_FEATURES)
    else:
        wide = anchor_matrix(stores, anchors, as_of=as_of, window_bars=window_bars, keep=AUX_FEATURES, chunk_rows=chunk_rows)
    return wide.select("symbol", "anchor_ts", *[
        F.col(c).cast("double" if precise else "float").alias(f"f_{i}") for i, c in enumerate(AUX_FEATURES)])


# ------------------------------------------------------------------- order book

def book_features(snapshots: DataFrame, *, drop_first: bool = True,
                  chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``symbol, ts, f_0..f_7`` per snapshot: microprice, mid return, spread, pressure,
    queue share, order-flow imbalance, log cumulative depth on both sides.

    Gaps and infinities take the last good value, then zero; the first snapshot of
    a symbol (no predecessor) is dropped on request.
    """
    bq, aq = F.col("bid1_qty").cast("double"), F.col("ask1_qty").cast("double")
    bp, ap = F.col("bid1_price"), F.col("ask1_price")

    def cols(w):
        prev = lambda c: F.lag(c, 1).over(w)
        bp0, ap0, bq0, aq0 = prev(bp), prev(ap), prev(bq), prev(aq)
        flow_b = F.when(bp > bp0, bq).when(bp < bp0, -bq0).otherwise(bq - bq0)
        flow_a = F.when(ap < ap0, aq).when(ap > ap0, -aq0).otherwise(aq - aq0)
        log_mid = F.log(shapes.mid())
        return {"f_0": shapes.microprice(), "f_1": log_mid - prev(log_mid), "f_2": F.col("spread_bps"),
                "f_3": shapes.book_pressure(), "f_4": shapes.queue_share(),
                "f_5": (flow_b - flow_a) / (bq + aq + shapes.EPS),
                "f_6": F.log(F.col("total_buy_qty").cast("double") + 1.0),
                "f_7": F.log(F.col("total_sell_qty").cast("double") + 1.0),
                "_first": prev(F.col("ts")).isNull()}

    names = [f"f_{i}" for i in range(8)]
    raw = over_series(snapshots, cols, lookback=1, chunk_rows=chunk_rows).select(
        "symbol", "ts", "_first", *[shapes.finite(F.col(c).cast("float")).alias(c) for c in names])
    out = carry_forward(raw, names, keys=["symbol"], order="ts").fillna(0.0, subset=names)
    if drop_first:
        only = F.col("_first")
        out = out.filter(~only)
    return out.select("symbol", "ts", *names)


# ------------------------------------------------------------ stationary windows

def stationary_bars(bars: DataFrame, *, anchor_close: str | None = None,
                    chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Bars as log moves from the previous close plus log volume.

    The first bar of a series is anchored on ``anchor_close`` (a column) or on itself.
    """
    floor = lambda c: F.greatest(F.col(c).cast("double"), F.lit(shapes.LOG_FLOOR))
    first = floor(anchor_close) if anchor_close else floor("close")

    def cols(w):
        prev = F.coalesce(F.lag(floor("close"), 1).over(w), first)
        return {"open_ret": F.log(floor("open") / prev), "high_pos": F.log(floor("high") / floor("open")),
                "low_pos": F.log(floor("low") / floor("open")), "close_ret": F.log(floor("close") / prev),
                "log_volume": F.log1p(F.greatest(F.col("volume"), F.lit(0)).cast("double"))}

    return over_series(bars, cols, lookback=1, chunk_rows=chunk_rows)


def rebuild_close(returns: DataFrame, anchor: str, *, ret: str = "close_ret",
                  bucket: str = "month") -> DataFrame:
    """Prices back from log returns and the close before the first one."""
    out = running_total(returns, F.col(ret), "_cum", keys=["symbol"], order=["ts"],
                        bucket=F.date_trunc(bucket, "ts"))
    return out.withColumn("rebuilt_close", F.col(anchor) * F.exp("_cum")).drop("_cum")


def forward_sums(returns: DataFrame, horizons: Sequence[int], *, ret: str = "close_ret",
                 scale_by: str = "sqrt", stds: dict[int, float] | None = None,
                 chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Cumulative forward return over the next ``h`` bars, for each h.

    Scaled by 1/sqrt(h) (``scale_by='sqrt'``), by given deviations (``'std'``), or
    not at all (``'none'``); null where fewer than ``h`` bars follow.
    """
    if not horizons or min(horizons) <= 0:
        raise ValueError("horizons must be positive bar counts")

    def cols(w):
        out = {}
        for h in horizons:
            f = w.rowsBetween(1, h)
            total = F.when(F.count(ret).over(f) == h, F.sum(ret).over(f))
            by = {"sqrt": lambda: F.lit(float(h) ** 0.5), "none": lambda: F.lit(1.0),
                  "std": lambda: F.lit(stds[h] + 1e-9)}[scale_by]()
            out[f"fwd_{h}"] = total / by
        return out

    return over_series(returns, cols, lookahead=max(horizons), chunk_rows=chunk_rows)


def window_patches(windows: DataFrame, column: str, *, length: int, stride: int,
                   eps: float = 1e-5) -> DataFrame:
    """Standardise each window by its own mean and deviation and cut it into patches.

    Adds ``mean``, ``std`` (to reuse on later bars) and ``patches``.
    """
    base = windows.withColumn("mean", shapes.array_mean(F.col(column)))
    base = base.withColumn("std", shapes.array_std(F.col(column), F.col("mean")))
    norm = shapes.standardised(F.col(column), F.col("mean"), F.col("std"), eps)
    return base.withColumn("patches", shapes.patches(norm, length, stride))


def last_windows(features: DataFrame, *, scale: str, n: int, channels: Sequence[str],
                 name: str = "window", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Per bar, the last ``n`` rows of the channels as an array; short ones removed."""
    item = F.struct(*[F.col(c).cast("float").alias(c) for c in channels])
    out = over_series(features, lambda w: {name: F.collect_list(item).over(w.rowsBetween(-(n - 1), 0))},
                      lookback=n, chunk_rows=chunk_rows)
    return out.filter(F.size(name) == n).select(
        "symbol", "ts", clock.effective_close_of(scale, "ts").alias("eff_close"), name)
