"""Feature queries."""

from pyspark.sql import functions as F

from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.functions import clock, shapes
from tickloom.operators.series import over_series
from tickloom.plans import features as ft
from tickloom.session import stored
from tickloom.sources import marketviews as mv

CAP_DAY = "2000-06-30 10:00:00"
CAP_INTRA = "1996-02-12 06:17:00"
FAR = "2100-01-01 00:00:00"


def feature_sql(scale: str, cap: str, table: str | None = None) -> str:
    """SELECT of every feature column of one scale from closed bars."""
    src = table or f"bars_{scale}"
    minutes = clock.SCALE_MINUTES.get(scale, 0)
    ist = "(ts + INTERVAL 330 MINUTE)"
    ang = f"((hour{ist} * 60 + minute{ist}) - 555) / 375.0::DOUBLE * 2 * pi()"
    msin, mcos = ("0.0::DOUBLE", "1.0::DOUBLE") if scale == "day" else (f"sin({ang})", f"cos({ang})")
    dow = f"isodow{ist} * (2 * pi() / 7)"
    rets = ", ".join(f"ln(close / lag(close, {k}) OVER w) AS ret_{k}" for k in (1, 5, 15, 60))
    return f"""
  SELECT symbol, ts, scale, open, high, low, close, volume, {rets},
    high - low AS bar_range, abs(close - open) AS body,
    CASE WHEN high - low > 0 THEN (high - greatest(open, close)) / (high - low) END AS upper_wick_norm,
    CASE WHEN high - low > 0 THEN (least(open, close) - low) / (high - low) END AS lower_wick_norm,
    CASE WHEN count(volume) OVER z = 20 AND stddev_samp(volume) OVER z > 0
         THEN (volume - avg(volume) OVER z) / stddev_samp(volume) OVER z END AS vol_z_20,
    {msin} AS min_of_day_sin, {mcos} AS min_of_day_cos, sin({dow}) AS day_of_week_sin, cos({dow}) AS day_of_week_cos
  FROM {src} WHERE ts + to_minutes({minutes}) <= TIMESTAMP '{cap}'
  WINDOW w AS (PARTITION BY symbol ORDER BY ts),
         z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def store_sql(scale: str, cap: str) -> str:
    cols = ", ".join(f"coalesce({c}, 0.0) AS {c}" if "wick" in c else c for c in ft.STORE_COLUMNS)
    return f"SELECT {cols} FROM ({feature_sql(scale, cap)}) WHERE ret_60 IS NOT NULL AND vol_z_20 IS NOT NULL"


def out_sql(columns, table: str, digits: int = 6) -> str:
    keep = {"symbol", "ts", "scale", "volume", "open", "high", "low", "close", "anchor_ts", "t"}
    return "SELECT " + ", ".join(c if c in keep else f"{r(c, digits)} AS {c}" for c in columns) + f" FROM {table}"


def q_features(scale, cap):
    return lambda s, d: rounded(ft.compute_features(mv.bars(s, d, scale), scale=scale, as_of=cap))


def q_store(scale, cap):
    return lambda s, d: rounded(ft.feature_store(mv.bars(s, d, scale), scale=scale, as_of=cap))


def q_windowed(s, d):
    return rounded(ft.compute_features(
        mv.bars(s, d, "day"), scale="day", as_of=CAP_DAY, window_start="1999-03-01", window_end="1999-12-31",
        groups=("bar_channels", "log_returns", "wicks")))


ALL = ("symbol", "ts", "scale", *ft.CHANNELS)


def digits_for(name: str) -> int:
    """Digits that keep averages of five-decimal prices away from rounding ties."""
    return {"mean": 8, "std": 5, "trend": 7}.get(name.rsplit("__", 1)[-1], 6)


def by_stat(df):
    """Trends divide by values near zero, so they are reported as signed log1p."""
    df = df.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in df.columns if c.endswith("__trend")})
    return rounded(df, 6, **{c: digits_for(c) for c in df.columns})


CHAN_SMALL = {"5m": 8, "15m": 6, "60m": 4, "day": 5}


def stores(s, d, cap=FAR):
    return {sc: ft.feature_store(mv.bars(s, d, sc), scale=sc, as_of=cap) for sc in clock.SCALES}


def stored_stores(s, d):
    """The feature stores as tables, as a pipeline keeps them: plans that read them several times derive them once."""
    return {sc: stored(df, f"features-{sc}") for sc, df in stores(s, d).items()}


def summary_sql(scale: str, n: int, source: str, channels=ft.CHANNELS) -> str:
    cols = []
    for ch in channels:
        c = f"CAST({ch} AS DOUBLE)"
        cols.append(f"{c} AS {ch}__last")
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append(f"CASE WHEN count({ch}) OVER f = {n} THEN {fn}({c}) OVER f END AS {ch}__{name}")
        lag = f"lag({c}, {n - 1}) OVER w"
        cols.append(f"({c} - {lag}) / (abs({lag}) + 1e-12) AS {ch}__trend")
    if scale == "5m":
        cols += [f"lag(CAST({ch} AS DOUBLE), {k}) OVER w AS {ch}__last5_b{k}" for ch in channels[:5] for k in range(5)]
    m = clock.SCALE_MINUTES.get(scale, 0)
    return (f"SELECT symbol, ts + to_minutes({m}) AS eff_close, {', '.join(cols)} FROM {source} "
            f"WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def matrix_ctes(cap=FAR) -> dict[str, str]:
    ctes = {}
    for sc in clock.SCALES:
        ctes[f"st_{sc}"] = store_sql(sc, cap)
        ctes[f"su_{sc}"] = summary_sql(sc, CHAN_SMALL[sc], f"st_{sc}")
    return ctes


MATRIX_KEEP = ("5m__close__mean", "5m__ret_5__std", "5m__volume__last5_b3", "5m__bar_range__trend",
               "15m__high__max", "15m__vol_z_20__min", "60m__low__min", "60m__ret_1__mean",
               "60m__min_of_day_cos__std", "day__close__std", "day__ret_60__last", "day__body__max")


def day_anchors(s, d):
    return mv.bars_day(s, d).select("symbol", F.col("ts").alias("anchor_ts"))


def q_matrix(s, d):
    d = mv.market(s, d)
    return by_stat(ft.anchor_matrix(stores(s, d), day_anchors(s, d), as_of=FAR, window_bars=CHAN_SMALL,
                                    keep=MATRIX_KEEP))


def matrix_sql(keep, anchors="SELECT symbol, ts AS anchor_ts FROM bars_day", names=None):
    names = names or {k: f'"{k}"' for k in keep}
    joins = " ".join(
        f"ASOF LEFT JOIN su_{sc} AS s_{sc} ON a.symbol = s_{sc}.symbol AND a.anchor_ts > s_{sc}.eff_close"
        for sc in clock.SCALES)
    src = lambda k: f's_{k.split("__", 1)[0]}.{k.split("__", 1)[1]}'
    val = lambda k: f"sign({src(k)}) * ln(1 + abs({src(k)}))" if k.endswith("__trend") else src(k)
    sel = ", ".join(f"{r(val(k), digits_for(k))} AS {names[k]}" for k in keep)
    ok = " AND ".join(f"{src(k)} IS NOT NULL" for k in keep)
    return oracle(f"SELECT a.symbol, a.anchor_ts, {sel} FROM ({anchors}) a {joins} WHERE {ok}", **matrix_ctes())


def q_aux(s, d):
    d = mv.market(s, d)
    out = ft.aux_features(stores(s, d), as_of=FAR, window_bars=CHAN_SMALL, precise=True)
    out = out.withColumns({f"f_{i}": F.signum(f"f_{i}") * F.log1p(F.abs(f"f_{i}"))
                           for i, k in enumerate(ft.AUX_FEATURES) if k.endswith("__trend")})
    return rounded(out, 6, **{f"f_{i}": digits_for(k) for i, k in enumerate(ft.AUX_FEATURES)})


# ---- the full matrix: 457 columns at full window lengths, reported as one weighted whole number per (scale, statistic)
#: channels with values near one get six decimals, prices and volumes two; the offset keeps averages off rounding ties
FINE, COARSE, OFFSET = 1e6, 1e2, 1.7e-6


def digest_terms(scale: str):
    """(statistic, [(column, weight, factor)]) so that every column counts with a weight of its own."""
    stats = {stat: [] for stat in ft.SUMMARY}
    for i, ch in enumerate(ft.CHANNELS):
        for stat in ft.SUMMARY:
            factor = 1e3 if stat == "trend" else COARSE if i < 5 else FINE
            stats[stat].append((f"{scale}__{ch}__{stat}", 2 * i + 1, factor))
    if scale == "5m":
        stats["raw"] = [(f"5m__{ch}__last5_b{k}", 2 * (5 * i + k) + 1, COARSE) for i, ch in enumerate(ft.CHANNELS[:5]) for k in range(5)]
    return stats


def whole_number(c, factor: float):
    return F.round(c * factor + OFFSET).cast("long")


def q_full_matrix(s, d):
    d = mv.market(s, d)
    wide = ft.full_anchor_matrix(stored_stores(s, d), day_anchors(s, d), as_of=FAR)
    signed = lambda n: F.signum(n) * F.log1p(F.abs(n)) if n.endswith("__trend") else F.col(n)
    out = []
    for sc in clock.SCALES:
        for stat, terms in digest_terms(sc).items():
            total = sum((whole_number(signed(n), f) * w for n, w, f in terms[1:]), whole_number(signed(terms[0][0]), terms[0][2]) * terms[0][1])
            out.append(total.alias(f"{stat}_{sc}"))
    return wide.select("symbol", "anchor_ts", *out)


def full_matrix_sql():
    joins = " ".join(f"ASOF JOIN su_{sc} AS s_{sc} ON a.symbol = s_{sc}.symbol AND a.anchor_ts > s_{sc}.eff_close" for sc in clock.SCALES)
    src = lambda k: f's_{k.split("__", 1)[0]}.{k.split("__", 1)[1]}'
    val = lambda k: f"sign({src(k)}) * ln(1 + abs({src(k)}))" if k.endswith("__trend") else src(k)
    whole = lambda k, f: f"CAST(round({val(k)} * {f:.0f}.0::DOUBLE + {OFFSET}::DOUBLE) AS BIGINT)"
    cols = [" + ".join(f"{whole(k, f)} * {w}" for k, w, f in terms) + f" AS {stat}_{sc}"
            for sc in clock.SCALES for stat, terms in digest_terms(sc).items()]
    ctes = {}
    for sc in clock.SCALES:
        ctes[f"st_{sc}"] = store_sql(sc, FAR)
        ctes[f"su_{sc}"] = summary_sql(sc, ft.WINDOW_BARS[sc], f"st_{sc}")
    ok = " AND ".join(f"{src(k)} IS NOT NULL" for k in ft.matrix_columns())
    return oracle(f"SELECT a.symbol, a.anchor_ts, {', '.join(cols)} FROM (SELECT symbol, ts AS anchor_ts FROM bars_day) a {joins} WHERE {ok}", **ctes)


def q_aux_full(s, d):
    """All fifty auxiliary features at full window lengths, as one weighted whole number per anchor and group of ten."""
    d = mv.market(s, d)
    out = ft.aux_features(stored_stores(s, d), as_of=FAR, precise=True, by_number=True)
    return out.select("symbol", "anchor_ts", *aux_digest())


def aux_digest():
    """All fifty auxiliary features, a whole number for every ten of them."""
    total = lambda i: sum((aux_whole(j) * (2 * j + 1) for j in range(i + 1, i + 10)), aux_whole(i) * (2 * i + 1))
    return [total(i).alias(f"g_{i // 10}") for i in range(0, 50, 10)]


def aux_factor(name: str) -> float:
    ch, stat = name.split("__")[1:]
    return 1e3 if stat == "trend" else COARSE if ch in ft.CHANNELS[:5] else FINE


def aux_whole(i: int):
    name, c = ft.AUX_FEATURES[i], F.col(f"f_{i}")
    return whole_number(F.signum(c) * F.log1p(F.abs(c)) if name.endswith("__trend") else c, aux_factor(name))


def aux_full_sql(sizes=ft.WINDOW_BARS, shown=()):
    """Anchors with the digest of all features over windows of ``sizes`` bars, and the features numbered in ``shown`` as they are."""
    src = lambda k: f's_{k.split("__", 1)[0]}.{k.split("__", 1)[1]}'
    val = lambda k: f"sign({src(k)}) * ln(1 + abs({src(k)}))" if k.endswith("__trend") else src(k)
    whole = lambda k: f"CAST(round({val(k)} * {aux_factor(k):.0f}.0::DOUBLE + {OFFSET}::DOUBLE) AS BIGINT)"
    cols = [" + ".join(f"{whole(ft.AUX_FEATURES[j])} * {2 * j + 1}" for j in range(i, i + 10)) + f" AS g_{i // 10}" for i in range(0, 50, 10)]
    cols += [f"{src(ft.AUX_FEATURES[i])} AS f_{i}" for i in shown]
    joins = " ".join(f"ASOF JOIN su_{sc} AS s_{sc} ON a.symbol = s_{sc}.symbol AND a.anchor_ts > s_{sc}.eff_close" for sc in clock.SCALES)
    ctes = {}
    for sc in clock.SCALES:
        ctes[f"st_{sc}"] = store_sql(sc, FAR)
        ctes[f"su_{sc}"] = summary_sql(sc, sizes[sc], f"st_{sc}")
    ok = " AND ".join(f"{src(k)} IS NOT NULL" for k in ft.AUX_FEATURES)
    return oracle(f"SELECT a.symbol, a.anchor_ts, {', '.join(cols)} FROM (SELECT symbol, ts + INTERVAL 5 MINUTE AS anchor_ts FROM st_5m) a {joins} WHERE {ok}", **ctes)


def q_rolling(s, d):
    st = ft.feature_store(mv.bars(s, d, "15m"), scale="15m", as_of=FAR)
    out = ft.rolling_summary(st, scale="15m", window_bars=12, channels=("close", "volume", "ret_1"))
    return by_stat(out)


def rolling_sql():
    names = [f"{c}__{k}" for c in ("close", "volume", "ret_1") for k in ("last", "mean", "std", "min", "max", "trend")]
    return oracle("SELECT symbol, ts, eff_close, " + ", ".join(
        f"{r(f'sign({n}) * ln(1 + abs({n}))' if n.endswith('trend') else n, digits_for(n))} AS {n}" for n in names)
                  + " FROM (SELECT *, eff_close - INTERVAL 15 MINUTE AS ts FROM su)",
                  st=store_sql("15m", FAR), su=summary_sql("15m", 12, "st", ("close", "volume", "ret_1")))


def book_features_sql():
    f = {0: "(bq * ask1_price + aq * bid1_price) / (bq + aq + 1e-9)",
         1: "lm - lag(lm) OVER w", 2: "spread_bps", 3: "(bq - aq) / (bq + aq + 1e-9)",
         4: "bq / (bq + aq + 1e-9)",
         5: """((CASE WHEN bid1_price > lag(bid1_price) OVER w THEN bq WHEN bid1_price < lag(bid1_price) OVER w
                 THEN -lag(bq) OVER w ELSE bq - lag(bq) OVER w END)
              - (CASE WHEN ask1_price < lag(ask1_price) OVER w THEN aq WHEN ask1_price > lag(ask1_price) OVER w
                 THEN -lag(aq) OVER w ELSE aq - lag(aq) OVER w END)) / (bq + aq + 1e-9)""",
         6: "ln(total_buy_qty + 1.0::DOUBLE)", 7: "ln(total_sell_qty + 1.0::DOUBLE)"}
    raw = ("SELECT symbol, ts, row_number() OVER w AS rn, "
           + ", ".join(f"CAST({e} AS REAL) AS g_{i}" for i, e in f.items())
           + " FROM (SELECT *, CAST(bid1_qty AS DOUBLE) bq, CAST(ask1_qty AS DOUBLE) aq, "
             "ln((bid1_price + ask1_price) * 0.5) lm FROM book) WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
    fill = ", ".join(f"coalesce(last_value(g_{i} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts "
                     f"ROWS UNBOUNDED PRECEDING), 0)::REAL AS f_{i}" for i in f)
    names = ", ".join(f"round(f_{i}::DOUBLE, 4) + 0.0 AS f_{i}" for i in f)
    return oracle(f"SELECT symbol, ts, {names} FROM (SELECT *, {fill} FROM raw) WHERE rn > 1", raw=raw)


def q_book_features(s, d):
    out = ft.book_features(mv.book(s, d))
    return rounded(out.select("symbol", "ts", *[F.col(f"f_{i}").cast("double").alias(f"f_{i}") for i in range(8)]), 4)


STAT = ("open_ret", "high_pos", "low_pos", "close_ret", "log_volume")


def q_stationary(s, d):
    out = ft.stationary_bars(mv.bars_day(s, d))
    return rounded(out.select("symbol", "ts", *STAT))


STAT_SQL = """SELECT *, ln(open / p) AS open_ret, ln(high / open) AS high_pos, ln(low / open) AS low_pos,
  ln(close / p) AS close_ret, ln(1 + volume::DOUBLE) AS log_volume
  FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS p FROM bars_day)"""


def q_rebuild(s, d):
    b = ft.stationary_bars(mv.bars_day(s, d)).withColumn("anchor", F.lit(100.0))
    return rounded(ft.rebuild_close(b, "anchor").select("symbol", "ts", "rebuilt_close"), 4)


def q_forward(s, d):
    b = ft.stationary_bars(mv.bars_day(s, d))
    out = ft.forward_sums(b, (3, 6, 12)).select("symbol", "ts", "fwd_3", "fwd_6", "fwd_12")
    raw = ft.forward_sums(b, (3,), scale_by="std", stds={3: 0.25}).select(
        "symbol", "ts", F.col("fwd_3").alias("std_3"))
    return rounded(out.join(raw, ["symbol", "ts"]))


FWD_SQL = "SELECT symbol, ts, " + ", ".join(
    f"{r(f'CASE WHEN count(close_ret) OVER f{h} = {h} THEN sum(close_ret) OVER f{h} END / {s}')} AS {n}"
    for h, s, n in ((3, "sqrt(3.0::DOUBLE)", "fwd_3"), (6, "sqrt(6.0::DOUBLE)", "fwd_6"),
                    (12, "sqrt(12.0::DOUBLE)", "fwd_12"), (3, "(0.25 + 1e-9)", "std_3"))) + " FROM stat WINDOW " + ", ".join(
    f"f{h} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (3, 6, 12))


def q_patches(s, d):
    b = ft.stationary_bars(mv.bars_day(s, d))
    win = over_series(b, lambda w: {"win": F.collect_list("close_ret").over(w.rowsBetween(-15, 0)),
                                    "vol": F.collect_list(F.col("volume").cast("double")).over(w.rowsBetween(-15, 0))},
                      lookback=16).filter(F.size("win") == 16)
    out = ft.window_patches(win, "win", length=8, stride=4)
    vols = F.transform(shapes.patches(F.col("vol"), 8, 4), shapes.array_mean)
    flat = out.select("symbol", "ts", "mean", "std", F.posexplode(F.arrays_zip(
        F.col("patches").alias("p"), vols.alias("v"))).alias("patch", "x"))
    return rounded(flat.select("symbol", "ts", "mean", "std", F.col("patch").cast("long").alias("patch"),
                               shapes.array_mean(F.col("x.p")).alias("patch_mean"),
                               F.element_at("x.p", -1).alias("patch_last"), F.col("x.v").alias("volume_mean")), 5)


PATCH_SQL = oracle(f"""SELECT symbol, ts, {r('mean', 5)} AS mean, {r('std', 5)} AS std, i AS patch,
  {r('(list_avg(win[i*4+1 : i*4+8]) - mean) / (std + 1e-5)', 5)} AS patch_mean,
  {r('(win[i*4+8] - mean) / (std + 1e-5)', 5)} AS patch_last, {r('list_avg(vol[i*4+1 : i*4+8])', 5)} AS volume_mean
  FROM (SELECT *, list_avg(win) AS mean, list_stddev_pop(win) AS std, unnest([0, 1, 2])::BIGINT AS i FROM wins WHERE len(win) = 16)""",
                   stat=STAT_SQL, wins="""SELECT symbol, ts, list(close_ret) OVER f AS win, list(volume::DOUBLE) OVER f AS vol
  FROM stat WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")


def q_null_audit(s, d):
    return ft.null_counts(ft.compute_features(mv.bars(s, d, "day"), scale="day", as_of=CAP_DAY))


def q_anchor_clock(s, d):
    b = mv.bars_5m(s, d).select(F.col("ts").alias("t")).distinct()
    circ = clock.anchor_circle(F.unix_micros("t"))
    return rounded(b.select("t", *[c.alias(n) for n, c in circ.items()], *clock.session_harmonics(F.col("t"))[:6]))


_D = "floor((epoch_us(t) / 1e6 + 19800.0) / 86400.0)"
_S = "(epoch_us(t) / 1e6 + 19800.0)"
_FR = "(((hour(t + INTERVAL 330 MINUTE) * 60 + minute(t + INTERVAL 330 MINUTE)) - 555) / 390.0::DOUBLE)"
CLOCK_SQL = oracle("SELECT t, " + ", ".join(
    f"{r(f'{fn}(2 * pi() * {e})')} AS {n}_{fn}" for n, e in (
        ("day", f"(({_S} - {_D} * 86400.0) / 86400.0)"), ("week", f"((({_D} + 3) % 7) / 7.0)"),
        ("year", f"(({_D} - floor({_D} / 365.25::DOUBLE) * 365.25::DOUBLE) / 365.25::DOUBLE)")) for fn in ("sin", "cos")) + ", " + ", ".join(
    f"{r(f'{fn}(2 * pi() * {k} * {_FR})')} AS tod_{fn}_{k}" for k in (1, 2, 3) for fn in ("sin", "cos"))
    + " FROM (SELECT DISTINCT ts AS t FROM bars_5m)")

QUERIES = {
    "features_5m": (q_features("5m", CAP_INTRA), oracle(out_sql(ALL, "f"), f=feature_sql("5m", CAP_INTRA))),
    "features_day": (q_features("day", CAP_DAY), oracle(out_sql(ALL, "f"), f=feature_sql("day", CAP_DAY))),
    "features_windowed": (q_windowed, oracle(
        out_sql([c for c in ALL if not c.startswith(("vol_z", "min_of", "day_of"))],
                "f WHERE ts BETWEEN TIMESTAMP '1999-03-01' AND TIMESTAMP '1999-12-31'"),
        f=feature_sql("day", CAP_DAY, "(SELECT * FROM bars_day WHERE ts >= TIMESTAMP '1999-03-01' - INTERVAL 100 DAY)"))),
    "feature_store_60m": (q_store("60m", CAP_INTRA), oracle(out_sql(ALL, "f"), f=store_sql("60m", CAP_INTRA))),
    "feature_null_audit": (q_null_audit, oracle(
        "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in ALL) + " FROM f", f=feature_sql("day", CAP_DAY))),
    "rolling_summary_15m": (q_rolling, rolling_sql()),
    "anchor_matrix": (q_matrix, matrix_sql(MATRIX_KEEP)),
    "anchor_matrix_full": (q_full_matrix, full_matrix_sql()),
    "aux_features_full": (q_aux_full, aux_full_sql()),
    "aux_features": (q_aux, matrix_sql(
        ft.AUX_FEATURES, "SELECT symbol, ts + INTERVAL 5 MINUTE AS anchor_ts FROM st_5m",
        {k: f"f_{i}" for i, k in enumerate(ft.AUX_FEATURES)})),
    "book_features": (q_book_features, book_features_sql()),
    "stationary_bars": (q_stationary, oracle(
        "SELECT symbol, ts, " + ", ".join(f"{r(c)} AS {c}" for c in STAT) + " FROM stat", stat=STAT_SQL)),
    "rebuilt_closes": (q_rebuild, oracle(
        f"SELECT symbol, ts, {r('100.0::DOUBLE * exp(sum(close_ret) OVER (PARTITION BY symbol ORDER BY ts))', 4)} AS rebuilt_close FROM stat",
        stat=STAT_SQL)),
    "forward_sums": (q_forward, oracle(FWD_SQL, stat=STAT_SQL)),
    "window_patches": (q_patches, PATCH_SQL),
    "anchor_clock": (q_anchor_clock, CLOCK_SQL),
}
