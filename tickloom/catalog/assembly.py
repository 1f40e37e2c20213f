"""As-of, window, cross-section, cohort, sampling and model queries."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickloom.catalog.features import (CHAN_SMALL, COARSE, FAR, FINE, MATRIX_KEEP, OFFSET, aux_digest, aux_full_sql, day_anchors, matrix_ctes,
                                       stored_stores, stores)
from tickloom.catalog.labels import daily_sql, intraday_sql, labels_1d, q_tradeable, tradeable_sql
from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.functions import clock, shapes
from tickloom.operators.asof import asof
from tickloom.plans import cohort as co, crosssection as cs, features as ft, labels as lb, metrics as mt, models as md, strategy as st
from tickloom.session import stored
from tickloom.sources import dimensions as dm, marketviews as mv

WIN = {"5m": 8, "15m": 6, "60m": 4, "day": 5}


def q_asof(strict):
    def run(s, d):
        left = mv.table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("t"))
        right = mv.book(s, d).select("symbol", F.col("ts").alias("bts"), "ltp", "volume")
        return rounded(asof(left, right, left_time="t", right_time="bts", strict=strict, bucket="day"))
    return run


def asof_sql(op):
    return oracle(f"""SELECT event_id, e.symbol, e.t, b.ts AS bts, {r('b.ltp')} AS ltp, b.volume FROM (SELECT event_id, event_type AS symbol, date_trunc('minute', ts) AS t FROM events) e
  ASOF LEFT JOIN book b ON b.symbol = e.symbol AND e.t {op} b.ts""")


def q_cross(s, d):
    d = mv.market(s, d)
    rows = cs.cross_sections(labels_1d(s, d), stores(s, d), horizon="1d", window_bars=WIN, channels=("close", "volume"), vol_returns=12)
    out = rows.select("t", "symbol", "y", "rank", F.col("vol_bucket").cast("int").alias("vol_bucket"), "vol",
                      *[F.col(f"w_{k}")[0]["close"].cast("double").alias(f"first_{k}") for k in WIN],
                      *[F.element_at(f"w_{k}", -1)["close"].cast("double").alias(f"last_{k}") for k in WIN],
                      *[F.aggregate(f"w_{k}", F.lit(0.0), lambda a, x: a + x["volume"]).alias(f"volume_{k}") for k in WIN])
    return rounded(out, 5)


def windows_ctes(sizes=WIN, more=""):
    """Windows of ``sizes`` bars at every scale; ``more`` adds columns to them."""
    base = {k: v for k, v in matrix_ctes().items() if k.startswith("st_")}
    for sc, n in sizes.items():
        m = clock.SCALE_MINUTES.get(sc, 0)
        base[f"w_{sc}"] = f"""SELECT * FROM (SELECT symbol, ts + to_minutes({m}) AS eff_close, first_value(close::REAL::DOUBLE) OVER f AS first_c, close::REAL::DOUBLE AS last_c, sum(volume::REAL::DOUBLE) OVER f AS vol_c, {more}count(*) OVER f AS k
  FROM st_{sc} WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE k = {n}"""
    base["vv"] = """SELECT * FROM (SELECT symbol, ts AS eff_close, CASE WHEN count(lr) OVER f = 12 THEN stddev_samp(lr) OVER f END AS vol FROM (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM st_day) WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE vol IS NOT NULL"""
    return base


CROSS_SQL = oracle(f"""SELECT t, symbol, y, {r('(row_number() OVER (PARTITION BY t ORDER BY y, symbol) - 1) / greatest(n - 1, 1)::DOUBLE', 5)} AS rank,
  CAST(CASE WHEN mn = mx THEN 2 ELSE len(list_filter(e, lambda x: x <= vol)) END AS INTEGER) AS vol_bucket, {r('vol', 5)} AS vol, """
                   + ", ".join(f"{r(f'first_{k}', 5)} AS first_{k}, {r(f'last_{k}', 5)} AS last_{k}, {r(f'volume_{k}', 5)} AS volume_{k}" for k in WIN)
                   + """ FROM cr JOIN (SELECT t, count(*) AS n, min(vol) AS mn, max(vol) AS mx, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) AS e FROM cr GROUP BY t) USING (t) WHERE n >= 10""",
                   **windows_ctes(), lab=daily_sql(1), cr="SELECT a.symbol, a.t, a.y_log_return AS y, vv.vol, "
                   + ", ".join(f"x{k}.first_c AS first_{k}, x{k}.last_c AS last_{k}, x{k}.vol_c AS volume_{k}" for k in WIN) + " FROM (SELECT * FROM lab WHERE valid_label) a "
                   + " ".join(f"ASOF JOIN w_{k} x{k} ON x{k}.symbol = a.symbol AND a.t > x{k}.eff_close" for k in WIN) + " ASOF JOIN vv ON vv.symbol = a.symbol AND a.t > vv.eff_close")


# ---- the other horizons, with auxiliary features, book windows and tradeable labels
AUX_SHOWN = (0, 9)
#: Window lengths of the intraday cross-sections, and those of their auxiliary features. Rows are wanted at both: 168 hourly bars and their
#: warm-up lie behind the last hours of the test tables only (33 sessions), windows of a few bars behind nearly every label.
LENGTHS = {"full": (ft.WINDOW_BARS, ft.WINDOW_BARS), "short": (WIN, CHAN_SMALL)}


def channel_factors():
    """(channel, weight, factor) so that every channel counts with a weight of its own."""
    return [(ch, 2 * i + 1, COARSE if i < 5 else FINE) for i, ch in enumerate(ft.CHANNELS)]


def channel_digest():
    """Mean, first and last value of every channel of a window in one whole number per scale."""
    def total(w):  # as text: column by column the 72 sums take seconds to build
        whole = lambda e, f: f"CAST(round(({e}) * {f}D + {OFFSET}D) AS BIGINT)"
        return " + ".join(f"({whole(f'aggregate({w}, 0D, (a, x) -> a + x.{ch}) / size({w})', f)} + {whole(f'CAST({w}[0].{ch} AS DOUBLE)', f)} * 3"
                          f" + {whole(f'CAST(element_at({w}, -1).{ch} AS DOUBLE)', f)} * 7) * {weight}" for ch, weight, f in channel_factors())
    return [F.expr(total(f"w_{k}")).alias(f"channels_{k}") for k in WIN]


def channel_digest_sql():
    x = lambda ch: f"{ch}::REAL::DOUBLE"
    whole = lambda e, f: f"CAST(round({e} * {f:.0f}.0::DOUBLE + {OFFSET}::DOUBLE) AS BIGINT)"
    return " + ".join(f"({whole(f'avg({x(ch)}) OVER f', f)} + {whole(f'(first_value({x(ch)}) OVER f)', f)} * 3 + {whole(x(ch), f)} * 7) * {w}"
                      for ch, w, f in channel_factors())


def digest():
    """First and last close and the summed volume of every window."""
    return [c for k in WIN for c in (F.col(f"w_{k}")[0]["close"].cast("double").alias(f"first_{k}"),
                                     F.element_at(f"w_{k}", -1)["close"].cast("double").alias(f"last_{k}"),
                                     F.aggregate(f"w_{k}", F.lit(0.0), lambda a, x: a + x["volume"]).alias(f"volume_{k}"))]


def q_cross_intraday(h, returns):
    def run(s, d):
        d = mv.market(s, d)
        st_ = stored_stores(s, d)
        # tables of their own, as in a pipeline: both lengths read them, and no plan spans more than one length
        labels = stored(lb.intraday_labels(mv.bars_5m(s, d), h, as_of=FAR), "labels")
        tradeable = stored(q_tradeable(s, d, FAR), "tradeable")
        shown = [*digest(), *channel_digest(), *[F.col(f"f_{i}") for i in AUX_SHOWN], *aux_digest()]

        def sections(name, sizes, aux_sizes):
            aux = ft.aux_features(st_, as_of=FAR, window_bars=aux_sizes, precise=True, by_number=name == "full")
            rows = cs.cross_sections(labels, st_, horizon=h, window_bars=sizes, channels=ft.CHANNELS, vol_returns=returns,
                                     aux=stored(aux, f"aux-{name}"), tradeable=tradeable, min_symbols=1, width="n_symbols")
            out = rows.select(F.lit(name).alias("windows"), "t", "symbol", "y", "rank", F.col("vol_bucket").cast("int").alias("vol_bucket"), "vol", *shown,
                              "tradeable_label", "tradeable_valid", "n_symbols", (F.col("n_symbols") >= cs.MIN_SYMBOLS).alias("wide"))
            return stored(out, f"sections-{name}")

        return rounded(reduce(DataFrame.unionByName, [sections(name, *sizes) for name, sizes in LENGTHS.items()]), 5)
    return run


def q_cross_book(s, d):
    d = mv.market(s, d)
    book = mv.book_for_stocks(s, d).select("symbol", "ts", shapes.microprice().alias("f_0"))
    rows = cs.cross_sections(labels_1d(s, d, "2d"), stored_stores(s, d), horizon="2d", window_bars=WIN, channels=("close", "volume"),
                             vol_returns=12, book=book, book_k=3, book_stale_minutes=360, book_channels=("f_0",))
    out = rows.select("t", "symbol", "y", "rank", F.col("vol_bucket").cast("int").alias("vol_bucket"), "vol", *digest(), "book_mask",
                      F.col("book_window")[0]["f_0"].cast("double").alias("oldest"), F.element_at("book_window", -1)["f_0"].cast("double").alias("newest"))
    return rounded(out, 5, oldest=3, newest=3)


def cross_sql(labels: str, vol_scale: str, returns: int, columns: str = "", joins: str = "", kept: str = "", width: int = 10, sizes=WIN, more: str = "") -> str:
    """Cross-sections in SQL: ``columns`` and ``joins`` add to the matched rows, ``kept`` to the result, ``more`` to the windows."""
    ctes = {k: v for k, v in windows_ctes(sizes, more).items() if k != "vv"}
    minutes = clock.SCALE_MINUTES.get(vol_scale, 0)
    ctes["vv"] = f"""SELECT * FROM (SELECT symbol, ts + to_minutes({minutes}) AS eff_close, CASE WHEN count(lr) OVER f = {returns} THEN stddev_samp(lr) OVER f END AS vol FROM (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM st_{vol_scale}) WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {returns - 1} PRECEDING AND CURRENT ROW)) WHERE vol IS NOT NULL"""
    shown = ", ".join(f"{r(f'first_{k}', 5)} AS first_{k}, {r(f'last_{k}', 5)} AS last_{k}, {r(f'volume_{k}', 5)} AS volume_{k}" for k in WIN)
    return oracle(f"""SELECT t, symbol, y, {r('(row_number() OVER (PARTITION BY t ORDER BY y, symbol) - 1) / greatest(n - 1, 1)::DOUBLE', 5)} AS rank,
  CAST(CASE WHEN mn = mx THEN 2 ELSE len(list_filter(e, lambda x: x <= vol)) END AS INTEGER) AS vol_bucket, {r('vol', 5)} AS vol, {shown}{kept}
  FROM cr JOIN (SELECT t, count(*) AS n, min(vol) AS mn, max(vol) AS mx, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) AS e FROM cr GROUP BY t) USING (t) WHERE n >= {width}""",
                  **ctes, lab=labels, cr="SELECT a.symbol, a.t, a.y_log_return AS y, vv.vol, "
                  + ", ".join(f"x{k}.first_c AS first_{k}, x{k}.last_c AS last_{k}, x{k}.vol_c AS volume_{k}" for k in WIN) + columns
                  + " FROM (SELECT * FROM lab WHERE valid_label) a "
                  + " ".join(f"ASOF JOIN w_{k} x{k} ON x{k}.symbol = a.symbol AND a.t > x{k}.eff_close" for k in WIN)
                  + " ASOF JOIN vv ON vv.symbol = a.symbol AND a.t > vv.eff_close" + joins)


def cross_intraday_sql(h, returns):
    own = [f"f_{i}" for i in AUX_SHOWN] + [f"g_{i}" for i in range(5)]
    columns = "".join(f", x{k}.all_c AS channels_{k}" for k in WIN) + "".join(f", ax.{c}" for c in own)
    kept = "".join(f", channels_{k}" for k in WIN) + "".join(f", {r(c, 5)} AS {c}" if c[0] == "f" else f", {c}" for c in own)

    def sections(sizes, aux_sizes):
        return cross_sql(intraday_sql(h, FAR), "5m", returns, columns + ", coalesce(tl.tradeable_label, 0)::TINYINT AS tradeable_label, coalesce(tl.valid_label, false) AS tradeable_valid",
                         f" JOIN ({aux_full_sql(aux_sizes, AUX_SHOWN)}) ax ON ax.symbol = a.symbol AND ax.anchor_ts = a.t LEFT JOIN ({tradeable_sql(FAR)}) tl ON tl.symbol = a.symbol AND tl.t = a.t",
                         kept + f", tradeable_label, tradeable_valid, n AS n_symbols, n >= {cs.MIN_SYMBOLS} AS wide", 1, sizes, channel_digest_sql() + " AS all_c, ")

    return " UNION ALL ".join(f"SELECT '{name}' AS windows, * FROM ({sections(*sizes)})" for name, sizes in LENGTHS.items())


CROSS_BOOK_SQL = cross_sql(daily_sql(2), "day", 12, ", bk.ok AS book_mask, bk.o AS oldest, bk.f AS newest",
                           """ LEFT JOIN (SELECT q.symbol, q.t, coalesce(k >= 3 AND q.t - INTERVAL 360 MINUTE <= b.ts, false) AS ok, o, f FROM lab q ASOF LEFT JOIN (
  SELECT symbol, ts, f, lag(f, 2) OVER w AS o, row_number() OVER w AS k FROM (SELECT symbol, ts,
    ((bid1_qty * ask1_price + ask1_qty * bid1_price) / (bid1_qty + ask1_qty + 1e-9::DOUBLE))::REAL::DOUBLE AS f FROM sbook) WINDOW w AS (PARTITION BY symbol ORDER BY ts)) b
  ON b.symbol = q.symbol AND q.t > b.ts) bk ON bk.symbol = a.symbol AND bk.t = a.t""",
                           f", book_mask, CASE WHEN book_mask THEN {r('oldest', 3)} END AS oldest, CASE WHEN book_mask THEN {r('newest', 3)} END AS newest")


def q_snapshots(s, d):
    f = ft.book_features(mv.book(s, d))
    anchors = f.select("symbol", F.date_trunc("hour", F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("t")).distinct()
    out = cs.snapshot_windows(anchors, f, k=3, max_stale_minutes=20)
    four = lambda c: F.round(c["f_0"].cast("double"), 4)
    return rounded(out.select("symbol", "t", "book_mask", four(F.col("book_window")[0]).alias("oldest"),
                              four(F.element_at("book_window", -1)).alias("newest")), 4)


def snapshots_sql():
    from tickloom.catalog.features import book_features_sql
    inner = book_features_sql()
    head, body = inner.rsplit("SELECT symbol, ts, round", 1)
    return head.rstrip() + f""", bf AS (SELECT symbol, ts, round{body}), wn AS (SELECT symbol, ts, f_0, lag(f_0, 2) OVER (PARTITION BY symbol ORDER BY ts) AS o, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bf)
  SELECT symbol, t, ok AS book_mask, CASE WHEN ok THEN {r('o', 4)} END AS oldest, CASE WHEN ok THEN {r('f_0', 4)} END AS newest FROM (
  SELECT a.symbol, a.t, coalesce(w.k >= 3 AND a.t - INTERVAL 20 MINUTE <= w.ts, false) AS ok, o, f_0
  FROM (SELECT DISTINCT symbol, date_trunc('hour', ts + INTERVAL 1 HOUR) AS t FROM bf) a ASOF LEFT JOIN wn w ON w.symbol = a.symbol AND a.t > w.ts)"""


# ---- cohorts: anchors every five minutes of every session that has bars
GRID_START, GRID_END = 560, 925


def grid(s, d):
    days = mv.bars_5m(s, d).select(clock.exchange_date(F.col("ts")).alias("trade_date")).distinct()
    return co.anchor_grid(days, start=GRID_START, end=GRID_END, step=5)


def cohort_rows(s, d, channels=None):
    st_ = {k: mv.bars(s, d, k) for k in ("5m", "15m")}
    return co.assemble(grid(s, d), mv.bars_5m(s, d), st_, mv.calendar(s, d), window_bars={"5m": 6, "15m": 4}, channels=channels)


GRID = f"""SELECT CAST(d AS TIMESTAMP) + to_minutes(m - 330) AS t, d, m FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM bars_5m),
  (SELECT unnest(range({GRID_START}, {GRID_END + 1}, 5)) AS m)"""
H = co.HORIZONS
ENDS = " UNION ALL ".join(
    f"SELECT t, {i} AS head, " + (
        f"CASE WHEN m + {n} <= 930 THEN t + INTERVAL {n} MINUTE END AS ep FROM gr" if kind == "intraday"
        else "CASE WHEN m < 930 THEN CAST(d AS TIMESTAMP) + INTERVAL 10 HOUR END AS ep FROM gr" if kind == "to_close"
        else f"CAST(b.trade_date AS TIMESTAMP) + to_minutes(225 + {5 if name == 'overnight' else n}) AS ep FROM gr JOIN cal a ON a.trade_date = d JOIN cal b ON b.idx = a.idx + {ahead}")
    for i, (name, kind, n, ahead) in enumerate(H))
COHORT = {
    "gr": GRID, "ends": ENDS, "cl": "SELECT symbol, ts + INTERVAL 5 MINUTE AS at, close FROM bars_5m",
    "n15": "SELECT symbol, ts + INTERVAL 15 MINUTE AS at15, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k15 FROM bars_15m",
    "here": """SELECT c.symbol, gr.t, gr.d, gr.m, c.close AS c0, k5 FROM gr
  JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cl.at) AS k5 FROM cl) c ON c.at = gr.t""",
    "al": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM (SELECT h.* FROM here h ASOF JOIN n15 ON n15.symbol = h.symbol AND h.t >= n15.at15
  WHERE k5 >= 6 AND k15 >= 4)) WHERE n >= 10""",
    "ys": "SELECT al.t, al.symbol, head, ln(cl.close / c0)::REAL AS y FROM al JOIN ends USING (t) JOIN cl ON cl.symbol = al.symbol AND cl.at = ep",
}


def q_cohort(s, d):
    rows = cohort_rows(s, d)
    return rows.select("t", "symbol", *[F.col("labels")[i].alias(H[i][0]) for i in range(len(H))])


COHORT_SQL = oracle("SELECT al.t, al.symbol, " + ", ".join(f"max(CASE WHEN head = {i} THEN y END) AS {H[i][0]}" for i in range(len(H)))
                    + " FROM al LEFT JOIN ys USING (t, symbol) GROUP BY ALL", **COHORT)


def q_endpoints(s, d):
    return co.endpoints(grid(s, d), mv.calendar(s, d)).filter("endpoint IS NOT NULL")


def q_regime(s, d):
    return rounded(co.regime(cohort_rows(s, d).select("t", "symbol", "c0"), mv.bars_5m(s, d), mv.calendar(s, d), mv.symbol_master(s, d)))


REGIME_SQL = oracle(f"""SELECT g.t, {r('coalesce(r5, 0)')} AS univ_5d_ret, {r('coalesce(br, 0.5)')} AS univ_breadth, {r('coalesce(CASE WHEN n1 > 1 THEN xs END, 0)')} AS univ_xs_vol, {r('coalesce(r1, 0)')} AS univ_1d_ret,
  {r('coalesce(disp, 0)')} AS sector_disp_1d, {r('coalesce(r30, 0)')} AS cohort_30m, {r('coalesce(r60, 0)')} AS cohort_1h, {r('coalesce(td, 0)')} AS cohort_today, {r('sin(2 * pi() * (m - 555) / 375)')} AS min_sin, {r('cos(2 * pi() * (m - 555) / 375)')} AS min_cos
  FROM (SELECT DISTINCT t, m FROM al) g LEFT JOIN (SELECT t, avg(r) FILTER (k = 'r5') AS r5, avg((r > 0)::INT) FILTER (k = 'r1') AS br, stddev_pop(r) FILTER (k = 'r1') AS xs, count(*) FILTER (k = 'r1') AS n1,
    avg(r) FILTER (k = 'r1') AS r1, avg(r) FILTER (k = 'r30') AS r30, avg(r) FILTER (k = 'r60') AS r60, avg(r) FILTER (k = 'td') AS td FROM rr GROUP BY t) USING (t)
  LEFT JOIN (SELECT t, CASE WHEN count(*) > 1 THEN stddev_pop(mm) END AS disp FROM (SELECT t, sec, avg(r) AS mm FROM rr WHERE k = 'r1' GROUP BY ALL) GROUP BY t) USING (t)""",
                    **COHORT, mo="""SELECT t, 'r30' AS k, t - INTERVAL 30 MINUTE AS at FROM gr UNION ALL SELECT t, 'r60', t - INTERVAL 60 MINUTE FROM gr
  UNION ALL SELECT t, 'td', CAST(d AS TIMESTAMP) + INTERVAL 230 MINUTE FROM gr WHERE m > 560
  UNION ALL SELECT t, 'r1', CAST(b.trade_date AS TIMESTAMP) + INTERVAL 10 HOUR FROM gr JOIN cal a ON a.trade_date = d JOIN cal b ON b.idx = a.idx - 1
  UNION ALL SELECT t, 'r5', CAST(b.trade_date AS TIMESTAMP) + INTERVAL 10 HOUR FROM gr JOIN cal a ON a.trade_date = d JOIN cal b ON b.idx = a.idx - 5""",
                    rr="SELECT al.t, al.symbol, mo.k, ln(c0 / cl.close) AS r, coalesce(sector, '_no_sector') AS sec FROM al JOIN mo USING (t) JOIN cl ON cl.symbol = al.symbol AND cl.at = mo.at JOIN master ON master.symbol = al.symbol")


def fact_rows(s, d):
    return co.facts(cohort_rows(s, d), dm.with_sector_ids(mv.symbol_master(s, d)))


def q_sector_pairs(s, d):
    return rounded(co.sector_pairs(fact_rows(s, d), threshold=0.5, top=4), 5).drop("pair_type")


VEC = "list_transform([" + ", ".join(f"coalesce(max(CASE WHEN head = {i} THEN y END), 0)::DOUBLE" for i in range(len(H))) + "], lambda v: v)"
FACT = {**COHORT, "fx": f"SELECT al.t, al.symbol, {VEC} AS v FROM al LEFT JOIN ys USING (t, symbol) GROUP BY ALL",
        "fn": """SELECT epoch_us(t) AS us, symbol AS stock, sid, list_transform(v, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(v, lambda q: q * q))) > 1e-9 THEN sqrt(list_sum(list_transform(v, lambda q: q * q))) ELSE 1 END) AS v
  FROM fx JOIN (SELECT symbol, CAST(dense_rank() OVER (ORDER BY coalesce(sector, '_no_sector')) - 1 AS INTEGER) AS sid FROM master) USING (symbol)"""}
PAIRS_SQL = oracle(f"""SELECT a AS stock_a, us AS anchor_a_us, b AS stock_b, us AS anchor_b_us, {r('c', 5)} AS cosine, sid AS sector_id_a, sid AS sector_id_b FROM (
  SELECT *, row_number() OVER (PARTITION BY us, sid ORDER BY c DESC, a, b) AS p FROM (SELECT x.us, x.sid, x.stock AS a, y.stock AS b, list_dot_product(x.v, y.v) AS c
  FROM fn x JOIN fn y ON x.us = y.us AND x.sid = y.sid AND x.stock < y.stock) WHERE c > 0.5) WHERE p <= 4""", **FACT)


def q_same_stock(s, d):
    return co.same_stock_pairs(fact_rows(s, d), per_stock=10, min_days=2, max_days=15, seed=7).drop("pair_type")


SAME_BODY = """SELECT c.stock AS stock_a, c.us AS anchor_a_us, c.stock AS stock_b, q.us AS anchor_b_us, 1.0::DOUBLE AS cosine, c.sid AS sector_id_a, c.sid AS sector_id_b FROM (
  SELECT *, pos + near + CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % m AS pp FROM (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY h) AS p FROM (SELECT *, md5('7|' || stock || '|' || us) AS h FROM ps WHERE m > 0)) WHERE p <= 10) c
  JOIN ps q ON q.stock = c.stock AND q.pos = c.pp"""
SAME_PS = """SELECT *, row_number() OVER w AS pos, count(*) OVER (w RANGE BETWEEN CURRENT ROW AND 172799999999 FOLLOWING) AS near,
  count(*) OVER (w RANGE BETWEEN 172800000000 FOLLOWING AND 1296000000000 FOLLOWING) AS m FROM fn WINDOW w AS (PARTITION BY stock ORDER BY us)"""
SAME_SQL = oracle(SAME_BODY, **FACT, ps=SAME_PS)
PAIR_WINDOWS_SQL = oracle(
    SAME_BODY.replace("SELECT c.stock AS stock_a, c.us AS anchor_a_us, c.stock AS stock_b, q.us AS anchor_b_us, 1.0::DOUBLE AS cosine, c.sid AS sector_id_a, c.sid AS sector_id_b",
                      f"SELECT c.stock AS stock_a, c.us AS anchor_a_us, q.us AS anchor_b_us, {r('a.c0')} AS c0_a, {r('b.c0')} AS c0_b, 6 AS n_a, 6 AS n_b")
    + " JOIN al a ON a.symbol = c.stock AND epoch_us(a.t) = c.us JOIN al b ON b.symbol = q.stock AND epoch_us(b.t) = q.us", **FACT, ps=SAME_PS)


def q_pair_windows(s, d):
    rows = cohort_rows(s, d, ("close",))
    pairs = co.same_stock_pairs(co.facts(rows, dm.with_sector_ids(mv.symbol_master(s, d))), per_stock=10, min_days=2, max_days=15, seed=7)
    out = co.pair_windows(pairs, rows, ["c0", "w_5m"])
    return rounded(out.select("stock_a", "anchor_a_us", "anchor_b_us", "c0_a", "c0_b", F.size("w_5m_a").alias("n_a"), F.size("w_5m_b").alias("n_b")))


# ---- sampling
def q_horizon_sample(s, d):
    p = mv.predictions(s, d).select(F.timestamp_micros("anchor_us").alias("t"), "horizon").distinct()
    return cs.sample_by_horizon(p, {"h1": 70, "h3": 52, "h5": 2}, 400, seed=3)


U = "(CAST(('0x' || substr(md5('{seed}|' || {parts}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0"
HS_SQL = oracle(f"""SELECT make_timestamp(anchor_us) AS t, horizon FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY u) AS p FROM (
  SELECT DISTINCT anchor_us, horizon, {U.format(seed=3, parts="anchor_us || '|' || horizon")} AS u FROM preds)) WHERE p <= CASE horizon WHEN 'h1' THEN {round(400 * 70 / 124)} WHEN 'h3' THEN {round(400 * 52 / 124)} ELSE {max(1, round(400 * 2 / 124))} END""")


def q_day_sample(s, d):
    b = mv.bars_5m(s, d).select("symbol", F.col("ts").alias("anchor_ts"), "close")
    return cs.sample_per_day(b, 5, seed=11)


def q_window_sample(s, d):
    tail = cs.forward_tail(mv.bars_day(s, d), 5)
    picked = cs.sample_windows(tail, 500, time="ts", as_of=clock.as_instant("2001-11-04"), seed=5)
    return rounded(picked.select("symbol", "ts", "close", F.element_at("tail", -1)["close"].alias("last_close")))


TRAIN, TEST = ("1996-01-01", "1999-12-31"), ("2000-01-10", "2000-06-30")


def parts(s, d):
    m = ft.anchor_matrix(stores(s, d), day_anchors(s, d), as_of=FAR, window_bars=CHAN_SMALL, keep=MATRIX_KEEP)
    return cs.train_test(m, labels_1d(s, d), train=TRAIN, test=TEST, per_day=5, seed=1)


def q_train_test(s, d):
    return parts(s, d).groupBy("part", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("anchor_ts").alias("first"), F.max("anchor_ts").alias("last"))


def q_trees(s, d):
    scored, _ = md.fit_predict(parts(s, d), MATRIX_KEEP, rounds=5, depth=3)
    return md.fold_metrics(scored)


def wide(s, d):
    hz = ("h1", "h3", "h5")
    w = st.regime_columns(st.wide_table(mv.predictions(s, d), hz), hz).dropna()
    return w, [c for c in w.columns if c.startswith(("pred_", "univ_"))]


def q_win_prob(s, d):
    w, cols = wide(s, d)
    cut = F.lit("1999-06-01").cast("date")
    out = md.win_probability(w.filter(F.col("date") < cut), w.filter(F.col("date") >= cut), cols, F.col("real_h1") > 0.001)
    return out.select("date", "stock", F.round("prob", 6).alias("prob"), "real_h1")


def q_isotonic(s, d):
    p = mv.predictions(s, d).filter("horizon = 'h1'")
    cut, win = F.lit("1999-06-01").cast("date"), F.col("real_lr") > 0.001
    return md.brier(md.isotonic(p.filter(F.col("date") < cut), p.filter(F.col("date") >= cut), pred="pred_lr", win=win), win)


WEIGHTS = (0.5, -0.25)


def q_batch(s, d):
    rows = cohort_rows(s, d, ("close",)).withColumn("last", F.element_at("w_5m", -1)["close"].cast("double")).withColumn("first", F.col("w_5m")[0]["close"].cast("double"))
    heads = [h[0] for h in H]

    def linear(batch):
        import numpy as np
        x = batch["last"].to_numpy() / batch["first"].to_numpy() - 1.0
        return np.outer(x, np.linspace(-0.1, -1.0, 10))

    out = md.score_batches(rows, linear, heads, keys=["t", "symbol"], columns=["last", "first"])
    return rounded(out.select("t", "symbol", "horizon", "pred_lr", F.col("real_lr").cast("double").alias("real_lr")), 5)


BATCH_SQL = oracle(f"""SELECT t, symbol, hn AS horizon, {r('x * (-0.1 - 0.1 * head)', 5)} AS pred_lr, {r('y::DOUBLE', 5)} AS real_lr FROM ys JOIN w5 USING (t, symbol) JOIN (VALUES """
                   + ", ".join(f"({i}, '{h[0]}')" for i, h in enumerate(H)) + ") z(head2, hn) ON head2 = head", **COHORT,
                   w5="""SELECT symbol, ts + INTERVAL 5 MINUTE AS t, close::REAL::DOUBLE / lag(close::REAL::DOUBLE, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x FROM bars_5m""")

QUERIES = {
    "asof_strict": (q_asof(True), asof_sql(">")),
    "asof_inclusive": (q_asof(False), asof_sql(">=")),
    "cross_sections_1d": (q_cross, CROSS_SQL),
    "cross_sections_30m": (q_cross_intraday("30m", 78), cross_intraday_sql("30m", 78)),
    "cross_sections_2d_book": (q_cross_book, CROSS_BOOK_SQL),
    "snapshot_windows": (q_snapshots, snapshots_sql()),
    "horizon_endpoints": (q_endpoints, oracle("SELECT t, head, ep AS endpoint FROM ends WHERE ep IS NOT NULL", gr=GRID, ends=ENDS)),
    "cohort_labels": (q_cohort, COHORT_SQL),
    "cohort_regime": (q_regime, REGIME_SQL),
    "sector_pairs": (q_sector_pairs, PAIRS_SQL),
    "same_stock_pairs": (q_same_stock, SAME_SQL),
    "pair_windows": (q_pair_windows, PAIR_WINDOWS_SQL),
    "horizon_weighted_sample": (q_horizon_sample, HS_SQL),
    "per_day_sample": (q_day_sample, oracle("""SELECT symbol, ts AS anchor_ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY md5('11|' || symbol || '|' || epoch_us(ts))) AS p FROM bars_5m) WHERE p <= 5""")),
    "regime_weighted_windows": (q_window_sample, oracle(f"""SELECT symbol, ts, {r('close')} AS close, {r('lc')} AS last_close FROM (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS lc FROM bars_day) WHERE lc IS NOT NULL
  ORDER BY ln({U.format(seed=5, parts="symbol || '|' || epoch_us(ts)")}) / CASE WHEN ts > TIMESTAMP '2001-11-04' - INTERVAL 549 DAY THEN 2.0 ELSE 1.0 END DESC, symbol, ts LIMIT 500""")),
    "train_test_matrix": (q_train_test, None),
    "tree_baseline_metrics": (q_trees, None),
    "win_probability": (q_win_prob, None),
    "isotonic_brier": (q_isotonic, None),
    "batch_scoring": (q_batch, BATCH_SQL),
}
