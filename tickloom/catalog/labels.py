"""Label queries."""

from functools import reduce

from pyspark.sql import functions as F

from tickloom.catalog.features import CAP_DAY, CAP_INTRA
from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.operators import ranking
from tickloom.plans import labels as lb
from tickloom.sources import marketviews as mv

HALT = "(volume = 0 OR high = low)::INT"


def intraday_sql(h: str, cap: str = CAP_INTRA) -> str:
    n = lb.INTRADAY_BARS[h]
    return f"""SELECT symbol, ts + INTERVAL 5 MINUTE AS t, ts2 + INTERVAL 5 MINUTE AS t_horizon,
  ln(c2 / close)::REAL AS y_log_return, NULL::REAL AS y_rank, halts = 0 AS valid_label,
  least(halts, 127)::TINYINT AS halt_count
  FROM (SELECT *, lead(ts, {n}) OVER w AS ts2, lead(close, {n}) OVER w AS c2,
        sum({HALT}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS halts
        FROM bars_5m WHERE ts + INTERVAL 5 MINUTE <= TIMESTAMP '{cap}' WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  WHERE ts2 = ts + INTERVAL {5 * n} MINUTE"""


def daily_sql(n: int, cap: str = CAP_DAY, positional: bool = True) -> str:
    halts = (f"sum({HALT}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
             if positional else "0")
    pos = "a.halts" if positional else (
        f"(SELECT sum({HALT}) FROM src x WHERE x.symbol = a.symbol AND x.ts > a.ts AND x.ts <= b.ts)")
    return f"""SELECT a.symbol, a.ts AS t, b.ts AS t_horizon, ln(b.close / a.close)::REAL AS y_log_return,
  NULL::REAL AS y_rank, coalesce({pos}, 0) = 0 AS valid_label, least(coalesce({pos}, 0), 127)::TINYINT AS halt_count
  FROM (SELECT *, {halts} AS halts FROM bars_day WHERE ts <= TIMESTAMP '{cap}') a
  JOIN cal ca ON ca.trade_date = CAST(a.ts AS DATE)
  JOIN cal cb ON cb.idx = ca.idx + {n} AND cb.trade_date <= CAST(TIMESTAMP '{cap}' AS DATE)
  JOIN (SELECT * FROM bars_day WHERE ts <= TIMESTAMP '{cap}') b
    ON b.symbol = a.symbol AND CAST(b.ts AS DATE) = cb.trade_date"""


def q_labels(s, d):
    five, day, cal = mv.bars_5m(s, d), mv.bars_day(s, d), mv.calendar(s, d)
    parts = [lb.build_labels(five, cal, h, as_of=CAP_INTRA).withColumn("horizon", F.lit(h)) for h in lb.INTRADAY_BARS]
    parts += [lb.build_labels(day, cal, h, as_of=CAP_DAY).withColumn("horizon", F.lit(h)) for h in lb.DAILY_STEPS]
    return reduce(lambda a, b: a.unionByName(b), parts)


LABELS_SQL = oracle(" UNION ALL ".join(
    [f"SELECT *, '{h}' AS horizon FROM ({intraday_sql(h)})" for h in lb.INTRADAY_BARS]
    + [f"SELECT *, '{h}' AS horizon FROM ({daily_sql(n)})" for h, n in lb.DAILY_STEPS.items()]))


def q_labels_calendar(s, d):
    return lb.daily_labels(mv.bars_day(s, d), mv.calendar(s, d), "2d", as_of=CAP_DAY, halts_by_position=False)


def labels_1d(s, d, h="1d"):
    return lb.daily_labels(mv.bars_day(s, d), mv.calendar(s, d), h, as_of=CAP_DAY)


def q_residual(s, d):
    out = lb.residual_labels(labels_1d(s, d), mv.symbol_master(s, d))
    return rounded(out.select("symbol", "t", "sector", "y_log_return", "valid_label", "y_sector_mean",
                              F.col("y_resid").cast("double").alias("y_resid")), 5)


RESID_SQL = oracle(f"""SELECT symbol, t, sector, y_log_return, valid_label, {r('m', 5)} AS y_sector_mean,
  {r('(y_log_return::DOUBLE - m)::REAL::DOUBLE', 5)} AS y_resid
  FROM (SELECT *, avg(CASE WHEN valid_label THEN y_log_return::DOUBLE END) OVER (PARTITION BY t, sector) AS m
        FROM (SELECT l.*, coalesce(sector, '_no_sector') AS sector FROM lab l LEFT JOIN master USING (symbol)))""",
                   lab=daily_sql(1))

TRADE = lb.TradeableConfig(trigger_threshold=0.12, floor_threshold=-0.1, d_min_minutes=5, d_max_minutes=15, k_minutes=10)


def q_tradeable(s, d, cap=CAP_INTRA):
    return lb.tradeable_labels(mv.bars_5m(s, d), TRADE, as_of=cap)


def tradeable_sql(cap: str = CAP_INTRA) -> str:
    c = "close::REAL::DOUBLE"
    f = lambda a, b: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"
    g = lambda fn, fr: f"CASE WHEN e IS NOT NULL THEN {fn} / c - 1.0 END AS {fr}"
    return f"""SELECT symbol, ts, ts + INTERVAL 5 MINUTE AS t,
  (CASE WHEN a > 0.12 AND h2 > -0.1 THEN 1 WHEN b < -0.12 AND h1 < 0.1 THEN -1 ELSE 0 END)::TINYINT AS tradeable_label,
  a::REAL AS realized_max_trigger_ret, b::REAL AS realized_min_trigger_ret, h1::REAL AS realized_max_hold_ret,
  h2::REAL AS realized_min_hold_ret, a IS NOT NULL AS valid_label
  FROM (SELECT *, {g('tx', 'a')}, {g('tn', 'b')}, {g('hx', 'h1')}, {g('hn', 'h2')} FROM (
    SELECT *, {c} AS c, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS e,
      max({c}) OVER {f(1, 3)} AS tx, min({c}) OVER {f(1, 3)} AS tn, max({c}) OVER {f(3, 5)} AS hx, min({c}) OVER {f(3, 5)} AS hn
    FROM bars_5m WHERE ts <= TIMESTAMP '{cap}' - INTERVAL 30 MINUTE))"""


def path_cte(a: int, b: int, off: int) -> str:
    lead = lambda c: f"lead({c}, {off}) OVER w" if off else c
    return f"""SELECT *, list_filter(ahead, lambda x: CAST(x.ts AS DATE) = CAST(ts AS DATE) AND strftime(x.ts, '%H:%M') <= '10:00') AS path
  FROM (SELECT symbol, ts, high, low, close, {lead('high')} AS eh, {lead('low')} AS el, lead(ts, {b}) OVER w AS fin,
    list({{'ts': ts, 'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING) AS ahead
    FROM bars_5m WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


SESS = "strftime(ts, '%H:%M') BETWEEN '03:45' AND '10:00'"


def q_barrier(s, d):
    return lb.barrier_labels(mv.bars_5m(s, d), target_long=0.2, stop_long=0.25, target_short=0.2, stop_short=0.3, minutes=40)


BARRIER_SQL = oracle("""SELECT symbol, ts, ts AS t, (CASE WHEN ok THEN lab ELSE 0 END)::TINYINT AS tradeable_label, ok AS valid_label,
  (CASE WHEN ok AND lab = 1 THEN k * 5.0 END)::REAL AS first_long_target_min,
  (CASE WHEN ok AND lab = -1 THEN k * 5.0 END)::REAL AS first_short_target_min,
  (CASE WHEN ok THEN (list_max(list_transform(path, lambda z: z.h)) - close) / close END)::REAL AS max_high_pct,
  (CASE WHEN ok THEN (list_min(list_transform(path, lambda z: z.l)) - close) / close END)::REAL AS min_low_pct
  FROM (SELECT *, CASE WHEN x.h >= close * 1.2::DOUBLE AND NOT x.l <= close * 0.75::DOUBLE THEN 1
          WHEN x.l <= close * 0.8::DOUBLE AND NOT x.h >= close * 1.3::DOUBLE THEN -1 ELSE 0 END AS lab
    FROM (SELECT *, path[k] AS x FROM (SELECT *, SESS AND coalesce(len(path), 0) >= 4 AS ok,
      list_position(list_transform(path, lambda x: x.h >= close * 1.2::DOUBLE OR x.l <= close * 0.75::DOUBLE
        OR x.l <= close * 0.8::DOUBLE OR x.h >= close * 1.3::DOUBLE), true) AS k FROM p)))""".replace("SESS", SESS),
                     p=path_cte(1, 8, 0))


def q_smooth(s, d):
    return lb.smooth_labels(mv.bars_5m(s, d), target=0.2, floor=0.1, minutes=30)


SMOOTH_SQL = oracle(f"""SELECT symbol, ts, ts AS t, (CASE WHEN lo AND so THEN 0 WHEN lo THEN 1 WHEN so THEN -1 ELSE 0 END)::TINYINT AS tradeable_label,
  ok AS valid_label, up::REAL AS max_high_pct, dn::REAL AS min_low_pct
  FROM (SELECT *, coalesce(up >= 0.2 AND dn >= -0.1, false) AS lo, coalesce(-dn >= 0.2 AND up <= 0.1, false) AS so FROM (
    SELECT *, CASE WHEN ok THEN list_max(list_transform(path, lambda x: x.h)) / close - 1 END AS up,
      CASE WHEN ok THEN list_min(list_transform(path, lambda x: x.l)) / close - 1 END AS dn
    FROM (SELECT *, {SESS} AND coalesce(len(path), 0) >= 4 AS ok FROM p)))""", p=path_cte(1, 6, 0))


def q_pnl(s, d):
    return lb.pnl_labels(mv.bars_5m(s, d), target=0.15, stop=0.25, entry_offset_minutes=5, minutes=40, cost_bps=15.0)


def pnl_sql() -> str:
    pos = lambda cond: f"list_position(list_transform(path, lambda x: {cond}), true)"
    return oracle(f"""SELECT symbol, ts, ts AS t,
  (CASE WHEN ok AND abs(lr - 0.15) < 1e-9 THEN 1 WHEN ok AND abs(sr - 0.15) < 1e-9 THEN -1 ELSE 0 END)::TINYINT AS tradeable_label,
  ok AS valid_label, (CASE WHEN ok THEN lr - 0.0015::DOUBLE ELSE 0 END)::REAL AS realized_pnl_long,
  (CASE WHEN ok THEN sr - 0.0015::DOUBLE ELSE 0 END)::REAL AS realized_pnl_short
  FROM (SELECT *, CASE WHEN ls > 0 AND (lw IS NULL OR lw = 0 OR ls <= lw) THEN -0.25::DOUBLE WHEN lw > 0 THEN 0.15::DOUBLE ELSE (path[-1].c - eh) / eh END AS lr,
      CASE WHEN ss > 0 AND (sw IS NULL OR sw = 0 OR ss <= sw) THEN -0.25::DOUBLE WHEN sw > 0 THEN 0.15::DOUBLE ELSE (el - path[-1].c) / el END AS sr
    FROM (SELECT *, {SESS} AND fin IS NOT NULL AND coalesce(len(path), 0) >= 3 AS ok,
      {pos('x.h >= eh * (1 + 0.15::DOUBLE)')} AS lw, {pos('x.l <= eh * (1 - 0.25::DOUBLE)')} AS ls,
      {pos('x.l <= el * (1 - 0.15::DOUBLE)')} AS sw, {pos('x.h >= el * (1 + 0.25::DOUBLE)')} AS ss FROM p))""", p=path_cte(2, 9, 1))


def q_classes(s, d):
    return rounded(lb.class_distribution(q_tradeable(s, d), ("symbol",)))


CLASSES_SQL = oracle(f"""SELECT *, {r('n_long * 100.0 / greatest(n_valid, 1)')} AS pct_long, {r('n_short * 100.0 / greatest(n_valid, 1)')} AS pct_short,
  {r('n_none * 100.0 / greatest(n_valid, 1)')} AS pct_none FROM (
  SELECT symbol, count(*) FILTER (valid_label) AS n_valid, count(*) FILTER (NOT valid_label) AS n_invalid,
    count(*) FILTER (valid_label AND tradeable_label = 1) AS n_long, count(*) FILTER (valid_label AND tradeable_label = -1) AS n_short,
    count(*) FILTER (valid_label AND tradeable_label = 0) AS n_none FROM lab GROUP BY symbol)""", lab=tradeable_sql())


def q_candidates(s, d):
    """Anchors with the width of their valid cross-section, floored."""
    lab = labels_1d(s, d).filter("valid_label")
    return lab.groupBy("t").agg(F.count(F.lit(1)).alias("width")).filter("width >= 10")


def q_vol_buckets(s, d):
    p = mv.predictions(s, d).filter("horizon = 'h1'")
    out = p.withColumns({"bucket": ranking.quantile_bucket("vol", ["date"], 5).cast("int"),
                         "unit_rank": ranking.unit_rank("real_lr", ["date"], "stock"),
                         "below": ranking.share_below("pred_lr", ["date"])})
    return rounded(out.select("date", "stock", "bucket", "unit_rank", "below"))


VOL_SQL = oracle(f"""SELECT date, stock, CAST(CASE WHEN mn = mx THEN 2 ELSE len(list_filter(edges, lambda e: e <= vol)) END AS INTEGER) AS bucket,
  {r('(rr - 1) / greatest(n - 1, 1)::DOUBLE')} AS unit_rank, {r('(rk - 1) / n::DOUBLE')} AS below
  FROM (SELECT p.*, q.*, row_number() OVER (PARTITION BY p.date ORDER BY real_lr, stock) AS rr,
          rank() OVER (PARTITION BY p.date ORDER BY pred_lr) AS rk
        FROM preds p JOIN (SELECT date AS qd, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) AS edges, min(vol) AS mn, max(vol) AS mx, count(*) AS n
                           FROM preds WHERE horizon = 'h1' GROUP BY date) q ON p.date = q.qd WHERE horizon = 'h1')""")

QUERIES = {
    "forward_labels": (q_labels, LABELS_SQL),
    "daily_labels_calendar_halts": (q_labels_calendar, oracle(daily_sql(2, positional=False),
                                                              src=f"SELECT * FROM bars_day WHERE ts <= TIMESTAMP '{CAP_DAY}'")),
    "residual_labels": (q_residual, RESID_SQL),
    "tradeable_labels": (q_tradeable, oracle(tradeable_sql())),
    "triple_barrier_labels": (q_barrier, BARRIER_SQL),
    "smooth_path_labels": (q_smooth, SMOOTH_SQL),
    "pnl_labels": (q_pnl, pnl_sql()),
    "label_class_distribution": (q_classes, CLASSES_SQL),
    "candidate_anchors": (q_candidates, oracle(
        "SELECT t, count(*) AS width FROM lab WHERE valid_label GROUP BY t HAVING count(*) >= 10", lab=daily_sql(1))),
    "cross_section_ranks": (q_vol_buckets, VOL_SQL),
}
