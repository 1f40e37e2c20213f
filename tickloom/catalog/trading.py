"""Backtest, exit, strategy and book-fill queries."""

from pyspark.sql import functions as F

from tickloom.catalog.evaluation import IC, RANKS, summary_sql
from tickloom.catalog.features import FAR
from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.plans import backtest as bt, bookfill as bf, features as ft, metrics as mt, strategy as st
from tickloom.sources import marketviews as mv

RULES = bt.Rules(long_top_k=3, short_top_k=2, min_valid=10, alpha=0.5, short_veto=0.62, long_gate=0.2, short_gate=0.3,
                 long_threshold=0.2, short_threshold=0.3, size_mode="score_pct_rank")


def scored(s, d):
    p = mv.predictions(s, d).filter("horizon = 'h1'")
    return p.select(F.timestamp_micros("anchor_us").alias("t"), F.col("stock").alias("symbol"), ((F.col("pred_lr") + 2) / 4).alias("long_p"),
                    ((F.lit(2.0) - F.col("pred_lr")) / 4).alias("short_p"), (F.col("vol") > 0.15).alias("valid"), F.col("real_lr").alias("ret"))


SCORED = """SELECT make_timestamp(anchor_us) AS t, stock AS symbol, (pred_lr + 2) / 4 AS long_p, (2.0::DOUBLE - pred_lr) / 4 AS short_p,
  vol > 0.15::DOUBLE AS valid, real_lr AS ret FROM preds WHERE horizon = 'h1'"""
TRADES = {
    "scored": SCORED,
    "v": "SELECT * FROM (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY t) AS nv FROM scored) WHERE nv >= 10 AND valid",
    "sides": """SELECT t, symbol, ret, 1 AS direction, long_p - 0.5 * short_p AS score, 3 AS k, 0.2::DOUBLE AS thr, 0.8::DOUBLE AS q FROM v WHERE short_p <= 0.62::DOUBLE
  UNION ALL SELECT t, symbol, ret, -1, short_p, 2, 0.3::DOUBLE, 0.7::DOUBLE FROM v""",
    "taken": """SELECT *, CASE WHEN n > 1 THEN 0.02::DOUBLE + (0.2::DOUBLE - 0.02::DOUBLE) * ((rk - 1) / n::DOUBLE) ELSE 0.02::DOUBLE END * 100000.0 AS notional FROM (
  SELECT *, row_number() OVER (PARTITION BY t, direction ORDER BY score DESC, symbol) AS pos, count(*) OVER g AS n, rank() OVER (PARTITION BY t, direction ORDER BY score) AS rk,
    quantile_cont(score, 0.8) OVER g AS q8, quantile_cont(score, 0.7) OVER g AS q7 FROM sides WINDOW g AS (PARTITION BY t, direction))
  WHERE pos <= k AND score >= thr AND (n <= 1 OR score >= CASE direction WHEN 1 THEN q8 ELSE q7 END)""",
    "trades": """SELECT t, symbol, direction, score, ret * direction AS raw_return, cost, ret * direction - cost AS net_return, notional, (ret * direction - cost) * notional AS pnl
  FROM (SELECT *, (10.0 + 0.001::DOUBLE * notional) / notional AS cost FROM taken)""",
}


def q_trades(s, d):
    return rounded(bt.backtest(scored(s, d), RULES))


TRADES_SQL = oracle("SELECT t, symbol, direction, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("score", "raw_return", "cost", "net_return", "notional", "pnl")) + " FROM trades", **TRADES)


def q_tearsheet(s, d):
    return rounded(bt.tearsheet(bt.backtest(scored(s, d), RULES)), 5)


TEAR_SQL = oracle(f"""SELECT n_trades, n_long, n_short, {r('total_pnl', 5)} AS total_pnl, {r('total_pnl / 100000', 5)} AS total_return_pct, {r('w / n_trades::DOUBLE', 5)} AS win_rate,
  {r('aw / 100000', 5)} AS avg_winner, {r('al / 100000', 5)} AS avg_loser, {r('abs(aw / al)', 5)} AS win_loss_ratio, {r('(SELECT avg(p) / stddev_pop(p) FROM daily)', 5)} AS sharpe_daily,
  {r('(SELECT max(peak - cum) FROM curve) / 100000', 5)} AS max_drawdown_pct FROM (SELECT count(*) AS n_trades, count(*) FILTER (direction = 1) AS n_long, count(*) FILTER (direction = -1) AS n_short,
  sum(pnl) AS total_pnl, count(*) FILTER (pnl > 0) AS w, avg(pnl) FILTER (pnl > 0) AS aw, avg(pnl) FILTER (pnl <= 0) AS al FROM trades)""", **TRADES,
                  daily="SELECT CAST(t AS DATE) AS d, sum(pnl) AS p FROM trades GROUP BY 1",
                  c0="SELECT *, sum(pnl) OVER (ORDER BY t, direction DESC, score DESC, symbol ROWS UNBOUNDED PRECEDING) AS cum FROM trades",
                  curve="SELECT *, max(cum) OVER (ORDER BY t, direction DESC, score DESC, symbol ROWS UNBOUNDED PRECEDING) AS peak FROM c0")


def q_equity(s, d):
    c = bt.equity_curve(bt.backtest(scored(s, d), RULES))
    return rounded(c.select("t", "symbol", "direction", "cum", "peak", "drawdown"), 4)


# ---- exits: entries at 5m closes, scored by minus the last return
def intraday_scores(s, d):
    f = ft.compute_features(mv.bars(s, d, "5m"), scale="5m", as_of=FAR, groups=("log_returns",))
    return f.select((F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("t"), "symbol", (-F.col("ret_1")).alias("score")).dropna()


def exit_entries(s, d):
    sc = intraday_scores(s, d)
    rows = sc.select("t", "symbol", ((F.col("score") + 2) / 4).alias("long_p"), ((F.lit(2.0) - F.col("score")) / 4).alias("short_p"),
                     F.lit(True).alias("valid"), F.lit(0.0).alias("ret"))
    return bt.entries(rows, bt.Rules(long_top_k=2, short_top_k=1, min_valid=8)).select("t", "symbol", "direction", "score")


EXIT_CTES = {
    "sc": "SELECT ts + INTERVAL 5 MINUTE AS t, symbol, s AS score FROM (SELECT *, -ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS s FROM bars_5m) WHERE s IS NOT NULL",
    "e0": """SELECT t, symbol, direction, score FROM (SELECT *, row_number() OVER (PARTITION BY t, direction ORDER BY score DESC, symbol) AS pos FROM (
  SELECT *, count(*) OVER (PARTITION BY t, direction) AS n FROM (SELECT t, symbol, 1 AS direction, (score + 2) / 4 AS score FROM sc UNION ALL SELECT t, symbol, -1, (2.0::DOUBLE - score) / 4 FROM sc)) WHERE n >= 8)
  WHERE score >= 0 AND pos <= CASE direction WHEN 1 THEN 2 ELSE 1 END""",
    "nx": "SELECT *, lead(ts) OVER w AS nts, lead(close) OVER w AS nc FROM bars_5m WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    "e": "SELECT e0.*, b.ts AS ets, b.close AS px, b.nts, b.nc FROM e0 ASOF JOIN nx b ON e0.symbol = b.symbol AND e0.t <= b.ts WHERE b.nts IS NOT NULL",
    "rk": "SELECT *, rank() OVER (PARTITION BY t ORDER BY score DESC) AS rk FROM sc",
}


def exits_sql(minutes, tgt, stp, code, gain_ambig, extra_join="", ranked="NULL::BIGINT AS rk, NULL::DOUBLE AS sc", curve=""):
    body = f"""SELECT t, symbol, direction, {r('score')} AS score, {r('coalesce(hit.g, direction * (coalesce(lst.c, nc) - px) / px)')} AS raw_return, coalesce(hit.o, 'timeout') AS outcome,
  {r("epoch_us(coalesce(hit.ts, lst.ts, nts) - t) / 60e6")} AS minutes_held FROM agg"""
    return oracle(body, **EXIT_CTES,
                  path=f"""SELECT e.*, b.ts AS bts, b.high AS h, b.low AS l, b.close AS c, direction * (b.close - px) / px AS drift, {ranked}
  FROM e LEFT JOIN bars_5m b ON b.symbol = e.symbol AND CAST(b.ts AS DATE) = CAST(e.t AS DATE) AND b.ts > e.ets AND b.ts <= e.t + INTERVAL {minutes} MINUTE {extra_join}""",
                  ev=f"""SELECT *, CASE WHEN o = 'ambig' THEN {gain_ambig} WHEN o = 'target' THEN {tgt}::DOUBLE WHEN o = 'stop' THEN -{stp}::DOUBLE ELSE drift END AS g FROM (SELECT *, {code} AS o FROM (
  SELECT *, CASE direction WHEN 1 THEN h >= px * (1 + {tgt}::DOUBLE) ELSE l <= px * (1 - {tgt}::DOUBLE) END AS ht, CASE direction WHEN 1 THEN l <= px * (1 - {stp}::DOUBLE) ELSE h >= px * (1 + {stp}::DOUBLE) END AS hs {curve} FROM path))""",
                  agg="""SELECT t, symbol, direction, score, px, nts, nc, arg_min({'ts': bts, 'g': g, 'o': o}, bts) FILTER (o IS NOT NULL) AS hit, arg_max({'ts': bts, 'c': c}, bts) FILTER (bts IS NOT NULL) AS lst
  FROM ev GROUP BY ALL""")


BASE_CODE = "CASE WHEN ht AND hs THEN 'ambig' WHEN ht THEN 'target' WHEN hs THEN 'stop' END"
PROP = "CASE WHEN (h - px) / px + (px - l) / px <= 0 THEN 0 ELSE ((px - l) / px) / ((h - px) / px + (px - l) / px) * 0.2::DOUBLE + (1 - ((px - l) / px) / ((h - px) / px + (px - l) / px)) * -0.15::DOUBLE END"


def q_first_touch(s, d):
    return rounded(bt.path_exits(exit_entries(s, d), mv.bars_5m(s, d), target=0.2, stop=0.15, minutes=60, rule="proportional"))


def q_rerank(s, d):
    return rounded(bt.path_exits(exit_entries(s, d), mv.bars_5m(s, d), target=0.25, stop=0.2, minutes=60, mode="hybrid_rerank",
                                 scores=intraday_scores(s, d), rerank_k=12))


def q_floor(s, d):
    return rounded(bt.path_exits(exit_entries(s, d), mv.bars_5m(s, d), target=0.25, stop=0.2, minutes=60, mode="score_floor",
                                 scores=intraday_scores(s, d), floor=-0.3))


CURVE = ((-0.1, 4), (0.05, 14), (0.2, 6))


def q_curve_exit(s, d):
    return rounded(bt.path_exits(exit_entries(s, d), mv.bars_5m(s, d), target=0.25, stop=0.2, minutes=60, mode="hybrid_floor",
                                 scores=intraday_scores(s, d), curve=CURVE))


RK_JOIN = "LEFT JOIN (SELECT t AS rt, symbol AS rs, rk AS rkk, score AS scc FROM rk) q ON q.rt = b.ts AND q.rs = e.symbol"
CURVE_JOIN = """LEFT JOIN (SELECT bts0, max(at0) AS at1 FROM (SELECT DISTINCT ts AS bts0 FROM bars_5m) x JOIN (SELECT DISTINCT t AS at0 FROM sc) y ON at0 <= bts0 GROUP BY 1) f ON f.bts0 = b.ts
  LEFT JOIN (SELECT t AS rt, symbol AS rs, rk AS rkk, score AS scc FROM rk) q ON q.rt = f.at1 AND q.rs = e.symbol"""


# ---- strategy
KS, THRS, HZ = (2, 4), (0.0, 0.05), ("h1", "h3")


def q_wide(s, d):
    return rounded(st.regime_columns(st.wide_table(mv.predictions(s, d), HZ), HZ))


WIDE_SQL = oracle("SELECT date, stock, " + ", ".join(
    [f"{r(f'{k}_{h}')} AS {k}_{h}" for h in HZ for k in ("pred", "real")]
    + [f"{r(f'avg(pred_{h}) OVER g')} AS univ_mean_pred_{h}, {r(f'stddev_samp(pred_{h}) OVER g')} AS univ_std_pred_{h}" for h in HZ])
    + " FROM w WINDOW g AS (PARTITION BY date)", w="SELECT date, stock, " + ", ".join(
        f"max(CASE WHEN horizon = '{h}' THEN {k}_lr END) AS {k}_{h}" for h in HZ for k in ("pred", "real")) + " FROM preds WHERE horizon IN ('h1', 'h3') GROUP BY ALL")


def q_topk_days(s, d):
    return rounded(st.top_k_days(mv.predictions(s, d), 4, 15.0), 4)


TOPK_SQL = oracle(f"""SELECT date, horizon, n AS n_alive, {r('b', 4)} AS net_bps, (b > 0)::INT AS win, {r('sum(b) OVER (PARTITION BY horizon ORDER BY date)', 4)} AS cum_bps FROM (
  SELECT date, horizon, count(*) AS n, (exp(avg(CASE WHEN pos <= 4 THEN real_lr END)) - 1) * 10000 - 15 AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY pred_lr DESC, stock) AS pos FROM preds) GROUP BY ALL HAVING count(*) >= 4)""")


def tuned(s, d):
    return st.rolling_best_config(mv.predictions(s, d), ks=KS, horizons=HZ, thresholds=THRS, lookback=10)


TUNED = {
    "cfg": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, '{h}', {t}::DOUBLE)" for i, (k, h, t) in enumerate(
        (k, h, t) for k in KS for h in HZ for t in THRS)) + ") c(no, top_k, horizon, threshold)",
    "dts": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS dn FROM (SELECT DISTINCT date FROM preds)",
    "dr": """SELECT date, horizon, k AS top_k, count(*) AS n_alive, avg(CASE WHEN pos <= k THEN pred_lr END) AS pm, avg(CASE WHEN pos <= k THEN real_lr END) AS rm
  FROM (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY pred_lr DESC, stock) AS pos FROM preds), (VALUES (2), (4)) z(k) GROUP BY ALL""",
    "gr": """SELECT dts.date, dn, cfg.*, n_alive, CASE WHEN n_alive >= cfg.top_k AND pm >= threshold THEN (exp(rm) - 1) * 10000 - 5 END AS bps
  FROM dts CROSS JOIN cfg LEFT JOIN dr ON dr.date = dts.date AND dr.horizon = cfg.horizon AND dr.top_k = cfg.top_k""",
    "sw": """SELECT *, count(bps) OVER w AS nt, avg(bps) OVER w / CASE WHEN stddev_pop(bps) OVER w = 0 THEN 1e-9 ELSE stddev_pop(bps) OVER w END * sqrt(252.0) AS ratio
  FROM gr WINDOW w AS (PARTITION BY no ORDER BY dn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    "tun": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ratio DESC, no) AS rn FROM sw WHERE dn >= 10 AND nt >= 3) WHERE rn = 1",
}
TUNED_SQL = oracle(f"""SELECT date, top_k AS tuned_k, horizon AS tuned_horizon, {r('threshold', 4)} AS tuned_threshold, {r('ratio', 4)} AS lookback_sharpe, nt AS lookback_n_trades,
  bps IS NOT NULL AS traded, {r('coalesce(bps, 0)', 4)} AS net_bps, coalesce(n_alive, 0) AS n_alive FROM tun""", **TUNED)


def probs(s, d):
    p = mv.predictions(s, d).filter("horizon = 'h1'")
    return p.select("date", "stock", ((F.col("pred_lr") + 1) / 2).alias("prob"), F.col("real_lr").alias("real"))


GATE_ARGS = dict(offset=1, fit_days=6, holdout=3, thresholds=(0.5, 0.6, 0.7), top_k=3, cost_bps=15.0)


def gate_days(s, d):
    return st.threshold_gate(probs(s, d), **GATE_ARGS)


def q_gate(s, d):
    out = gate_days(s, d).withColumn("chosen_stocks", F.array_join("chosen_stocks", ","))
    x = F.col("lookback_sharpe")
    out = out.withColumn("lookback_sharpe", F.signum(x) * F.log1p(F.abs(x)))
    return rounded(out, 4, lookback_pnl_bps=6)


GATE = {
    "pr": "SELECT date, stock, (pred_lr + 1) / 2 AS prob, real_lr AS real FROM preds WHERE horizon = 'h1'",
    "dts": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS dn, sum(n) OVER (ORDER BY date) AS cn FROM (SELECT date, count(*) AS n FROM pr GROUP BY date)",
    "dd": """SELECT date, thr, no, count(*) AS width, count(*) FILTER (prob > thr) AS na, avg(CASE WHEN pos <= 3 THEN real END) AS tm, string_agg(CASE WHEN pos <= 3 THEN stock END, ',' ORDER BY pos) AS picks
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prob DESC, stock) AS pos FROM pr), (VALUES (0, 0.5::DOUBLE), (1, 0.6::DOUBLE), (2, 0.7::DOUBLE)) z(no, thr) GROUP BY ALL""",
    "db": "SELECT *, width >= 3 AND na >= 3 AS fires, CASE WHEN width >= 3 THEN CASE WHEN na >= 3 THEN (exp(tm) - 1) * 10000 - 15 ELSE 0 END END AS bps FROM dd",
    # labels one day old are known strictly before yesterday: the last known date is two back
    "tests": "SELECT a.date, a.dn, b.cn FROM dts a JOIN dts b ON b.dn = a.dn - 2 WHERE a.dn - 1 >= 9 AND b.cn >= 100",
    "sco": """SELECT t.date, no, thr, round(avg(bps) FILTER (abs(bps) > 1e-9), 6) AS m, stddev_pop(bps) FILTER (abs(bps) > 1e-9) AS sd, count(*) FILTER (abs(bps) > 1e-9) AS k
  FROM tests t JOIN dts h ON h.dn BETWEEN t.dn - 4 AND t.dn - 2 JOIN db ON db.date = h.date GROUP BY ALL""",
    "bst": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY m DESC, no) AS rn FROM sco WHERE k > 0) WHERE rn = 1",
}
GATE_SQL = oracle(f"""SELECT t.date AS test_date, CASE WHEN m > 0 THEN {r('b.thr', 4)} END AS chosen_threshold, {r('m', 6)} AS lookback_pnl_bps,
  {r('sign(m) * ln(1 + abs(m / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END * sqrt(252.0)))', 4)} AS lookback_sharpe, coalesce(k, 0) AS n_lookback_trades, CASE WHEN m > 0 AND fires THEN 3 ELSE 0 END AS n_today_trades,
  {r('CASE WHEN m > 0 AND fires THEN bps ELSE 0 END', 4)} AS today_pnl_bps, CASE WHEN m > 0 AND fires THEN picks ELSE '' END AS chosen_stocks
  FROM tests t LEFT JOIN bst b ON b.date = t.date LEFT JOIN db ON db.date = t.date AND db.thr = b.thr AND m > 0""", **GATE)


def q_clock_gate(s, d):
    return rounded(st.clock_gate(mv.predictions(s, d).filter("horizon = 'h3'"), fit_days=5, holdout=3, top_k=2, cost_bps=20.0,
                                 percents=(5, 10, 25)), 4)


CLOCK_SQL = oracle(f"""SELECT clock, date, CASE WHEN bm > 0 THEN q END AS percent, {r('bm', 4)} AS holdout_bps, coalesce(bm > 0, false) AS traded, {r('CASE WHEN bm > 0 THEN (exp(top) - 1) * 10000 - 20 END', 4)} AS net_bps FROM (
  SELECT *, greatest(m0, m1, m2) AS bm, CASE greatest(m0, m1, m2) WHEN m0 THEN 5.0::DOUBLE WHEN m1 THEN 10.0::DOUBLE ELSE 25.0::DOUBLE END AS q FROM (
  SELECT *, row_number() OVER w - 1 AS hist, sum(wd) OVER (w ROWS BETWEEN 8 PRECEDING AND 4 PRECEDING) AS fitr, """ + ", ".join(
    f"CASE WHEN count(r{i}) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 2 THEN avg((exp(r{i}) - 1) * 10000 - 20) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS m{i}" for i in range(3)) + """
  FROM day WINDOW w AS (PARTITION BY clock ORDER BY date)) WHERE hist >= 8 AND fitr >= 50)""", day="""SELECT anchor_us % 86400000000 AS clock, date, count(*) AS wd, avg(CASE WHEN pos <= 2 THEN real_lr END) AS top, """ + ", ".join(
        f"avg(CASE WHEN pos <= greatest(1, floor(wd * {q} / 100)) THEN real_lr END) AS r{i}" for i, q in enumerate((5, 10, 25))) + """
  FROM (SELECT *, row_number() OVER (PARTITION BY date, anchor_us ORDER BY pred_lr DESC, stock) AS pos, count(*) OVER (PARTITION BY date, anchor_us) AS wd FROM preds WHERE horizon = 'h3') GROUP BY ALL""")


def h1(s, d):
    return mv.predictions(s, d).filter("horizon = 'h1'").select("date", "stock", "pred_lr", "real_lr")


def log_sleeve(df):
    """Compounded percent as a log return: test prices compound to astronomic sleeves."""
    return df.withColumn("sleeve_pct", F.log1p(F.col("sleeve_pct") / 100))


def rolling_scores(s, d):
    return log_sleeve(st.rolling_rebalance(h1(s, d), holds=(3, 5), ks=(3, 5)))


def q_rolling(s, d):
    return rounded(rolling_scores(s, d), 5)


def q_offsets(s, d):
    return rounded(st.over_offsets(rolling_scores(s, d)), 5)


def rolling_ctes():
    per = []
    for hold in (3, 5):
        for k in (3, 5):
            per.append(f"""SELECT {hold} AS hold, {k} AS k, (dn % {hold})::INTEGER AS "offset", date, ln(avg(exp(hl{hold}))) - 0.003::DOUBLE AS r FROM pk WHERE pos <= {k} AND w >= {k} AND dn + {hold} <= mx GROUP BY ALL""")
    return {
        "h1p": "SELECT * FROM preds WHERE horizon = 'h1'",
        "dts": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS dn, count(*) OVER () - 1 AS mx FROM (SELECT DISTINCT date FROM h1p)",
        "pk": """SELECT p.*, dn, mx, row_number() OVER (PARTITION BY date ORDER BY pred_lr DESC, stock) AS pos, count(*) OVER (PARTITION BY date) AS w,
  sum(real_lr) OVER (PARTITION BY stock ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS hl3, sum(real_lr) OVER (PARTITION BY stock ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS hl5
  FROM h1p p JOIN dts USING (date)""",
        "ports": " UNION ALL ".join(per),
        "ro": """SELECT hold, k, "offset", count(*) AS n, avg(r) / (stddev_samp(r) + 1e-12) * sqrt(250.0 / hold) AS sharpe, sum(r) AS sleeve_pct, avg((r > 0)::INT) AS hit FROM ports GROUP BY hold, k, "offset" HAVING count(*) >= 2""",
    }


ROLL_SQL = oracle(f'SELECT hold, k, "offset", n, {r("sharpe", 5)} AS sharpe, {r("sleeve_pct", 5)} AS sleeve_pct, {r("hit", 5)} AS hit FROM ro', **rolling_ctes())
OFFS_SQL = oracle("SELECT hold, k, count(*) AS n_offsets, " + ", ".join(f"{r(e, 5)} AS {n}" for n, e in (
    ("sharpe_mean", "avg(sharpe)"), ("sharpe_median", "median(sharpe)"), ("sharpe_std", "stddev_samp(sharpe)"), ("sharpe_min", "min(sharpe)"), ("sharpe_max", "max(sharpe)"),
    ("sleeve_mean", "avg(sleeve_pct)"), ("sleeve_std", "stddev_samp(sleeve_pct)"), ("hit_mean", "avg(hit)"))) + " FROM ro GROUP BY hold, k", **rolling_ctes())


def model_sets(s, d):
    p = mv.predictions(s, d).select("date", "stock", "horizon", "pred_lr", "real_lr")
    return [p.filter(F.col("horizon") == h).drop("horizon") for h in ("h1", "h3", "h5")]


def q_ensemble(std):
    def run(s, d):
        e = st.ensemble(model_sets(s, d), standardise=std)
        return rounded(mt.ic_summary(mt.rank_ic_by_group(e, ["date"], min_size=12)))
    return run


def ensemble_sql(std):
    z = "(pred_lr - avg(pred_lr) OVER w) / (stddev_pop(pred_lr) OVER w + 1e-9)" if std else "pred_lr"
    return oracle(summary_sql(), m=f"""SELECT date, stock, avg(z) AS pred_lr, max(CASE WHEN horizon = 'h1' THEN real_lr END) AS real_lr
  FROM (SELECT *, {z} AS z FROM preds WINDOW w AS (PARTITION BY horizon, date)) GROUP BY ALL HAVING count(*) = 3""",
                  rk=RANKS.format(by="date", p="pred_lr", y="real_lr", src="m"), ic=IC.format(by="date", m=12))


def q_quarters(s, d):
    return rounded(log_sleeve(st.series_stats(gate_days(s, d))), 4)


QUARTER_SQL = oracle(f"""SELECT coalesce(quarter, 'TOTAL') AS quarter, count(*) AS n, count(*) FILTER (b <> 0) AS traded, {r('avg(b)', 4)} AS mean_bps,
  {r('avg(b) / CASE WHEN stddev_pop(b) = 0 THEN 1e-9 ELSE stddev_pop(b) END * sqrt(252.0)', 4)} AS sharpe, {r('sum(ln(1 + b / 10000))', 4)} AS sleeve_pct,
  {r('count(*) FILTER (b > 0) / greatest(count(*) FILTER (b <> 0), 1)::DOUBLE * 100', 4)} AS hit_pct
  FROM (SELECT year(date) || '-Q' || quarter(date) AS quarter, b FROM gd) GROUP BY ROLLUP (quarter)""", **GATE,
                     gd="SELECT t.date, CASE WHEN m > 0 AND fires THEN bps ELSE 0 END AS b FROM tests t LEFT JOIN bst b ON b.date = t.date LEFT JOIN db ON db.date = t.date AND db.thr = b.thr AND m > 0")


def q_sleeve(s, d):
    return rounded(st.running_sleeve(st.top_k_days(mv.predictions(s, d).filter("horizon = 'h1'"), 4, 15.0), bps="net_bps", date="date").select("date", "cum_sleeve_pct"), 1)


def stop_days(s, d):
    """Each session's three best names by volume as the strategy's picks."""
    from pyspark.sql import Window
    b = mv.bars_5m(s, d).groupBy("symbol", F.to_date("ts").alias("test_date")).agg(F.sum("volume").alias("v"))
    w = Window.partitionBy("test_date").orderBy(F.col("v").desc(), "symbol")
    top = b.withColumn("_p", F.row_number().over(w)).filter("_p <= 3")
    return top.groupBy("test_date").agg(F.collect_list("symbol").alias("chosen_stocks")).withColumn("today_pnl_bps", F.lit(12.0))


def q_stop(horizon):
    return lambda s, d: rounded(bt.stop_exits(stop_days(s, d), mv.bars_5m(s, d), mv.calendar(s, d), horizon=horizon, anchor_minute=600, stop_bps=3000.0))


def stop_sql(exit_join, out):
    return oracle(f"""SELECT test_date, 12.0::DOUBLE AS today_pnl_bps, {r('CASE WHEN o IS NULL THEN 12.0::DOUBLE ELSE avg(x) * 10000 - 15 END')} AS today_pnl_bps_stop,
  CASE WHEN o IS NULL THEN 'no_exit_day' WHEN count(*) FILTER (why = 'stop') > 0 THEN 'stop' WHEN count(*) FILTER (why <> 'no_bars') = 0 THEN 'no_bars' ELSE 'target' END AS exit_reason
  FROM (SELECT test_date, o, CASE WHEN en IS NULL THEN 12.0::DOUBLE / 10000 + 0.0015::DOUBLE WHEN lo <= en * 0.7::DOUBLE THEN (en * 0.7::DOUBLE - en) / en ELSE (cl - en) / en END AS x,
    CASE WHEN en IS NULL THEN 'no_bars' WHEN lo <= en * 0.7::DOUBLE THEN 'stop' ELSE 'target' END AS why FROM (
    SELECT p.test_date, p.symbol, o, arg_min(open, ts) AS en, min(low) AS lo, arg_max(close, ts) AS cl FROM p {exit_join}
    LEFT JOIN bars_5m b ON b.symbol = p.symbol AND b.ts BETWEEN CAST(p.test_date AS TIMESTAMP) + INTERVAL 270 MINUTE AND o GROUP BY ALL)) GROUP BY test_date, o""",
                  p="""SELECT test_date, symbol FROM (SELECT *, row_number() OVER (PARTITION BY test_date ORDER BY v DESC, symbol) AS rn FROM (
  SELECT symbol, CAST(ts AS DATE) AS test_date, sum(volume) AS v FROM bars_5m GROUP BY ALL)) WHERE rn <= 3""", **({"xo": out} if out else {}))


# ---- book fills
POS = 6000.0


def fill_picks(s, d):
    return st.rebalances(h1(s, d), 5, 4)


def q_fill(s, d):
    return rounded(bf.fill_audit(fill_picks(s, d), mv.book_for_stocks(s, d), POS))


def q_fill_summary(s, d):
    return rounded(bf.fill_summary(bf.fill_audit(fill_picks(s, d), mv.book_for_stocks(s, d), POS)))


def q_slip_stock(s, d):
    return rounded(bf.slippage_by_stock(bf.fill_audit(fill_picks(s, d), mv.book_for_stocks(s, d), POS)), 5)


PICKS5 = {
    "h1p": "SELECT * FROM preds WHERE horizon = 'h1'",
    "dts": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS dn, count(*) OVER () - 1 AS mx FROM (SELECT DISTINCT date FROM h1p)",
    "pk": """SELECT * FROM (SELECT p.*, dn, mx, row_number() OVER (PARTITION BY date ORDER BY pred_lr DESC, stock) AS pos, count(*) OVER (PARTITION BY date) AS w,
  sum(real_lr) OVER (PARTITION BY stock ORDER BY dn RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ideal FROM h1p p JOIN dts USING (date)) WHERE pos <= 4 AND w >= 4 AND dn + 5 <= mx""",
    "snap": "SELECT * FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS rn FROM sbook) WHERE rn = 1",
    "lv": "SELECT symbol, date, ask1_price AS top_ask, unnest([" + ", ".join(f"{{'i': {i}, 'ap': ask{i}_price, 'aq': ask{i}_qty, 'bp': bid{i}_price, 'bq': bid{i}_qty}}" for i in range(1, 6)) + "], recursive := true) FROM snap",
    "buy": f"""SELECT symbol, date, any_value(top_ask) AS top_ask, sum(q) AS qty, sum(q * ap) / sum(q) AS vwap, bool_or(val_to >= {POS}) AS filled FROM (
  SELECT *, CASE WHEN val_to - ap * aq >= {POS} THEN 0 WHEN val_to >= {POS} THEN ({POS} - (val_to - ap * aq)) / ap ELSE aq END AS q
  FROM (SELECT *, sum(ap * aq) OVER (PARTITION BY symbol, date ORDER BY i) AS val_to FROM lv)) GROUP BY ALL""",
}
FILL_CTES = dict(PICKS5, fa="""SELECT p.date, p.stock, b.top_ask, CASE WHEN b.symbol IS NULL THEN 'no_snapshot' WHEN filled THEN 'filled' ELSE 'unfillable' END AS status,
  CASE WHEN filled THEN vwap END AS vwap, CASE WHEN filled THEN qty END AS qty, CASE WHEN filled THEN (vwap / top_ask - 1) * 10000 END AS slip_bps FROM pk p LEFT JOIN buy b ON b.symbol = p.stock AND b.date = p.date""")
FILL_SQL = oracle(f"SELECT date, stock, {r('top_ask')} AS top_ask, status, {r('vwap')} AS vwap, {r('qty')} AS qty, {r('slip_bps')} AS slip_bps FROM fa", **FILL_CTES)
FILLSUM_SQL = oracle(f"""SELECT count(*) AS n_picks, count(*) FILTER (status = 'no_book') AS n_no_book, count(*) FILTER (status = 'no_snapshot') AS n_no_snapshot, count(*) FILTER (status = 'filled') AS n_filled,
  count(*) FILTER (status = 'unfillable') AS n_unfillable, count(*) FILTER (slip_bps <= 20) AS n_in_budget, {r('avg(slip_bps)')} AS mean, {r('max(slip_bps)')} AS max, {r('quantile_cont(slip_bps, 0.25)')} AS p25,
  {r('quantile_cont(slip_bps, 0.5)')} AS median, {r('quantile_cont(slip_bps, 0.75)')} AS p75, {r('quantile_cont(slip_bps, 0.95)')} AS p95 FROM fa""", **FILL_CTES)


def exec_picks(s, d):
    return bf.executed_picks(h1(s, d), mv.book_for_stocks(s, d), hold=5, k=4, position=POS)


def q_exec_full(s, d):
    return rounded(bf.executed_full(exec_picks(s, d)))


def q_exec_partial(s, d):
    return rounded(bf.executed_partial(exec_picks(s, d), k=4, position=POS))


def q_exec_ratio(s, d):
    return rounded(bf.annual_ratio(bf.executed_partial(exec_picks(s, d), k=4, position=POS), 5))


def q_pick_fill(s, d):
    return rounded(bf.pick_fill_stats(exec_picks(s, d), POS))


def _sell(qty: str, name: str) -> str:
    return f"""SELECT rid, sum(q) AS sq, sum(q * bp) / sum(q) AS sv, sum(bq) >= any_value(want) AS sfull, arg_max(bp, i) FILTER (q > 0) AS lastp FROM (
  SELECT *, greatest(least(bq, want - (bq_to - bq)), 0) AS q FROM (SELECT rid, {qty} AS want, i, bp, bq::DOUBLE AS bq, sum(bq) OVER (PARTITION BY rid ORDER BY i) AS bq_to
  FROM ex JOIN lv ON lv.symbol = ex.stock AND lv.date = ex.xdate)) GROUP BY rid"""


EXEC = dict(
    PICKS5,
    ex="""SELECT row_number() OVER () AS rid, (p.dn % 5)::INTEGER AS "offset", p.date AS entry, x.date AS xdate, p.stock, ideal, b.qty, b.vwap, b.filled FROM pk p JOIN dts x ON x.dn = p.dn + 5
  LEFT JOIN buy b ON b.symbol = p.stock AND b.date = p.date WHERE p.date >= (SELECT CAST(min(ts) AS DATE) FROM sbook) AND x.date <= (SELECT CAST(max(ts) AS DATE) FROM sbook)""",
    sell=_sell("qty", "sell"), sellf=_sell(f"{POS} / vwap", "sellf"),
    ful=f"""SELECT "offset", entry, xdate AS exit, count(*) FILTER (ok) AS n_filled, count(*) FILTER (NOT ok) AS n_dropped, ln(avg(exp(ln(sv / vwap))) FILTER (ok)) AS ob, ln(avg(exp(ideal)) FILTER (ok)) AS idl
  FROM (SELECT *, coalesce(filled AND sfull, false) AS ok FROM ex LEFT JOIN sellf USING (rid)) GROUP BY ALL HAVING count(*) FILTER (ok) > 0""",
    par=f"""SELECT "offset", entry, xdate AS exit, count(*) AS n_picks, sum(qty * vwap) AS total_deployed, sum(sq * sv + CASE WHEN qty - sq > 1e-9 THEN (qty - sq) * lastp * 0.995::DOUBLE ELSE 0 END) AS total_terminal,
  ln(avg(exp(ideal))) AS idl FROM ex JOIN sell USING (rid) WHERE qty > 0 AND sq > 0 GROUP BY ALL""")


def exec_sql(table, extra, ob):
    return oracle(f"""SELECT "offset", entry, exit, {extra}, {r(ob)} AS ob_port_lr, {r('idl')} AS ideal_lr, {r('idl - 0.003::DOUBLE')} AS ideal_net, {r(f'({ob} - idl) * 10000')} AS ob_vs_ideal_bps FROM {table}""", **EXEC)


QUERIES = {
    "backtest_trades": (q_trades, TRADES_SQL),
    "backtest_tearsheet": (q_tearsheet, TEAR_SQL),
    "equity_curve": (q_equity, oracle(f"SELECT t, symbol, direction, {r('cum', 4)} AS cum, {r('peak', 4)} AS peak, {r('peak - cum', 4)} AS drawdown FROM curve", **TRADES,
                                      c0="SELECT *, sum(pnl) OVER (ORDER BY t, direction DESC, score DESC, symbol ROWS UNBOUNDED PRECEDING) AS cum FROM trades",
                                      curve="SELECT *, max(cum) OVER (ORDER BY t, direction DESC, score DESC, symbol ROWS UNBOUNDED PRECEDING) AS peak FROM c0")),
    "first_touch_exits": (q_first_touch, exits_sql(60, 0.2, 0.15, BASE_CODE, PROP)),
    "rerank_exits": (q_rerank, exits_sql(60, 0.25, 0.2, BASE_CODE.replace(" END", " WHEN rk > 12 THEN 'score_rerank_exit' END"), "-0.2::DOUBLE", RK_JOIN, "rkk AS rk, scc AS sc")),
    "floor_exits": (q_floor, exits_sql(60, 0.25, 0.2, "CASE WHEN ht THEN 'target' WHEN sc < -0.3 THEN 'score_floor_exit' END", "0", RK_JOIN, "rkk AS rk, scc AS sc")),
    "curve_exits": (q_curve_exit, exits_sql(60, 0.25, 0.2, "CASE WHEN hs THEN 'stop' WHEN rk > CASE WHEN drift < -0.1 THEN 4 WHEN drift < 0.05 THEN 14 WHEN drift < 0.2 THEN 6 ELSE 6 END THEN 'curve_exit' END",
                                            "0", CURVE_JOIN, "rkk AS rk, scc AS sc")),
    "wide_predictions": (q_wide, WIDE_SQL),
    "top_k_days": (q_topk_days, TOPK_SQL),
    "rolling_best_config": (lambda s, d: rounded(tuned(s, d), 4), TUNED_SQL),
    "config_frequency": (lambda s, d: rounded(st.config_frequency(tuned(s, d), 5), 4), oracle(
        f"SELECT top_k AS tuned_k, horizon AS tuned_horizon, {r('threshold', 4)} AS tuned_threshold, count(*) AS n FROM tun GROUP BY top_k, horizon, threshold ORDER BY n DESC, 1, 2, 3 LIMIT 5", **TUNED)),
    "threshold_gate": (q_gate, GATE_SQL),
    "clock_gate": (q_clock_gate, CLOCK_SQL),
    "rolling_rebalance": (q_rolling, ROLL_SQL),
    "rebalance_over_offsets": (q_offsets, OFFS_SQL),
    "seed_ensemble_ic": (q_ensemble(False), ensemble_sql(False)),
    "zscore_ensemble_ic": (q_ensemble(True), ensemble_sql(True)),
    "quarterly_stats": (q_quarters, QUARTER_SQL),
    "first_anchor_rows": (lambda s, d: rounded(st.first_anchor_of_day(mv.predictions(s, d)).select("date", "anchor_us", "stock", "horizon", "pred_lr")), oracle(
        f"SELECT date, anchor_us, stock, horizon, {r('pred_lr')} AS pred_lr FROM (SELECT *, min(anchor_us) OVER (PARTITION BY date) AS f FROM preds) WHERE anchor_us = f")),
    "stop_exits_day": (q_stop("intraday_120m"), stop_sql("JOIN (SELECT DISTINCT test_date AS td, CAST(test_date AS TIMESTAMP) + INTERVAL 390 MINUTE AS o FROM p) z ON td = p.test_date", "")),
    "stop_exits_multi_day": (q_stop("day_plus_3"), stop_sql(
        "LEFT JOIN xo ON xo.td = p.test_date", "SELECT a.trade_date AS td, CAST(b.trade_date AS TIMESTAMP) + INTERVAL 10 HOUR AS o FROM cal a JOIN cal b ON b.idx = a.idx + 3")),
    "fill_audit": (q_fill, FILL_SQL),
    "fill_summary": (q_fill_summary, FILLSUM_SQL),
    "slippage_by_stock": (q_slip_stock, oracle(
        f"SELECT stock, {r('avg(slip_bps)', 5)} AS avg_slip, count(slip_bps) AS n, {r('max(slip_bps)', 5)} AS max_slip FROM fa WHERE slip_bps IS NOT NULL GROUP BY stock ORDER BY avg(slip_bps) DESC, stock LIMIT 15", **FILL_CTES)),
    "executed_full": (q_exec_full, exec_sql("ful", "n_filled, n_dropped", "ob")),
    "executed_partial": (q_exec_partial, exec_sql("par", f"n_picks, {r('total_deployed')} AS total_deployed, {r('total_terminal')} AS total_terminal, {r(f'total_deployed / (4 * {POS}) * 100')} AS fill_pct", "ln(total_terminal / total_deployed)")),
    "executed_ratio": (q_exec_ratio, oracle(f"""SELECT count(*) AS n, {r('avg(o) / stddev_samp(o) * sqrt(50.0)')} AS ob_sharpe, {r('avg(i) / stddev_samp(i) * sqrt(50.0)')} AS ideal_sharpe
  FROM (SELECT ln(total_terminal / total_deployed) AS o, idl - 0.003::DOUBLE AS i FROM par)""", **EXEC)),
    "pick_fill_stats": (q_pick_fill, oracle(f"""SELECT count(*) AS n, {r('avg(f)')} AS mean, count(*) FILTER (f >= 99) AS n_full, {r('quantile_cont(f, 0.25)')} AS p25, {r('quantile_cont(f, 0.5)')} AS median, {r('quantile_cont(f, 0.75)')} AS p75
  FROM (SELECT qty * vwap / {POS} * 100 AS f FROM ex JOIN sell USING (rid) WHERE qty > 0 AND sq > 0)""", **EXEC)),
}
