"""Evaluation queries: ranks, calibration, gates."""

from pyspark.sql import functions as F

from tickloom.catalog import calendars
from tickloom.catalog.features import CAP_DAY, FAR
from tickloom.catalog.labels import daily_sql, labels_1d, q_tradeable, tradeable_sql
from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.operators import ranking, tradingdays as td
from tickloom.plans import conformal as cf, features as ft, gates, metrics as mt
from tickloom.sources import marketviews as mv

RANKS = """SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0::DOUBLE AS rp,
  rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0::DOUBLE AS rr FROM {src}"""
IC = "SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {m} AND min(rp) < max(rp) AND min(rr) < max(rr) THEN corr(rp, rr) END AS ic FROM rk GROUP BY {by}"


def summary_sql(by="") -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {g}{r('coalesce(avg(ic), 0)')} AS mean_ic, {r('coalesce(stddev_samp(ic), 0)')} AS std_ic,
  {r('CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) * sqrt(count(ic)) / stddev_samp(ic) ELSE 0 END')} AS t_stat,
  count(ic) AS n_cross_sections, CAST(sum(n) AS BIGINT) AS n_observations FROM ic {'GROUP BY ' + by if by else ''}"""


def q_flagship(s, d):
    """Bars known by a moment -> features -> forward labels -> rank IC, one plan."""
    bars = mv.bars_day(s, d)
    feats = ft.compute_features(bars, scale="day", as_of=CAP_DAY, groups=("log_returns", "volume_z", "wicks"))
    lab = labels_1d(s, d).filter("valid_label").select("symbol", "t", "y_log_return")
    rows = feats.select("symbol", F.col("ts").alias("t"), (-F.col("ret_1")).alias("score")).dropna().join(lab, ["symbol", "t"])
    return rounded(mt.ic_summary(mt.rank_ic_by_group(rows, ["t"], "score", "y_log_return")))


FLAGSHIP_SQL = oracle(summary_sql(), lab=daily_sql(1), rows_="""SELECT symbol, t, score, y_log_return FROM
  (SELECT symbol, ts AS t, -ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS score FROM bars_day WHERE ts <= TIMESTAMP '2000-06-30 10:00:00')
  JOIN lab USING (symbol, t) WHERE valid_label AND score IS NOT NULL""",
                      rk=RANKS.format(by="t", p="score", y="y_log_return", src="rows_"), ic=IC.format(by="t", m=10))

PRK = RANKS.format(by="horizon, date", p="pred_lr", y="real_lr", src="preds")
PIC = IC.format(by="horizon, date", m=10)


def q_ic(s, d):
    return rounded(mt.ic_summary(mt.rank_ic_by_group(mv.predictions(s, d), ["horizon", "date"]), ["horizon"]))


def q_ic_spread(s, d):
    per = mt.rank_ic_by_group(mv.predictions(s, d), ["horizon", "date"])
    return rounded(mt.ic_spread(per.withColumn("ic", F.round("ic", 9)), ["horizon"]))


def q_pooled(s, d):
    return rounded(mt.pooled_ic(mv.predictions(s, d), group=["date"]))


def q_spread(s, d):
    return rounded(mt.decile_spread_bps(mv.predictions(s, d), ["horizon", "date"], tie="stock", out_by=["horizon"]), 4)


def scored_tradeable(s, d):
    """Tradeable labels with a score known at the anchor (minus the last bar's return)."""
    feats = ft.compute_features(mv.bars(s, d, "5m"), scale="5m", as_of=FAR, groups=("log_returns",))
    sc = feats.select("symbol", "ts", (-F.col("ret_1")).alias("score")).dropna()
    return q_tradeable(s, d).filter("valid_label").join(sc, ["symbol", "ts"])


SCORED = """SELECT l.*, score FROM lab l JOIN (SELECT symbol, ts, -ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS score FROM bars_5m) f
  USING (symbol, ts) WHERE valid_label AND score IS NOT NULL"""


def q_hits(s, d):
    rows = scored_tradeable(s, d)
    both = mt.hits_at_k(rows, ["t"], (1, 3, 5), score=F.col("score")).withColumn("side", F.lit("long")).unionByName(
        mt.hits_at_k(rows, ["t"], (1, 3, 5), score=-F.col("score"), target=-1).withColumn("side", F.lit("short")))
    out = mt.lift_over_base(both, mt.base_rates(rows), "base_long")
    rate = F.when(F.col("side") == "long", F.col("base_long")).otherwise(F.col("base_short"))
    return rounded(out.withColumn("lift", F.try_divide("precision", rate)))


def hits_sql():
    parts = []
    for side, sgn, tgt in (("long", "", 1), ("short", "-", -1)):
        parts.append(f"""SELECT '{side}' AS side, k, avg(h / least(k, n)::DOUBLE) AS precision, coalesce(avg(CASE WHEN tg > 0 THEN h / tg::DOUBLE END), 0) AS recall,
  count(*) AS n_cross_sections, avg(tg) AS n_target_in_universe FROM (
  SELECT t, k, count(*) AS n, sum(hit) AS tg, sum(CASE WHEN pos <= k THEN hit ELSE 0 END) AS h FROM (
    SELECT t, (tradeable_label = {tgt})::INT AS hit, row_number() OVER (PARTITION BY t ORDER BY {sgn}score DESC, symbol) AS pos FROM sc),
    (VALUES (1), (3), (5)) ks(k) GROUP BY t, k) GROUP BY k""")
    return oracle(f"""SELECT side, k, {r('precision')} AS precision, {r('recall')} AS recall, n_cross_sections, {r('n_target_in_universe')} AS n_target_in_universe,
  {r('base_long')} AS base_long, {r('base_short')} AS base_short, {r("precision / CASE side WHEN 'long' THEN base_long ELSE base_short END")} AS lift
  FROM ({' UNION ALL '.join(parts)}), (SELECT avg((tradeable_label = 1)::INT) AS base_long, avg((tradeable_label = -1)::INT) AS base_short FROM sc)""",
                  lab=tradeable_sql(), sc=SCORED)


def q_pnl_at_k(s, d):
    return rounded(mt.pnl_at_k(mv.predictions(s, d).filter("horizon = 'h3'"), ["date"], (1, 3, 5), score="pred_lr", pnl="real_lr", tie="stock"))


PNLK_SQL = oracle(f"""SELECT k, {r('avg(m)')} AS mean_pnl, {r('stddev_samp(m)')} AS pnl_std, {r('avg(m) / stddev_samp(m)')} AS sharpe, count(*) AS n_cross_sections FROM (
  SELECT date, k, avg(real_lr) AS m FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred_lr DESC, stock) AS pos FROM preds WHERE horizon = 'h3'),
  (VALUES (1), (3), (5)) ks(k) WHERE pos <= k GROUP BY date, k) GROUP BY k""")

EDGES = "SELECT horizon, list_sort(list_distinct(quantile_cont(pred_lr, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM preds GROUP BY horizon"
BINNED = "SELECT p.*, CAST(len(list_filter(e[2:len(e)-1], lambda x: x <= pred_lr)) AS INTEGER) AS bin FROM preds p JOIN ed USING (horizon)"


def q_lift(s, d):
    return rounded(mt.decile_lift(mv.predictions(s, d)))


def q_win_deciles(s, d):
    return rounded(mt.decile_win_rate(mv.predictions(s, d), F.col("real_lr") > 0.001))


def q_win_summary(s, d):
    return rounded(mt.win_rate_summary(mv.predictions(s, d), F.col("real_lr") > 0.001))


def win_summary_sql():
    tops = ", ".join(f"sum(CASE WHEN desc_pos <= greatest(floor(n * {p}::DOUBLE), 1) THEN y ELSE 0 END) / greatest(floor(max(n) * {p}::DOUBLE), 1) AS top{q}pct_winrate"
                     for p, q in ((0.01, 1), (0.05, 5), (0.1, 10)))
    return oracle(f"""SELECT horizon, n_test, {r('base_rate')} AS base_rate, {r('(rs - w * (w + 1) / 2.0::DOUBLE) / (w * (n_test - w))')} AS auc,
  {r('top1pct_winrate')} AS top1pct_winrate, {r('top5pct_winrate')} AS top5pct_winrate, {r('top10pct_winrate')} AS top10pct_winrate
  FROM (SELECT horizon, count(*) AS n_test, avg(y) AS base_rate, sum(y)::DOUBLE AS w, sum(y * rp) AS rs, {tops} FROM (
    SELECT *, (real_lr > 0.001::DOUBLE)::INT AS y, count(*) OVER (PARTITION BY horizon) AS n, row_number() OVER (PARTITION BY horizon ORDER BY pred_lr DESC) AS desc_pos,
      rank() OVER (PARTITION BY horizon ORDER BY pred_lr) + (count(*) OVER (PARTITION BY horizon, pred_lr) - 1) / 2.0::DOUBLE AS rp FROM preds) GROUP BY horizon)""")


# ------------------------------------------------------------------- conformal

def quantile_rows(s, d):
    """Predictions as five quantiles with a volatility bucket per date."""
    p = mv.predictions(s, d)
    mid, v = F.col("pred_lr") * 0.5, F.col("vol")
    return p.select("date", "stock", "horizon", F.col("real_lr").alias("y"), "pred_lr", "real_lr",
                    (mid - v * 1.2).alias("q10"), (mid - v * 0.6).alias("q25"), mid.alias("q50"),
                    (mid + v * 0.5).alias("q75"), (mid + v * 1.1).alias("q90"),
                    ranking.quantile_bucket("vol", ["horizon", "date"], 5).cast("int").alias("vol_bucket"))


QROWS = """SELECT date, stock, horizon, real_lr AS y, pred_lr, real_lr, pred_lr * 0.5 - vol * 1.2 AS q10, pred_lr * 0.5 - vol * 0.6 AS q25,
  pred_lr * 0.5 AS q50, pred_lr * 0.5 + vol * 0.5 AS q75, pred_lr * 0.5 + vol * 1.1 AS q90,
  CASE WHEN mn = mx THEN 2 ELSE len(list_filter(e, lambda x: x <= vol)) END AS vol_bucket
  FROM preds JOIN (SELECT horizon, date, min(vol) AS mn, max(vol) AS mx, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) AS e FROM preds GROUP BY ALL) USING (horizon, date)"""
SPLIT = """SELECT q.*, part FROM qr q JOIN (SELECT horizon, date, CASE WHEN coalesce(sum(n) OVER (PARTITION BY horizon ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < floor(sum(n) OVER (PARTITION BY horizon) * 0.5) THEN 'cal' ELSE 'test' END AS part FROM (SELECT horizon, date, count(*) AS n FROM qr GROUP BY ALL)) USING (horizon, date)"""


def cells_ctes(src: str, min_cell: int) -> dict[str, str]:
    return {
        "cellrows": f"""SELECT horizon, CASE WHEN count(*) OVER (PARTITION BY horizon, vol_bucket) >= {min_cell} THEN vol_bucket ELSE -1 END AS cell,
  greatest((s[1] - y) / (s[2] - s[1] + 1e-9), (y - s[3]) / (s[3] - s[2] + 1e-9)) AS s1, abs(y - q50) AS s2 FROM (SELECT *, list_sort([q10, q50, q90]) AS s FROM {src})""",
        "cuts": """SELECT horizon, cell, max(CASE WHEN r1 = k THEN s1 END) AS t1, max(CASE WHEN r2 = k THEN s2 END) AS t2 FROM (
  SELECT *, least(greatest(ceil((count(*) OVER (PARTITION BY horizon, cell) + 1) * 0.8::DOUBLE), 1), count(*) OVER (PARTITION BY horizon, cell)) AS k,
    row_number() OVER (PARTITION BY horizon, cell ORDER BY s1) AS r1, row_number() OVER (PARTITION BY horizon, cell ORDER BY s2) AS r2 FROM cellrows) GROUP BY ALL""",
        "cells": """SELECT horizon, cell AS vol_bucket, CASE WHEN f THEN 'cqr' ELSE 'vanilla' END AS score_fn, CASE WHEN f THEN t1 ELSE t2 END AS s_star, n AS n_calibration,
  CASE WHEN f THEN c1 ELSE c2 END AS coverage_in_sample, 0.2::DOUBLE AS alpha FROM (SELECT *, abs(c1 - 0.8::DOUBLE) <= abs(c2 - 0.8::DOUBLE) AS f FROM (
  SELECT horizon, cell, any_value(t1) AS t1, any_value(t2) AS t2, count(*) AS n, avg((s1 <= t1)::INT) AS c1, avg((s2 <= t2)::INT) AS c2
  FROM cellrows JOIN cuts USING (horizon, cell) GROUP BY ALL)) WHERE cell <> -1 OR n >= 10""",
    }


def q_cells(s, d):
    return rounded(cf.calibrate(quantile_rows(s, d), min_cell_size=5000))


def q_conformal(s, d):
    return rounded(cf.calibrate_and_score(quantile_rows(s, d), min_cell_size=2500))


CONF_SQL = oracle(f"""SELECT horizon, {r('avg((y BETWEEN lo AND hi)::INT)')} AS coverage, count(*) AS n_test FROM (
  SELECT t.*, CASE WHEN fn = 'cqr' THEN q50 - (1 + ss) * (q50 - q10) ELSE q50 - ss END AS lo, CASE WHEN fn = 'cqr' THEN q50 + (1 + ss) * (q90 - q50) ELSE q50 + ss END AS hi
  FROM (SELECT t.*, coalesce(c.score_fn, p.score_fn) AS fn, coalesce(c.s_star, p.s_star) AS ss FROM sp t
    LEFT JOIN cells c ON c.horizon = t.horizon AND c.vol_bucket = t.vol_bucket LEFT JOIN cells p ON p.horizon = t.horizon AND p.vol_bucket = -1 WHERE part = 'test') t) GROUP BY horizon""",
                  qr=QROWS, sp=SPLIT, **cells_ctes("(SELECT * FROM sp WHERE part = 'cal')", 2500))


def parts(s, d):
    p = cf.chronological_parts(mv.predictions(s, d))
    return p.filter("part = 'cal'"), p.filter("part = 'test'")


def q_curve(s, d):
    return rounded(cf.coverage_curve(*parts(s, d)))


def q_profile(s, d):
    return rounded(cf.residual_profile(*parts(s, d)))


PSPLIT = SPLIT.replace("qr", "preds")
CURVE_SQL = oracle(f"""SELECT horizon, {r('nominal')} AS nominal, {r('avg((abs(real_lr - pred_lr) <= q)::INT)')} AS actual, {r('2 * q')} AS width
  FROM (SELECT * FROM sp WHERE part = 'test') t JOIN qs USING (horizon) GROUP BY horizon, nominal, q""", sp=PSPLIT,
                   qs="""SELECT horizon, nominal, max(CASE WHEN rn = least(greatest(ceil((n + 1) * nominal), 1), n) THEN e END) AS q FROM (
  SELECT horizon, abs(real_lr - pred_lr) AS e, row_number() OVER (PARTITION BY horizon ORDER BY abs(real_lr - pred_lr)) AS rn, count(*) OVER (PARTITION BY horizon) AS n
  FROM sp WHERE part = 'cal'), (VALUES """ + ", ".join(f"({1.0 - a!r}::DOUBLE)" for a in cf.LEVELS) + ") l(nominal) GROUP BY ALL")
PROFILE_SQL = oracle(f"""SELECT horizon, {r('p50')} AS residual_p50, {r('p90')} AS residual_p90, {r('pearson')} AS pearson, n_test, {r('spearman')} AS spearman
  FROM (SELECT horizon, quantile_cont(abs(real_lr - pred_lr), 0.5) AS p50, quantile_cont(abs(real_lr - pred_lr), 0.9) AS p90 FROM sp WHERE part = 'cal' GROUP BY horizon)
  JOIN (SELECT horizon, corr(pred_lr, real_lr) AS pearson, count(*) AS n_test, corr(rp, rr) AS spearman FROM rk GROUP BY horizon) USING (horizon)""", sp=PSPLIT,
                     te="SELECT * FROM sp WHERE part = 'test'", rk=RANKS.format(by="horizon", p="pred_lr", y="real_lr", src="te"))


# ----------------------------------------------------------------------- gates

def fold_results(s, d):
    """Per fold and horizon: IC of the predictions, of a volatility baseline, of three noise seeds."""
    folds = calendars.q_folds(s, d).select("name", F.col("test_start").alias("lo"), F.col("test_end").alias("hi"))
    p = mv.predictions(s, d)
    no = F.substring("stock", 7, 10).cast("int")
    day = F.datediff("date", F.lit("1995-01-02").cast("date"))
    noise = [F.struct(F.lit("random_init").alias("mode"), F.lit(k).alias("seed"),
                      ((no * 7919 + day * (104729 + 31 * k)) % 1009).cast("double").alias("score")) for k in (1, 2, 3)]
    modes = F.explode(F.array(F.struct(F.lit("ssl_heads").alias("mode"), F.lit(0).alias("seed"), F.col("pred_lr").alias("score")),
                              F.struct(F.lit("xgboost").alias("mode"), F.lit(0).alias("seed"), F.col("vol").alias("score")), *noise))
    rows = td.by_interval(p, folds, "date").select(
        F.col("name").alias("fold_id"), "horizon", "date", "stock", "real_lr", modes.alias("m")).select(
        "fold_id", "horizon", "date", "stock", "real_lr", "m.mode", "m.seed", "m.score")
    per = mt.rank_ic_by_group(rows, ["fold_id", "horizon", "mode", "seed", "date"], "score")
    return mt.ic_summary(per, ["fold_id", "horizon", "mode", "seed"]).select(
        "fold_id", "horizon", "mode", "seed", F.round("mean_ic", 9).alias("rank_ic_mean"), "n_cross_sections")


FOLD_CTES = dict(
    folds=calendars.FOLDS_SQL[calendars.FOLDS_SQL.index("SELECT 'fold_'"):],
    frows="""SELECT f.name AS fold_id, p.horizon, date, stock, real_lr, m.mode AS mode, m.seed AS seed, m.score AS score FROM folds f JOIN (SELECT *, unnest([
    {'mode': 'ssl_heads', 'seed': 0, 'score': pred_lr}, {'mode': 'xgboost', 'seed': 0, 'score': vol}, """ + ", ".join(
        f"{{'mode': 'random_init', 'seed': {k}, 'score': ((no * 7919 + dd * {104729 + 31 * k}) % 1009)::DOUBLE}}" for k in (1, 2, 3)) + """]) AS m FROM (
    SELECT *, CAST(substr(stock, 7) AS INTEGER) AS no, datediff('day', DATE '1995-01-02', date) AS dd FROM preds)) p ON date BETWEEN test_start AND test_end""",
    rk=RANKS.format(by="fold_id, horizon, mode, seed, date", p="score", y="real_lr", src="frows"),
    ic=IC.format(by="fold_id, horizon, mode, seed, date", m=10),
    results="SELECT fold_id, horizon, mode, seed, round(coalesce(avg(ic), 0), 9) AS rank_ic_mean, count(ic) AS n_cross_sections FROM ic GROUP BY ALL",
    tri="""SELECT *, mean_model_ic - mean_baseline_ic AS mean_delta, delta_t_stat > 1.5 AS passed_t_stat, mean_model_ic - mean_baseline_ic >= 0.005 AS passed_mean_delta,
  folds_positive >= 3 AS passed_folds_positive, folds_beat >= 3 AS passed_folds_beat, delta_t_stat > 1.5 AND folds_positive >= 3 AND folds_beat >= 3 AS passed FROM (
  SELECT horizon, avg(a) AS mean_model_ic, avg(b) AS mean_baseline_ic, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS delta_t_stat,
    count(*) FILTER (a > 0) AS folds_positive, count(*) FILTER (a > b) AS folds_beat, count(*) AS n_folds
  FROM (SELECT horizon, fold_id, rank_ic_mean AS a FROM results WHERE mode = 'ssl_heads') JOIN (SELECT horizon, fold_id, rank_ic_mean AS b FROM results WHERE mode = 'xgboost') USING (horizon, fold_id) GROUP BY horizon)""",
    rnd="""SELECT *, mean_model_ic - mean_random_ic AS mean_delta, mean_model_ic - mean_random_ic >= 0.005 AS passed_mean_delta, delta_t_stat > 1.5 AS passed FROM (
  SELECT horizon, avg(a) AS mean_model_ic, avg(b) AS mean_random_ic, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS delta_t_stat
  FROM (SELECT horizon, fold_id, rank_ic_mean AS a FROM results WHERE mode = 'ssl_heads') JOIN (SELECT horizon, fold_id, max(rank_ic_mean) AS b FROM results WHERE mode = 'random_init' GROUP BY ALL) USING (horizon, fold_id) GROUP BY horizon)""",
)


def fold_coverage(s, d):
    rows = quantile_rows(s, d).select("horizon", "date", "y", F.col("q10").alias("band_lo"), F.col("q90").alias("band_hi"))
    folds = calendars.q_folds(s, d).select("name", F.col("test_start").alias("lo"), F.col("test_end").alias("hi"))
    return cf.coverage(td.by_interval(rows, folds, "date"), ["horizon", "name"])


COVF = "SELECT horizon, name, avg((y BETWEEN q10 AND q90)::INT) AS coverage FROM qr JOIN folds ON date BETWEEN test_start AND test_end GROUP BY ALL"


def q_overall(s, d):
    out = gates.overall(fold_results(s, d), fold_coverage(s, d))
    return out.withColumn("horizons_passed", F.array_join("horizons_passed", ","))


OVERALL_SQL = oracle("""SELECT count(*) FILTER (t) AS n_horizons_passed, count(*) FILTER (t) >= 2 AS gate_1, count(*) FILTER (t) > 0 AND count(*) FILTER (t AND NOT band) = 0 AS gate_3,
  count(*) FILTER (q) >= 2 AND count(*) FILTER (t AND q) >= 2 AS gate_4, coalesce(string_agg(CASE WHEN t THEN horizon END, ',' ORDER BY horizon), '') AS horizons_passed
  FROM (SELECT tri.horizon, tri.passed AS t, rnd.passed AS q, band FROM tri JOIN rnd USING (horizon) JOIN (SELECT horizon, avg(coverage) BETWEEN 0.75 AND 0.85 AS band FROM covf GROUP BY horizon) USING (horizon))""",
                     **FOLD_CTES, qr=QROWS, covf=COVF)


def q_consistency(s, d):
    w = s.createDataFrame([("h1", 0.5), ("h3", 0.3), ("h5", 0.2)], "horizon string, weight double")
    return rounded(mt.signed_consistency(mv.predictions(s, d), ["date", "stock"], w))


CONS_SQL = oracle(f"""SELECT date, stock, {r('score')} AS score, {r('avg((sign(pred_lr) = sign(score))::INT)')} AS consistency
  FROM (SELECT *, sum(pred_lr * w) OVER g / sum(w) OVER g AS score FROM (SELECT *, CASE horizon WHEN 'h1' THEN 0.5::DOUBLE WHEN 'h3' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w FROM preds)
        WINDOW g AS (PARTITION BY date, stock)) GROUP BY date, stock, score""")

QUERIES = {
    "flagship_rank_ic": (q_flagship, FLAGSHIP_SQL),
    "rank_ic_by_horizon": (q_ic, oracle(summary_sql("horizon"), rk=PRK, ic=PIC)),
    "rank_ic_spread": (q_ic_spread, oracle(f"""SELECT horizon, {r('quantile_cont(ic, 0.1)')} AS p10, {r('quantile_cont(ic, 0.5)')} AS p50, {r('quantile_cont(ic, 0.9)')} AS p90,
  count(*) FILTER (ic > 0) AS n_pos, count(*) FILTER (ic < 0) AS n_neg FROM (SELECT horizon, round(ic, 9) AS ic FROM ic) WHERE ic IS NOT NULL GROUP BY horizon""", rk=PRK, ic=PIC)),
    "pooled_ic": (q_pooled, oracle(f"SELECT horizon, count(*) AS n, {r('corr(rp, rr)')} AS ic FROM rk GROUP BY horizon",
                                   src="SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY horizon, date) AS w FROM preds) WHERE w >= 5",
                                   rk=RANKS.format(by="horizon", p="pred_lr", y="real_lr", src="src"))),
    "decile_spread": (q_spread, oracle(f"""SELECT horizon, {r('avg((top - bot) * 10000)', 4)} AS spread_bps, count(*) AS n_cross_sections FROM (
  SELECT horizon, date, avg(CASE WHEN k >= n - greatest(1, n // 10) THEN real_lr END) AS top, avg(CASE WHEN k < greatest(1, n // 10) THEN real_lr END) AS bot
  FROM (SELECT *, count(*) OVER (PARTITION BY horizon, date) AS n, row_number() OVER (PARTITION BY horizon, date ORDER BY pred_lr, stock) - 1 AS k FROM preds) WHERE n >= 10 GROUP BY ALL) GROUP BY horizon""")),
    "precision_recall_at_k": (q_hits, hits_sql()),
    "pnl_at_k": (q_pnl_at_k, PNLK_SQL),
    "decile_lift": (q_lift, oracle(f"SELECT horizon, bin, {r('avg(pred_lr)')} AS mean_pred, {r('avg(real_lr)')} AS mean_real, count(*) AS n FROM bn GROUP BY ALL", ed=EDGES, bn=BINNED)),
    "decile_win_rate": (q_win_deciles, oracle(
        f"SELECT horizon, bin, {r('avg((real_lr > 0.001)::INT)')} AS win_rate, {r('avg(pred_lr)')} AS mean_pred, count(*) AS n FROM bn GROUP BY ALL", ed=EDGES, bn=BINNED)),
    "win_rate_summary": (q_win_summary, win_summary_sql()),
    "conformal_cells": (q_cells, oracle(
        f"SELECT horizon, vol_bucket::INTEGER AS vol_bucket, score_fn, {r('s_star')} AS s_star, n_calibration, {r('coverage_in_sample')} AS coverage_in_sample, {r('alpha')} AS alpha FROM cells",
        qr=QROWS, **cells_ctes("qr", 5000))),
    "conformal_coverage": (q_conformal, CONF_SQL),
    "coverage_curve": (q_curve, CURVE_SQL),
    "residual_profile": (q_profile, PROFILE_SQL),
    "fold_results": (lambda s, d: rounded(fold_results(s, d)), oracle(f"SELECT fold_id, horizon, mode, seed, {r('rank_ic_mean')} AS rank_ic_mean, n_cross_sections FROM results",
                                                                      **{k: v for k, v in FOLD_CTES.items() if k not in ("tri", "rnd")})),
    "horizon_gate": (lambda s, d: rounded(gates.horizon_gate(fold_results(s, d)), 5), oracle(
        f"SELECT * REPLACE ({r('mean_model_ic', 5)} AS mean_model_ic, {r('mean_baseline_ic', 5)} AS mean_baseline_ic, {r('mean_delta', 5)} AS mean_delta, {r('delta_t_stat', 5)} AS delta_t_stat) FROM tri", **FOLD_CTES)),
    "random_init_gate": (lambda s, d: rounded(gates.random_init_gate(fold_results(s, d)), 5), oracle(
        f"SELECT * REPLACE ({r('mean_model_ic', 5)} AS mean_model_ic, {r('mean_random_ic', 5)} AS mean_random_ic, {r('mean_delta', 5)} AS mean_delta, {r('delta_t_stat', 5)} AS delta_t_stat) FROM rnd", **FOLD_CTES)),
    "overall_gate": (q_overall, OVERALL_SQL),
    "gate_report_json": (lambda s, d: gates.report(fold_results(s, d), fold_coverage(s, d)), None),
    "weighted_score_consistency": (q_consistency, CONS_SQL),
}
