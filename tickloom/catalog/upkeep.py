"""Scan, source, merge, corporate-action and audit queries."""

from pyspark.sql import functions as F

from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.functions import clock
from tickloom.plans import audit as au, maintenance as mn
from tickloom.sources import dimensions as dm, marketviews as mv, store, vendor

NO = "CAST(substr(symbol, 7) AS INTEGER)"
IST = "CAST(ts + INTERVAL 330 MINUTE AS DATE)"


def q_scan(s, d):
    return store.scan(mv.bars(s, d, "day", "60m"), as_of="1998-07-01 09:00:00", scale="day", start="1996-05-01", end="1999-01-01")


def q_closed(s, d):
    return clock.closed_by(mv.bars(s, d), clock.as_instant("1996-01-24 05:20:00")).withColumn("eff_close", clock.effective_close("scale", "ts"))


def q_cross(s, d):
    out = None
    for scale, ts, cap in (("day", "1997-03-04 10:00:00", "1997-03-04 10:00:00"), ("5m", "1996-01-10 05:00:00", "1996-01-10 05:05:00"),
                           ("15m", "1996-01-10 05:00:00", "1996-01-10 05:05:00")):
        x = store.cross_section(mv.bars(s, d, scale), scale=scale, ts=ts, as_of=cap)
        out = x if out is None else out.unionByName(x)
    return out


def q_reader(s, d):
    t = mv.predictions(s, d).select(F.timestamp_micros("anchor_us").alias("t"), "stock", "horizon", "vol")
    return rounded(store.read_pit(t, time="t", as_of="1999-06-01 10:00:00", min_time="1998-01-01"))


def q_missing(s, d):
    have = mv.bars_day(s, d).filter(F.col("ts") < F.lit("1995-01-04").cast("timestamp"))
    return store.missing_keys(mv.symbol_master(s, d).select("symbol"), have, ["symbol"])


# ---- vendor payloads rebuilt from the bars, some rows damaged
def payloads(s, d, bars=mv.bars_day):
    b = bars(s, d)
    epoch = F.unix_seconds(F.col("ts") - F.expr(clock.DAILY_SHIFT))
    text = lambda c: F.col(c).cast("string")
    close = F.when(F.dayofyear("ts") % 19 == 0, "bad").otherwise(text("close"))
    row = F.array(epoch.cast("string"), text("open"), text("high"), text("low"), close, text("volume"), F.lit(None).cast("string"))
    rows = b.groupBy("symbol", "scale", F.year("ts").cast("int").alias("chunk")).agg(F.collect_list(row).alias("candles"))
    flat = F.to_json(F.struct("candles"))
    nested = F.to_json(F.struct(F.struct("candles").alias("payload")))
    return rows.select("symbol", "scale", "chunk", F.when(F.col("chunk") % 2 == 0, flat).otherwise(nested).alias("payload"))


def q_vendor(s, d):
    return vendor.candles_from_arrays(payloads(s, d))[0]


def q_rejects(s, d):
    return vendor.candles_from_arrays(payloads(s, d))[1].groupBy("symbol", "chunk").agg(F.count(F.lit(1)).alias("n_rejected"))


def q_chunks(s, d):
    a = mv.production_bars(s, d).withColumn("chunk", F.lit(1))
    return vendor.merge_chunks(a.unionByName(mv.staged_bars(s, d).withColumn("chunk", F.lit(2))))


def q_gap(s, d):
    tokens = mv.symbol_master(s, d).select("symbol", (F.col("symbol_no") + 1000).alias("token"))
    last = au.last_bar(mv.bars(s, d, "day", "5m"))
    return vendor.gap_plan(tokens, last, ("5m", "15m", "day"), floor="1995-01-01", end="2001-10-31")


def q_lookup(s, d):
    p = mv.table(s, d, "part")
    dump = p.select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("exchange"), F.when(F.col("p_size") > 25, "CASH").otherwise("FNO").alias("segment"),
                    F.col("p_partkey").alias("token"))
    return vendor.instrument_lookup(dump, mv.symbol_master(s, d), exchange="PROMO", segment="CASH")


# ---- dimensions
def q_completeness(s, d):
    m = mv.symbol_master(s, d)
    built = dm.build_master(m.select("symbol"), m.select("symbol", "sector", "industry", "macro_sector"), m.select("symbol", "isin"))
    return dm.completeness(built, ("symbol", "sector", "macro_sector", *dm.PLACEHOLDERS))


def q_roster(s, d):
    m = dm.with_sector_ids(mv.symbol_master(s, d))
    return dm.universe(m, mv.bars_day(s, d)).join(m, "symbol").join(
        dm.roster(mv.bars_day(s, d), start="2001-10-01", end="1995-01-20"), "symbol", "left_semi").select("symbol", "sector", F.col("sector_id").cast("long").alias("sector_id"))


# ---- merges
def rogue_bars(s, d):
    b = mv.bars_day(s, d)
    hit = F.dayofyear("ts") % 23 == 0
    moved = b.withColumn("ts", F.when(hit, F.col("ts") - F.expr(clock.DAILY_SHIFT)).otherwise(F.col("ts")))
    return moved.unionByName(b.filter(hit & (F.dayofyear("ts") % 46 == 0)))


ROGUE = """SELECT symbol, CASE WHEN dayofyear(ts) % 23 = 0 THEN ts - INTERVAL 930 MINUTE ELSE ts END AS ts, scale, open, high, low, close, volume FROM bars_day
  UNION ALL SELECT symbol, ts, scale, open, high, low, close, volume FROM bars_day WHERE dayofyear(ts) % 46 = 0"""
RHIT = "hour(ts) = 18 AND minute(ts) = 30"


def q_caldiff(s, d):
    cal = mv.calendar(s, d)
    old = cal.filter((F.dayofmonth("trade_date") != 17) & (F.col("trade_date") < F.lit("2000-01-01").cast("date")))
    return mn.calendar_diff(old, cal.filter(F.dayofmonth("trade_date") != 9).filter(F.col("trade_date") > F.lit("1996-01-01").cast("date")))


PLAN = [dict(symbol="Brand#1", ratio=0.5, cutoff_date_ist="1997-06-02"), dict(symbol="Brand#1", ratio=0.2, cutoff_date_ist="1999-01-04"),
        dict(symbol="Brand#2", ratio=0.1, cutoff_date_ist=None), dict(symbol="Brand#9", ratio=2.0, cutoff_date_ist="1998-02-03")]
PLAN_SQL = "SELECT * FROM (VALUES ('Brand#1', 0.5::DOUBLE, DATE '1997-06-02'), ('Brand#1', 0.2::DOUBLE, DATE '1999-01-04'), ('Brand#2', 0.1::DOUBLE, NULL), ('Brand#9', 2.0::DOUBLE, DATE '1998-02-03')) p(symbol, ratio, cut)"


def q_adjust(s, d):
    return rounded(mn.apply_adjustments(mv.bars(s, d, "day", "60m"), dm.adjustments(s, PLAN)))


def q_preview(s, d):
    return mn.adjustment_preview(mv.bars(s, d, "day", "60m"), dm.adjustments(s, PLAN))


def q_pending(s, d):
    """Detected adjustments minus the ones a ledger already holds."""
    plan = proposals(s, d)
    done = dm.adjustments(s, [dict(symbol="Brand#1", ratio=2.0, cutoff_date_ist="1998-01-01")])
    return mn.pending(plan, done)


def segments(s, d):
    return mn.ratio_segments(mn.close_ratios(mv.staged_bars(s, d).filter(F.dayofyear("ts") % 17 != 0), mv.production_bars(s, d)), noise=0.005)


def proposals(s, d):
    return mn.propose(segments(s, d), dividend_band=0.05)


# clean two-level ratios make the greedy runs expressible as islands of equal ratio
SEG_SQL = """SELECT symbol, min(dt) AS start_date, max(dt) AS end_date, count(*) AS n_rows, ratio AS median_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - row_number() OVER (PARTITION BY symbol, ratio ORDER BY dt) AS g FROM rt) GROUP BY symbol, ratio, g"""
RT_SQL = f"""SELECT s.symbol, CAST(s.ts + INTERVAL 330 MINUTE AS DATE) AS dt, round(s.close / p.close, 6) AS ratio FROM staged s JOIN prod p USING (symbol, ts) WHERE dayofyear(s.ts) % 17 <> 0"""
GAP = "abs(s.close - p.close) / nullif(p.close, 0)"


def q_freshness(s, d):
    return au.freshness(mv.bars(s, d), mv.calendar(s, d), today=F.lit("2001-09-28").cast("date"))


def q_upsert(s, d):
    return rounded(mn.merge_update(mv.production_bars(s, d), mv.staged_bars(s, d), threshold=0.01))


QUERIES = {
    "pit_bar_scan": (q_scan, oracle("SELECT * FROM bars_day WHERE ts <= TIMESTAMP '1998-07-01 09:00:00' AND ts >= TIMESTAMP '1996-05-01' AND ts <= TIMESTAMP '1999-01-01'")),
    "closed_bars": (q_closed, oracle("SELECT * FROM eff WHERE eff_close <= TIMESTAMP '1996-01-24 05:20:00'")),
    "bar_cross_sections": (q_cross, oracle("SELECT * FROM bars_day WHERE ts = TIMESTAMP '1997-03-04 10:00:00' UNION ALL SELECT * FROM bars_5m WHERE ts = TIMESTAMP '1996-01-10 05:00:00'")),
    "derived_table_reader": (q_reader, oracle(f"""SELECT make_timestamp(anchor_us) AS t, stock, horizon, {r('vol')} AS vol FROM preds
  WHERE make_timestamp(anchor_us) < TIMESTAMP '1999-06-01 10:00:00' AND make_timestamp(anchor_us) >= TIMESTAMP '1998-01-01'""")),
    "series_profile": (lambda s, d: store.profile(mv.bars(s, d)), oracle(
        "SELECT scale, symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY ALL")),
    "missing_symbols": (q_missing, oracle("SELECT symbol FROM master WHERE symbol NOT IN (SELECT symbol FROM bars_day WHERE ts < TIMESTAMP '1995-01-04')")),
    "bar_contract_check": (lambda s, d: store.check_bars(mv.bars(s, d)), oracle(
        """SELECT CAST(sum(n) AS BIGINT) AS n_rows, 0::BIGINT AS unknown_scale, 0::BIGINT AS unsafe_symbol, CAST(sum(n - 1) AS BIGINT) AS repeated_keys, 0::BIGINT AS null_keys
  FROM (SELECT symbol, scale, ts, count(*) AS n FROM bars GROUP BY ALL)""")),
    "vendor_candles": (q_vendor, oracle("SELECT symbol, scale, CAST(year(ts) AS INTEGER) AS chunk, ts, open, high, low, close, volume FROM bars_day WHERE dayofyear(ts) % 19 <> 0")),
    "vendor_rejects": (q_rejects, oracle("SELECT symbol, CAST(year(ts) AS INTEGER) AS chunk, count(*) AS n_rejected FROM bars_day WHERE dayofyear(ts) % 19 = 0 GROUP BY ALL")),
    "vendor_chunk_merge": (q_chunks, oracle("SELECT * FROM staged UNION ALL SELECT * FROM prod ANTI JOIN staged USING (symbol, ts)")),
    "gap_plan": (q_gap, oracle("""SELECT symbol, token, scale, last_ts, coalesce(last_ts - INTERVAL 5 DAY, TIMESTAMP '1995-01-01') AS "start", TIMESTAMP '2001-10-31' AS "end"
  FROM (SELECT symbol, symbol_no + 1000 AS token, sc AS scale FROM master, (VALUES ('5m'), ('15m'), ('day')) z(sc)) LEFT JOIN
  (SELECT symbol, scale, max(ts) AS last_ts FROM (SELECT * FROM bars_day UNION ALL SELECT * FROM bars_5m) GROUP BY ALL) USING (symbol, scale)
  WHERE coalesce(last_ts - INTERVAL 5 DAY, TIMESTAMP '1995-01-01') < TIMESTAMP '2001-10-31'""")),
    "instrument_lookup": (q_lookup, oracle("""SELECT symbol, token, token IS NOT NULL AS found FROM (SELECT DISTINCT symbol FROM master)
  LEFT JOIN (SELECT p_brand AS symbol, min(p_partkey) AS token FROM part WHERE p_type = 'PROMO' AND p_size > 25 GROUP BY 1) USING (symbol)""")),
    "master_completeness": (q_completeness, oracle("""SELECT unnest([{'column': 'symbol', 'populated': true}, {'column': 'sector', 'populated': count(sector) = count(*)}, {'column': 'macro_sector', 'populated': true},
  {'column': 'isin', 'populated': count(isin) = count(*)}, """ + ", ".join(f"{{'column': '{c}', 'populated': false}}" for c in dm.PLACEHOLDERS[1:]) + "], recursive := true) FROM master")),
    "sector_members": (lambda s, d: dm.in_group(mv.symbol_master(s, d), "sector", "sec3").select("symbol"), oracle("SELECT symbol FROM master WHERE lower(sector) = 'sec3'")),
    "universe_roster": (q_roster, oracle("""SELECT symbol, sector, dense_rank() OVER (ORDER BY coalesce(sector, '_no_sector')) - 1 AS sector_id FROM master
  WHERE symbol IN (SELECT symbol FROM bars_day GROUP BY symbol HAVING max(ts) >= TIMESTAMP '2001-10-01' AND min(ts) <= TIMESTAMP '1995-01-20')""")),
    "insert_missing": (lambda s, d: mn.insert_missing(mv.production_bars(s, d), mv.staged_bars(s, d)), oracle("SELECT * FROM staged ANTI JOIN prod USING (symbol, ts)")),
    "merge_update": (q_upsert, oracle("SELECT symbol, ts, scale, " + ", ".join(f"{r(f'CASE WHEN pc IS NULL OR dv THEN s{c} ELSE p{c} END')} AS {c}" for c in ("open", "high", "low", "close"))
                                      + f""", CASE WHEN pc IS NULL OR dv THEN svolume ELSE pvolume END AS volume, CASE WHEN pc IS NULL THEN 'inserted' WHEN dv THEN 'updated' ELSE 'kept' END AS action FROM (
  SELECT symbol, ts, 'day' AS scale, p.close AS pc, coalesce({GAP} > 0.01, false) AS dv, """ + ", ".join(f"s.{c} AS s{c}, p.{c} AS p{c}" for c in mn.VALUES) + " FROM prod p FULL JOIN staged s USING (symbol, ts))")),
    "overlap_check": (lambda s, d: rounded(mn.overlap_check(mv.production_bars(s, d), mv.staged_bars(s, d), tolerance=0.01)), oracle(
        f"SELECT count(*) AS n_overlap, count(*) FILTER (g > 0.01) AS n_diff, {r('max(g)')} AS max_rel_diff, {r('quantile_cont(g, 0.95)')} AS p95_rel_diff FROM (SELECT {GAP} AS g FROM staged s JOIN prod p USING (symbol, ts))")),
    "diff_summary": (lambda s, d: mn.diff_summary(mv.production_bars(s, d), mv.staged_bars(s, d), threshold=0.01), oracle(
        f"""SELECT scale, count(*) AS n_staged, count(*) FILTER (pc IS NULL) AS n_missing_in_prod, count(*) FILTER (g > 0.01) AS n_diverge, count(*) FILTER (g <= 0.01) AS n_match
  FROM (SELECT s.scale, p.close AS pc, {GAP} AS g FROM staged s LEFT JOIN prod p USING (symbol, ts)) GROUP BY scale""")),
    "rogue_summary": (lambda s, d: mn.rogue_summary(rogue_bars(s, d)), oracle(
        f"SELECT count(*) AS n_rogue, count(DISTINCT symbol) AS n_symbols, min({IST}) AS first_date, max({IST}) AS last_date FROM rg WHERE {RHIT}", rg=ROGUE)),
    "rogue_sample": (lambda s, d: mn.rogue_sample(rogue_bars(s, d)), oracle(f"SELECT symbol, {IST} AS date, ts, close FROM rg WHERE {RHIT} ORDER BY symbol, ts LIMIT 5", rg=ROGUE)),
    "rogue_collisions": (lambda s, d: mn.shift_collisions(rogue_bars(s, d)), oracle(
        f"SELECT count(*) AS n_collisions FROM (SELECT symbol, ts + INTERVAL 930 MINUTE AS ts FROM rg WHERE {RHIT}) JOIN rg USING (symbol, ts)", rg=ROGUE)),
    "rogue_shifted": (lambda s, d: mn.shift_rogue(rogue_bars(s, d)), oracle(f"SELECT * REPLACE (CASE WHEN {RHIT} THEN ts + INTERVAL 930 MINUTE ELSE ts END AS ts) FROM rg", rg=ROGUE)),
    "calendar_diff": (q_caldiff, oracle("""SELECT trade_date, 'new' AS kind FROM rf ANTI JOIN ol USING (trade_date) UNION ALL SELECT trade_date, 'discrepancy' FROM ol ANTI JOIN rf USING (trade_date)
  WHERE trade_date BETWEEN greatest((SELECT min(trade_date) FROM ol), (SELECT min(trade_date) FROM rf)) AND least((SELECT max(trade_date) FROM ol), (SELECT max(trade_date) FROM rf))""",
                                        ol="SELECT trade_date FROM cal WHERE day(trade_date) <> 17 AND trade_date < DATE '2000-01-01'", rf="SELECT trade_date FROM cal WHERE day(trade_date) <> 9 AND trade_date > DATE '1996-01-01'")),
    "close_ratios": (lambda s, d: rounded(mn.close_ratios(mv.staged_bars(s, d), mv.production_bars(s, d))), oracle(
        f"SELECT s.symbol, CAST(s.ts + INTERVAL 330 MINUTE AS DATE) AS dt, {r('s.close / p.close')} AS ratio FROM staged s JOIN prod p USING (symbol, ts)")),
    "ratio_segments": (segments, oracle(SEG_SQL, rt=RT_SQL)),
    "readjustment_proposals": (lambda s, d: proposals(s, d).select("symbol", "ratio", "cutoff_date_ist"), oracle(
        """SELECT symbol, round(median_ratio / m, 6) AS ratio, st AS cutoff_date_ist FROM (SELECT *, lead(median_ratio) OVER w AS m, lead(n_rows) OVER w AS n, lead(start_date) OVER w AS st FROM sg
  WINDOW w AS (PARTITION BY symbol ORDER BY start_date)) WHERE st IS NOT NULL AND abs(median_ratio / m - 1) > 0.05 AND n_rows >= 3 AND n >= 3""", rt=RT_SQL, sg=SEG_SQL)),
    "pending_readjustments": (lambda s, d: q_pending(s, d).select("symbol", "ratio", "cutoff_date_ist"), oracle(
        """SELECT symbol, round(median_ratio / m, 6) AS ratio, st AS cutoff_date_ist FROM (SELECT *, lead(median_ratio) OVER w AS m, lead(n_rows) OVER w AS n, lead(start_date) OVER w AS st FROM sg
  WINDOW w AS (PARTITION BY symbol ORDER BY start_date)) WHERE st IS NOT NULL AND abs(median_ratio / m - 1) > 0.05 AND n_rows >= 3 AND n >= 3
  AND NOT (symbol = 'Brand#1' AND st = DATE '1998-01-01' AND round(median_ratio / m, 6) = 2)""", rt=RT_SQL, sg=SEG_SQL)),
    "adjustment_preview": (q_preview, oracle(f"""SELECT b.symbol, ratio, cut AS cutoff_date_ist, count(*) AS n_rows, count(DISTINCT scale) AS n_scales, count(DISTINCT {IST}) AS n_dates, min({IST}) AS first_date, max({IST}) AS last_date
  FROM (SELECT * FROM bars_day UNION ALL SELECT * FROM bars_60m) b JOIN plan p ON p.symbol = b.symbol AND (cut IS NULL OR {IST} < cut) GROUP BY ALL""", plan=PLAN_SQL)),
    "adjusted_bars": (q_adjust, oracle(f"""SELECT symbol, ts, scale, {r('open * f')} AS open, {r('high * f')} AS high, {r('low * f')} AS low, {r('close * f')} AS close,
  CASE WHEN f <> 1 THEN CAST(round(volume / f) AS BIGINT) ELSE volume END AS volume FROM (SELECT b.*, coalesce((SELECT product(ratio) FROM plan p WHERE p.symbol = b.symbol AND (cut IS NULL OR {IST} < cut)), 1.0) AS f
  FROM (SELECT * FROM bars_day UNION ALL SELECT * FROM bars_60m) b)""", plan=PLAN_SQL)),
    "last_bar_per_series": (lambda s, d: au.last_bar(mv.bars(s, d)), oracle("SELECT symbol, scale, max(ts) AS last_ts FROM bars GROUP BY ALL")),
    "freshness": (q_freshness, oracle("""SELECT 'calendar' AS "check", datediff('day', DATE '2001-09-28', max(trade_date)) AS got, 30::BIGINT AS "limit",
  CASE WHEN datediff('day', DATE '2001-09-28', max(trade_date)) >= 30 THEN 'OK' ELSE 'STALE' END AS status FROM cal
  UNION ALL SELECT 'bars_' || scale, n, 5, CASE WHEN n <= 5 THEN 'OK' ELSE 'STALE' END FROM (SELECT scale, (SELECT count(*) FROM cal WHERE trade_date > CAST(m AS DATE) AND trade_date <= DATE '2001-09-28') AS n
  FROM (SELECT scale, max(ts) AS m FROM bars GROUP BY scale))""")),
    "table_profile": (lambda s, d: au.profile(mv.bars(s, d)), oracle(
        "SELECT scale, CAST(year(ts) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(ts) AS ts_min, max(ts) AS ts_max FROM bars GROUP BY ALL")),
    "staleness_buckets": (lambda s, d: au.staleness(mv.bars_day(s, d), (1, 3, 5, 30)), oracle(
        "SELECT " + ", ".join(f"count(*) FILTER (datediff('day', t, (SELECT max(ts) FROM bars_day)) > {n}) AS stale_{n}d" for n in (1, 3, 5, 30))
        + ", count(*) AS total_symbols FROM (SELECT symbol, max(ts) AS t FROM bars_day GROUP BY 1)")),
    "jump_probe": (lambda s, d: rounded(au.jump_probe(mv.bars_day(s, d))), oracle(f"""SELECT count(*) FILTER (x > 0.3) AS n_over_30pct, count(*) FILTER (x > 0.5) AS n_over_50pct, count(*) AS n_returns,
  {r('quantile_cont(x, 0.995)')} AS abs_ret_p99_5, {r('quantile_cont(x, 0.999)')} AS abs_ret_p99_9 FROM (SELECT abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS x FROM bars_day) WHERE x IS NOT NULL""")),
    "book_census": (lambda s, d: au.book_census(mv.book(s, d)), oracle(f"""SELECT count(*) AS symbol_days, count(*) FILTER (k > 0) AS symbol_days_with_book, CAST(sum(k) AS BIGINT) AS n_with_book, CAST(sum(n - k) AS BIGINT) AS n_without_book,
  CAST(sum(n) AS BIGINT) AS n_total FROM (SELECT symbol, {IST} AS dd, count(*) AS n, count(bid1_price) AS k FROM book GROUP BY ALL)""")),
    "book_daily": (lambda s, d: au.book_daily(mv.book(s, d)), oracle(f"SELECT {IST} AS date, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM book GROUP BY 1")),
    "book_levels": (lambda s, d: au.book_levels(mv.book(s, d)), oracle(" UNION ALL ".join(
        f"SELECT {i} AS level, '{x}' AS side, count({x}{i}_price) AS n_rows FROM book" for i in range(1, 6) for x in ("bid", "ask")))),
    "snapshot_cadence": (lambda s, d: rounded(au.cadence(mv.book(s, d))), oracle(f"""SELECT {r('quantile_cont(x, 0.05)')} AS p05, {r('quantile_cont(x, 0.5)')} AS p50, {r('quantile_cont(x, 0.95)')} AS p95
  FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol, {IST} ORDER BY ts)) / 1e6 AS x FROM book) WHERE x IS NOT NULL""")),
    "scale_coverage": (lambda s, d: au.coverage(mv.bars(s, d)), oracle(
        "SELECT scale, count(DISTINCT symbol) AS n_series, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars) AS complete FROM bars GROUP BY scale")),
    "clock_alignment": (lambda s, d: au.alignment(mv.bars(s, d).unionByName(rogue_bars(s, d))), oracle(
        f"SELECT scale, count(*) AS n_rows, count(*) FILTER (scale = 'day' AND hour(ts) <> 10) AS n_off_clock FROM (SELECT * FROM bars UNION ALL SELECT * FROM rg) GROUP BY scale", rg=ROGUE)),
    "sector_counts": (lambda s, d: au.sectors(mv.symbol_master(s, d)), oracle("SELECT coalesce(sector, '_no_sector') AS sector, count(*) AS n_symbols, count(isin) AS n_with_isin FROM master GROUP BY 1")),
    "traded_value": (lambda s, d: rounded(au.traded_value(mv.bars_day(s, d), days=1, top=5), 3), oracle(f"""SELECT symbol, {r('v', 3)} AS median_value, t AS last_ts, datediff('day', t, (SELECT max(ts) FROM bars_day)) > 1 AS stale, e AS "end" FROM (
  (SELECT *, 'top' AS e FROM m ORDER BY v DESC, symbol LIMIT 5) UNION ALL (SELECT *, 'bottom' AS e FROM m ORDER BY v, symbol LIMIT 5))""",
                                                                                                    m="SELECT symbol, quantile_cont(close * volume, 0.5) AS v, max(ts) AS t FROM bars_day GROUP BY 1")),
    "audit_report": (lambda s, d: au.report(mv.bars(s, d), mv.book(s, d)), None),
}
