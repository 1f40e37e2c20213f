"""Maintenance chains run on stored copies of the test tables, each called twice: the second call must change nothing."""

from pyspark.sql import functions as F

from tickloom.catalog import upkeep as up
from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.plans import chains
from tickloom.session import shared_folder
from tickloom.sources import marketviews as mv, store, versioned

NEW_SYMBOL, END, DAYS = "Brand#11", "2001-06-30", 2000


def refreshed(s, d):
    root, ledger = shared_folder(s, "refresh"), shared_folder(s, "refresh-steps")
    d = mv.market(s, d)
    versioned.create(mv.production_bars(s, d).filter(F.col("symbol") != NEW_SYMBOL), root, files=16)
    tokens = mv.symbol_master(s, d).select("symbol", (F.col("symbol_no") + 1000).alias("token"))
    for _ in range(2):
        run = chains.refresh_cycle(up.payloads(s, d, mv.staged_bars), tokens, root, ledger, scales=("day",), floor="1995-01-01", end=END,
                                   overlap_days=DAYS, files=8)
    return run, root


def q_refresh(s, d):
    return rounded(versioned.open_table(s, refreshed(s, d)[1]))


def q_refresh_report(s, d):
    run, root = refreshed(s, d)
    steps = run.steps
    given = {"n_staged": steps["staged"]["rows"], "n_rejected": steps["staged"]["rejected"], "n_overlap": steps["overlap"]["n_overlap"],
             "n_diff": steps["overlap"]["n_diff"], "n_inserted": steps["merged"]["inserted"]}
    worst = F.round(F.lit(float(steps["overlap"]["max_rel_diff"])), 6).alias("max_rel_diff")
    stored = versioned.manifest(s, root).agg(F.sum("n_rows").alias("n_stored"))
    return stored.select("n_stored", *[F.lit(v).cast("long").alias(k) for k, v in given.items()], worst,
                         F.lit(len(versioned.versions(s, root))).cast("long").alias("n_versions"))


def q_calendar(s, d):
    """A refused refresh, then the same one allowed: what each found and the days stored after it."""
    root, ledger = shared_folder(s, "calendar"), shared_folder(s, "calendar-steps")
    cal = mv.calendar(s, d)
    store.publish(cal.filter((F.dayofmonth("trade_date") != 17) & (F.col("trade_date") < F.lit("2000-01-01").cast("date"))), root)
    fresh = cal.filter((F.dayofmonth("trade_date") != 9) & (F.col("trade_date") > F.lit("1996-01-01").cast("date")))
    out = None
    for allowed in (False, True):
        try:
            found, outcome = chains.calendar_refresh(fresh, root, ledger, allow_discrepancy=allowed).steps["published"]["inserted"], "merged"
        except chains.Discrepancy:
            found, outcome = 0, "refused"
        days = store.published(s, root).agg(F.count_distinct("trade_date").alias("n_days"), F.max("trade_date").alias("last_day")).select(
            F.lit(outcome).alias("outcome"), F.lit(found).cast("long").alias("n_inserted"), "n_days", "last_day")
        out = days if out is None else out.unionByName(days)
    return out


def repaired(s, d):
    root, ledger = shared_folder(s, "repair"), shared_folder(s, "repair-steps")
    d = mv.market(s, d)
    versioned.create(mv.production_bars(s, d), root, files=16)
    fresh = mv.staged_bars(s, d).filter(F.dayofyear("ts") % 17 != 0)
    for _ in range(2):
        chains.repair_cycle(fresh, root, ledger, files=8)
    return root, ledger


def q_repair(s, d):
    return rounded(versioned.open_table(s, repaired(s, d)[0]))


def q_applied(s, d):
    return chains.applied(s, repaired(s, d)[1]).select("symbol", F.round("ratio", 6).alias("ratio"), "cutoff_date_ist", "rows_affected")


REFRESH = {
    "kept": f"SELECT * FROM prod WHERE symbol <> '{NEW_SYMBOL}'",
    "win": f"""SELECT symbol, coalesce(t - INTERVAL {DAYS} DAY, TIMESTAMP '1995-01-01') AS lo FROM master LEFT JOIN (SELECT symbol, max(ts) AS t FROM kept GROUP BY 1) USING (symbol)""",
    "good": f"SELECT s.* FROM staged s JOIN win w USING (symbol) WHERE dayofyear(s.ts) % 19 <> 0 AND s.ts BETWEEN w.lo AND TIMESTAMP '{END}'",
    "fresh": "SELECT * FROM good ANTI JOIN kept USING (symbol, ts)",
}
PROPOSED = """SELECT symbol, round(median_ratio / m, 6) AS ratio, st AS cut FROM (SELECT *, lead(median_ratio) OVER w AS m, lead(n_rows) OVER w AS n, lead(start_date) OVER w AS st FROM sg
  WINDOW w AS (PARTITION BY symbol ORDER BY start_date)) WHERE st IS NOT NULL AND abs(median_ratio / m - 1) > 0.05 AND n_rows >= 3 AND n >= 3"""
REPAIR = {"rt": up.RT_SQL, "sg": up.SEG_SQL, "plan": PROPOSED}
PRICES = ("open", "high", "low", "close")

QUERIES = {
    "refresh_cycle": (q_refresh, oracle(" UNION ALL ".join(
        f"SELECT symbol, ts, scale, {', '.join(f'{r(c)} AS {c}' for c in PRICES)}, volume FROM {t}" for t in ("kept", "fresh")), **REFRESH)),
    "refresh_report": (q_refresh_report, oracle(f"""SELECT CAST((SELECT count(*) FROM kept) + (SELECT count(*) FROM fresh) AS BIGINT) AS n_stored, (SELECT count(*) FROM good) AS n_staged,
  (SELECT count(*) FROM staged WHERE dayofyear(ts) % 19 = 0) AS n_rejected, count(*) AS n_overlap, count(*) FILTER (g > 0.005) AS n_diff, {r('max(g)')} AS max_rel_diff,
  (SELECT count(*) FROM fresh) AS n_inserted, 2::BIGINT AS n_versions FROM (SELECT {up.GAP} AS g FROM good s JOIN kept p USING (symbol, ts))""", **REFRESH)),
    "calendar_refresh_abort": (q_calendar, oracle("""SELECT 'refused' AS outcome, 0::BIGINT AS n_inserted, count(*) AS n_days, max(trade_date) AS last_day FROM old
  UNION ALL SELECT 'merged', (SELECT count(*) FROM (SELECT * FROM rf ANTI JOIN old USING (trade_date))), count(*), max(trade_date) FROM (SELECT trade_date FROM old UNION SELECT trade_date FROM rf)""",
                                                  old="SELECT trade_date FROM cal WHERE day(trade_date) <> 17 AND trade_date < DATE '2000-01-01'",
                                                  rf="SELECT trade_date FROM cal WHERE day(trade_date) <> 9 AND trade_date > DATE '1996-01-01'")),
    "repair_cycle": (q_repair, oracle(f"""SELECT symbol, ts, scale, {', '.join(f"{r(f'{c} * f')} AS {c}" for c in PRICES)}, CASE WHEN f <> 1 THEN CAST(round(volume / f) AS BIGINT) ELSE volume END AS volume
  FROM (SELECT b.*, coalesce((SELECT product(ratio) FROM plan p WHERE p.symbol = b.symbol AND {up.IST} < cut), 1.0) AS f FROM prod b)""", **REPAIR)),
    "applied_adjustments": (q_applied, oracle(f"""SELECT p.symbol, ratio, cut AS cutoff_date_ist, (SELECT count(*) FROM prod b WHERE b.symbol = p.symbol AND {up.IST} < cut) AS rows_affected FROM plan p""", **REPAIR)),
}
