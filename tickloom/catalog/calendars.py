"""Calendar, horizon-endpoint and fold queries."""

from pyspark.sql import functions as F

from tickloom.catalog.oraclebase import oracle
from tickloom.operators import tradingdays as td
from tickloom.sources import marketviews as mv

CIVIL = """SELECT CAST(d AS DATE) AS day, idx,
  min(idx) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_idx,
  max(idx) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_idx
  FROM (SELECT unnest(generate_series((SELECT min(trade_date) - 40 FROM cal)::TIMESTAMP,
        (SELECT max(trade_date) + 40 FROM cal)::TIMESTAMP, INTERVAL 1 DAY)) AS d) LEFT JOIN cal ON trade_date = CAST(d AS DATE)"""


def q_navigation(s, d):
    return td.navigation(mv.calendar(s, d))


def q_shift(s, d):
    cal = mv.calendar(s, d)
    out = None
    for n in (-5, -1, 0, 1, 3):
        part = td.shift_table(cal, n, as_of=F.lit("2000-06-30").cast("date")).withColumn("n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


SHIFT_SQL = oracle(" UNION ALL ".join(
    f"SELECT day, trade_date AS target, {n} AS n FROM civ JOIN cal ON cal.idx = {g}"
    + (" WHERE trade_date <= DATE '2000-06-30'" if n > 0 else "")
    for n, g in ((-5, "coalesce(civ.idx - 5, prev_idx - 4)"), (-1, "coalesce(civ.idx - 1, prev_idx)"), (0, "civ.idx"),
                 (1, "coalesce(civ.idx + 1, next_idx)"), (3, "coalesce(civ.idx + 3, next_idx + 2)"))), civ=CIVIL)


def q_far(s, d):
    """Dates up to eleven years beyond either end of the calendar."""
    cal = mv.calendar(s, d)
    days = mv.table(s, d, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 3 - 1).cast("int").alias("k")).select(
        F.date_add("d", F.col("k") * 4000).alias("day")).distinct()
    out = td.navigation(cal, dates=days, as_of=F.lit("2000-06-30").cast("date"))
    for n, name in ((-3, "three_back"), (2, "two_on")):
        moved = td.shift_table(cal, n, dates=days, as_of=F.lit("2000-06-30").cast("date"))
        out = out.join(moved.withColumnRenamed("target", name), "day", "left")
    return out


FAR_SQL = oracle("""SELECT day, k.idx IS NOT NULL AS is_trading, (SELECT min(trade_date) FROM known WHERE trade_date > day) AS next_day,
  (SELECT max(trade_date) FROM known WHERE trade_date < day) AS prev_day,
  (SELECT trade_date FROM cal c WHERE c.idx = (SELECT count(*) FROM cal x WHERE x.trade_date < day) - 3) AS three_back,
  (SELECT trade_date FROM known c WHERE c.idx = (SELECT count(*) FROM cal x WHERE x.trade_date <= day) + 1) AS two_on
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) + CAST((o_orderkey % 3 - 1) * 4000 AS INTEGER) AS day FROM orders) LEFT JOIN known k ON k.trade_date = day""",
                 known="SELECT * FROM cal WHERE trade_date <= DATE '2000-06-30'")


def q_count(s, d):
    pairs = mv.table(s, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("start")).withColumn(
        "end", F.date_add("start", F.when(F.col("o_orderkey") % 7 == 0, 4000).otherwise((F.col("o_orderkey") % 60)).cast("int")))
    return td.count_between(pairs, mv.calendar(s, d), "start", "end", "n_days")


COUNT_SQL = oracle("""SELECT o_orderkey, s AS start, e AS "end",
  (SELECT count(*) FROM cal WHERE trade_date <= e) - (SELECT count(*) FROM cal WHERE trade_date < s) AS n_days
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE)
    + CAST(CASE WHEN o_orderkey % 7 = 0 THEN 4000 ELSE o_orderkey % 60 END AS INTEGER) AS e FROM orders) o""")


def q_folds(s, d):
    return td.walk_forward(mv.calendar(s, d), first_test_end=F.lit("1996-09-01").cast("date"),
                           embargo=5, val=30, test=20, roll=20)


FOLDS_SQL = oracle("""SELECT 'fold_' || e.trade_date AS name, t0.trade_date AS train_start, te.trade_date AS train_end, vs.trade_date AS val_start,
  ve.trade_date AS val_end, ts.trade_date AS test_start, e.trade_date AS test_end, 5 AS embargo_days
  FROM cal e, (SELECT min(idx) AS f FROM cal WHERE trade_date >= DATE '1996-09-01') b, (SELECT * FROM cal WHERE idx = 0) t0, cal te, cal vs, cal ve, cal ts
  WHERE e.idx >= f AND (e.idx - f) % 20 = 0 AND ts.idx = e.idx - 19 AND ve.idx = ts.idx - 6
    AND vs.idx = ve.idx - 29 AND te.idx = vs.idx - 6""")


def q_assign(s, d):
    rows = mv.bars_day(s, d).select("symbol", F.to_date("ts").alias("date"), "volume")
    return td.assign_folds(rows, q_folds(s, d), "date").groupBy("name", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("volume").alias("volume"))


ASSIGN_SQL = FOLDS_SQL.replace("SELECT 'fold_'", "SELECT name, part, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, "
                               "CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT CAST(ts AS DATE) AS date, volume FROM bars_day) "
                               "JOIN (SELECT name, unnest([{'part': 'train', 'lo': train_start, 'hi': train_end}, {'part': 'val', 'lo': val_start, 'hi': val_end}, "
                               "{'part': 'test', 'lo': test_start, 'hi': test_end}], recursive := true) FROM (SELECT 'fold_'", 1) \
    + ")) ON date BETWEEN lo AND hi GROUP BY ALL"


def q_lag_pairs(s, d):
    """Anchor days paired with the day whose labels had realised three days before."""
    m = td.shift_table(mv.calendar(s, d), -3)
    return (mv.predictions(s, d).filter("horizon = 'h1'").select("date").distinct()
            .join(m, F.col("date") == F.col("day")).select("date", F.col("target").alias("train_date")))


def _with_bars_day(sql: str) -> str:
    from tickloom.catalog.oraclebase import BASE
    return sql.replace("WITH ", f"WITH brand_days AS ({BASE['brand_days']}), bars_day AS ({BASE['bars_day']}), ", 1)


QUERIES = {
    "calendar_navigation": (q_navigation, oracle(
        """SELECT day, civ.idx IS NOT NULL AS is_trading, a.trade_date AS next_day, b.trade_date AS prev_day
  FROM civ LEFT JOIN cal a ON a.idx = next_idx LEFT JOIN cal b ON b.idx = prev_idx""", civ=CIVIL)),
    "calendar_shift": (q_shift, SHIFT_SQL),
    "calendar_far_dates": (q_far, FAR_SQL),
    "trading_days_between": (q_count, COUNT_SQL),
    "walk_forward_folds": (q_folds, FOLDS_SQL),
    "fold_assignment": (q_assign, _with_bars_day(ASSIGN_SQL)),
    "label_lag_pairs": (q_lag_pairs, oracle("""SELECT DISTINCT date, b.trade_date AS train_date
  FROM preds JOIN cal a ON a.trade_date = date JOIN cal b ON b.idx = a.idx - 3 WHERE horizon = 'h1'""")),
}
