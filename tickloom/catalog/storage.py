"""Storage queries: stored tables are written, rewritten and read back, then compared with the source."""

from pyspark.sql import functions as F

from tickloom.catalog.oraclebase import oracle, r
from tickloom.catalog.tables import rounded
from tickloom.plans import audit
from tickloom.session import shared_folder
from tickloom.sources import marketviews as mv
from tickloom.sources import store, versioned


def day_bars(s, d):
    return mv.bars(s, d).filter("scale = 'day'")


def q_rewrite(s, d):
    root, bars = shared_folder(s, "rewrite"), day_bars(s, d)
    store.write_bars(bars, root)
    late = bars.filter("symbol = 'Brand#11' AND year(ts) > 1997").withColumn("close", F.col("close") * 2)
    store.write_bars(late, root, only=("day", "Brand#11"))
    return store.read_bars(s, root, as_of="2100-01-01")


def q_published(s, d):
    root, bars = shared_folder(s, "published"), day_bars(s, d)
    store.publish(bars, root)
    store.publish(bars, root, keep=F.col("volume") > 30)
    return store.published(s, root)


def q_view(s, d):
    """A persistent view over the newest published version."""
    import uuid

    root, bars = shared_folder(s, "viewed"), day_bars(s, d)
    path = store.publish(bars, root)
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    return versioned.create_view(s, f"bars_view_{uuid.uuid4().hex}", path, kinds)


def q_touched_merge(s, d):
    """Staged rows merged into the stored production table, file range by file range, in two merges."""
    root = shared_folder(s, "merged")
    versioned.create(mv.production_bars(s, d), root, files=16)
    staged = mv.staged_bars(s, d)
    for part in ("symbol < 'Brand#3'", "symbol >= 'Brand#3'"):
        versioned.merge(staged.filter(part), root, versioned.replaced_by(0.01), files=8)
    out = versioned.open_table(s, root)
    return rounded(out)


def q_touched_files(s, d):
    """Rows that a late correction of one symbol and year reads, against the rows of the table's files it leaves alone."""
    root = shared_folder(s, "touched")
    versioned.create(day_bars(s, d), root, files=32)
    late = day_bars(s, d).filter("symbol = 'Brand#23' AND year(ts) = 1997").withColumn("close", F.col("close") * 2)
    files = versioned.manifest(s, root, versioned.versions(s, root)[-1])
    hit = versioned.touched(files, late).withColumn("hit", F.lit(True))
    per = files.join(hit, "path", "left")
    versioned.merge(late, root, versioned.replaced_by(0.01), files=4)
    rows = versioned.open_table(s, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("close"), 3).alias("closes"))
    share = per.agg((F.sum(F.when(F.col("hit"), F.col("n_rows"))) * 8 < F.sum("n_rows")).alias("reads_under_an_eighth"))
    return rows.join(share)


def q_missing(s, d):
    """A table that is not there reads as empty beside one that is."""
    root = shared_folder(s, "absent")
    return day_bars(s, d).groupBy("symbol").count().withColumnRenamed("count", "n").join(
        store.open_bars(s, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_stored")), "symbol", "left").select(
        "symbol", "n", F.coalesce("n_stored", F.lit(0)).alias("n_stored"))


def q_stale(s, d):
    bars, cal = mv.bars(s, d).filter("ts < '1998-01-01'"), mv.calendar(s, d)
    return audit.freshness(bars, cal, today=F.lit("2024-06-20").cast("date")).select("check", "got", "limit", "status")


STALE_SQL = oracle("""
SELECT 'calendar' AS "check", datediff('day', DATE '2024-06-20', (SELECT max(trade_date) FROM cal)) AS got, CAST(30 AS BIGINT) AS "limit",
  CASE WHEN datediff('day', DATE '2024-06-20', (SELECT max(trade_date) FROM cal)) >= 30 THEN 'OK' ELSE 'STALE' END AS status
UNION ALL
SELECT 'bars_' || scale, n, CAST(5 AS BIGINT), CASE WHEN n <= 5 THEN 'OK' ELSE 'STALE' END FROM (
  SELECT scale, (SELECT count(*) FROM cal WHERE trade_date <= DATE '2024-06-20') - (SELECT count(*) FROM cal WHERE trade_date <= last) AS n
  FROM (SELECT scale, CAST(max(ts) AS DATE) AS last FROM bars WHERE ts < TIMESTAMP '1998-01-01' GROUP BY scale))""")

QUERIES = {
    "store_rewrite_one_symbol": (q_rewrite, oracle("""
SELECT * FROM bars_day WHERE symbol <> 'Brand#11'
UNION ALL SELECT symbol, ts, scale, open, high, low, close * 2, volume FROM bars_day WHERE symbol = 'Brand#11' AND year(ts) > 1997""")),
    "published_latest": (q_published, oracle("SELECT * FROM bars_day WHERE volume > 30")),
    "view_over_published": (q_view, oracle("SELECT * FROM bars_day")),
    "touched_range_merge": (q_touched_merge, oracle("SELECT symbol, ts, scale, " + ", ".join(
        f"{r(f'CASE WHEN p.symbol IS NULL OR abs(s.close - p.close) / nullif(abs(p.close), 0) > 0.01 THEN s.{c} ELSE p.{c} END')} AS {c}" for c in ("open", "high", "low", "close"))
        + ", CASE WHEN p.symbol IS NULL OR abs(s.close - p.close) / nullif(abs(p.close), 0) > 0.01 THEN s.volume ELSE p.volume END AS volume FROM prod p FULL JOIN staged s USING (symbol, ts, scale)")),
    "touched_range_files": (q_touched_files, oracle("""SELECT symbol, count(*) AS n_rows, round(sum(CASE WHEN symbol = 'Brand#23' AND year(ts) = 1997 THEN close * 2 ELSE close END), 3) AS closes,
  true AS reads_under_an_eighth FROM bars_day GROUP BY symbol""")),
    "read_missing_table": (q_missing, oracle("SELECT symbol, count(*) AS n, CAST(0 AS BIGINT) AS n_stored FROM bars_day GROUP BY symbol")),
    "staleness_far_past": (q_stale, STALE_SQL),
}
