"""DuckDB text of the derived market tables; every oracle query starts from it."""

from __future__ import annotations

BASE = {
    "brand_days": """
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS d,
         arg_min(t.ticks, t.seq) / 100000.0 AS open,
         (max(t.ticks) + (CAST(sum(l_quantity) AS BIGINT) % 7) * 1000) / 100000.0 AS high,
         (min(t.ticks) - (CAST(sum(l_quantity) AS BIGINT) % 5) * 1000) / 100000.0 AS low,
         arg_max(t.ticks, t.seq) / 100000.0 AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, 10000000 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS ticks,
               (l_orderkey * 10 + l_linenumber)::HUGEINT * 1000000000
               + (10000000 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS seq
        FROM lineitem) t JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2""",
    "bars_day": """
  SELECT symbol, CAST(d AS TIMESTAMP) + INTERVAL 10 HOUR AS ts, 'day' AS scale,
         open, high, low, close, volume
  FROM brand_days WHERE isodow(d) < 6 AND dayofyear(d) % 41 <> 0""",
    "bars_5m": """
  SELECT symbol, CAST(sd AS TIMESTAMP) + INTERVAL 225 MINUTE + to_minutes(5 * (pos % 75)) AS ts,
         '5m' AS scale, open, high, low, close, volume
  FROM (SELECT *, CAST(DATE '1996-01-01' + CAST(7 * ((pos // 75) // 5) + (pos // 75) % 5 AS INTEGER) AS DATE) AS sd
        FROM (SELECT *, datediff('day', DATE '1995-01-02', d) AS pos FROM brand_days))
  WHERE isodow(sd) < 6 AND dayofyear(sd) % 41 <> 0""",
    "bars_15m": """
  SELECT symbol, s AS ts, '15m' AS scale, arg_min(open, ts) AS open, max(high) AS high,
         min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM (SELECT *, date_trunc('day', ts) + INTERVAL 225 MINUTE + to_minutes(15 *
          (datediff('minute', date_trunc('day', ts) + INTERVAL 225 MINUTE, ts) // 15)) AS s FROM bars_5m)
  GROUP BY symbol, s""",
    "bars_60m": """
  SELECT symbol, s AS ts, '60m' AS scale, arg_min(open, ts) AS open, max(high) AS high,
         min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM (SELECT *, date_trunc('day', ts) + INTERVAL 225 MINUTE + to_minutes(60 *
          (datediff('minute', date_trunc('day', ts) + INTERVAL 225 MINUTE, ts) // 60)) AS s FROM bars_5m)
  GROUP BY symbol, s""",
    "bars": """
  SELECT * FROM bars_5m UNION ALL SELECT * FROM bars_15m
  UNION ALL SELECT * FROM bars_60m UNION ALL SELECT * FROM bars_day""",
    "eff": """
  SELECT *, CASE scale WHEN 'day' THEN ts WHEN '5m' THEN ts + INTERVAL 5 MINUTE
    WHEN '15m' THEN ts + INTERVAL 15 MINUTE ELSE ts + INTERVAL 60 MINUTE END AS eff_close FROM bars""",
    "cal": """
  SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem)
  WHERE isodow(trade_date) < 6 AND dayofyear(trade_date) % 41 <> 0""",
    "master": """
  SELECT symbol, symbol_no,
         CASE WHEN symbol_no % 11 <> 0 THEN 'SEC' || (symbol_no % 5) END AS sector,
         CASE WHEN symbol_no % 11 <> 0 THEN 'IND' || (symbol_no % 3) END AS industry,
         'MAC' || (symbol_no % 2) AS macro_sector,
         CASE WHEN symbol_no % 7 <> 0 THEN 'IN' || lpad(CAST(symbol_no AS VARCHAR), 10, '0') END AS isin
  FROM (SELECT DISTINCT p_brand AS symbol, CAST(substr(p_brand, 7) AS INTEGER) AS symbol_no FROM part)""",
    "day_ret": """
  SELECT *, ln(close / lag(close, 1) OVER w) AS r1,
    -ln(close / lag(close, 1) OVER w) AS p1, -ln(close / lag(close, 3) OVER w) AS p3,
    -ln(close / lag(close, 5) OVER w) AS p5, ln(lead(close, 1) OVER w / close) AS y1,
    ln(lead(close, 3) OVER w / close) AS y3, ln(lead(close, 5) OVER w / close) AS y5
  FROM bars_day WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "day_vol": """
  SELECT *, CASE WHEN count(r1) OVER f = 10 THEN stddev_samp(r1) OVER f END AS vol FROM day_ret
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "preds": """
  SELECT CAST(ts AS DATE) AS date, epoch_us(ts) AS anchor_us, symbol AS stock, h.horizon AS horizon,
         h.p AS pred_lr, h.y AS real_lr, vol
  FROM (SELECT *, unnest([{'horizon': 'h1', 'p': p1, 'y': y1}, {'horizon': 'h3', 'p': p3, 'y': y3},
                          {'horizon': 'h5', 'p': p5, 'y': y5}]) AS h FROM day_vol)
  WHERE h.p IS NOT NULL AND h.y IS NOT NULL AND vol IS NOT NULL""",
    "book0": """
  SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, max(value) + 100 AS px,
         count(*) AS volume, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k
  FROM events GROUP BY 1, 2""",
    "book": """
  SELECT *, (ask1_price - bid1_price) / ((bid1_price + ask1_price) * 0.5) * 10000 AS spread_bps FROM (
  SELECT symbol, ts, px AS ltp, volume, k * 3 + 10 AS total_buy_qty, k * 2 + 15 AS total_sell_qty, """
    + ", ".join(
        f"CASE WHEN k % 13 <> 0 THEN px + (k % 3 + 1) / 100.0 * ({sign * i}.0) END AS {side}{i}_price, "
        f"CASE WHEN k % 13 <> 0 THEN {qty} END AS {side}{i}_qty"
        for i in range(1, 6)
        for side, sign, qty in (("bid", -1, f"(k * {i}) % 40 + 5"), ("ask", 1, f"(k + 7 * {i}) % 40 + 5")))
    + " FROM book0)",
    "sbook": """
  SELECT symbol, ts, px AS ltp, """
    + ", ".join(
        f"px + (k % 3 + 1) / 20.0 * ({sign * i}.0) AS {side}{i}_price, {qty} AS {side}{i}_qty"
        for i in range(1, 6)
        for side, sign, qty in (("bid", -1, f"(k * {i}) % 40 + 5"), ("ask", 1, f"(k + 7 * {i}) % 40 + 5")))
    + """ FROM (SELECT symbol, date_trunc('day', ts) + to_minutes(240 + n * 60) AS ts,
           CASE WHEN n = 0 THEN open ELSE close END AS px, volume + n * 11 AS k
           FROM bars_day, (VALUES (0), (1)) x(n))""",
    "prod": "SELECT * FROM bars_day WHERE dayofyear(ts) % 31 <> 0",
    "staged": """
  SELECT symbol, ts, scale, open * f AS open, high * f AS high, low * f AS low,
         close * f * CASE WHEN dayofyear(ts) % 17 = 0 THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END AS close, volume
  FROM (SELECT *, CASE WHEN CAST(substr(symbol, 7) AS INTEGER) % 5 = 1 AND ts < TIMESTAMP '1998-01-01'
                       THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM bars_day)
  WHERE dayofyear(ts) % 29 <> 0""",
}


def oracle(body: str, **ctes: str) -> str:
    """``WITH`` the base tables and the query's own ones, then ``body``.

    Only tables the text mentions (directly or through others) are included.
    """
    import re

    own = dict(ctes)
    need: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for name in BASE:
            if name != skip and name not in own and name not in need and re.search(rf"\b{name}\b", text):
                visit(BASE[name], name)
                if name not in need:
                    need.append(name)

    for text in own.values():
        visit(text)
    visit(body)
    parts = [f"{n} AS MATERIALIZED ({BASE[n]})" for n in need] + [f"{n} AS MATERIALIZED ({t})" for n, t in own.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r(expr: str, digits: int = 6) -> str:
    """Rounded with negative zero removed, as the Spark side does."""
    return f"(round({expr}, {digits}) + 0.0)"
