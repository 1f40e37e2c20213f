"""The derived market tables themselves, checked whole."""

from pyspark.sql import functions as F

from tickloom.catalog.oraclebase import oracle, r
from tickloom.sources import marketviews as mv


def rounded(df, digits: int = 6, **per_column: int):
    """Round doubles for comparison; +0.0 removes negative zero."""
    cols = [(F.round(F.col(c), per_column.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes]
    return df.select(*cols)


QUERIES = {
    "bars_all_scales": (lambda s, d: mv.bars(s, d), oracle("SELECT * FROM bars")),
    "trading_calendar": (lambda s, d: mv.calendar(s, d), oracle("SELECT trade_date FROM cal")),
    "symbol_master": (lambda s, d: mv.symbol_master(s, d), oracle("SELECT * FROM master")),
    "prediction_table": (lambda s, d: rounded(mv.predictions(s, d)), oracle(
        f"SELECT date, anchor_us, stock, horizon, {r('pred_lr')} pred_lr, {r('real_lr')} real_lr, {r('vol')} vol FROM preds")),
    "book_snapshots": (lambda s, d: rounded(mv.book(s, d)), oracle(
        "SELECT symbol, ts, round(ltp,6) ltp, volume, total_buy_qty, total_sell_qty, "
        + ", ".join(f"round({x}{i}_price,6) {x}{i}_price, {x}{i}_qty" for i in range(1, 6) for x in ("bid", "ask"))
        + ", round(spread_bps,6) spread_bps FROM book")),
}
