"""The intraday cross-sections against a count of bars by hand: no label, section or channel is left out, windows have full length."""

import numpy as np
import pandas as pd
from compare import connect, normal

import __spark_entry__ as entry
from tickloom.catalog.assembly import WIN
from tickloom.catalog.features import FAR
from tickloom.functions import clock
from tickloom.plans import features as ft
from tickloom.sources import marketviews as mv

SF_DIR = "/root/testdata/sf0.01"


def valid_labels(bars: pd.DataFrame) -> pd.DataFrame:
    """symbol, t and the 30 minute return over six unbroken slots without a halt, of the whole table."""
    out = []
    for symbol, b in bars.sort_values("ts").groupby("symbol"):
        halt = ((b.volume == 0) | (b.high == b.low)).astype(int)
        ahead = halt[::-1].rolling(6, min_periods=1).sum()[::-1].shift(-1)
        ok = (b.ts.shift(-6) - b.ts == pd.Timedelta(minutes=30)) & (ahead == 0)
        out.append(pd.DataFrame({"symbol": symbol, "t": b.ts + pd.Timedelta(minutes=5), "y": np.log(b.close.shift(-6) / b.close)})[ok])
    return pd.concat(out)


def expected(labels: pd.DataFrame, stores: dict, sizes: dict) -> dict:
    """(symbol, t) -> the windows' first close, last close and volume per scale; rows short of history have none."""
    out = {}
    for symbol, t in zip(labels.symbol, labels.t):
        mine = {k: s[symbol] for k, s in stores.items() if symbol in s}
        if len(mine) < len(sizes) or not (mine["5m"].closed == t).any():
            continue
        past = {k: s[s.closed < t] for k, s in mine.items()}
        if all(len(past[k]) >= n for k, n in sizes.items()) and len(past["5m"]) > 78:
            tail = {k: past[k].iloc[-n:] for k, n in sizes.items()}
            out[symbol, t] = {k: (np.float32(w.close.iloc[0]), np.float32(w.close.iloc[-1]), w.volume.sum()) for k, w in tail.items()}
    return out


def test_30m_sections_are_whole(spark):
    table = entry.queries()["cross_sections_30m"](spark, SF_DIR).toArrow()
    sql = connect(SF_DIR).sql(entry.oracle_sql()["cross_sections_30m"]).to_arrow_table()
    assert normal(table)[1] == normal(sql)[1]
    got = table.to_pandas()

    labels = valid_labels(mv.bars(spark, SF_DIR, "5m").toPandas())
    stores = {}
    for k in clock.SCALES:
        s = ft.feature_store(mv.bars(spark, SF_DIR, k), scale=k, as_of=FAR).select("symbol", "ts", "close", "volume").toPandas().sort_values("ts")
        stores[k] = dict(list(s.assign(closed=s.ts + pd.Timedelta(minutes=clock.SCALE_MINUTES.get(k, 0))).groupby("symbol")))
    y = labels.set_index(["symbol", "t"]).y
    for name, sizes in (("full", ft.WINDOW_BARS), ("short", WIN)):
        rows, want = got[got.windows == name], expected(labels, stores, sizes)
        assert want and set(zip(rows.symbol, rows.t)) == set(want) and len(rows) == len(want)
        for r in rows.itertuples():
            assert abs(r.y - y[r.symbol, r.t]) < 1e-6
            for k, (first, last, volume) in want[r.symbol, r.t].items():
                assert abs(getattr(r, f"first_{k}") - first) < 1e-5 and abs(getattr(r, f"last_{k}") - last) < 1e-5
                assert getattr(r, f"volume_{k}") == volume
        width = rows.groupby("t").symbol.transform("size")
        assert (rows.n_symbols == width).all() and (rows.wide == (width >= 10)).all() and (width == 1).any()
