import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    s = local_session(4, app="tests", memory="6g")
    yield s
    s.stop()


def make_bars(spark, symbols=("AA", "BB", "CC"), days=4, scale="5m", seed=3, drop=0.1):
    """Random-walk bars with gaps, flat bars and zero volumes."""
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        px = 100.0
        for d in range(days):
            day = dt.datetime(2024, 6, 3) + dt.timedelta(days=d)
            slots = 75 if scale == "5m" else 1
            for k in range(slots):
                px *= float(np.exp(rng.normal(0, 0.004)))
                if rng.random() < drop:
                    continue
                ts = day + (dt.timedelta(hours=3, minutes=45 + 5 * k) if scale == "5m" else dt.timedelta(hours=10))
                o, c = px * 0.999, px
                flat = rng.random() < 0.03
                h, lo = (px, px) if flat else (px * 1.002, px * 0.997)
                rows.append((s, ts, scale, o, h, lo, c, int(rng.integers(0, 50))))
    schema = "symbol string, ts timestamp, scale string, open double, high double, low double, close double, volume long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def bars_factory(spark):
    return lambda **kw: make_bars(spark, **kw)


def as_rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
