"""Distributed pooling against one pass over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.plans import models as md


def one_pass(x, y):
    """Blocks [lo, hi, sum, n] of all rows in one list."""
    out = []
    for v in np.unique(x):
        b = [v, v, float(y[x == v].sum()), float((x == v).sum())]
        while out and out[-1][2] * b[3] >= b[2] * out[-1][3]:
            a = out.pop()
            b = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
        out.append(b)
    return out


def interpolated(blocks, x):
    xs = [v for b in blocks for v in ((b[0],) if b[0] == b[1] else (b[0], b[1]))]
    ps = [b[2] / b[3] for b in blocks for _ in ((0,) if b[0] == b[1] else (0, 1))]
    return np.interp(x, xs, ps)


def cases():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=900), 2)
    yield "noisy", x, (rng.random(900) < 1 / (1 + np.exp(-x))).astype(float)
    yield "falling", np.arange(300.0), (np.arange(300) < 150).astype(float)
    yield "rising", np.arange(300.0), (np.arange(300) >= 150).astype(float)
    yield "ties", np.repeat([1.0, 2.0, -0.0, 0.0], 50), rng.integers(0, 2, 200).astype(float)
    yield "one row", np.array([3.0]), np.array([1.0])


@pytest.mark.parametrize("name, x, y", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
@pytest.mark.parametrize("part_rows", [20, 500_000])
def test_pooling_equals_one_pass(spark, name, x, y, part_rows):
    train = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, None)], "x double, y double")
    got = md.isotonic_blocks(train.unionByName(odd), pred="x", win=F.col("y"), part_rows=part_rows).orderBy("lo").collect()
    want = one_pass(x, y)
    assert [[r.lo, r.hi, r.s, r.n] for r in got] == want
    if name == "noisy":
        asked = np.concatenate([np.random.default_rng(1).normal(size=300) * 2, x[:50]])
        test = spark.createDataFrame([(i, float(v)) for i, v in enumerate(asked)] + [(-1, None), (-2, float("nan"))], "i int, x double")
        probs = {r.i: r.prob for r in md.isotonic(train, test, pred="x", win=F.col("y"), part_rows=part_rows).collect()}
        assert probs.pop(-1) is None and probs.pop(-2) is None
        assert np.allclose([probs[i] for i in range(len(asked))], interpolated(want, asked), atol=1e-12)


def test_no_train_rows(spark):
    test = spark.createDataFrame([(1.0,)], "x double")
    assert md.isotonic(test.limit(0), test, pred="x", win=F.lit(True)).collect()[0].prob is None
