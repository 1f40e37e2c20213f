"""A cross-section of registered queries against their SQL oracle (all of them: tests/compare.py)."""

import pytest
from compare import check, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("flagship_rank_ic", "features_day", "forward_labels", "triple_barrier_labels", "calendar_shift", "conformal_cells", "wide_predictions",
         "first_touch_exits", "rolling_best_config", "fill_audit", "merge_update", "adjusted_bars", "asof_strict", "book_features", "jump_probe")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert check(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 130
