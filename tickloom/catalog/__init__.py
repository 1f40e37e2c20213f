"""Registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import functools
import importlib

MODULES = ("tables", "features", "labels", "calendars", "evaluation", "trading", "upkeep", "assembly", "storage", "chains")


def _entries() -> dict:
    out: dict = {}
    for m in MODULES:
        for name, pair in importlib.import_module(f"tickloom.catalog.{m}").QUERIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = pair
    return out


def _pinned(fn):
    from tickloom.session import prepare

    @functools.wraps(fn)
    def run(spark, sf_dir):
        return plain_times(fn(prepare(spark), sf_dir))

    return run


def plain_times(df):
    """UTC instants as zone-free timestamps, the form the oracle returns."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import TimestampType

    names = [f.name for f in df.schema if isinstance(f.dataType, TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names}) if names else df


def spark_queries() -> dict:
    return {n: _pinned(p[0]) for n, p in _entries().items()}


def oracle_queries() -> dict[str, str]:
    return {n: p[1] for n, p in _entries().items() if p[1]}
