"""Ranks, order statistics and top-k.

Two families:

* **Cross-section** helpers work inside one instant or day.  Such a group holds
  at most one row per symbol, so an ordinary window is enough.
* **Pool** helpers work on groups that grow with the table (a horizon, a
  volatility bucket, everything).  They never sort a group in one task: rows
  collapse to distinct values first, these are range-partitioned by measured
  quantiles (so outliers and heavy tails leave the parts even), and
  positions are part offsets plus a running count inside the part.  The layout is
  stored once, so it is derived once and later steps agree on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import stored

#: parts to range-partition into; None leaves it to the session's shuffle partitions
PARTS: int | None = None


# ---------------------------------------------------------------- cross-section

def average_rank(value: Column | str, by: Sequence[str]) -> Column:
    """Rank with ties sharing their mean position (1-based) inside a cross-section."""
    v = F.col(value) if isinstance(value, str) else value
    return (F.rank().over(Window.partitionBy(*by).orderBy(v))
            + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / F.lit(2.0))


def ordinal_rank(value: str, by: Sequence[str], tie: str = "symbol") -> Column:
    """0-based position, ties resolved by ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value), F.col(tie))) - 1


def unit_rank(value: str, by: Sequence[str], tie: str = "symbol") -> Column:
    """Ordinal rank scaled to [0, 1]."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return ordinal_rank(value, by, tie) / F.greatest(n - 1, F.lit(1)).cast("double")


def share_below(value: str, by: Sequence[str]) -> Column:
    """Share of the cross-section strictly below each value."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return (F.rank().over(Window.partitionBy(*by).orderBy(F.col(value))) - 1) / n.cast("double")


def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, tie: str = "symbol",
          full_only: bool = False) -> DataFrame:
    """First ``k`` rows per cross-section by score; ties by ``tie``.

    ``full_only`` drops cross-sections narrower than ``k``.  The row-number filter
    lets Spark prune inside each task before the shuffle (window group limit).
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    if full_only:
        width = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_width")).filter(F.col("_width") >= k)
        df = df.join(width.drop("_width"), list(by), "left_semi")
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def top_share(df: DataFrame, by: Sequence[str], score: str, percent: float,
              tie: str = "symbol") -> DataFrame:
    """Best ``percent`` percent per cross-section, never fewer than one row."""
    w = Window.partitionBy(*by)
    return (df.withColumn("_pos", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie))))
            .withColumn("_keep", F.greatest(F.lit(1), F.floor(
                F.count(F.lit(1)).over(w) * percent / 100)))
            .filter(F.col("_pos") <= F.col("_keep")).drop("_pos", "_keep"))


def quantile_bucket(value: str, by: Sequence[str], bins: int) -> Column:
    """Interpolated quantile bins of a cross-section; a flat one goes to the middle bin."""
    w = Window.partitionBy(*by)
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = F.percentile(F.col(value), probs).over(w)
    flat = F.min(value).over(w) == F.max(value).over(w)
    return F.when(flat, F.lit(bins // 2)).otherwise(
        F.aggregate(edges, F.lit(0), lambda n, e: n + (e <= F.col(value)).cast("int")))


def first_per(df: DataFrame, keys: Sequence[str], order: str | Column, last: bool = False) -> DataFrame:
    """Earliest (or latest) row per key, as an aggregate: reduced before the shuffle."""
    pick = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.col(order) if isinstance(order, str) else order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


# ------------------------------------------------------------------------- pools

def layout(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Distinct values per group with counts and sums, stored in parts (``_part``) of even size and ascending order."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value)).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
    order = [*by, value]
    ranged = cells.repartitionByRange(PARTS, *order) if PARTS else cells.repartitionByRange(*order)
    return stored(ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "positions")


def value_positions(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct value) with its place in the group's order.

    Output: ``by``, ``value``, ``cnt`` rows at the value, ``before`` rows below it,
    ``total`` rows in the group, and for every entry of ``sums`` its sum at the
    value, below it (``before_*``) and over the group (``total_*``).  Null values are
    left out; NaN orders last.
    """
    if not by:
        return value_positions(df.withColumn("_all", F.lit(0)), ["_all"], value, sums).drop("_all")
    sums = sums or {}
    names, laid = ["cnt", *sums], layout(df, by, value, sums)
    # a part is a contiguous range, so there are at most as many rows as groups and parts together
    per_part = laid.groupBy(*by, "_part").agg(*[F.sum(n).alias(f"_p_{n}") for n in names])
    group = Window.partitionBy(*by)
    prior = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*by, "_part", *[
        F.coalesce(F.sum(f"_p_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in names], *[
        F.sum(f"_p_{n}").over(group).alias(f"total_{n}") for n in names])
    inside = (Window.partitionBy(*by, "_part").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = laid.join(offsets, [*by, "_part"]).withColumns({
        f"before_{n}": F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))
        for n in names})
    return (out.withColumnRenamed("before_cnt", "before").withColumnRenamed("total_cnt", "total")
            .select(*by, value, "cnt", "before", "total",
                    *[c for n in sums for c in (n, f"before_{n}", f"total_{n}")]))


def pool_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Average-tie rank inside arbitrarily large groups, added as ``name``."""
    pos = value_positions(df, by, value).select(
        *by, value, (F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)).alias(name))
    return df.join(pos, [*by, value])


def kth_smallest(df: DataFrame, by: Sequence[str], value: str,
                 k: dict[str, Column]) -> DataFrame:
    """Exact order statistics; ``k`` maps output name to a 1-based position built
    from the column ``total`` (rows in the group)."""
    pos = value_positions(df, by, value)
    hit = {n: (F.col("before") < e) & (e <= F.col("before") + F.col("cnt")) for n, e in k.items()}
    return pos.groupBy(*by).agg(*[F.max(F.when(c, F.col(value))).alias(n) for n, c in hit.items()])


def pool_quantiles(df: DataFrame, by: Sequence[str], value: str,
                   probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of arbitrarily large groups."""
    pos = value_positions(df, by, value)
    aggs = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        for side, idx in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("before") <= idx) & (idx < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_{name}_f"))
    out = pos.groupBy(*by).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
        for n in probs])
