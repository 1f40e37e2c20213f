"""Small expression builders: arithmetic, price shapes, arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOG_FLOOR = 1e-8  # fixed value: floor under prices before a logarithm
EPS = 1e-9        # fixed value: guard in book ratios


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient, null on a zero or null denominator."""
    return F.try_divide(num, den)


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| relative to b, null where b is zero."""
    return F.try_divide(F.abs(a - b), F.nullif(b, F.lit(0.0)))


def finite(c: Column) -> Column:
    """Null for infinities, other values unchanged."""
    return F.when(F.abs(c) == F.lit(float("inf")), None).otherwise(c)


def wicks() -> dict[str, Column]:
    """Range, body and the wick shares of the range; shares are null on a flat bar."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    return {"bar_range": rng, "body": F.abs(c - o),
            "upper_wick_norm": F.when(rng > 0, (h - F.greatest(o, c)) / rng),
            "lower_wick_norm": F.when(rng > 0, (F.least(o, c) - lo) / rng)}


def untradeable() -> Column:
    """No volume, or price locked for the whole bar."""
    return (F.col("volume") == 0) | (F.col("high") == F.col("low"))


def microprice() -> Column:
    b, a = F.col("bid1_qty").cast("double"), F.col("ask1_qty").cast("double")
    return (b * F.col("ask1_price") + a * F.col("bid1_price")) / (b + a + EPS)


def book_pressure() -> Column:
    b, a = F.col("bid1_qty").cast("double"), F.col("ask1_qty").cast("double")
    return (b - a) / (b + a + EPS)


def queue_share() -> Column:
    b, a = F.col("bid1_qty").cast("double"), F.col("ask1_qty").cast("double")
    return b / (b + a + EPS)


def mid() -> Column:
    return (F.col("bid1_price") + F.col("ask1_price")) * 0.5


def log_mean_exp(r: Column) -> Column:
    """Log return of an equal-weight basket (aggregate expression)."""
    return F.log(F.avg(F.exp(r)))


def exp_mean(r: Column) -> Column:
    """Simple return at the mean log return (aggregate expression)."""
    return F.exp(F.avg(r)) - 1


def step_curve(curve: list[tuple[float, int]], r: Column) -> Column:
    """Value of the first breakpoint above ``r``; the last value past the end.

    A curve with only non-negative breakpoints is read at ``|r|``.
    """
    curve = sorted(curve)
    if not curve:
        return F.lit(None).cast("int")
    at = r if curve[0][0] < 0 else F.abs(r)
    out = F.when(at < curve[0][0], curve[0][1])
    for point, value in curve[1:]:
        out = out.when(at < point, value)
    return out.otherwise(curve[-1][1])


AMBIGUITY_RULES = ("stop_first", "target_first", "midbar", "proportional")


def ambiguous_return(rule: str, target: float, stop: float, high: Column, low: Column,
                     entry: Column) -> Column:
    """Return booked when one bar touches both barriers."""
    if rule == "target_first":
        return F.lit(float(target))
    if rule == "midbar":
        return F.lit((target - stop) / 2.0)
    if rule == "proportional":
        up, down = (high - entry) / entry, (entry - low) / entry
        p = down / (up + down)
        return F.when(up + down <= 0, 0.0).otherwise(p * target + (1 - p) * (-stop))
    return F.lit(-float(stop))


def trade_cost(notional: Column, fixed_per_leg: float, variable: float,
               override: float = 0.0) -> Column:
    """Round-trip cost as a fraction of notional."""
    if override > 0:
        return F.lit(float(override))
    return F.when(notional > 0, (2 * fixed_per_leg + variable * notional) / notional)


# ---- arrays ----------------------------------------------------------------

def masked_unit(values: Column, valid: Column) -> Column:
    """L2-normalised vector with invalid entries at zero."""
    masked = F.zip_with(values, valid, lambda v, ok: F.when(ok, v.cast("double")).otherwise(0.0))
    norm = F.sqrt(F.aggregate(masked, F.lit(0.0), lambda s, v: s + v * v))
    scale = F.when(norm > 1e-9, norm).otherwise(1.0)
    return F.transform(masked, lambda v: v / scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def array_std(a: Column, mean: Column) -> Column:
    """Population standard deviation around a given mean."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(a))


def patches(a: Column, length: int, stride: int) -> Column:
    """Overlapping slices of an array; a remainder shorter than ``length`` is dropped."""
    n = F.floor((F.size(a) - length) / F.lit(stride)).cast("int")
    return F.when(F.size(a) >= length, F.transform(
        F.sequence(F.lit(0), n), lambda i: F.slice(a, i * stride + 1, F.lit(length))))


def standardised(a: Column, mean: Column, std: Column, eps: float = 1e-5) -> Column:
    return F.transform(a, lambda v: (v - mean) / (std + eps))


def destandardised(a: Column, mean: Column, std: Column, eps: float = 1e-5) -> Column:
    return F.transform(a, lambda v: v * (std + eps) + mean)
