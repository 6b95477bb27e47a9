"""Scalar money / score arithmetic (SCL-1, SCL-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def request_cost(input_tokens, output_tokens, input_per_million, output_per_million, digits: int = 8) -> Column:
    """SCL-1: in/1e6 * p_in + out/1e6 * p_out, rounded to 8 places; missing prices count as 0."""
    p_in = F.coalesce(_c(input_per_million), F.lit(0.0))
    p_out = F.coalesce(_c(output_per_million), F.lit(0.0))
    cost = (_c(input_tokens) / F.lit(1_000_000.0)) * p_in + (_c(output_tokens) / F.lit(1_000_000.0)) * p_out
    return F.round(cost, digits)


def usd_exact(cost) -> Column:
    """A request cost (<= 8 decimals) as exact integer units of 1e-8 USD, so sums are order-free."""
    return F.round(_c(cost) * F.lit(100_000_000.0)).cast("bigint")


def usd_round(total_units, digits: int = 6) -> Column:
    """Integer 1e-8 units -> USD rounded half-up (away from zero) to ``digits`` places, as DOUBLE."""
    step = 10 ** (8 - digits)
    t = _c(total_units)
    half = F.lit(step // 2)
    mag = F.abs(t) + half
    q = ((mag - F.pmod(mag, F.lit(step))) / F.lit(step)).cast("bigint")  # exact integer division
    return (F.signum(t) * q).cast("double") / F.lit(float(10 ** digits))


def usd_sum(cost, digits: int = 6) -> Column:
    """Exact sum of request costs, rounded half-up to ``digits`` places, as DOUBLE."""
    return usd_round(F.sum(usd_exact(cost)), digits)


def clamp_invert(score, invert) -> Column:
    """SCL-16: clamp to [0, 1], then 1 - x when the rule inverts the metric."""
    q = F.least(F.greatest(_c(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when(F.coalesce(_c(invert), F.lit(False)), F.lit(1.0) - q).otherwise(q)
