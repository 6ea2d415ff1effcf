"""Randomness keyed by row.

Every random number is a function of a seed, a tag and the keys of the row it belongs to. Retried tasks, other
partitionings and lost executors therefore give the same rows, and SQL can reproduce each draw.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(2**48)


def digest(seed: int, tag: str, *parts: Column | str) -> Column:
    """32 hex characters for one (seed, tag, keys)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[c.cast("string") for c in cols]))


def uniform(hexed: Column, slot: int = 0) -> Column:
    """A number in [0, 1); slots 0 and 1 of one digest are independent."""
    return F.conv(F.substring(hexed, 1 + 12 * slot, 12), 16, 10).cast("double") / F.lit(SCALE)


def laplace(u: Column, scale: float | Column) -> Column:
    """Inverse distribution function of Laplace(0, scale)."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    centred = u - F.lit(0.5)
    return -b * F.signum(centred) * F.ln(F.greatest(1 - 2 * F.abs(centred), F.lit(1 / SCALE)))


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniforms."""
    return F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * F.pi() * u2)


def once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row even if ``then`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def invert_cdf(cdf: Column, u: Column) -> Column:
    """Position drawn from an ascending cumulative array; the last cell takes any rounding remainder."""
    return once(u, lambda v: F.least(F.size(F.filter(cdf, lambda c: c <= v)), F.size(cdf) - 1))


def invert_constants(cdf: Sequence[float], u: Column) -> Column:
    """:func:`invert_cdf` for a cumulative array known when the plan is made: plain comparisons, all in generated code."""
    return reduce(add, [(u >= F.lit(c)).cast("int") for c in cdf[:-1]], F.lit(0))
