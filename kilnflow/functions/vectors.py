"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guidance_blend(u: ColumnOrName, t: ColumnOrName, g: float = 7.5) -> Column:
    """``u + g * (t - u)`` for each element."""

    def blend(a: Column, b: Column) -> Column:
        a, b = a.cast("double"), b.cast("double")
        return a + F.lit(float(g)) * (b - a)

    return F.zip_with(_col(u), _col(t), blend)


def quantize_u8(v: ColumnOrName, scale: float = 1.0) -> Column:
    """Map [-1, 1] (after dividing by ``scale``) to 0..255, rounding half to even."""

    def level(x: Column) -> Column:
        unit = x.cast("double") / F.lit(float(scale)) / 2 + 0.5
        return F.rint(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    return F.transform(_col(v), level)


def join_pair(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.concat(_col(a), _col(b))


def split_pair(v: ColumnOrName) -> Column:
    """The two halves of an array of even length."""
    half = F.floor(F.size(_col(v)) / 2).cast("int")
    return F.struct(
        F.slice(_col(v), F.lit(1), half).alias("first"),
        F.slice(_col(v), half + 1, half).alias("second"),
    )


def pixel_diff(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Percent of elements that differ, and whether none does.

    Arrays of unequal length are not equal and have no percentage.
    """
    a, b = _col(a), _col(b)
    differing = F.aggregate(
        F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")),
        F.lit(0),
        lambda n, d: n + d,
    )
    percent = F.when(
        F.size(a) == F.size(b),
        F.coalesce(F.try_divide(differing * 100.0, F.size(a)), F.lit(0.0)),
    )
    return F.struct(percent.alias("percent"), F.coalesce(percent == 0, F.lit(False)).alias("equal"))
