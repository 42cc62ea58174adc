"""Rates, progress and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(_col(a), _col(b))


def per_second(amount: ColumnOrName, elapsed: ColumnOrName) -> Column:
    """Amount per second (steps, bytes, ...), 0 unless time has passed."""
    return F.when(_col(elapsed) > 0, _col(amount) / _col(elapsed)).otherwise(F.lit(0.0))


def ms_per_step(elapsed: ColumnOrName, steps: ColumnOrName) -> Column:
    return ratio(elapsed, steps) * 1000


def percent_done(progress: ColumnOrName, total: ColumnOrName) -> Column:
    """Progress in percent; a total of 0 shows a full bar."""
    return F.when(_col(total) > 0, _col(progress) / _col(total) * 100).otherwise(F.lit(100.0))


def remaining_s(
    progress: ColumnOrName, total: ColumnOrName, time_per_step: ColumnOrName
) -> Column:
    """Seconds left, known once a step is done and its time is given; else null."""
    progress, total, each = _col(progress), _col(total), _col(time_per_step)
    known = (total > 0) & (progress > 0) & (each != 0)
    return F.when(known, (total - progress) * each)


def duration_text(seconds: ColumnOrName) -> Column:
    """``2m 5s`` above a minute, else ``60s``; fractions are cut."""
    s = _col(seconds)
    minutes = F.concat(
        F.floor(s / 60).cast("string"), F.lit("m "), F.floor(s % 60).cast("string"), F.lit("s")
    )
    return F.when(s > 60, minutes).otherwise(F.concat(F.floor(s).cast("string"), F.lit("s")))


def performance_label(performance_ratio: ColumnOrName) -> Column:
    """Percent of normal speed, rounded half to even; no ratio yet means no baseline yet."""
    shown = F.rint(_col(performance_ratio) * 100).cast("long").cast("string")
    return F.when(
        _col(performance_ratio).isNull(), F.lit("Establishing baseline...")
    ).otherwise(F.concat(F.lit("Performance: "), shown, F.lit("%")))


def throttle_label(is_throttled: ColumnOrName) -> Column:
    """THROTTLED or NORMAL; no state is NORMAL."""
    return F.when(_col(is_throttled), F.lit("THROTTLED")).otherwise(F.lit("NORMAL"))
