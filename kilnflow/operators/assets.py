"""Asset listings: newest, new, numbered, sampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.operators.ordered import Running, number_rows, previous, running


def describe_assets(catalog: DataFrame) -> DataFrame:
    """Add the size in MB (of 1048576 bytes)."""
    return catalog.withColumn("size_mb", F.col("length") / F.lit(1024.0 * 1024.0))


def latest_asset(catalog: DataFrame, required: bool = True) -> DataFrame:
    """The newest asset; equal times go to the greater path. None at all is an error."""
    newest = catalog.agg(F.max(F.struct("mtime", "path", "length")).alias("_a"))
    if required:
        missing = F.raise_error(F.lit("no asset found"))
        newest = newest.withColumn("_a", F.when(F.col("_a").isNull(), missing).otherwise(F.col("_a")))
    return newest.where(F.col("_a").isNotNull()).select("_a.path", "_a.mtime", "_a.length")


def new_assets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Assets that were not there before, oldest first."""
    fresh = after.join(before.select("path"), "path", "left_anti")
    return fresh.orderBy("mtime", "path")


def number_items(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """1-based position and the total of each group."""
    keys = list(keys)
    count = {"position": Running("count")}
    numbered = running(df, keys, order, count, rows=rows, whole=["position"] if keys else [])
    if keys:
        return numbered.withColumnRenamed("position_of_key", "total")
    return numbered.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def sample_every_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rows: int | None = None
) -> DataFrame:
    """Every n-th row of each group, from its first (index 0, n, 2n, ...)."""
    numbered = number_rows(df, keys, order, "step_index", rows)
    return numbered.withColumn("step_index", F.col("step_index") - 1).where(
        F.col("step_index") % n == 0
    )


def _print_of(df: DataFrame, value: str) -> Column:
    """What two values have in common just when they are equal: a short digest of large ones."""
    kind = df.schema[value].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.struct(F.sha2(value, 256), F.octet_length(value))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.StringType)):
        # Adding 0 makes the zeros of both signs one; every entry says how long it is.
        number = isinstance(kind.elementType, (T.FloatType, T.DoubleType))

        def entry(x: Column) -> Column:
            shown = (x + F.lit(0.0) if number else x).cast("string")
            return F.coalesce(F.concat(F.length(shown), F.lit(":"), shown), F.lit("-"))

        return F.struct(F.sha2(F.array_join(F.transform(value, entry), ""), 256), F.size(value))
    return F.col(value)


def consecutive_duplicates(
    frames: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    rows: int | None = None,
) -> DataFrame:
    """Flag a frame that equals the one before it; the first of a run never does.

    Frames are compared by digest, so that none is kept beside its successor or handed on
    from chunk to chunk.
    """
    known = F.when(F.col(value).isNotNull(), _print_of(frames, value))
    seen = previous(frames.withColumn("_print", known), keys, order, "_print", "_before", rows)
    same = F.coalesce(F.col("_print") == F.col("_before"), F.lit(False))
    return seen.withColumn("is_duplicate", same).drop("_before", "_print")
