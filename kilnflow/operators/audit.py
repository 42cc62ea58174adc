"""Checks on page texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_literal(text: Column, marker: str) -> Column:
    """Occurrences of ``marker``, read as plain text."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))
    return (removed / F.lit(len(marker))).cast("int")


def content_audit(
    pages: DataFrame,
    marker: str,
    expected: Sequence[str],
    required: Sequence[str],
    title_prefix: str = "",
    html: str = "html",
) -> DataFrame:
    """Marker count, expected titles missing (a warning) and the verdict on required texts."""
    text = F.col(html)
    missing = F.array_compact(
        F.array(*[F.when(~text.contains(title_prefix + t), F.lit(t)) for t in expected])
    )
    passed = F.lit(True)
    for needed in required:
        passed = passed & text.contains(needed)
    return pages.withColumns(
        {
            "marker_count": count_literal(text, marker),
            "missing_titles": missing,
            "found_titles": F.lit(len(expected)) - F.size(missing),
            "passed": passed,
        }
    )


def title_report(
    pages: DataFrame,
    expected: Sequence[str],
    title_prefix: str = "",
    key: str = "page_id",
    html: str = "html",
) -> DataFrame:
    """One row per page and expected title: found or missing."""
    checks = F.array(
        *[
            F.struct(
                F.lit(t).alias("title"), F.col(html).contains(title_prefix + t).alias("found")
            )
            for t in expected
        ]
    )
    return pages.select(key, F.inline(checks))
