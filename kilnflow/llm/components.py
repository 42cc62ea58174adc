"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnflow.llm.common import staged


def _around(links: DataFrame) -> DataFrame:
    """Every link with the least node at or next to its first end, ``m``.

    The minima are written first, so that the join is one of two shuffled tables, whose hot
    nodes adaptive execution can split.
    """
    least = staged(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    return links.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))


def _settled(links: DataFrame) -> bool:
    """Every node has one link at most, and none has both a link and nodes linked to it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    both = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return both.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every linked node but roots.

    ``links`` has ``a`` and ``b``. Every node's greater neighbours, then its lesser ones, are
    linked to the least node around it, over and over until only stars are left; a round at
    least halves what is left of a path.
    """
    now = staged(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        both = staged(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        large = staged(
            _around(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        met = _around(large)
        small = met.select("a", F.col("m").alias("b")).union(
            met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = staged(small.filter("a <> b").distinct(), "small")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
