"""Unique output names: the first free of ``a``, ``a_1``, ``a_2``, ... in request order.

A request takes the lowest index that is free when its turn comes. An index of a slug can be
gone for two reasons only: a file of that name exists, or the name is itself a requested
slug (``a_1`` for ``a``) that came first. So for each slug it is enough to know which indexes
it skips; the k-th request then gets the k-th index that is not skipped.

* Which existing names are skipped is known beforehand.
* Which requested names are skipped follows from one pass over the *distinct* colliding
  names of a slug, never over its requests. Slugs without such names, nearly all, take no
  part in it.
* That pass counts the skips so far. What one colliding index does to the count is to raise it
  by one if it lies in some interval, and what a run of indexes does is to raise it by a
  number that depends on the count before the run only: a short list of steps. So a slug with
  many colliding names is cut into runs. Their lists are made in parallel, the count is handed
  from list to list, and then every run is walked from its own count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnflow.operators.ordered import Running, chunk_rows, number_rows, running
from kilnflow.session import staged

COUNTED = r"^(.+)_([1-9][0-9]*)$"
SUFFIXES = r"((_[1-9][0-9]*)*)$"
FOLD_SCHEMA = "slug string, j long, skipped boolean, taken boolean"
#: Colliding names of a run.
RUN = 4096
_FOREVER = np.iinfo(np.int64).max


def _stem(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, COUNTED, 1), F.lit(""))


def _count(name: Column) -> Column:
    return F.regexp_extract(name, COUNTED, 2).try_cast("long")


def _depth(slug: Column) -> Column:
    """How many counters end the slug: 0 for ``a``, 2 for ``a_1_1``."""
    suffixes = F.regexp_extract(slug, r"^.+?" + SUFFIXES, 1)
    return F.size(F.split(suffixes, "_")) - 1


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per run, in index order: is each contested index skipped, or taken by a request?

    Rows come sorted by slug and index, and say how many skips came before their run, so one
    counter is all there is to remember.
    """
    current, skips = None, 0
    for batch in batches:
        skipped, taken = [], []
        columns = (batch[c] for c in ("slug", "part", "start", "j", "always", "before", "n"))
        for slug, part, start, j, always, before, n in zip(*columns):
            if (slug, part) != current:
                current, skips = (slug, part), start
            request = j - skips
            reached = request < n
            skip = bool(reached and (always or before <= request))
            skipped.append(skip)
            taken.append(bool(reached and not skip))
            skips += skip
        yield pd.DataFrame(
            {"slug": batch["slug"], "j": batch["j"], "skipped": skipped, "taken": taken}
        )


class Steps:
    """What a run of contested indexes makes of the number of skips before it.

    From ``at[i]`` on the run adds ``by[i]`` skips. An index adds one where the count so far is
    in an interval; as counts never change their order, that is one interval of starts.
    """

    def __init__(self) -> None:
        self.at, self.by = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def then(self, low: int, high: int) -> None:
        """Add one where the count so far is from ``low`` to ``high``."""
        for bound in (low, high + 1 if high < _FOREVER else None):
            if bound is None:
                continue
            # The first start whose count has reached the bound; a step may leap over it.
            i = int(np.searchsorted(self.at + self.by, bound, "left")) - 1
            start = bound - self.by[i]
            if i >= 0 and (i + 1 == len(self.at) or start < self.at[i + 1]):
                self.at = np.insert(self.at, i + 1, start)
                self.by = np.insert(self.by, i + 1, self.by[i])
        counts = self.at + self.by
        self.by[(counts >= low) & (counts <= high)] += 1

    def after(self, start: int) -> int:
        return start + int(self.by[np.searchsorted(self.at, start, "right") - 1])


STEPS_SCHEMA = "slug string, part long, at array<long>, by array<long>"


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The steps of every run."""
    current, steps = None, Steps()

    def made() -> pd.DataFrame:
        return pd.DataFrame({"slug": [current[0]], "part": [current[1]], "at": [steps.at], "by": [steps.by]})

    for batch in batches:
        columns = (batch[c] for c in ("slug", "part", "j", "always", "before", "n"))
        for slug, part, j, always, before, n in zip(*columns):
            if (slug, part) != current:
                if current is not None:
                    yield made()
                current, steps = (slug, part), Steps()
            # Reached while j - skips < n, and skipped if always or before <= j - skips.
            steps.then(max(0, j - n + 1), _FOREVER if always else j - before)
    if current is not None:
        yield made()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The skips before every run but the first, from the steps of those before it in order."""
    current, skips = None, 0
    for batch in batches:
        starts = []
        for slug, at, by in zip(batch["slug"], batch["at"], batch["by"]):
            if slug != current:
                current, skips = slug, 0
            steps = Steps()
            steps.at, steps.by = np.asarray(at, np.int64), np.asarray(by, np.int64)
            skips = steps.after(skips)
            starts.append(skips)
        yield pd.DataFrame({"slug": batch["slug"], "part": batch["part"] + 1, "start": starts})


def _walked(level: DataFrame, run: int, rows: int | None) -> DataFrame:
    """``level`` (``slug, j, always, before, n``) decided, run by run."""
    if not level.groupBy("slug").count().where(F.col("count") > run).isEmpty():
        ranked = number_rows(level, ["slug"], ["j"], "_r", rows)
        cut = staged(ranked.withColumn("part", F.floor((F.col("_r") - 1) / run)).drop("_r"), "runs")
        several = cut.where("part > 0").select("slug").distinct()
        lined = cut.join(several, "slug", "left_semi").repartition("slug", "part").sortWithinPartitions("slug", "part", "j")
        steps = staged(lined.mapInPandas(_compose, STEPS_SCHEMA), "steps")
        starts = steps.repartition("slug").sortWithinPartitions("slug", "part").mapInPandas(
            _chain, "slug string, part long, start long"
        )
        placed = cut.join(starts, ["slug", "part"], "left").fillna(0, ["start"])
    else:
        placed = level.select("*", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"))
    return placed.repartition("slug", "part").sortWithinPartitions("slug", "part", "j").mapInPandas(_walk, FOLD_SCHEMA)


def unique_names(
    requests: DataFrame,
    existing: DataFrame | None = None,
    slug: str = "slug",
    order: Sequence[str] = ("prompt_id",),
    extension: str = ".png",
    rows: int | None = None,
    run: int = RUN,
) -> DataFrame:
    """Add ``name_index`` and ``name`` to each request.

    ``existing`` has the stems of files already there in a column ``name``. The requests
    and their slugs are read several times, so both are written to the shared folder when the
    function is called: hand in names and order, not texts. They move twice, by slug and chunk;
    a slug held by a third of them is spread over its chunks, its colliding names over runs of
    ``run``.
    """
    order = list(order)
    spark = requests.sparkSession
    if existing is None:
        existing = spark.createDataFrame([], "name string")
    asked = staged(requests.withColumn("_slug", F.col(slug)), "requests")
    slugs = staged(
        asked.groupBy("_slug").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")
        ),
        "slugs",
    )

    # Indexes a slug may find gone: files, and other slugs that spell one of its names.
    files = existing.select("name").distinct()
    by_file = files.select(F.col("name").alias("_slug"), F.lit(0).cast("long").alias("j")).union(
        files.select(_stem(F.col("name")), _count(F.col("name")))
    ).where(F.col("_slug").isNotNull() & F.col("j").isNotNull())
    by_file = by_file.join(slugs.select("_slug"), "_slug", "left_semi").distinct()
    rivals = (
        slugs.select(_stem(F.col("_slug")).alias("_stem"), _count(F.col("_slug")).alias("j"), "first")
        .where(F.col("_stem").isNotNull() & F.col("j").isNotNull())
        .join(slugs.select(F.col("_slug").alias("_stem")), "_stem")
    )
    # A rival stands among the requests of the slug it spells a name of, where it came first.
    arrivals = rivals.select(
        F.col("_stem").alias("_slug"), *[F.col(f"first.{c}").alias(c) for c in order], "j", F.lit(0).alias("_own")
    )
    both = asked.withColumn("_own", F.lit(1)).unionByName(arrivals, allowMissingColumns=True)
    turns = staged(running(both, ["_slug"], order, {"_k": Running("sum", F.col("_own"))}, rows=rows), "turns")
    rivals = turns.where("_own = 0").select("_slug", "j", F.col("_k").alias("before"))
    numbered = turns.where("_own = 1")
    skips = by_file
    if not rivals.isEmpty():
        skips = _contested(by_file, rivals, slugs, run, rows)
    moved = _shifted(numbered, skips, slugs, requests.columns, rows or chunk_rows(spark))
    index = F.col("_at") + F.col("_shift")
    counted = F.concat("_slug", F.lit("_"), index.cast("string"))
    return moved.select(
        "_row.*",
        index.alias("name_index"),
        F.concat(F.when(index == 0, F.col("_slug")).otherwise(counted), F.lit(extension)).alias(
            "name"
        ),
    )


def _shifted(
    numbered: DataFrame, skips: DataFrame, slugs: DataFrame, columns: list[str], size: int
) -> DataFrame:
    """Each request with ``_at``, its number from 0, and ``_shift``, the skips before it.

    A skipped index j with m skipped ones below it shifts every request from number j - m on
    by one. Numbers are dense, so request k of a slug belongs to block k div ``size``. Every
    block gets one row with the shifts of the blocks before it, every skip a row with 1; a
    running sum within the block does the rest.
    """
    ranked = number_rows(skips, ["_slug"], ["j"], "_m")
    at = (F.col("j") - F.col("_m") + 1).alias("_at")
    shifts = ranked.select("_slug", at).groupBy("_slug", "_at").agg(F.count(F.lit(1)).alias("_by"))
    blocked = shifts.withColumn("_block", F.floor(F.col("_at") / size))
    blocks = (
        slugs.join(shifts.select("_slug").distinct(), "_slug", "left_semi")
        .select("_slug", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size))).alias("_block"))
        .join(blocked.groupBy("_slug", "_block").agg(F.sum("_by").alias("_in")), ["_slug", "_block"], "left")
    )
    before = Window.partitionBy("_slug").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opening = blocks.select(
        "_slug", "_block", F.lit(-1).cast("long").alias("_at"),
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_by"),
    )
    turns = numbered.select(
        "_slug",
        F.floor((F.col("_k") - 1) / size).alias("_block"),
        (F.col("_k") - 1).alias("_at"),
        F.lit(0).cast("long").alias("_by"),
        F.struct(*columns).alias("_row"),
    )
    merged = turns.unionByName(
        opening.unionByName(blocked.select(*opening.columns)), allowMissingColumns=True
    )
    in_block = Window.partitionBy("_slug", "_block").orderBy(
        "_at", F.col("_row").isNotNull()
    ).rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("_shift", F.sum("_by").over(in_block)).where(F.col("_row").isNotNull())


def _contested(
    by_file: DataFrame, rivals: DataFrame, slugs: DataFrame, run: int, rows: int | None
) -> DataFrame:
    """Skipped indexes of every slug when some slugs spell names of others.

    ``rivals`` has the requests of the slug ``before`` the rival's first one.
    """
    before = rivals.select("_slug", "j", F.lit(False).alias("always"), "before")
    fixed = by_file.join(rivals.select("_slug").distinct(), "_slug", "left_semi").select(
        "_slug", "j", F.lit(True).alias("always"), F.lit(None).cast("long").alias("before")
    )
    contested = staged(
        before.unionByName(fixed)
        .groupBy("_slug", "j")
        .agg(F.bool_or("always").alias("always"), F.min("before").alias("before"))
        .join(slugs.select("_slug", "n"), "_slug")
        .withColumn("depth", _depth(F.col("_slug")))
    )
    # A slug loses its own name only to the slug one counter shorter, so shorter ones go
    # first. There are at most as many rounds as counters fit in one name.
    depths = sorted(r["depth"] for r in contested.select("depth").distinct().collect())
    walked, lost = None, None
    for depth in depths:
        level = contested.where(F.col("depth") == depth).drop("depth")
        if lost is not None:
            own = lost.join(level.select("_slug", "n").distinct(), "_slug").select(
                "_slug",
                F.lit(0).cast("long").alias("j"),
                F.lit(True).alias("always"),
                F.lit(None).cast("long").alias("before"),
                "n",
            )
            level = level.unionByName(own).groupBy("_slug", "j", "n").agg(
                F.bool_or("always").alias("always"), F.min("before").alias("before")
            )
        columns = (F.col("_slug").alias("slug"), "j", "always", F.coalesce("before", F.lit(0)).alias("before"), "n")
        done = staged(_walked(level.select(*columns), run, rows))
        walked = done if walked is None else walked.unionByName(done)
        gone = done.where("taken and j > 0").select(
            F.concat("slug", F.lit("_"), F.col("j").cast("string")).alias("_slug")
        )
        lost = gone if lost is None else lost.unionByName(gone)
    settled = walked.where("skipped").select(F.col("slug").alias("_slug"), "j")
    lost_own = lost.select("_slug", F.lit(0).cast("long").alias("j"))
    untouched = by_file.join(rivals.select("_slug").distinct(), "_slug", "left_anti")
    return settled.unionByName(lost_own).unionByName(untouched).distinct()
