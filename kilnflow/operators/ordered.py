"""Ordered scans that stay parallel when one key holds most of the rows.

A window over ``partitionBy(key).orderBy(...)`` sends each key to a single task. Here the
rows of a large key are first cut into chunks that are contiguous in the given order, the
window runs per ``(key, chunk)``, and what a chunk must know about the chunks before it (a
running total, the last rows) is joined to it from a small table.

Where to cut is a property of the rows alone: a row opens a new chunk when the hash of its
key and order columns is a multiple of ``rows``. So

* every branch of a plan and every retry of a task cuts at the same rows;
* a chunk holds about ``rows`` rows whatever the distribution of keys or times, and
  equal timestamps are parted by the tie-break column;
* there are no more cut points than tasks can use: where a table of N rows has more than
  16 per shuffle partition, those with the smaller second hash are left out, so that a chunk
  is at most about a sixteenth of a task's share of the table.

The cut points are one sorted array for the whole table, found by a job when the plan is made, as
Spark finds the bounds of a range partitioning. It is a literal: a task holds it once, a row
finds its chunk by bisection, and no row carries it. A table without cut points needs no
more than its window. Carried totals are the only data broadcast, one row per chunk of a key
with cut points.

The order columns must identify a row within its key, and the input must give the same rows
each time it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
SPLIT = "_split"
HELPERS = (CHUNK, SPLIT)
UNCUT = "uncut"

ROWS_CONF = "spark.kilnflow.rowsPerChunk"
DEFAULT_ROWS = 1_000_000
CUTS_PER_PARTITION = 16


def chunk_rows(spark: SparkSession) -> int:
    """Rows aimed at per chunk."""
    return int(spark.conf.get(ROWS_CONF, str(DEFAULT_ROWS)))


def useful_cuts(spark: SparkSession) -> int:
    """Cut points that spread a table over all tasks, several to each."""
    return CUTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def attach(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join ``small``, at most one row per chunk or split key, matching nulls too."""
    renamed = small.select(
        *[F.col(c).alias(f"_on_{c}") for c in on],
        *[c for c in small.columns if c not in on],
    )
    match = _all([F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(F.broadcast(renamed), match, "left").drop(*[f"_on_{c}" for c in on])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cuts_up_to(cuts: Column, at: Column) -> Column:
    """How many of the sorted ``cuts`` are at or before ``at``, by bisection."""

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["lo"] + span["hi"], 1)
        return (
            F.when(span["lo"] >= span["hi"], span)
            .when(
                F.get(cuts, middle)["at"] <= at,
                F.struct((middle + 1).alias("lo"), span["hi"].alias("hi")),
            )
            .otherwise(F.struct(span["lo"].alias("lo"), middle.alias("hi")))
        )

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(cuts))))
    whole = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(rounds, whole, halve, lambda span: span["lo"])


def _key_of(keys: list[str]) -> Column:
    """The key as one value; a table without keys has one."""
    return (F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))).alias("key")


def _cut_points(
    df: DataFrame, keys: list[str], order: list[str], rows: int
) -> tuple[Column, list[int]] | None:
    """All cut points in order, each with its number within its key, as a literal; and the
    hashes of their keys."""
    opens = F.pmod(F.xxhash64(*keys, *order), F.lit(rows)) == 0
    # Another hash ranks the cut points: rank 1 and up half of them, 2 and up a quarter, ...
    lots = F.xxhash64(F.lit("rank"), *keys, *order).bitwiseAND(F.lit(2**63 - 1))
    rank = F.bit_count(lots.bitwiseAND(-lots) - 1)
    openers = (
        df.where(opens)
        .select(_key_of(keys), F.struct(*order).alias("tick"), rank.alias("rank"))
        .groupBy("key", "tick")
        .agg(F.max("rank").alias("rank"))
    )
    excess = F.count("rank") / F.lit(float(useful_cuts(df.sparkSession)))
    halvings = F.when(excess <= 1, 0).otherwise(F.ceil(F.log2(excess)))
    number = F.row_number().over(Window.partitionBy("key").orderBy("tick"))
    kept = openers.where(F.col("rank") >= openers.agg(halvings).scalar()).select(
        F.struct("key", "tick").alias("at"), number.alias("number")
    )
    points = kept.agg(F.sort_array(F.collect_list(F.struct("at", "number"))).alias("points"))
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    hashes = F.array_distinct(F.transform("points", lambda p: F.xxhash64(p["at"]["key"])))
    found = points.select(hashes.alias("hashes"), F.to_json("points", exact).alias("text")).first()
    if not found["hashes"]:
        return None
    return F.from_json(F.lit(found["text"]), points.schema["points"].dataType, exact), found["hashes"]


def cut(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Add ``_chunk`` (0, 1, ... in order within a key) and ``_split`` (the key has cuts)."""
    if CHUNK in df.columns:
        return df
    keys, order = list(keys), list(order)
    found = _cut_points(df, keys, order, rows or chunk_rows(df.sparkSession))
    if found is None:
        return df.select("*", F.lit(0).alias(CHUNK, metadata={UNCUT: True}), F.lit(False).alias(SPLIT))
    cuts, hashes = found
    key = _key_of(keys)

    def place(points: Column) -> Column:
        """The number of the key's last cut point up to here, and whether the key has any."""

        def around(passed: Column) -> Column:
            last, following = F.get(points, passed - 1), F.get(points, passed)
            after = last["at"]["key"].eqNullSafe(key)
            return F.struct(
                F.when(after, last["number"]).otherwise(0).alias("chunk"),
                (after | following["at"]["key"].eqNullSafe(key)).alias("split"),
            )

        at = F.struct(key, F.struct(*order).alias("tick"))
        return _bound(_cuts_up_to(points, at), around)

    # The bisection costs a row far more than its key's hash does.
    marked = df.withColumn("_place", F.when(F.xxhash64(key).isin(hashes), _bound(cuts, place)))
    return marked.withColumn(CHUNK, F.coalesce("_place.chunk", F.lit(0))).withColumn(
        SPLIT, F.coalesce("_place.split", F.lit(False))
    ).drop("_place")


def is_whole(df: DataFrame) -> bool:
    """No key of the output of :func:`cut` has cut points: plain windows do."""
    return bool(df.schema[CHUNK].metadata.get(UNCUT))


def chunk_window(
    keys: Sequence[str], order: Sequence[str], reverse: bool = False
) -> WindowSpec:
    """The window of one chunk; every step of a scan uses it, so rows move once.

    ``_split`` follows from the key. It is named among the partition columns so that Spark
    can push a filter on it below the window, and small keys stay out of the carried totals.
    """
    by = [F.desc(c) if reverse else F.asc(c) for c in order]
    return Window.partitionBy(*keys, SPLIT, CHUNK).orderBy(*by)


def across_chunks(keys: Sequence[str], reverse: bool = False) -> WindowSpec:
    """The window over the per-chunk totals of one key."""
    return Window.partitionBy(*keys).orderBy(F.desc(CHUNK) if reverse else F.asc(CHUNK))


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``how`` is count, sum, max or min."""

    how: str
    value: Column | None = None

    def aggregate(self) -> Column:
        if self.how == "count":
            return F.count(F.lit(1))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](self.value)

    def merge(self, name: str) -> Column:
        """The aggregate of per-chunk totals."""
        how = "sum" if self.how == "count" else self.how
        return {"sum": F.sum, "max": F.max, "min": F.min}[how](name)

    def add(self, local: Column, carried: Column) -> Column:
        if self.how == "count":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if self.how == "sum":
            return F.coalesce(local + carried, local, carried)
        return (F.greatest if self.how == "max" else F.least)(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, Running],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    rows: int | None = None,
    keep_chunks: bool = False,
    whole: Sequence[str] = (),
) -> DataFrame:
    """Running aggregates per key; ``reverse`` runs from the last row to the first.

    One shuffle of ``df`` by (key, chunk). ``inclusive=False`` leaves the row itself out. Of the
    names in ``whole`` the aggregate of the whole key is added as ``<name>_of_key``.
    """
    keys, order = list(keys), list(order)
    df = cut(df, keys, order, rows)
    frame = chunk_window(keys, order, reverse).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = df.select(
        "*",
        *[spec.aggregate().over(frame).alias(name) for name, spec in specs.items()],
        *[specs[n].aggregate().over(Window.partitionBy(*keys, SPLIT, CHUNK)).alias(f"{n}_of_key") for n in whole],
    )
    if is_whole(df):
        return local if keep_chunks else local.drop(*HELPERS)
    totals = (
        df.where(SPLIT)
        .groupBy(*keys, CHUNK)
        .agg(*[spec.aggregate().alias(f"_t_{name}") for name, spec in specs.items()])
    )
    before = across_chunks(keys, reverse).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        CHUNK,
        *[
            spec.merge(f"_t_{name}").over(before).alias(f"_c_{name}")
            for name, spec in specs.items()
        ],
        *[specs[n].merge(f"_t_{n}").over(Window.partitionBy(*keys)).alias(f"_w_{n}") for n in whole],
    )
    joined = attach(local, carried, [*keys, CHUNK])
    out = joined.withColumns(
        {n: spec.add(F.col(n), F.col(f"_c_{n}")) for n, spec in specs.items()}
        | {f"{n}_of_key": F.coalesce(f"_w_{n}", f"{n}_of_key") for n in whole}
    ).drop(*[f"_c_{name}" for name in specs], *[f"_w_{n}" for n in whole])
    return out if keep_chunks else out.drop(*HELPERS)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    rows: int | None = None,
    keep_chunks: bool = False,
) -> DataFrame:
    """1-based position of each row within its key (or in the whole table)."""
    return running(
        df, keys, order, {name: Running("count")}, rows=rows, keep_chunks=keep_chunks
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    rows: int | None = None,
    keep_chunks: bool = False,
) -> DataFrame:
    """The value of the row before, across chunks; null on the first row of a key."""
    keys, order = list(keys), list(order)
    df = cut(df, keys, order, rows)
    local_window = chunk_window(keys, order)
    local = df.select(
        "*",
        F.lag(value).over(local_window).alias(name),
        F.row_number().over(local_window).alias("_rank"),
    )
    if is_whole(df):
        out = local.drop("_rank")
        return out if keep_chunks else out.drop(*HELPERS)
    last = (
        df.where(SPLIT)
        .groupBy(*keys, CHUNK)
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
    )
    carried = last.select(*keys, CHUNK, F.lag("_last").over(across_chunks(keys)).alias("_last"))
    joined = attach(local, carried, [*keys, CHUNK])
    out = joined.withColumn(
        name, F.when(F.col("_rank") == 1, F.col("_last")).otherwise(F.col(name))
    ).drop("_rank", "_last")
    return out if keep_chunks else out.drop(*HELPERS)


def last_n(values: Column, n: int | Column) -> Column:
    """The last ``n`` entries of an array (all of it when shorter)."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, name: str
) -> DataFrame:
    """The first ``n`` values per key as an array.

    The filter on ``row_number`` lets Spark keep ``n`` rows per key before the shuffle.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.select(*keys, *order, F.col(value).alias("_v"))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "_v")))["_v"].alias(name))
    )
