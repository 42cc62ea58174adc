"""Edit logs and region masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnflow.operators.ordered import (
    CHUNK,
    SPLIT,
    across_chunks,
    attach,
    chunk_window,
    cut,
)
from kilnflow.session import staged


def replay_edits(
    log: DataFrame,
    keys: Sequence[str] = ("image_id",),
    order: Sequence[str] = ("seq",),
    rows: int | None = None,
) -> DataFrame:
    """Rectangles left after add, undo and reset, numbered from the bottom of the stack.

    The stack is never built. Among the rows after the last reset, the height after a row is
    the running sum of +1 and -1, lifted by how far it ever fell below 0 (undo on an empty
    stack). An added rectangle is left iff no later row brings the height below its own.

    A chunk tells the others three numbers about its rows after its last reset: whether it
    had a reset, its net change and its lowest point.
    """
    keys, order = list(keys), list(order)
    chunks = cut(log, keys, order, rows)
    moved = _with_levels(chunks, keys, order)
    totals = (
        _with_levels(chunks.where(SPLIT), keys, order)
        .groupBy(*keys, CHUNK)
        .agg(
            F.max("_resets").alias("_resets"),
            F.sum("_move").alias("_net"),
            F.min("_level").alias("_low"),
        )
    )
    joined = attach(moved, _stack_carries(totals, keys), [*keys, CHUNK])

    base = F.coalesce("_base", F.lit(0))
    floor = F.coalesce("_floor", F.lit(0))
    height = base + F.col("_level") - F.least(floor, base + F.col("_lowest"))
    live = joined.where((F.col("_resets") == 0) & ~F.coalesce("_dead", F.lit(False)))
    later = chunk_window(keys, order, reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    after = live.withColumn("_height", height).withColumn(
        "_below", F.least(F.min("_height").over(later), F.col("_after"))
    )
    left = (F.col("op") == "add") & (
        F.col("_below").isNull() | (F.col("_below") >= F.col("_height"))
    )
    return after.where(left).select(
        *keys,
        *order,
        F.col("_height").alias("rect_id"),
        F.least("x1", "x2").alias("x1"),
        F.least("y1", "y2").alias("y1"),
        F.greatest("x1", "x2").alias("x2"),
        F.greatest("y1", "y2").alias("y2"),
    )


def _with_levels(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Within a chunk: resets from the row on, and the level since the last reset."""
    to_end = chunk_window(keys, order, reverse=True).rowsBetween(Window.unboundedPreceding, 0)
    so_far = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("op") == "add", 1).when(F.col("op") == "undo", -1).otherwise(0)
    return (
        chunks.withColumn("_resets", F.sum((F.col("op") == "reset").cast("int")).over(to_end))
        .withColumn("_move", F.when(F.col("_resets") == 0, move).otherwise(0))
        .withColumn("_level", F.sum("_move").over(so_far))
        .withColumn("_lowest", F.min("_level").over(so_far))
    )


def _stack_carries(totals: DataFrame, keys: list[str]) -> DataFrame:
    """What a chunk must know of the others: dead or not, level and floor before it, and
    the lowest height after it."""
    before = across_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    behind = across_chunks(keys, reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    dead = totals.withColumn("_dead", F.coalesce(F.sum("_resets").over(behind), F.lit(0)) > 0)
    counted = F.when(~F.col("_dead"), F.col("_net"))
    lowest = F.when(~F.col("_dead"), F.col("_base") + F.col("_low"))
    # Within a chunk the height is lowest where the level is.
    low_height = F.greatest(F.col("_base") + F.col("_low") - F.col("_floor"), F.lit(0))
    return (
        dead.withColumn("_base", F.coalesce(F.sum(counted).over(before), F.lit(0)))
        .withColumn("_floor", F.least(F.coalesce(F.min(lowest).over(before), F.lit(0)), F.lit(0)))
        .withColumn("_after", F.min(low_height).over(behind))
        .select(*keys, CHUNK, "_dead", "_base", "_floor", "_after")
    )


def _side() -> Column:
    return F.pow(F.lit(2.0), F.col("grid"))


def _cell(value: Column, side: Column) -> Column:
    return F.floor(value / side)


#: Distinct pieces of regions that a point is compared with in a cell; a cell with more is
#: quartered, at most so many times.
CELL_PIECES = 64
QUARTERINGS = 40


def region_mask(
    points: DataFrame,
    regions: DataFrame,
    by: Sequence[str] = (),
    cell_pieces: int = CELL_PIECES,
    quarterings: int = QUARTERINGS,
) -> DataFrame:
    """Points inside any region, edges included, each once, with mask value 255.

    Regions lie on grids of sides 1, 2, 4, ... (and 1/2, 1/4, ...): each goes to the grid
    whose side is from half its longer extent up, so it meets a few cells whatever its size.
    Only the distinct coordinates are tested, once per grid in use. A cell that some region
    covers whole needs no comparison; the others compare with the distinct pieces of regions
    inside them. The points then meet the coordinates found by an equi join.

    Where many regions crowd, a cell would hold them all. A cell with more than ``cell_pieces``
    distinct pieces is quartered, pieces and points, until none has more: overlapping pieces
    soon cover a quarter whole, others are parted. So a point meets that many pieces for each
    grid in use at most, but for pieces that crowd in a cell 2^``quarterings`` times smaller than
    their grid's; there they are compared all the same. Every round works on crowded cells only.

    The pieces are read several times, so they are written to the shared folder first.
    """
    by = list(by)
    cell, spot = [*by, "grid", "cx", "cy"], [*by, "x", "y"]
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2
    grid = F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(F.lit(0)).cast("int")
    shapes = regions.select(*by, "x1", "y1", "x2", "y2").distinct().withColumn("grid", grid)
    spans = {c: F.sequence(_cell(F.col(f"{c}1"), _side()), _cell(F.col(f"{c}2"), _side())) for c in "xy"}
    pieces = staged(_cut_up(shapes, by, spans), "pieces")
    grids = pieces.agg(F.collect_set("grid")).scalar()
    spots = _placed(points.select(*spot).distinct().withColumn("grid", F.explode(grids)), cell)

    hits = None
    for depth in range(quarterings + 1):
        covered = pieces.where(_covers_cell()).select(*cell).distinct()
        partial = pieces.where(~_covers_cell()).join(covered, cell, "left_anti")
        crowded = None
        if depth < quarterings:
            counted = partial.groupBy(*cell).agg(F.count(F.lit(1)).alias("_pieces"))
            crowded = staged(counted.where(F.col("_pieces") > cell_pieces).select(*cell), "crowded")
            if crowded.isEmpty():
                crowded = None
        few = partial if crowded is None else partial.join(crowded, cell, "left_anti")
        found = spots.join(covered, cell, "left_semi").select(*spot).union(_inside(spots, few, cell).select(*spot))
        hits = found if hits is None else hits.union(found)
        if crowded is None:
            break
        halves = {c: F.sequence(2 * F.col(f"c{c}"), 2 * F.col(f"c{c}") + 1) for c in "xy"}
        finer = partial.join(crowded, cell, "left_semi").withColumn("grid", F.col("grid") - 1)
        pieces = staged(_cut_up(finer, by, halves), "pieces")
        inner = spots.join(crowded, cell, "left_semi").withColumn("grid", F.col("grid") - 1)
        spots = staged(_placed(inner, cell), "crowded-spots")
    return points.join(hits.distinct(), spot, "left_semi").withColumn("mask", F.lit(255))


def _cut_up(shapes: DataFrame, by: list[str], spans: dict[str, Column]) -> DataFrame:
    """The distinct pieces of shapes in the cells of their grid that ``spans`` lists."""
    out = shapes.withColumn("_x", spans["x"]).withColumn("_y", spans["y"]).select(
        *by, "grid", "x1", "y1", "x2", "y2", F.explode("_x").alias("cx"), "_y"
    ).withColumn("cy", F.explode("_y"))
    cut = out.select(
        *by, "grid", "cx", "cy",
        F.greatest(F.col("x1"), F.col("cx") * _side()).alias("x1"),
        F.greatest(F.col("y1"), F.col("cy") * _side()).alias("y1"),
        F.least(F.col("x2"), (F.col("cx") + 1) * _side()).alias("x2"),
        F.least(F.col("y2"), (F.col("cy") + 1) * _side()).alias("y2"),
    )
    return cut.where("x1 <= x2 and y1 <= y2").distinct()


def _covers_cell() -> Column:
    return (
        (F.col("x1") == F.col("cx") * _side())
        & (F.col("y1") == F.col("cy") * _side())
        & (F.col("x2") == (F.col("cx") + 1) * _side())
        & (F.col("y2") == (F.col("cy") + 1) * _side())
    )


def _placed(spots: DataFrame, cell: list[str]) -> DataFrame:
    """Spots with the cell of their grid that they are in."""
    rest = [c for c in spots.columns if c not in ("cx", "cy")]
    return spots.select(*rest, _cell(F.col("x"), _side()).alias("cx"), _cell(F.col("y"), _side()).alias("cy"))


def _inside(spots: DataFrame, pieces: DataFrame, cell: list[str]) -> DataFrame:
    """The spots inside a piece of their cell."""
    p, r = spots.alias("p"), pieces.alias("r")
    matched = F.col("p.x").between(F.col("r.x1"), F.col("r.x2")) & F.col("p.y").between(
        F.col("r.y1"), F.col("r.y2")
    )
    for c in cell:
        matched = (F.col(f"p.{c}") == F.col(f"r.{c}")) & matched
    return p.join(r, matched, "left_semi")
