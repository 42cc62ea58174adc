"""Hard negatives by exact inner-product search with coordinate pruning.

Rows are kept in buckets of similar length; a bucket holds, for every coordinate, the list of
its rows sorted by that coordinate of the vectors scaled to length one. An anchor that needs
a score of at least ``s`` needs a cosine of at least ``s / (its length * the bucket's largest
length)``. No bucket where that is above one can matter; elsewhere it confines each
coordinate of a row to a range. For the anchor's focus coordinates, its largest, the ranges
are looked up in the sorted lists, and only rows that lie in all of them are scored, exactly.
What an anchor needs rises with what it has found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnflow.llm.common import shuffle_width, staged, table
from kilnflow.llm.topk import matrix, products, quantised

EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: Rows and bytes of a bucket, anchors of a tile, bytes of the buckets that a slot keeps in memory.
BUCKET = 1024
BUCKET_BYTES = 1 << 20
TILE = 128
SLOT_BYTES = 32 << 20
#: Coordinates of an anchor that are looked up, and the part of a bucket that a lookup must leave
#: out at least; else the whole bucket is scored at once.
FOCUS = 6
WORTH = 0.5

_LEAST = np.iinfo(np.int64).min
_ROUNDING = 1e-9

_INDEX = (
    "kind int, id long, part long, rows int, width int, label_lo long, label_hi long, reach double, "
    "ids binary, labels binary, vectors binary, orders binary, least binary"
)


@dataclass
class Bucket:
    """Rows of similar length with a sorted list of rows per coordinate."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    orders: np.ndarray

    def __post_init__(self) -> None:
        lengths = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.longest = float(lengths.max(initial=0))
        self.scaled = self.vectors / np.where(lengths > 0, lengths, 1)[:, None]
        if not len(self.orders):
            self.orders = self.scaled.argsort(axis=0, kind="stable").astype(np.uint16)
        self.lists = np.take_along_axis(self.scaled, self.orders.astype(np.int64), 0)
        self.known_labels = np.unique(self.labels)
        self.one_label = self.known_labels[0] if len(self.known_labels) == 1 else None

    def candidates(self, queries: np.ndarray, lengths: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of some queries and some rows, outside of which no row scores what its query needs."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(need > 0, need / (lengths * self.longest), -1.0) - _ROUNDING
        alive = np.flatnonzero(least <= 1)
        free = alive[least[alive] <= 0]
        bound = alive[least[alive] > 0]
        whole = [free]
        if len(bound) and self.vectors.shape[1]:
            unit = queries[bound] / lengths[bound, None]
            n = min(FOCUS, unit.shape[1])
            focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :n]
            at = np.take_along_axis(unit, focus, 1)
            t = np.minimum(least[bound], 1.0)[:, None]
            slack = np.sqrt((1 - t * t) * np.maximum(1 - at * at, 0))
            low = np.where(t <= -at, -1.0, at * t - slack) - _ROUNDING
            high = np.where(t <= at, 1.0, at * t + slack) + _ROUNDING
            start, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
            for c in np.unique(focus):
                here = focus == c
                start[here] = np.searchsorted(self.lists[:, c], low[here], "left")
                end[here] = np.searchsorted(self.lists[:, c], high[here], "right")
            found = end - start
            best = found.argmin(1)
            fewest = found.min(1)
            whole.append(bound[fewest > WORTH * len(self.ids)])
            for i in np.flatnonzero((fewest > 0) & (fewest <= WORTH * len(self.ids))):
                j = best[i]
                rows = self.orders[start[i, j] : end[i, j], focus[i, j]].astype(np.int64)
                inside = self.scaled[rows[:, None], focus[i]]
                rows = rows[((inside >= low[i]) & (inside <= high[i])).all(1)]
                if len(rows):
                    yield bound[i : i + 1], rows
        elif len(bound):
            whole.append(bound)
        together = np.concatenate(whole)
        if len(together):
            yield together, np.arange(len(self.ids))


class Best:
    """The ``k`` best rows of each of some groups: scores downwards, ties by smaller id."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = least.astype(np.int64).copy(), k
        self.group = self.score = self.id = np.empty(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[group]
        if not good.any():
            return
        group = np.concatenate([self.group, group[good]])
        score = np.concatenate([self.score, score[good]])
        ids = np.concatenate([self.id, ids[good]])
        order = np.lexsort((ids, ~score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, group, "left")
        rank = np.arange(len(group)) - first
        last = rank == self.k - 1
        self.least[group[last]] = np.maximum(self.least[group[last]], score[last])
        keep = rank < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _narrowed(queries: np.ndarray, width: int) -> np.ndarray:
    """Queries with the dimensions of a bucket: what either lacks is zero."""
    if queries.shape[1] >= width:
        return queries[:, :width]
    return np.pad(queries, ((0, 0), (0, width - queries.shape[1])))


def search_positives(best: Best, tile: dict, bucket: Bucket) -> None:
    """Rows of the anchor's label, but its own id."""
    mine = np.flatnonzero(np.isin(tile["labels"], bucket.known_labels))
    if not len(mine):
        return
    queries = _narrowed(tile["vectors"], bucket.vectors.shape[1])
    for some, rows in bucket.candidates(queries[mine], tile["lengths"][mine], best.least[mine].astype(np.float64)):
        some = mine[some]
        scores = products(queries[some], bucket.vectors[rows])
        fits = (tile["labels"][some, None] == bucket.labels[rows]) & (tile["ids"][some, None] != bucket.ids[rows])
        a, b = np.nonzero(fits & (scores >= best.least[some, None]))
        best.add(some[a], scores[a, b], bucket.ids[rows[b]])


def search_negatives(best: Best, tile: dict, bucket: Bucket) -> None:
    """Rows of other labels in the range of a positive's score; ``tile`` has the positives in order of anchors."""
    anchor, top = tile["anchor"], tile["most"]
    mine = np.unique(anchor)
    if bucket.one_label is not None:
        mine = mine[tile["labels"][mine] != bucket.one_label]
    if not len(mine):
        return
    queries = _narrowed(tile["vectors"], bucket.vectors.shape[1])
    need = np.full(len(tile["ids"]), np.inf)
    np.minimum.at(need, anchor, best.least.astype(np.float64))
    of = np.searchsorted(anchor, np.arange(len(tile["ids"]) + 1))
    for some, rows in bucket.candidates(queries[mine], tile["lengths"][mine], need[mine]):
        some = mine[some]
        scores = products(queries[some], bucket.vectors[rows])
        other = tile["labels"][some, None] != bucket.labels[rows]
        for k in range(int((of[some + 1] - of[some]).max(initial=0))):
            has = np.flatnonzero(of[some] + k < of[some + 1])
            group = of[some[has]] + k
            fits = (scores[has] >= best.least[group, None]) & (scores[has] <= top[group, None]) & other[has]
            a, b = np.nonzero(fits)
            best.add(group[a], scores[has[a], b], bucket.ids[rows[b]])


def least_of(positive: np.ndarray) -> np.ndarray:
    """The least whole number ``n`` with 50 * positive <= 100 * n."""
    return -(-positive // 2)


def most_of(positive: np.ndarray) -> np.ndarray:
    """The greatest whole number ``n`` with 100 * n <= 95 * positive, without leaving the range of a long."""
    return positive // 100 * 95 + positive % 100 * 95 // 100


def build(rows: DataFrame, every: int, k: int) -> DataFrame:
    """The index as a written table: buckets (kind 0) and tiles of anchors (kind 1).

    Rows are sorted by label and length over all tasks and cut into buckets, so most have one
    label. A tile's ``least`` holds what each anchor's own bucket has given as its k-th score.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = [0, 0]
        waiting: list[pa.RecordBatch] = []

        def record(kind: int, labels: np.ndarray, reach: float, **columns: np.ndarray) -> pa.RecordBatch:
            number[kind] += 1
            row = {
                "kind": kind, "id": (part << 32) + number[kind] - 1, "part": part, "rows": len(labels),
                "width": columns["vectors"].shape[1], "label_lo": int(labels.min()), "label_hi": int(labels.max()),
                "reach": reach, "labels": labels.tobytes(), "orders": b"", "least": b"",
            }
            row |= {c: np.ascontiguousarray(a).tobytes() for c, a in columns.items()}
            return pa.RecordBatch.from_pylist([row], _index_schema())

        def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, labels = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("vec_id", "label"))
            vectors = matrix(rows.column("v").combine_chunks())
            bucket = Bucket(ids, labels, vectors, np.empty(0))
            yield record(0, labels, bucket.longest, ids=ids, vectors=vectors, orders=bucket.orders)
            asked = np.flatnonzero(ids % every == 0)
            for lo in range(0, len(asked), TILE):
                some = asked[lo : lo + TILE]
                tile = {"ids": ids[some], "labels": labels[some], "vectors": vectors[some],
                        "lengths": np.linalg.norm(vectors[some].astype(np.float64), axis=1)}
                best = Best(np.full(len(some), _LEAST), k)
                search_positives(best, tile, bucket)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(best.least > 0, best.least / tile["lengths"], -np.inf).min()
                yield record(1, tile["labels"], float(reach), ids=tile["ids"], vectors=tile["vectors"], least=best.least)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting) if waiting else None
            while rows is not None and len(rows):
                sizes = rows.column("v").combine_chunks().value_lengths()
                width = max(1, max(sizes.to_pylist()))
                n = max(1, min(BUCKET, BUCKET_BYTES // (8 * width)))
                if len(rows) < n and not last:
                    break
                yield from made(rows.slice(0, n).combine_chunks())
                rows = rows.slice(n)
            waiting[:] = rows.to_batches() if rows is not None and len(rows) else []

        for batch in batches:
            waiting.append(batch)
            yield from cut(False)
        yield from cut(True)

    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    measured = rows.withColumn("length", length)
    ordered = measured.repartitionByRange("label", F.desc("length"), "vec_id").sortWithinPartitions(
        "label", F.desc("length"), "vec_id"
    )
    return staged(ordered.select("vec_id", "label", "v").mapInArrow(pack, _INDEX), "coordinate-lists")


def _index_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in _INDEX.split(", "))])


def slotted(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets with their ``slot``, and a row per slot: labels and largest length in it.

    A slot is a run of buckets that a task keeps in memory. There is a row here for every
    ``SLOT_BYTES`` of vectors at most, or for each of a few tasks' shares.
    """
    width = shuffle_width(index.sparkSession)
    buckets = index.filter("kind = 0")
    n, size = buckets.agg(F.count(F.lit(1)), F.sum(F.octet_length("vectors") + F.octet_length("orders"))).first()
    held = max(1, min(int(SLOT_BYTES // max(1, (size or 0) / max(1, n))), -(-n // (2 * width))))
    run = F.col("part") * (1 << 24) + F.floor(F.col("id").bitwiseAND(F.lit((1 << 32) - 1)) / held)
    buckets = buckets.withColumn("slot", run.cast("long"))
    slots = buckets.groupBy("slot").agg(
        F.min("label_lo").alias("slot_lo"), F.max("label_hi").alias("slot_hi"), F.max("reach").alias("longest")
    )
    numbered = slots.withColumn("number", F.row_number().over(Window.orderBy("slot")))
    return buckets, staged(numbered, "slots")


def _searched(tiles: DataFrame, buckets: DataFrame, slots: DataFrame, wanted, search, schema: str) -> DataFrame:
    """Every tile held against the slots that may matter to it, ``wanted`` by their bounds.

    Tiles and slots meet by their bounds alone; then a tile's vectors go to those slots once, and
    the task that keeps a slot's buckets streams through the tiles.
    """
    n = slots.count()
    heads = tiles.select("id", "label_lo", "label_hi", "reach")
    meetings = heads.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(max(n, 1))))).join(slots, "number")
    meetings = meetings.filter(wanted & (F.col("longest") >= F.col("reach") * (1 - 1e-9))).select("id", "slot")
    sent = tiles.join(meetings, "id")
    both = buckets.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition("slot").sortWithinPartitions("slot", "kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, kept = None, []
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["slot"] != slot:
                    slot, kept = row["slot"], []
                data = {"ids": _numbers(row["ids"]), "labels": _numbers(row["labels"])}
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(row["rows"], row["width"])
                if row["kind"] == 0:
                    orders = np.frombuffer(row["orders"], np.uint16).reshape(row["rows"], row["width"])
                    kept.append(Bucket(data["ids"], data["labels"], vectors, orders))
                else:
                    data |= {"vectors": vectors, "lengths": np.linalg.norm(vectors.astype(np.float64), axis=1)}
                    yield from search(row, data, kept)

    return dealt.mapInArrow(task, schema)


def positives(tiles: DataFrame, buckets: DataFrame, slots: DataFrame, k: int) -> DataFrame:
    """``id`` of the tile, ``at`` in it, ``place`` from 1, ``positive_id`` and ``score``, per anchor."""
    def search(row: dict, tile: dict, kept: list[Bucket]) -> Iterator[pa.RecordBatch]:
        best = Best(_numbers(row["least"]), k)
        for bucket in kept:
            search_positives(best, tile, bucket)
        if len(best.group):
            reach = least_of(best.score) / np.where(tile["lengths"] > 0, tile["lengths"], 1)[best.group]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(best.group), row["id"])), pa.array(best.group), pa.array(best.id),
                 pa.array(best.score), pa.array(reach)],
                names=["id", "at", "positive_id", "score", "reach"],
            )

    label = (F.col("label_lo") <= F.col("slot_hi")) & (F.col("label_hi") >= F.col("slot_lo"))
    found = _searched(tiles, buckets, slots, label, search, "id long, at long, positive_id long, score long, reach double")
    place = F.row_number().over(Window.partitionBy("id", "at").orderBy(F.desc("score"), "positive_id"))
    return staged(found.withColumn("place", place).filter(F.col("place") <= k), "positives")


def hard_negatives(
    embeddings: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Every
    row with an id divisible by ``every`` is an anchor of its own, also where ids repeat; rows
    with the anchor's id are not its positives, and rows that repeat count each. A shorter
    vector counts as filled with zeros. A pair without a fitting negative gives no row, so a
    positive of a score below zero gives none. Values beyond a long are held at its ends.
    """
    index = build(labelled(embeddings), every, n_positives)
    buckets, slots = slotted(index)
    tiles = index.filter("kind = 1")
    pos = positives(tiles, buckets, slots, n_positives)
    pairs = pos.filter("score >= 0").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("at", "place", "positive_id", "score"))).alias("pairs"),
        F.min("reach").alias("reach"),
    )
    asked = tiles.drop("reach").join(pairs, "id")

    def search(row: dict, tile: dict, kept: list[Bucket]) -> Iterator[pa.RecordBatch]:
        anchor, place, found, score = (np.array([p[c] for p in row["pairs"]], np.int64) for c in ("at", "place", "positive_id", "score"))
        tile |= {"anchor": anchor, "most": most_of(score)}
        best = Best(least_of(score), n_negatives)
        for bucket in kept:
            search_negatives(best, tile, bucket)
        at = best.group
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(len(at), row["id"]), anchor[at], place[at], tile["ids"][anchor[at]],
                                       found[at], best.id, score[at], best.score)],
                names=["id", "at", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
            )

    other = ~((F.col("label_lo") == F.col("label_hi")) & (F.col("slot_lo") == F.col("slot_hi")) & (F.col("label_lo") == F.col("slot_lo")))
    schema = "id long, at long, place long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _searched(asked, buckets, slots, other, search, schema)
    rank = F.row_number().over(Window.partitionBy("id", "at", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def labelled(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` (changed where the id is divisible by 7) and ``v`` of the rows that take part."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return quantised(embeddings.filter("label is not null"), moved.alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as materialized (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
