"""Exact top-k search by inner product, block at a time.

Every dimension of a vector is a term. Vectors are put in an order that keeps like ones
together, and cut into document-range blocks; a block's forward index is its matrix, and it
keeps the largest and smallest value of every term. For a query the terms' best
contributions, summed, bound every score of a block. Blocks are taken in order of that bound
and scored through their forward indexes until it falls below the k-th score so far, which
starts from what the query's own neighbourhood gave when the index was built.

Many queries go through a block together: one matrix product over the leading terms, with the
length of the others as one more term and the k-th score as another, is nowhere below zero
where a vector can matter; only those pairs get their other terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnflow.llm.common import shuffle_width, staged, table

K = 5
EVERY = 50
#: Vectors of a block; blocks are kept in packs of about so many vectors or bytes.
BLOCK = 256
PACK_ROWS = 4096
PACK_BYTES = 4 << 20
#: Queries that meet a pack together, and those that meet a block in one product.
TILE = 16384
ROWS = 1024
#: Bytes of queries that a task holds.
GROUP_BYTES = 16 << 20
#: From so many vectors on, one pack in ``FIRST`` meets the queries before the others do.
ROUND_ROWS = 1 << 18
FIRST = 16
#: A pair that passes the leading terms costs about as much as so many terms of a product.
PASSING = 4000
#: Sampled vectors that order the others. They affect speed alone.
PIVOTS = 64
#: Sums of products below this are exact in floating point.
_EXACT = 2.0**53
_LEAST = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def quantised(embeddings: DataFrame, *others: Column) -> DataFrame:
    """``vec_id``, ``others`` and ``v``: floor(256 x) of every component.

    Rows with a null id, a null vector, or a null or non-finite component are left out.
    Values beyond a long are held at its ends.
    """
    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), *others, x.alias("x"))
    return rows.filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", usable)
    ).withColumn("v", F.transform("x", lambda c: F.floor(c * 256))).drop("x")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column; shorter vectors are filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, over the dimensions both have."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max())
    if largest * width < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Summed best contributions of all terms, per query and block, never too small.

    Floating numbers are given where their sums are exact.
    """
    if queries.dtype.kind == "f":
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    up = products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)
    largest = np.abs(queries.astype(float)).sum(1, initial=0)[:, None] * max(
        1.0, float(np.abs(high.astype(float)).max(initial=0)), float(np.abs(low.astype(float)).max(initial=0))
    )
    # Where a sum might leave the range of a long, nothing is pruned.
    return np.where(largest < 2.0**62, up, np.iinfo(np.int64).max)


class Best:
    """The k best of each of some queries: scores downwards, ties by smaller id.

    What is worse than the score ``least`` with the id ``last`` is left out.
    """

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int, last: np.ndarray | None = None) -> None:
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), _LEAST)
        self.found = np.full((len(ids), k), -1)
        self.filled = np.zeros((len(ids), k), bool)
        self.least = least.copy()
        self.last = np.full(len(ids), _LAST) if last is None else last.copy()
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0
        self.asked: Asked | None = None

    def add(self, some: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> None:
        """``hits``: places in ``some``, the queries, and in ``ids``, the candidates, and scores."""
        query, found, scores = some[hits[0]], ids[hits[1]], hits[2]
        least = self.least[query]
        open_ = (scores > least) | ((scores == least) & (found <= self.last[query]))
        open_ &= found != self.ids[query]
        self.waiting.append((query[open_], scores[open_], found[open_]))
        self.many += len(self.waiting[-1][0])
        if self.many > max(len(self.ids), 4096):
            self.settle()

    def settle(self) -> None:
        """Take up what waits."""
        if not self.waiting:
            return
        query, scores, found = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.many = [], 0
        touched = np.zeros(len(self.ids), bool)
        touched[query] = True
        held, place = np.nonzero(self.filled & touched[:, None])
        query = np.concatenate([query, held])
        scores = np.concatenate([scores, self.scores[held, place]])
        found = np.concatenate([found, self.found[held, place]])
        order = np.lexsort((found, ~scores, query))
        query, scores, found = query[order], scores[order], found[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
        kept = place < self.k
        query, scores, found, place = query[kept], scores[kept], found[kept], place[kept]
        self.scores[query, place], self.found[query, place], self.filled[query, place] = scores, found, True
        worst = place == self.k - 1
        self.least[query[worst]], self.last[query[worst]] = scores[worst], found[worst]


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Whole numbers, none below the length of its row."""
    return np.ceil(np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9))


class Asked:
    """Queries, made ready once for the packs they meet: floating, the terms with most weight first."""

    def __init__(self, queries: np.ndarray) -> None:
        self.queries, self.longest = queries, _lengths(queries).max(initial=0)
        self.order = np.argsort(-(queries.astype(np.float64) ** 2).sum(0), kind="stable")
        self.leading = queries.shape[1]
        self.key: tuple | None = None

    def ready(self, kind: type, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of ``width`` terms, and the terms."""
        if self.key != (kind, width):
            self.key, self.within, self.part = (kind, width), self.order[self.order < width], None
            self.terms = np.ascontiguousarray(self.queries[:, self.within], kind)
        return self.within, self.terms

    def parted(self, n: int) -> np.ndarray:
        """The first ``n`` terms, the length of the others if there are any, and room for the k-th score."""
        if self.part is None or self.leading != n:
            rest = n < self.terms.shape[1]
            self.leading, self.part = n, np.empty((len(self.terms), n + rest + 1), self.terms.dtype)
            self.part[:, :n] = self.terms[:, :n]
            if rest:
                self.part[:, n] = _lengths(self.terms[:, n:])
        return self.part


def _leading(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, now: int) -> int:
    """How many terms to take first, by what a few of the queries and vectors need; ``now`` if it is nearly as good."""
    width = queries.shape[1]
    if len(queries) * len(vectors) < 1 << 22:
        return width
    some = np.linspace(0, len(queries) - 1, 64).astype(int)
    a, b, least = queries[some], vectors[np.linspace(0, len(vectors) - 1, 256).astype(int)], least[some, None]
    costs = {width: width}
    for n in range(8, width, 8):
        bound = a[:, :n] @ b[:, :n].T + _lengths(a[:, n:])[:, None] * _lengths(b[:, n:])
        costs[n] = n + 1 + PASSING * (bound >= least).mean()
    if now in costs:
        costs[now] *= 0.9
    return min(costs, key=costs.__getitem__)


def _places(flags: np.ndarray) -> np.ndarray:
    """Places of the few true ones; eight are looked at in one."""
    flags = flags.reshape(-1)
    whole = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    word, byte = np.nonzero(flags[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + byte, whole + np.flatnonzero(flags[whole:])])


def scorer(best: Best, queries: np.ndarray, pack: dict) -> tuple[np.ndarray, Callable]:
    """Bounds by query and block, and what gives the pairs of some queries and a block that can matter.

    Whole numbers up to 2^24 are exact in single precision, those up to 2^53 in double. Three
    times the product of the lengths is more than any sum on the way.
    """
    if best.asked is None or best.asked.queries is not queries:
        best.asked = Asked(queries)
    asked = best.asked
    width = min(queries.shape[1], pack["vectors"].shape[1])
    vectors, low, high = (pack[c][:, :width] for c in ("vectors", "low", "high"))
    longest = _lengths(np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64)))).max(initial=0)
    most = (asked.longest + 2) * (longest + 2)
    if most >= 2.0**51:
        queries, vectors, low, high = (x.astype(np.int64) for x in (queries[:, :width], vectors, low, high))

        def slowly(some: np.ndarray, part: slice) -> tuple:
            scores = products(queries[some], vectors[part])
            row, column = np.nonzero(scores >= best.least[some, None])
            return row, column, scores[row, column]

        return bounds(queries, low, high), slowly
    kind = np.float32 if most < 2.0**22 else np.float64
    order, a = asked.ready(kind, width)
    b = np.ascontiguousarray(vectors[:, order], kind)
    n = _leading(a, b, best.least, asked.leading)
    mine, theirs, rest = asked.parted(n), [b[:, :n], np.ones((len(b), 1), kind)], n < width
    if rest:
        theirs.insert(1, _lengths(b[:, n:]).astype(kind)[:, None])
    theirs = np.ascontiguousarray(np.hstack(theirs))
    # Written over and over: fresh memory costs as much as the product.
    room = np.empty((ROWS, mine.shape[1]), kind), np.empty(ROWS * BLOCK, kind), np.empty(ROWS * BLOCK, bool)

    def reach(some: np.ndarray, part: slice) -> tuple:
        right = theirs[part]
        n_pairs = len(some), len(right)
        if some[-1] - some[0] < len(some):
            left = mine[some[0] : some[-1] + 1]
        else:
            left = np.take(mine, some, axis=0, out=room[0][: len(some)], mode="clip")
        left[:, -1] = -np.clip(best.least[some], -int(most), int(most))
        over = np.matmul(left, right.T, out=room[1][: math.prod(n_pairs)].reshape(n_pairs))
        flat = _places(np.greater_equal(over, 0, out=room[2][: over.size].reshape(n_pairs)))
        row, column = np.divmod(flat, over.shape[1])
        scores = over.reshape(-1)[flat] - left[row, -1]
        if rest and len(flat):
            scores += np.einsum("ij,ij->i", a[some[row], n:], b[part][column, n:]) - left[row, n] * right[column, n]
            close = scores >= -left[row, -1]
            row, column, scores = row[close], column[close], scores[close]
        return row, column, scores.astype(np.int64)

    return bounds(a, low[:, order].astype(kind), high[:, order].astype(kind)), reach


def search(best: Best, queries: np.ndarray, pack: dict) -> None:
    """Score the blocks of a pack for each query, highest bound first, while it can still matter.

    Up to ``ROWS`` queries, neighbours as their packs are, take the blocks in one order.
    """
    bound, reach = scorer(best, queries, pack)
    everyone = np.arange(len(queries))
    for at in range(0, len(queries), ROWS):
        those = slice(at, at + ROWS)
        for b in np.argsort(-bound[those].mean(0), kind="stable"):
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            some, alive = everyone[those], bound[those, b] >= best.least[those]
            # Leaving out a few queries costs more than it spares.
            if alive.mean() < 0.8:
                some = some[alive]
            if not len(some):
                continue
            hits = reach(some, part)
            if len(hits[0]):
                best.add(some, hits, pack["ids"][part])
    best.settle()


_QUERIES = "pack long, width int, query_ids binary, queries binary, least binary, last binary"
_PACK = _QUERIES + ", ids binary, vectors binary, low binary, high binary"


def _stored(values: np.ndarray) -> np.ndarray:
    """In two bytes where they do."""
    small = np.iinfo(np.int16)
    fits = not values.size or (values.min() >= small.min and values.max() <= small.max)
    return values.astype(np.int16) if fits else values


def _restored(stored: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.int16 if len(stored) == 2 * rows * width else np.int64
    return np.frombuffer(stored, kind).reshape(rows, width)


def pack_rows(ids: np.ndarray, vectors: np.ndarray, every: int, k: int) -> dict:
    """The blocks of consecutive vectors, and the queries among them with what they found here."""
    cuts = range(0, len(ids), BLOCK)
    order = np.concatenate([c + np.argsort(ids[c : c + BLOCK], kind="stable") for c in cuts])
    ids, vectors = ids[order], vectors[order]
    pack = {
        "ids": ids,
        "vectors": vectors,
        "low": np.array([vectors[c : c + BLOCK].min(0) for c in cuts]).reshape(len(cuts), -1),
        "high": np.array([vectors[c : c + BLOCK].max(0) for c in cuts]).reshape(len(cuts), -1),
    }
    asked = np.flatnonzero(ids % every == 0)
    best = Best(ids[asked], np.full(len(asked), _LEAST), k)
    search(best, vectors[asked], pack)
    return pack | {"query_ids": ids[asked], "queries": vectors[asked], "least": best.least, "last": best.last}


def quantised_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """:func:`quantised` of ``vec_id`` and ``x``, doubles; neither is null."""
    column = batch.column(1)
    sizes, values = np.diff(np.asarray(column.offsets)), column.flatten()
    x = np.asarray(values.fill_null(np.nan), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.ones(len(sizes), bool)
    good[row[~np.isfinite(x)]] = False
    kept = good[row]
    with np.errstate(over="ignore"):
        x = np.floor(x[kept] * 256)
    inside = np.abs(x) < 2.0**63
    v = np.where(inside, np.where(inside, x, 0).astype(np.int64), np.where(x > 0, _LAST, _LEAST))
    offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64()))], names=["vec_id", "v"]
    )


def build(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """The index as a written table of packs."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(PIVOTS).toArrow()
    pivots = [matrix(quantised_batch(b).column(1)) for b in sample.combine_chunks().to_batches()]
    pivots = pivots[0].astype(np.float64) if pivots else np.zeros((0, 0))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(quantised_batch, batches):
            rows = matrix(batch.column(1)).astype(np.float64)
            width = min(rows.shape[1], pivots.shape[1])
            near = (rows[:, :width] @ pivots[:, :width].T).argmax(1) if len(rows) and len(pivots) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["vec_id", "v", "near"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def packs(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting
            rows = pa.Table.from_batches(waiting).combine_chunks() if waiting else None
            while rows is not None and len(rows):
                width = max(1, int(np.diff(np.asarray(rows.column("v").combine_chunks().offsets)).max()))
                n = min(PACK_ROWS, max(BLOCK, PACK_BYTES // (8 * width)))
                # A small rest goes with the last pack.
                if len(rows) < n + n // 2:
                    if not last:
                        break
                    n = len(rows)
                part = rows.slice(0, n).combine_chunks()
                rows = rows.slice(n)
                data = matrix(part.column("v").combine_chunks())
                made = pack_rows(np.asarray(part.column("vec_id"), np.int64), data, every, k)
                made |= {c: _stored(made[c]) for c in ("vectors", "low", "high", "queries")}
                yield pa.RecordBatch.from_pylist(
                    [{"pack": number, "width": data.shape[1]} | {c: np.ascontiguousarray(a).tobytes() for c, a in made.items()}],
                    _schema(_PACK),
                )
                number += 1
            waiting = rows.to_batches() if rows is not None and len(rows) else []

        for batch in batches:
            waiting.append(batch)
            yield from packs(False)
        yield from packs(True)

    ordered = vectors.mapInArrow(locate, "vec_id long, v array<long>, near int")
    ranged = ordered.repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
    return staged(ranged.mapInArrow(pack, _PACK), "vector-packs")


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in columns.split(", "))])


def grid(cells: int, vectors: int, queries: int, group: int) -> tuple[int, int]:
    """Groups of queries and slots of packs: about so many pairs, and the fewest bytes copied.

    ``vectors`` and ``queries`` are what a copy of them costs; ``group``: fewest groups.
    """
    groups = max(1, group, round(math.sqrt(cells * queries / max(1, vectors))))
    return groups, max(1, math.ceil(cells / groups))


def meet(packs: DataFrame, tiles: DataFrame, groups: int, slots: int, k: int) -> DataFrame:
    """What the vectors of ``packs`` give the queries of ``tiles``: for each query, the k best of every slot.

    A cell of the grid is a task: it holds its group of queries and streams through the packs
    of its slot. Each pack is sent once for every group, each query once for every slot.
    """
    def part(of: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("pack", F.lit(seed)), F.lit(of)).cast("int")

    def cell(group: Column, slot: Column) -> Column:
        return (group * slots + slot).cast("int").alias("cell")

    def each(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    nothing = F.lit(None).cast("binary")
    asking = tiles.withColumn("slot", each(slots)).select(
        cell(part(groups, 1), F.col("slot")), "pack", "width", F.col("query_ids").alias("ids"),
        F.col("queries").alias("vectors"), "least", "last", nothing.alias("low"), nothing.alias("high"),
    )
    asked = packs.withColumn("group", each(groups)).select(
        cell(F.col("group"), part(slots, 2)), "pack", "width", "ids", "vectors",
        nothing.alias("least"), nothing.alias("last"), "low", "high",
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[dict]] = {}
        tiles: list[tuple] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], np.int64)
                row |= {"ids": ids, "vectors": _restored(row["vectors"], len(ids), row["width"])}
                if row["least"] is not None:
                    held.setdefault((row["width"], row["vectors"].dtype.str), []).append(row)
                    continue
                tiles = tiles if tiles is not None else [t for rows in held.values() for t in _tiles(rows, k)]
                blocks = -(-len(ids) // BLOCK)
                row |= {c: _restored(row[c], blocks, row["width"]) for c in ("low", "high")}
                for _, _, queries, best in tiles:
                    search(best, queries, row)
        for pack, place, _, best in tiles or []:
            at, rank = np.nonzero(best.filled)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (pack[at], place[at], best.ids[at], best.found[at, rank], best.scores[at, rank])],
                names=["pack", "at", "query_id", "vec_id", "score"],
            )

    cells = asking.union(asked).repartitionById(groups * slots, "cell").sortWithinPartitions(F.col("least").isNull())
    return cells.mapInArrow(score, "pack long, at long, query_id long, vec_id long, score long")


def _tiles(rows: list[dict], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Best]]:
    """Packs and places of queries, the queries, and their best; rows of one width and kind."""
    rows = sorted(rows, key=lambda r: r["pack"])
    while rows:
        ends = np.cumsum([len(r["ids"]) for r in rows])
        n = max(1, int(np.searchsorted(ends, TILE, "right")))
        part, rows = rows[:n], rows[n:]
        least, last = (np.concatenate([np.frombuffer(r[c], np.int64) for r in part]) for c in ("least", "last"))
        yield (
            np.concatenate([np.full(len(r["ids"]), r["pack"]) for r in part]),
            np.concatenate([np.arange(len(r["ids"])) for r in part]),
            np.concatenate([r["vectors"] for r in part]),
            Best(np.concatenate([r["ids"] for r in part]), least, k, last),
        )


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every query's row, with their ``rank``."""
    place = F.row_number().over(Window.partitionBy("pack", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def raised(tiles: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``tiles`` whose queries know the last of the ``k`` rows already found for them."""
    known = found.filter(F.col("rank") == k).groupBy("pack").agg(F.collect_list(F.struct("at", "score", "vec_id")).alias("known"))

    def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                known = row.pop("known") or []
                at = [x["at"] for x in known]
                for name, value in (("least", "score"), ("last", "vec_id")):
                    new = np.frombuffer(row[name], np.int64).copy()
                    new[at] = [x[value] for x in known]
                    row[name] = new.tobytes()
                yield pa.RecordBatch.from_pylist([row], _schema(_QUERIES))

    return tiles.join(known, "pack", "left").mapInArrow(raise_, _QUERIES)


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The ``k`` best other rows of each query, a row whose ``vec_id`` is divisible by ``every``.

    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; fewer where there are fewer. Rows
    with the query's own id are not candidates. Where ids repeat, every row is a query with
    ranks of its own, and a candidate of its own. A shorter vector counts as filled with zeros.

    Queries meet packs of blocks on a grid. In a large table a few of the packs come first, so that
    the queries go to the others with a k-th score that few vectors reach.
    """
    spark = embeddings.sparkSession
    index = build(embeddings, every, k)
    packs = index.select("pack", "width", "ids", "vectors", "low", "high")
    tiles = index.filter(F.octet_length("query_ids") > 0).select(*(f.split()[0] for f in _QUERIES.split(", ")))
    octets = {c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in ("ids", "vectors", "query_ids", "queries")}
    total = index.agg(*octets.values()).first()
    group = math.ceil(total.queries / GROUP_BYTES)
    tasks = shuffle_width(spark)
    # Half the partitions where there are many: a copy costs more than the last tasks' idle cores.
    cells, queries = max(min(tasks, 64), tasks // 2), total.queries + 3 * total.query_ids
    vectors, count = total.vectors + total.ids, total.query_ids // 8
    if total.ids // 8 < ROUND_ROWS:
        return ranked(meet(packs, tiles, *grid(cells, vectors, queries, group), k), k).select(
            "query_id", "rank", "vec_id", "score"
        )
    first = F.pmod(F.xxhash64("pack", F.lit(3)), F.lit(FIRST)) == 0
    # Here every slot finds rows for every query: a row is worth hundreds of bytes moved.
    shape = grid(max(min(tasks, 64), tasks // 4), vectors // FIRST, queries + 256 * k * count, group)
    before = staged(ranked(meet(packs.filter(first), tiles, *shape, k), k), "first-found")
    after = meet(packs.filter(~first), raised(tiles, before, k), *grid(cells, vectors, queries, group), k)
    return ranked(before.drop("rank").union(after), k).select("query_id", "rank", "vec_id", "score")


def op8_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
  from s
)
select * from r where rank <= 5
"""
