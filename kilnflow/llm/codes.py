"""Vector codes: parts of vectors as entries of trained codebooks, through a trie of the parts.

A vector is cut into equal parts; each part position has a codebook. The distinct parts of a
batch at one position, in lexicographic order, are a trie: its levels are the dimensions of a
part. The trie is walked depth first, and what a prefix has added to the squared distance to
each entry is handed down to everything below it, so parts that begin alike share that work.
A leaf takes the nearest entry and adds itself, times how often it occurs, to that entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.llm.common import staged, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors whose parts make one trie, and leaves below which a subtree is walked as one block.
TRIE_ROWS = 1 << 15
TRIE_BYTES = 32 << 20
LEAVES = 4096
#: Labels whose errors are broadcast; with more of them they are joined by shuffling.
FEW_LABELS = 100_000
#: Rows of one label are dealt to so many groups in that join.
SALTS = 64

_EXACT = 2.0**53
_MOST = np.iinfo(np.int64).max


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``x``, the vectors as doubles, of the rows that take part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    ).filter(F.col("x").isNotNull() & F.forall("x", finite))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x), a row per vector; a shorter one is filled with zeros.

    Values beyond 2^52 are held there.
    """
    sizes = np.diff(np.asarray(column.offsets))
    values = np.clip(np.floor(np.asarray(column.flatten(), np.float64) * 256), -(2.0**52), 2.0**52).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Trie:
    """The distinct rows of a matrix of whole numbers, in lexicographic order.

    ``counts`` has how often each occurs, ``of`` the leaf of every row, and ``opens`` the
    dimension in which a leaf first differs from the one before it.
    """

    def __init__(self, rows: np.ndarray) -> None:
        order = np.lexsort(rows.T[::-1])
        ranked = rows[order]
        differs = ranked[1:] != ranked[:-1]
        new = np.concatenate([[True], differs.any(1)])
        self.leaves = ranked[new]
        self.opens = np.concatenate([[0], differs.argmax(1)])[new]
        self.of = np.empty(len(rows), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.of)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of every leaf; ties to the lower index."""
        width = self.leaves.shape[1]
        largest = float(max(np.abs(self.leaves).max(initial=0), np.abs(entries).max(initial=0)))
        kind = np.float64 if 4 * width * (largest + 1) ** 2 < _EXACT else object
        leaves, entries = self.leaves.astype(kind), entries.astype(kind)
        best = np.empty(len(leaves), np.int64)
        far = np.empty(len(leaves), np.int64 if kind is np.float64 else object)
        todo = [(0, len(leaves), 0, np.zeros(len(entries), kind))]
        while todo:
            lo, hi, depth, shared = todo.pop()
            if hi - lo <= LEAVES or depth == width:
                sums = self._block(leaves, entries, lo, hi, depth, shared)
                best[lo:hi] = sums.argmin(1)
                far[lo:hi] = sums[np.arange(hi - lo), best[lo:hi]]
                continue
            starts = lo + np.flatnonzero(self.opens[lo:hi] <= depth)
            starts[0] = lo
            todo += reversed(self._children(leaves, entries, starts, hi, depth, shared))
        return best, far

    def sums(self, best: np.ndarray, entries: int) -> np.ndarray:
        """The leaves, times how often each occurs, summed by the entry that they took."""
        if float(np.abs(self.leaves).max(initial=0)) * len(self.of) < _EXACT:
            weighed = (self.leaves * self.counts[:, None]).astype(np.float64)
            return np.stack([np.bincount(best, w, entries) for w in weighed.T], 1).astype(np.int64).astype(object)
        out = np.zeros((entries, self.leaves.shape[1]), object)
        np.add.at(out, best, self.leaves.astype(object) * self.counts[:, None].astype(object))
        return out

    def _children(self, leaves, entries, starts, hi, depth, shared) -> list[tuple]:
        """The subtrees below a prefix: large ones alone and one level down, small ones in runs."""
        out, at, ends = [], 0, np.append(starts[1:], hi)
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + LEAVES, "right")))
            if ends[at] - starts[at] > LEAVES:
                down = shared + (leaves[starts[at], depth] - entries[:, depth]) ** 2
                out.append((starts[at], ends[at], depth + 1, down))
                to = at + 1
            else:
                out.append((starts[at], ends[to - 1], depth, shared))
            at = to
        return out

    def _block(self, leaves, entries, lo, hi, depth, shared) -> np.ndarray:
        """Distances of the leaves ``lo`` to ``hi`` to all entries, by levels from ``depth`` down."""
        opens = self.opens[lo:hi].copy()
        opens[0] = 0
        sums, parent = shared[None, :], np.zeros(hi - lo, np.int64)
        for d in range(depth, leaves.shape[1]):
            starts = np.flatnonzero(opens <= d)
            step = (leaves[lo + starts, d][:, None] - entries[:, d]) ** 2
            sums = sums[parent[starts]] + step
            parent = np.cumsum(opens <= d) - 1
        return sums[parent]


def _tries(batches: Iterator[pa.RecordBatch], width: int, column: int) -> Iterator[tuple[pa.Table, np.ndarray, list[Trie]]]:
    """The rows of a task in groups of bounded size, as numbers, with a trie per part position."""
    waiting: list[pa.RecordBatch] = []
    n = min(TRIE_ROWS, max(1, TRIE_BYTES // (8 * width)))

    def made() -> tuple[pa.Table, np.ndarray, list[Trie]]:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        data = whole_numbers(rows.column(column).combine_chunks(), width)
        return rows, data, [Trie(part) for part in np.split(data, PARTS, axis=1)]

    for batch in batches:
        for lo in range(0, batch.num_rows, n):
            waiting.append(batch.slice(lo, n))
            if sum(b.num_rows for b in waiting) >= n:
                yield made()
                waiting.clear()
    if waiting:
        yield made()


def _whole(number) -> int:
    return int(min(number, _MOST))


def trained(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks: part position, entry, dimension. ``vectors`` is what :func:`usable` gives.

    They begin as the parts of the ``ENTRIES`` smallest ids. A round reads the vectors once;
    each task sums its parts by entry, and only these sums are shuffled. The driver holds the
    codebooks alone.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    rows = whole_numbers(pa.array([r.x for r in first], pa.list_(pa.float64())), width)
    books = np.stack(np.split(rows, PARTS, axis=1))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shape = sent.value.shape
            total, times = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
            for _, _, tries in _tries(batches, width, 0):
                for p, trie in enumerate(tries):
                    best, _ = trie.nearest(sent.value[p])
                    total[p] += trie.sums(best, shape[1])
                    times[p] += np.bincount(best, trie.counts, shape[1]).astype(np.int64)
            part, entry = np.nonzero(times)
            if len(part):
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "times": times[part, entry],
                     "sums": pa.array([[str(s) for s in total[p, e]] for p, e in zip(part, entry)], pa.list_(pa.string()))}
                )

        per_task = vectors.select("x").mapInArrow(sums, "part int, entry int, times long, sums array<string>")
        added = per_task.groupBy("part", "entry").agg(
            F.sum("times").alias("times"),
            *(F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width // PARTS)),
        )
        books = books.copy()
        for row in added.collect():
            books[row["part"], row["entry"]] = [int(row[f"s{d}"]) // row["times"] for d in range(width // PARTS)]
        sent.unpersist()
    return books


def digest_of_books(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``vec_id``, ``label``, ``codes`` (an entry per part) and ``error`` (squared distance)."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, tries in _tries(batches, width, 2):
            codes, error = np.empty((len(data), PARTS), np.uint8), 0
            for p, trie in enumerate(tries):
                best, far = trie.nearest(sent.value[p])
                codes[:, p] = best[trie.of]
                error = error + far[trie.of]
            error = np.array([_whole(e) for e in error], np.int64) if error.dtype == object else error
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).combine_chunks(), rows.column(1).combine_chunks(),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["vec_id", "label", "codes", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(task, f"vec_id long, label {label}, codes binary, error long")


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that rows of codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(PARTS)], 1)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (written) with ``label_error``, the errors of all rows of its label summed.

    Nulls are one label. Sums are made per task first. The sums are broadcast after a count of
    them; beyond ``FEW_LABELS`` the rows of a label, which may be a third of all, are dealt to
    ``SALTS`` groups that each get the sum.
    """
    sums = staged(
        coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(
            F.col("label").alias("of"), F.least("sum", F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error")
        ),
        "label-errors",
    )
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), same).drop("of")
    many = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("group", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return dealt.join(many, same & (F.col("group") == F.col("salt"))).drop("of", "salt", "group")


def coded_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable row.

    Rows whose vector is null or holds a null or non-finite component are left out; null ids
    take part, after all others where the codebooks begin. Rows may repeat: each is coded, and
    counts. Vectors of different lengths are filled with zeros to a multiple of 16. Whole
    numbers beyond 2^52, errors and sums beyond a long are held at those bounds. No rows give
    no rows. Ids that repeat are ordered by their vectors.
    """
    vectors = usable(embeddings)
    longest = vectors.agg(F.max(F.size("x"))).first()[0]
    width = max(PARTS, -(-(longest or 0) // PARTS) * PARTS)
    if longest is None:
        books = np.zeros((PARTS, 1, 1), np.int64)
    else:
        books = trained(vectors, width)
    coded = staged(encoded(vectors, books, width), "codes")
    return with_label_error(coded).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(digest_of_books(books)).alias("codebooks_sha256"),
    )


def op12_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_vectors(table(spark, sf_dir, "embeddings"))


def _assigned(books: str) -> str:
    """Every part with the nearest entry of ``books`` and its distance."""
    return f"""
  select vec_id, p, v, arg_min(e, d * 64 + e) as e, min(d) as d from (
    select s.vec_id, s.p, s.v, b.e, list_sum(list_transform(range(1, len(s.v) + 1),
      lambda i: (s.v[i] - b.v[i]) * (s.v[i] - b.v[i])))::bigint as d
    from parts s join {books} b using (p)
  ) group by vec_id, p, v"""


def _moved(assigned: str, books: str) -> str:
    """``books`` with every used entry at the floor of its parts' means."""
    return f"""
  select p, e, coalesce(m.v, b.v) as v from {books} b left join (
    select p, e, list(floor(s / n)::bigint order by i) as v from (
      select p, e, i, sum(v[i]) as s, count(*) as n
      from (select p, e, v, unnest(range(1, len(v) + 1)) as i from {assigned}) group by p, e, i
    ) group by p, e
  ) m using (p, e)"""


OP12_SQL = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as v
  from kept, range({PARTS}) r(p)
), books0 as materialized (
  select p, e, v from (select vec_id, row_number() over (order by vec_id) - 1 as e from kept)
  join parts using (vec_id) where e < {ENTRIES}
), a0 as materialized ({_assigned("books0")}),
books1 as materialized ({_moved("a0", "books0")}),
a1 as materialized ({_assigned("books1")}),
books2 as materialized ({_moved("a1", "books1")}),
a2 as materialized ({_assigned("books2")}),
coded as (
  select vec_id, string_agg(printf('%02x', e::int), '' order by p) as code, sum(d)::bigint as error
  from a2 group by vec_id
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' order by p, e)) from books2) as codebooks_sha256
from coded join kept using (vec_id)
"""
