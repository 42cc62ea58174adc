"""Exact de-duplication against a persistent index of digests.

The index is a Parquet table of one row per distinct text, bucketed and sorted by digest. A
batch is reduced to its distinct digests, held against the index by a sort-merge anti-join
that moves no index row, and what is new is appended. Decisions are read from the index, so
a batch that is run again after a failure appends nothing and decides the same.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.llm.common import WHITE, documents, repeated, restored, scratch_path, shuffle_width, staged


def digest(text: Column) -> Column:
    """SHA-256, 32 bytes, of the text without white space; null counts as empty."""
    bare = reduce(
        lambda t, w: F.replace(t, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit(""))
    )
    return F.unhex(F.sha2(bare, 256))


def points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


@dataclass(frozen=True)
class DigestIndex:
    """An index opened in this session: ``digest``, ``keep_id``, ``n_points``."""

    spark: SparkSession
    name: str

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table's name out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id", "n_points").write.insertInto(self.name)


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """Open the index below ``path``, or a new one in the shared folder.

    ``buckets`` belongs to the index for its whole life (the session's shuffle partitions
    by default): with as many shuffle partitions, a batch meets it without moving it.
    """
    path = path or scratch_path(spark, "digest-index")
    name = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, n_points BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets or shuffle_width(spark)} BUCKETS "
        f"LOCATION '{path}'"
    )
    return DigestIndex(spark, name)


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Add a batch to the index and decide on each of its rows.

    Of equal new texts the row with the most code points stays, then the smallest
    ``doc_id``; a text the index has from an earlier batch stays with that batch's row. The
    result has one row per distinct (``digest``, ``doc_id``, ``n_points``) with ``copies``
    (identical rows; the first of them is the one that may stay), ``group_size`` (rows of
    this batch with the text), ``keep_id`` and ``kept``. A null ``doc_id`` comes after all
    others. Equal rows are summed before any shuffle by digest, so a text that a third of
    the rows share reaches its task as one row per map task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        points(F.col("text")).alias("n_points"),
        digest(F.col("text")).alias("digest"),
    )
    copies = staged(
        rows.groupBy("digest", "doc_id", "n_points").agg(F.count(F.lit(1)).alias("copies")),
        "digest-rows",
    )
    # The complement orders ids downwards without overflow.
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("down"))).alias("best")
    # Written, because the optimizer would move the anti-join below the sums otherwise.
    groups = staged(
        copies.groupBy("digest").agg(best, F.sum("copies").alias("group_size")), "digest-groups"
    )
    new = groups.join(index.read().hint("merge"), "digest", "left_anti")
    index.append(
        new.select(
            "digest",
            F.bitwise_not("best.down").alias("keep_id"),
            F.col("best.n_points").alias("n_points"),
        )
    )
    known = index.read().select("digest", "keep_id", F.col("n_points").alias("keep_points"))
    verdict = staged(
        groups.select("digest", "group_size").join(known.hint("merge"), "digest"), "digest-verdicts"
    )
    return copies.join(verdict, "digest").select(
        "digest",
        "doc_id",
        "n_points",
        "copies",
        "group_size",
        "keep_id",
        (
            F.col("doc_id").eqNullSafe(F.col("keep_id"))
            & (F.col("n_points") == F.col("keep_points"))
        ).alias("kept"),
    )


def _decided(docs: DataFrame, index: DigestIndex | None) -> DataFrame:
    """:func:`ingest` with the given index, or with one that is for this batch alone."""
    if index is not None:
        return ingest(docs, index)
    own = open_index(docs.sparkSession)
    try:
        return ingest(docs, own)
    finally:
        own.close()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: which row of its text stays.

    ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Of identical rows one
    is kept. Null and empty texts are one text; other columns are not looked at.
    """
    return repeated(_decided(docs, index), "copies", "copy").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("kept") & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are shuffled once, by digest and id together, which no group makes uneven.
    """
    decided = _decided(docs, index)
    keepers = staged(
        decided.filter("kept").select("digest", "doc_id", "n_points", "copies"), "digest-keepers"
    )
    keys = {
        "digest": digest(F.col("text")),
        "doc_id": F.col("doc_id").cast("long"),
        "n_points": points(F.col("text")),
    }
    once = F.lit(1).alias("times")
    equal = keepers.filter("copies > 1")
    if equal.isEmpty():
        return restored(docs, keepers.select(*keys, once), keys, "times")
    single = restored(docs, keepers.filter("copies = 1").select(*keys, once), keys, "times")
    # Identical rows: any one of them, chosen by value.
    several = restored(docs, equal.select(*keys, once), keys, "times")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = several.groupBy(
        digest(F.col("text")).alias("d"), F.col("doc_id").alias("i"), points(F.col("text")).alias("p")
    ).agg(F.min_by(row, F.struct("text", F.md5(F.to_json(row)))).alias("row"))
    return single.unionByName(first.select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP10_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents
), g as (
  select *, first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id,
    count(*) over (partition by h) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from g
"""
