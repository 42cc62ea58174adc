"""Small helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.session import scratch_path, staged, table

__all__ = [
    "WHITE", "documents", "hash48", "label_of", "let", "repeated", "restored", "scratch_path", "shuffle_width",
    "source_key", "staged", "table", "unused", "word_count",
]

#: Blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with underscores until no column of ``taken`` has that name."""
    known = {c.lower() for c in taken}
    names = []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        names.append(name)
    return names


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that tells a null source from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def hash48(key: Column, salt: str | Column) -> Column:
    """48 bits of an MD5, as a long: the same in every engine."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), salt)
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def label_of(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the decimal id, modulo ``parts``: the folds the queries fix."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Copies of a row that are made from one array.
COPIES = 1 << 16


def repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Every row as often as its column ``times`` says, numbered from 1 in ``number``.

    Made in pieces of bounded size, so that the count may be any long.
    """
    (piece,) = unused([*rows.columns, number], "_piece")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))
    pieces = rows.filter(F.col(times) > 0).withColumn(piece, F.explode(blocks))
    left = F.least(F.col(times) - F.col(piece) * COPIES, F.lit(COPIES))
    within = F.explode(F.sequence(F.lit(1).cast("long"), left.cast("long")))
    return pieces.withColumn(number, within).withColumn(number, F.col(number) + F.col(piece) * COPIES).drop(piece)


def restored(docs: DataFrame, plan: DataFrame, keys: dict[str, Column], times: str) -> DataFrame:
    """Rows of ``docs`` that ``plan`` names, each ``times`` times, with their own columns only.

    ``plan`` has the columns of ``keys`` and ``times``, and one row per combination. Keys
    compare null to null; the names in ``plan`` may clash with those of ``docs``.
    """
    names = unused([*docs.columns, *plan.columns], *(f"_{k}" for k in keys), f"_{times}")
    renamed = plan.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(times).alias(names[-1])
    )
    mine = unused([*docs.columns, *names], *(f"_my{k}" for k in keys))
    left = docs.withColumns(dict(zip(mine, keys.values())))
    condition = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(mine, names)]
    joined = left.join(renamed, condition, "inner")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return repeated(joined.select(*columns, names[-1]), names[-1], mine[0]).select(*columns)
