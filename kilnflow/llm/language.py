"""Language of documents by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams of one to three letters over every text
it is learned from, in order of frequency; words carry a boundary mark at both ends. A
document is compared by the out-of-place distance: how far each of its own most frequent
n-grams lies from its place in the profile, or the most if it is not there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnflow.llm.common import documents, label_of

#: N-grams of a profile and of a document.
PROFILE = 300
#: Languages at most: profiles travel to every task.
LANGUAGES = 2_000
UNKNOWN = "und"

#: Stands for the edge of a word; not a letter.
_EDGE = 1
_CODE_POINTS = 0x110000


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(_CODE_POINTS)), bool, _CODE_POINTS)


def grams(text: str | None, letter: np.ndarray) -> np.ndarray:
    """N-grams of one to three of a text, each as 63 bits, 21 for a code point."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = letter[codes]
    if not inside.any():
        return np.empty(0, np.int64)
    # One edge between words, and one at either end.
    after_letter = np.concatenate([[False], inside[:-1]])
    kept = np.where(inside, codes, _EDGE)[inside | after_letter]
    if kept[-1] != _EDGE:
        kept = np.append(kept, _EDGE)
    kept = np.concatenate([[_EDGE], kept])
    one = kept[kept != _EDGE] << 42
    two = kept[:-1] << 42 | kept[1:] << 21
    three = (kept[:-2] << 42 | kept[1:-1] << 21 | kept[2:])[kept[1:-1] != _EDGE]
    return np.concatenate([one, two, three])


def ranked(values: np.ndarray) -> np.ndarray:
    """The most frequent first, equal ones by code point."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) > PROFILE:
        least = np.partition(counts, -PROFILE)[-PROFILE]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))][:PROFILE]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang``, ``gram``, ``n`` of one task's texts."""
    letter = letters()
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merge(lang: str, parts: list[np.ndarray]) -> None:
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        if lang in totals:
            before, n = totals[lang]
            both, at = np.unique(np.concatenate([before, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n, counts])).astype(np.int64)
            found = both
        totals[lang] = found, counts

    for batch in batches:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = grams(text.as_py(), letter)
            waiting.setdefault(lang, []).append(new)
            sizes[lang] = sizes.get(lang, 0) + len(new)
            if sizes[lang] > 1_000_000:
                merge(lang, waiting.pop(lang))
                sizes[lang] = 0
        for lang, parts in waiting.items():
            merge(lang, parts)
    for lang, (found, counts) in totals.items():
        for lo in range(0, len(found), 10_000):
            part = slice(lo, lo + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found[part]), pa.string()), pa.array(found[part]), pa.array(counts[part])],
                names=["lang", "gram", "n"],
            )


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles of the languages in ``docs`` (``lang``, ``text``), over all of its texts.

    Rows without a language or a text teach nothing.
    """
    known = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(count_grams, "lang string, gram long, n long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = (
        counts.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", place)
        .filter(F.col("place") <= PROFILE)
    )
    rows = top.limit(LANGUAGES * PROFILE + 1).collect()
    if len(rows) > LANGUAGES * PROFILE:
        raise ValueError(f"more than {LANGUAGES} languages")
    profiles: dict[str, np.ndarray] = {}
    for lang in sorted({r.lang for r in rows}):
        mine = sorted((r.place, r.gram) for r in rows if r.lang == lang)
        profiles[lang] = np.array([g for _, g in mine], np.int64)
    return profiles


class Detector:
    """Profiles, made ready for look-up."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.langs = list(profiles)
        self.sorted = []
        for profile in profiles.values():
            order = np.argsort(profile)
            self.sorted.append((profile[order], order))
        self.letter = letters()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 minus the distance's share of the largest one; ties to the first name."""
        mine = ranked(grams(text, self.letter))
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        places = np.arange(len(mine))
        distances = []
        for keys, order in self.sorted:
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            away = np.where(keys[at] == mine, np.abs(order[at] - places), PROFILE)
            distances.append(int(away.sum()))
        best = int(np.argmin(distances))
        return self.langs[best], 1 - distances[best] / (PROFILE * len(mine))


def predicted(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every row, from its text alone.

    ``und`` and 0 where the text is null or has no letter, or where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value)
        for batch in batches:
            found = [detector.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, lang_pred string, score double"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = label_of(F.col("doc_id"), 4) == 2
    profiles = learn(docs.filter(~held_out))
    return predicted(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
