"""Quality of documents: random-indexing word vectors, pooled, into a small calibrated network.

Every word has a random index vector of a few plus and minus ones. The vector of a word is
the sum of its own and its neighbours' index vectors over all of the corpus; words share
2^14 hashed rows, so the table has one size for every corpus and each task can hold it. A
document is the mean of its words' vectors, plain and with frequent words weighed down. A
two-layer network on that is trained on a bounded sample of labelled documents and its
probabilities are calibrated by one temperature on a part of the sample it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.llm.common import documents, hash48, label_of, table, unused
from kilnflow.llm.tokens import WordHasher, mixed, summed

#: Hashed rows of the word table, and its width.
ROWS = 1 << 14
WIDTH = 32
#: Ones in an index vector, and neighbours to each side.
ONES = 2
WINDOW = 2
#: Labelled documents the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN = 32
#: Two means, two measures of length, one of repetition.
INPUTS = 2 * WIDTH + 3
EPOCHS = 60
THRESHOLD = 0.3


def _ones(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of the index vectors."""
    out = []
    for k in range(ONES):
        bits = hashes >> np.uint64(16 + 8 * k)
        place = (bits % np.uint64(WIDTH)).astype(np.int64)
        sign = ((bits >> np.uint64(7)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out.append((place, sign))
    return out


def _rows(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes, 1) % np.uint64(ROWS)).astype(np.int64)


def context_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The word table of some texts: ``WIDTH`` context sums and the count of each row."""
    hasher = WordHasher(symbols=True)
    contexts = np.zeros(ROWS * WIDTH)
    counts = np.zeros(ROWS)
    for batch in batches:
        for _, hashes, offsets in hasher.pieces(batch.column(0)):
            if not len(hashes):
                continue
            rows = _rows(hashes)
            counts += np.bincount(rows, minlength=ROWS)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            at, signs = [], []
            for place, sign in _ones(hashes):
                at.append(rows * WIDTH + place)
                signs.append(sign)
                for o in range(1, WINDOW + 1):
                    near = text[o:] == text[:-o]
                    at += [(rows[:-o] * WIDTH + place[o:])[near], (rows[o:] * WIDTH + place[:-o])[near]]
                    signs += [sign[o:][near], sign[:-o][near]]
            contexts += np.bincount(
                np.concatenate(at), weights=np.concatenate(signs), minlength=ROWS * WIDTH
            )
    return np.concatenate([contexts, counts]).round()


@dataclass
class WordTable:
    """Vectors and weights of the hashed rows."""

    vectors: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(sums: np.ndarray) -> WordTable:
        contexts, counts = sums[: ROWS * WIDTH].reshape(ROWS, WIDTH), sums[ROWS * WIDTH :]
        vectors = contexts / np.maximum(counts, 1)[:, None]
        seen = counts > 0
        if seen.any():
            vectors[seen] -= vectors[seen].mean(0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        weights = 1e-3 / (1e-3 + counts / max(counts.sum(), 1))
        return WordTable(vectors.astype(np.float32), weights.astype(np.float32))

    def pool(self, texts: pa.Array) -> np.ndarray:
        """One row per text: weighed mean, plain mean, likeness of neighbours, and two measures of length.

        A text without words has zeros.
        """
        out = np.zeros((len(texts), INPUTS), np.float32)
        hasher = WordHasher(symbols=True)
        for first, hashes, offsets in hasher.pieces(texts):
            sizes = np.diff(offsets)
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            rows = _rows(hashes)
            for lo in range(0, len(filled), 64):
                some = filled[lo : lo + 64]
                begin, end = offsets[some[0]], offsets[some[-1] + 1]
                part = rows[begin:end]
                cuts = offsets[some] - begin
                vectors, weights = self.vectors[part], self.weights[part]
                alike = np.zeros(len(part), np.float32)
                alike[1:] = np.einsum("ij,ij->i", vectors[1:], vectors[:-1])
                alike[cuts] = 0
                n = sizes[some][:, None].astype(np.float32)
                total = np.add.reduceat(weights, cuts)[:, None]
                to = first + some
                out[to, :WIDTH] = np.add.reduceat(vectors * weights[:, None], cuts) / total
                out[to, WIDTH : 2 * WIDTH] = np.add.reduceat(vectors, cuts) / n
                out[to, 2 * WIDTH] = np.log1p(n[:, 0])
                out[to, 2 * WIDTH + 1] = total[:, 0] / n[:, 0]
                out[to, 2 * WIDTH + 2] = np.add.reduceat(alike, cuts) / n[:, 0]
        return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh, a logistic output and its temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Train by Adam on four fifths of the rows, calibrate on the rest.

    With one class or no rows the network gives the smoothed share of label 1 everywhere.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN),
                   np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = np.split(order, [len(y) // 5])
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-6
    params = [
        rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([flat.b2]),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, step = (x - mean) / scale, 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for rows in np.array_split(train, max(1, len(train) // 128)):
            w1, b1, w2, b2 = params
            hidden = np.tanh(z[rows] @ w1 + b1)
            error = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30))) - y[rows]
            back = error[:, None] * w2 * (1 - hidden**2)
            n = len(rows)
            grads = [
                z[rows].T @ back / n + 1e-4 * w1, back.mean(0),
                hidden.T @ error / n + 1e-4 * w2, np.array([error.mean()]),
            ]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                slope = first[i] / (1 - 0.9**step)
                params[i] = params[i] - 0.003 * slope / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held):
        logits = net.logits(x[held])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t))

        net.temperature = float(min(np.geomspace(0.5, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame) -> tuple[WordTable, Network]:
    """Word table over every text of ``docs``, network over a bounded sample of the labelled ones.

    ``labels`` has ``doc_id`` and ``quality``. A document labelled more than once counts as 1
    if most of its labels are; null ids and labels are left out. The sample is the
    ``SAMPLE`` documents smallest by a hash of their id.
    """
    words = WordTable.of(summed(docs.select("text"), ROWS * (WIDTH + 1), context_counts))
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .orderBy(hash48(F.col("labelled"), "sample"), "labelled")
        .limit(SAMPLE)
    )
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(shared.value.pool(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float32()))],
                names=["labelled", "y", "x"],
            )

    # SAMPLE rows of two numbers bound what is broadcast, and what comes to the driver.
    sample = docs.select(F.col("doc_id").cast("long").alias("labelled"), "text").join(
        F.broadcast(chosen), "labelled"
    )
    pooled = sample.select("labelled", "y", "text").mapInArrow(pool, "labelled long, y double, x array<float>")
    unique = pooled.groupBy("labelled").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    unique = unique.sort_values("labelled")
    x = np.array(unique["x"].tolist(), np.float64).reshape(len(unique), INPUTS)
    return words, fit(x, unique["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: tuple[WordTable, Network], name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1, from the text alone; null and empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        for batch in batches:
            score = net.probability(words.pool(batch.column(place)).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(task, schema)


def train_outside(docs: DataFrame, labels: DataFrame) -> tuple[WordTable, Network]:
    """Trained without the labels of the held-out fold."""
    return train(docs, labels.filter(label_of(F.col("doc_id"), 5) != 0))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    (name,) = unused(docs.columns, "score")
    columns = docs.columns
    result = scored(docs, train_outside(docs, labels), name)
    return result.filter(F.col(name) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in columns))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_outside(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (label_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
