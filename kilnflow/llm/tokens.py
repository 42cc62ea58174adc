"""Hashes of the words of Arrow text columns, and fixed-size counters summed over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts are hashed in pieces of about so many bytes (a longer text is one piece).
PIECE_BYTES = 1 << 20
#: Counters are summed in so many blocks.
BLOCKS = 96

_M = 0x9E3779B97F4A7C15 | 1
_M_INVERSE = pow(_M, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """All bits of 64-bit hashes mixed."""
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of texts.

    Words are runs without white space; with ``symbols``, runs of ASCII signs are words of
    their own.
    """

    def __init__(self, symbols: bool = False) -> None:
        self.kinds = np.where(_SPACE, 0, 1).astype(np.int8)
        if symbols:
            for b in range(33, 127):
                if not chr(b).isalnum():
                    self.kinds[b] = 2
        self.values = mixed(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)
        self.up = self.down = np.empty(0, np.uint64)

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For consecutive texts: the first one's number, all word hashes, and where each text's begin.

        The last entry of the offsets is the number of words. Null is a text without words.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            part = offsets[at : to + 1]
            yield at, *self._hash(data[part[0] : part[-1]], part - part[0])
            at = to

    def _hash(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        if len(self.up) < n + 1:
            size = max(n + 1, PIECE_BYTES + 1)
            self.up, self.down = _powers(_M, size), _powers(_M_INVERSE, size)
        kinds = self.kinds[data]
        turn = np.empty(n + 1, bool)
        turn[0] = turn[n] = True
        np.not_equal(kinds[1:], kinds[:-1], out=turn[1:n])
        turn[offsets[offsets < n]] = True
        turns = np.flatnonzero(turn)
        words = kinds[turns[:-1]] > 0
        starts, ends = turns[:-1][words], turns[1:][words]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts])
        return hashes, np.searchsorted(starts, offsets)


def summed(
    docs: DataFrame, length: int, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray]
) -> np.ndarray:
    """The sum over all tasks of the integer arrays of ``length`` that ``count`` makes of each.

    Tasks send their array in blocks, every block is summed by one task as it streams in, and
    the driver gets ``length`` numbers however large the input is.
    """
    size = -(-length // BLOCKS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = count(batches)
        blocks = [np.asarray(counts[i : i + size], np.int32) for i in range(0, length, size)]
        filled = [i for i, b in enumerate(blocks) if b.any()]
        if filled:
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), pa.array([blocks[i].tobytes() for i in filled], pa.binary())],
                names=["block", "data"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(size, np.int64), None
        for batch in batches:
            for number, data in zip(batch.column("block"), batch.column("data")):
                block = number.as_py()
                values = np.frombuffer(data.as_buffer(), np.int32)
                total[: len(values)] += values
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["block", "data"],
        )

    schema = "block int, data binary"
    whole = np.zeros(size * BLOCKS, np.int64)
    sent = docs.mapInArrow(send, schema)
    for row in sent.groupBy("block").applyInArrow(_streaming(add), schema).collect():
        whole[row.block * size : (row.block + 1) * size] = np.frombuffer(row.data, np.int64)
    return whole[:length]


def _streaming(function):
    """Spark tells a streaming function by its annotations, which must be real types."""

    def stream(batches):
        return function(batches)

    stream.__annotations__ = {
        "batches": Iterator[pa.RecordBatch],
        "return": Iterator[pa.RecordBatch],
    }
    return stream
