"""Byte-level BPE by a sentencepiece model made from a rank file.

The model is written field by field from the vocabulary: every token is a piece of
byte-mapped characters, scored by its negative rank, so that the best-scored merge is the one
of lowest rank; the normaliser is the identity. Pre-tokens are encoded, and ids are decoded
by the inverse of the mapping.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.llm.common import documents

#: Byte b is the character of code point BYTE_BASE + b: letters to every library.
BYTE_BASE = 0x100
BYTE_CHARS = "".join(chr(BYTE_BASE + b) for b in range(256))
#: Distinct pre-tokens a task remembers before it starts anew.
REMEMBERED = 400_000


def byte_mapped(token: bytes) -> str:
    return codecs.charmap_decode(token, "strict", BYTE_CHARS)[0]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    return [tokens[r] for r in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def piece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file: piece i is token i, and the unknown piece comes last."""

    def piece(text: str, score: float, kind: int) -> bytes:
        body = _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score)
        return _bytes(1, body + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece(byte_mapped(t), -float(r), normal) for r, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
    trainer += b"".join(_varint(f << 3) + _varint(2**64 - 1) for f in (41, 42, 43))
    # No blank in front, no blanks taken out or replaced.
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


#: Code points that newer Unicode counts as letters, and as numbers, but the
#: splitting of the vocabulary's own library does not (first and last of each range).
NEWER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD "
    "A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB "
    "11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _ranges(listed: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in listed.split())


class Splitter:
    """Splits texts into pre-tokens.

    The ``regex`` package knows newer letters and numbers than the vocabulary's library. Texts
    with any of them, which are rare, are split by classes without them.
    """

    def __init__(self, pattern: str) -> None:
        import regex

        self.plain = regex.compile(pattern).findall
        self.newer = re.compile(f"[{_ranges(NEWER_LETTERS)}{_ranges(NEWER_NUMBERS)}]").search
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_ranges(NEWER_LETTERS)}]]")
        older = older.replace(r"\p{N}", rf"[\p{{N}}--[{_ranges(NEWER_NUMBERS)}]]")
        self.older = regex.compile(older, regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.newer(text):
            return self.plain(text)
        return self.older(text)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str) -> None:
        import sentencepiece

        self.find = Splitter(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(model)
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.names = [str(i) for i in range(len(tokens))]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """A pre-token that is a token is that token; others are merged."""
        words = self.find(text)
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(words))
            raw = [w.encode() for w in new]
            merged = self.pieces.encode(
                [byte_mapped(r) for r in raw],
                out_type=int,
                num_threads=1,
            )
            for word, data, ids in zip(new, raw, merged):
                whole = self.rank.get(data)
                known[word] = tuple(ids) if whole is None else (whole,)
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec_for(spark: SparkSession, path: str, pattern: str):
    """The vocabulary is read once and sent to the tasks: its size is the file's."""
    tokens = read_ranks(path)
    shared = spark.sparkContext.broadcast((tokens, piece_model(tokens), pattern))
    return lambda: Codec(*shared.value)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Length and digests of every text's ids, and of the bytes they decode to.

    ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. Null counts as empty: no ids,
    digests of nothing.
    """
    make = _codec_for(docs.sparkSession, path, pattern)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                joined = ",".join(map(codec.names.__getitem__, ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(bytes_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every text."""
    make = _codec_for(docs.sparkSession, path, pattern)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, ids array<int>"
    )


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes`` (binary) of every row of ``doc_id`` and ``ids``; null ids give none."""
    make = _codec_for(tokens.sparkSession, path, pattern)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            data = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"]
            )

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        task, "doc_id long, bytes binary"
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
