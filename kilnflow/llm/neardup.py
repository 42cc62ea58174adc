"""Near-duplicates by improved consistent weighted sampling of TF-IDF shingles.

Shingles are five words. A shingle weighs more the more often its text has it and the rarer
it is; document frequencies are counted over all texts in 2^20 hashed cells. Texts whose
samples agree in a band meet under the band's key. Members of a key are first held against
its first and its last member, which joins most copies. In keys that still hold several
components, every text is held against every text of another component: in blocks, each two
of which are one task's group, by the shingles' weights. So no two texts that meet in a key
are left out, whatever the key's size. Links are verified by the exact weighted Jaccard
similarity of the whole texts, and the classes are the components of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.llm.common import documents, staged, unused
from kilnflow.llm.components import components
from kilnflow.llm.tokens import WordHasher, mixed, summed

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 meets with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996.
BANDS = 15
ROWS = 4
#: Cells of the document frequencies, how strongly rarity counts, and the share of the texts
#: below which a shingle is not rarer: what the cells can tell at any number of texts.
CELLS = 1 << 20
RARITY = 0.02
RAREST = 1 / 1024

#: Members and characters of an open key's block, about. Two blocks meet in one group of a task,
#: which bounds its memory whatever the key's size.
BLOCK = 192
BLOCK_CHARS = 1 << 22
#: Shingles whose weights are multiplied at once, and what rounding may take off a bound.
_COLUMNS = 4096
_SLACK = 1e-3

#: Bits of the map that holds back texts without a candidate: 16 for each, within these bounds.
FEWEST_BITS, MOST_BITS = 1 << 23, 1 << 31

_SAMPLES = BANDS * ROWS
_TABLE = 1 << 14
#: Shingles that are sampled at once.
_AT_ONCE = 4096


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text's words, and how often each occurs.

    A text of fewer words is one shingle; a text of none has none.
    """
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(WORDS, len(words))
    joined = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        joined = joined * np.uint64(0x100000001B3) + words[k : k + len(joined)]
    return np.unique(mixed(joined, width), return_counts=True)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def count_documents(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Texts with a shingle in each cell, and at the end the number of texts."""
    hasher = WordHasher()
    counts = np.zeros(CELLS + 1, np.int64)
    for batch in batches:
        counts[CELLS] += batch.num_rows
        for _, words, offsets in hasher.pieces(batch.column(0)):
            found = [
                np.unique(cells(shingles(words[a:b])[0])) for a, b in zip(offsets[:-1], offsets[1:]) if b > a
            ]
            if found:
                counts[:CELLS] += np.bincount(np.concatenate(found), minlength=CELLS)
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each cell, damped by ``RARITY``.

    What an average cell holds, which other shingles brought, is taken off first.
    """
    texts, found = counts[CELLS] + 1, counts[:CELLS] - counts[:CELLS].mean() + 1
    return (1 + RARITY * np.log(texts / np.maximum(found, max(1.0, texts * RAREST)))).astype(np.float32)


def weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(times)) * idf[cells(hashes)]).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two texts, each its sorted shingles and their weights."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    same = b[0][at] == a[0]
    common = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return common / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common)


@dataclass
class Sampler:
    """The random numbers of the samples: r and c of gamma(2, 1), beta uniform, by a hash."""

    odd: np.ndarray
    r: np.ndarray
    log_c: np.ndarray
    beta: np.ndarray

    @staticmethod
    def seeded(seed: int = 1, samples: int = _SAMPLES) -> Sampler:
        rng = np.random.default_rng(seed)
        return Sampler(
            rng.integers(0, 1 << 63, samples, np.uint64)[:, None] * np.uint64(2) + np.uint64(1),
            rng.gamma(2, 1, _TABLE).astype(np.float32),
            np.log(rng.gamma(2, 1, _TABLE)).astype(np.float32),
            rng.uniform(0, 1, _TABLE).astype(np.float32),
        )

    def samples(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash per sample of one text."""
        n = len(self.odd)
        least = np.full(n, np.inf, np.float32)
        sample = np.zeros(n, np.uint64)
        every = np.arange(n)
        for lo in range(0, len(hashes), _AT_ONCE):
            part, log_w = hashes[lo : lo + _AT_ONCE], np.log(weight[lo : lo + _AT_ONCE])
            bits = self.odd * part
            r = self.r[bits >> np.uint64(50)]
            beta = self.beta[bits >> np.uint64(36) & np.uint64(_TABLE - 1)]
            level = np.floor(log_w / r + beta)
            log_a = self.log_c[bits >> np.uint64(22) & np.uint64(_TABLE - 1)] - r * (level - beta + 1)
            first = log_a.argmin(1)
            value = log_a[every, first]
            better = value < least
            drawn = mixed(part[first] ^ (level[every, first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            least = np.where(better, value, least)
            sample = np.where(better, drawn, sample)
        return sample

    def keys(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The bands' keys of one text."""
        key = np.arange(BANDS, dtype=np.uint64)
        for column in self.samples(hashes, weight).reshape(BANDS, ROWS).T:
            key = mixed(key * np.uint64(0x100000001B3) + column)
        return key.astype(np.int64)


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def _digest(words: np.ndarray) -> bytes:
    return hashlib.md5(words.tobytes()).digest()


_KEYS = [f"k{i}" for i in range(BANDS)]


def signatures(docs: DataFrame, idf) -> DataFrame:
    """``doc_id``, ``digest`` of its words, and the keys ``k0``, ``k1``, ... (null without words)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sampler = WordHasher(), Sampler.seeded()
        for batch in batches:
            digests = []
            keys = np.zeros((batch.num_rows, BANDS), np.int64)
            blank = np.zeros(batch.num_rows, bool)
            for _, words, offsets in hasher.pieces(batch.column(1)):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    if b > a:
                        found, times = shingles(words[a:b])
                        keys[len(digests)] = sampler.keys(found, weights(found, times, idf.value))
                    else:
                        blank[len(digests)] = True
                    digests.append(_digest(words[a:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), *(pa.array(c, mask=blank) for c in keys.T)],
                names=["doc_id", "digest", *_KEYS],
            )

    schema = "doc_id long, digest binary, " + ", ".join(f"{k} long" for k in _KEYS)
    return _lowered(docs).mapInArrow(task, schema)


def digested(docs: DataFrame) -> DataFrame:
    """``digest`` of its words and the lower-case ``text`` of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            digests = [
                _digest(words[a:b])
                for _, words, offsets in hasher.pieces(batch.column(0))
                for a, b in zip(offsets[:-1], offsets[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), batch.column(0)], names=["digest", "text"]
            )

    return docs.select("text").mapInArrow(task, "digest binary, text string")


def node_of(doc_id: Column, digest: Column) -> Column:
    """A text's node: bytes that sort by its smallest ``doc_id``, none last, then by digest."""
    flipped = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.coalesce(F.concat(F.lit("00"), flipped), F.lit("01"))), digest)


def doc_id_of(node: Column) -> Column:
    """The ``doc_id`` in a node, or null."""
    signed = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long")
    return F.when(F.length(node) == 25, signed.bitwiseXOR(F.lit(-(1 << 63))))


def digest_of(node: Column) -> Column:
    return F.substring(node, F.length(node) - 15, F.lit(16))


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def weighed(text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            ((_, words, _),) = hasher.pieces(pa.array([text], text.type))
            found, times = shingles(words)
            return found, weights(found, times, idf.value)

        last, kept = None, None
        for batch in batches:
            good = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, kept = b, weighed(text_b)
                good.append(similarity(weighed(text_a), kept) >= SIMILARITY - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(task, "a binary, b binary")


def shingled(texts: DataFrame, idf) -> DataFrame:
    """``node``, and the ``hashes`` and ``weights`` of its shingles, as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            hashes, weighed = [], []
            for _, words, offsets in hasher.pieces(batch.column(1)):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    found, times = shingles(words[a:b])
                    hashes.append(found.tobytes())
                    weighed.append(weights(found, times, idf.value).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.binary()), pa.array(weighed, pa.binary())],
                names=["node", "hashes", "weights"],
            )

    return texts.select("node", "text").mapInArrow(task, "node binary, hashes binary, weights binary")


def most_common(texts: list[tuple[np.ndarray, np.ndarray]], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """At least the common weight of each text of ``one`` and each of ``two`` (their numbers).

    The lesser of two weights is their geometric mean at most, so a product of matrices bounds
    the sums; it is exact where both texts have a shingle equally often.
    """
    row = np.repeat(np.arange(len(texts)), [len(hashes) for hashes, _ in texts])
    _, column, times = np.unique(np.concatenate([h for h, _ in texts]), return_inverse=True, return_counts=True)
    root = np.sqrt(np.concatenate([w for _, w in texts]))
    kept = times[column] > 1
    row, root, column = row[kept], root[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, root, column = row[order], root[order], column[order]
    out = np.zeros((len(one), len(two)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        part = np.zeros((len(texts), _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - lo] = root[a:b]
        out += part[one] @ part[two].T
    return out


def joining(group: pa.Table) -> pa.Table:
    """Verified links that join the components of two blocks, or of one: no more than they have.

    Takes ``i`` and ``j``, the blocks, and of each text ``first`` (it is of block ``i``), ``node``,
    ``root``, ``hashes`` and ``weights``.
    """
    node, root = group.column("node").to_pylist(), group.column("root").to_pylist()
    above = {r: r for r in root}
    links: list[tuple[bytes, bytes]] = []
    inside = group.column("i")[0] == group.column("j")[0]
    first = np.array(group.column("first").to_pylist(), bool)
    one, two = np.flatnonzero(first), np.flatnonzero(first if inside else ~first)

    def top(r: bytes) -> bytes:
        while above[r] != r:
            above[r] = above[above[r]]
            r = above[r]
        return r

    if len(above) > 1 and len(one) and len(two):
        texts = [
            (np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32))
            for h, w in zip(group.column("hashes").to_pylist(), group.column("weights").to_pylist())
        ]
        whole = np.array([w.sum(dtype=np.float64) for _, w in texts])
        common = most_common(texts, one, two)
        near = common >= (SIMILARITY - _SLACK) * (whole[one][:, None] + whole[two][None, :] - common)
        for x, y in zip(*np.nonzero(np.triu(near, 1) if inside else near)):
            a, b = int(one[x]), int(two[y])
            ends = top(root[a]), top(root[b])
            if ends[0] != ends[1] and similarity(texts[a], texts[b]) >= SIMILARITY - 1e-9:
                above[ends[0]] = ends[1]
                links.append((node[a], node[b]))
    return pa.table({end: pa.array([link[k] for link in links], pa.binary()) for k, end in enumerate("ab")})


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is one of ``wanted`` (distinct, one column ``id``).

    A bitmap of hashed ids first holds back most other rows, so that their texts are not
    shuffled; the exact join follows. It has 16 bits for each id and is 256 MB at most: with
    far more than 10^8 ids wanted, others pass it too and are shuffled. A semi-join would be
    moved below the bitmap by the optimizer.
    """
    n = 16 * wanted.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << n.bit_length()))

    def place(doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id, F.lit("bitmap")), F.lit(bits))

    position = place(F.col("id"))
    bitmap = wanted.groupBy(F.bitmap_bucket_number(position).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")
    )
    at = F.bitmap_bit_position(place(F.col("doc_id")))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, (at % 8).cast("int")) == 1
    likely = docs.withColumn("bucket", F.bitmap_bucket_number(place(F.col("doc_id")))).join(
        F.broadcast(bitmap), "bucket"
    )
    kept = likely.filter(marked).select(*(F.col(c) for c in docs.columns))
    return kept.join(wanted, F.col("doc_id") == F.col("id")).drop("id")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``text`` (lower case), once for each ``node`` of ``wanted`` (distinct)."""
    lowered = _lowered(docs)
    ids = wanted.select(doc_id_of(F.col("node")).alias("id")).filter("id is not null").distinct()
    rows = among(lowered, ids).select("text").union(lowered.filter("doc_id is null").select("text"))
    found = digested(rows).dropDuplicates(["digest"])
    return wanted.select("node", digest_of(F.col("node")).alias("digest")).join(found, "digest").select("node", "text")


def _order(node: Column) -> Column:
    """Nodes by a hash, so that no id range leads."""
    return F.struct(F.xxhash64(node).alias("h"), node.alias("node"))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's ``doc_id`` and ``digest``, and every text's ``digest``, ``node`` and ``root``, its class."""
    spark = docs.sparkSession
    counts = summed(docs.select(F.lower("text")), CELLS + 1, count_documents)
    idf = spark.sparkContext.broadcast(rarity(counts))
    rows = staged(signatures(docs, idf), "signatures")
    single = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.min(k).alias(k) for k in _KEYS))
    nodes = staged(
        single.select("digest", node_of(F.col("doc_id"), F.col("digest")).alias("node"), *_KEYS), "texts"
    )
    entries = nodes.filter("k0 is not null").select("node", F.explode(F.array(*_KEYS)).alias("key"))
    ends = staged(
        entries.groupBy("key")
        .agg(F.min(_order(F.col("node"))).alias("first"), F.max(_order(F.col("node"))).alias("last"))
        .filter("first.node <> last.node")
        .select("key", F.col("first.node").alias("first"), F.col("last.node").alias("last")),
        "key-ends",
    )
    met = staged(entries.join(ends, "key"), "met")
    star = met.select(
        F.col("node").alias("a"),
        F.explode(F.array(F.struct(F.col("first").alias("b"), F.lit(True).alias("leads")),
                          F.struct(F.col("last").alias("b"), F.lit(False).alias("leads")))).alias("to"),
    ).select("a", "to.b", "to.leads")
    proposals = staged(
        star.filter("a <> b").groupBy("a", "b").agg(F.max("leads").alias("leads")), "proposals"
    )
    wanted = staged(proposals.select(F.col("a").alias("node")).union(proposals.select("b")).distinct(), "candidates")
    texts = staged(texts_of(docs, wanted), "candidate-texts")
    leader = proposals.filter("leads").groupBy("a").agg(F.min(_order(F.col("b"))).alias("to"))
    first = staged(verified(leader.select("a", F.col("to.node").alias("b")), texts, idf), "first-links")
    roots = components(first)
    rest = _across(proposals.select("a", "b"), roots)
    second = staged(verified(rest, texts, idf), "second-links")
    joined = staged(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second), "joined")
    roots = components(joined)
    third = _unsettled(met.select("key", "node"), roots, texts, idf)
    classes = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(third))
    labels = nodes.select("digest", "node").join(classes, "node", "left").select(
        "digest", "node", F.coalesce("root", "node").alias("root")
    )
    return rows.select("doc_id", "digest"), staged(labels, "text-classes")


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``class_id``, the smallest ``doc_id`` of its class, for every row.

    Texts with the same words (lower case, any white space) are one; among different texts
    links are sought. Null and empty texts form one class. Rows without a ``doc_id`` are
    compared like all others; the ``class_id`` of a class without any ``doc_id`` is null. Rows
    that share a ``doc_id`` are judged by their own texts.

    First every text is held against one leader, the first of all its keys' members in a
    hashed order, then against the other ends of its keys that this has not joined. Every key
    is reduced by map-side minima and maxima, so a key that a third of the texts share costs
    as many rows as it has texts. In keys whose members are still in several components all
    pairs of different components are compared, ``BLOCK`` texts with as many at a time: a text
    is shuffled once for every ``BLOCK`` texts of such a key. In a family whose texts are all
    just below the threshold, that is the square of its size over ``BLOCK``.
    """
    rows, labels = _classified(docs)
    return rows.join(labels.select("digest", doc_id_of(F.col("root")).alias("class_id")), "digest").select(
        "doc_id", "class_id"
    )


def _unsettled(members: DataFrame, roots: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Verified links between texts of keys whose ``members`` are in several components.

    They join whatever components any pair of a key's members joins.
    """
    sizes = texts.select("node", F.length("text").cast("long").alias("size"))
    member = staged(
        members.join(roots, "node", "left").join(sizes, "node").select(
            "key", "node", F.coalesce("root", "node").alias("root"), "size"
        ),
        "members",
    )
    # Keys with the same members are one: their number and two sums of hashes tell them.
    same = {f"same{i}": F.bit_xor(F.xxhash64(F.lit(i), "node")) for i in (0, 1)}
    of_key = member.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("size"), *(total.alias(name) for name, total in same.items()),
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_CHARS))
    open_keys = of_key.filter("least <> most").dropDuplicates(["n", *same])
    open_keys = staged(open_keys.select("key", blocks.cast("int").alias("blocks")), "open-keys")
    inside = staged(member.join(open_keys, "key").select("key", "node", "root", "blocks"), "open-members")
    made = staged(shingled(inside.select("node").distinct().join(texts, "node"), idf), "open-shingles")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = inside.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    tiles = dealt.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("first"), "node", "root",
    ).join(made, "node")
    return staged(tiles.groupBy("key", "i", "j").applyInArrow(joining, "a binary, b binary"), "third-links")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    marked = (
        pairs.join(a, "a", "left")
        .join(b, "b", "left")
        .withColumn("root_a", F.coalesce("root_a", "a"))
        .withColumn("root_b", F.coalesce("root_b", "b"))
        .filter("root_a <> root_b")
    )
    return marked.select("a", "b").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, the one with the smallest ``doc_id``.

    Of several rows with that text and ``doc_id``, and of a class without any ``doc_id``, the
    least by text and then by a digest of the whole row stays.
    """
    (mark,) = unused(docs.columns, "kept_id")
    rows, labels = _classified(docs)
    stay = labels.filter("node = root").select("digest", doc_id_of(F.col("node")).alias("id"))
    times = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    stay = staged(stay.join(times, F.col("id") == F.col("doc_id"), "left").select("digest", "id", "times"), "near-kept")
    doc_id = F.col("doc_id").cast("long")
    single = stay.filter("times = 1").select(F.col("id").alias(mark))
    out = docs.join(single, doc_id == F.col(mark), "left_semi")
    several = stay.filter("times is null or times > 1").select("digest", "id")
    if several.isEmpty():
        return out
    return out.union(_least_rows(docs, several))


def _least_rows(docs: DataFrame, several: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``digest`` and ``id`` (or null) of ``several``."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mark, row = unused(docs.columns, "kept_id", "whole_row")
    ids = several.filter("id is not null").select(F.col("id").alias(mark)).distinct()
    doc_id = F.col("doc_id").cast("long")
    whole = docs.join(ids, doc_id == F.col(mark), "left_semi").union(docs.filter("doc_id is null"))
    packed = whole.select(F.lower("text").alias("text"), doc_id.alias("id"), F.struct(*columns).alias(row))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            digests = [
                _digest(words[a:b])
                for _, words, offsets in hasher.pieces(batch.column(0))
                for a, b in zip(offsets[:-1], offsets[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), batch.column(1), batch.column(2)], names=["digest", "id", row]
            )

    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("id", T.LongType()), packed.schema[row]])
    marked = packed.mapInArrow(task, schema)
    # Of a class without ids, any row of its text; else rows with the id.
    order = F.struct(F.col(row)["text"].alias("text"), F.md5(F.to_json(row)).alias("digest"))
    least = marked.groupBy("digest", "id").agg(F.min_by(row, order).alias(row))
    wanted = several.select(F.col("digest").alias("d"), F.col("id").alias(mark))
    kept = least.join(wanted, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col(mark)), "left_semi")
    return kept.select(f"{row}.*")


def op9_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(documents(spark, sf_dir))
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
