"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level a row draws ``-ln(u) / weight`` for each child, ``u`` from a hash of its key and
the child's name, and descends into the smallest draw: a child wins in proportion to its
weight, and a changed weight moves rows into or out of that child's subtree only. Leaves also
have an epoch, the planned extension they came with. A node draws once for each epoch among
its leaves, with the weight of those leaves, and the descent keeps to the epoch that won. A
leaf added with a new epoch therefore adds one draw at the root and changes no other: what
it wins goes down to it alone, and nothing moves between the older shards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnflow.llm.common import documents, hash48, repeated, staged
from kilnflow.operators.ordered import Running, running

SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 4
#: Slots are counted in so many parts of each shard.
SLOT_PARTS = 512


@dataclass(frozen=True)
class Leaf:
    """One shard and its place."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    epoch: int = 0


def planned(shards: int, base: int = SHARDS) -> list[Leaf]:
    """Equal shards, racks of 5, regions of 4 racks; each one after ``base`` is an extension."""
    return [
        Leaf(
            shard=s,
            region=s // (SHARDS_PER_RACK * RACKS_PER_REGION),
            rack=s // SHARDS_PER_RACK % RACKS_PER_REGION,
            epoch=max(0, s - base + 1),
        )
        for s in range(shards)
    ]


def _children(leaves: Sequence[Leaf]) -> dict[str, dict[str, float]]:
    """Weight of each child of each node; leaves are named by their shard number."""
    tree: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        if leaf.weight <= 0:
            continue
        region = f"e{leaf.epoch}/g{leaf.region}"
        path = ["", region, f"{region}/k{leaf.rack}", str(leaf.shard)]
        for parent, child in zip(path, path[1:]):
            below = tree.setdefault(parent, {})
            below[child] = below.get(child, 0.0) + leaf.weight
    return tree


def place(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key. The tree travels as a literal: it grows with the shards only."""
    tree = _children(leaves)
    if not tree:
        raise ValueError("no shard has a weight")
    child = "array<struct<name:string,weight:double>>"
    nodes = F.create_map(
        *(
            part
            for parent, below in tree.items()
            for part in (
                F.lit(parent),
                F.array(
                    *(
                        F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))
                        for n, w in below.items()
                    )
                ).cast(child),
            )
        )
    )

    def draw(c: Column) -> Column:
        uniform = (hash48(key, c["name"]).cast("double") + 0.5) / float(2**48)
        return F.struct((-F.ln(uniform) / c["weight"]).alias("draw"), c["name"].alias("name"))

    node: Column = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(F.element_at(nodes, node), draw))["name"]
    return node.cast("int")


def assign(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf]) -> DataFrame:
    """Shard and slot of every row of ``docs``, and its shard in the ``grown`` tree.

    ``doc_id``, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard``. A null text has no bytes and the checksum of the empty text; a null
    ``doc_id`` is a key of its own; identical rows get one shard and a slot each.

    Slots follow a hash of the id: a shard is numbered in ``SLOT_PARTS`` parts, and only the
    sums per part (at most shards x parts rows) are broadcast. Rows of one id, or of none, are
    in one part; equal rows are counted first, and a part with very many others is numbered
    in chunks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id")
    placed = staged(
        docs.select(
            doc_id.cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.lit("key").alias("law"),
            place(doc_id, leaves).alias("shard"),
            place(doc_id, grown).alias("grown_shard"),
            (hash48(doc_id, "slot") % SLOT_PARTS).cast("int").alias("part"),
        ),
        "placed",
    )
    parts = ["shard", "part"]
    equal = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("copies"))
    counts = placed.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*parts, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = ["doc_id", "text_crc32", "size"]
    upto = running(staged(equal, "equal-rows"), parts, order, {"upto": Running("sum", F.col("copies"))})
    first = F.col("start") + F.col("upto") - F.col("copies")
    each = repeated(upto.join(F.broadcast(starts), parts).withColumn("first", first), "copies", "copy")
    return each.select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("first") + F.col("copy") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, leaves: Sequence[Leaf], path: str) -> None:
    """``docs`` as one folder per shard, each written by as many tasks as its size asks for."""
    shard = "shard"
    while shard in {c.lower() for c in docs.columns}:
        shard += "_"
    placed = docs.withColumn(shard, place(F.col("doc_id"), leaves))
    placed.hint("rebalance", shard).write.partitionBy(shard).parquet(path)


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), planned(SHARDS), planned(SHARDS + 1))


def _crc_entry(n: int) -> int:
    """One entry of the byte table of the reflected CRC-32 polynomial."""
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def _placed_sql(tree: str, leaves: Sequence[Leaf]) -> str:
    """CTEs that descend a tree: the last one has ``doc_id`` and ``node``, the shard."""
    rows = ", ".join(
        f"('{parent}', '{name}', {weight}::double)"
        for parent, below in _children(leaves).items()
        for name, weight in below.items()
    )
    draw = (
        "-ln((('0x' || substr(md5(d.doc_id || ':' || c.name), 1, 12))::bigint::double + 0.5)"
        f" / {float(2**48)!r}::double) / c.weight"
    )
    steps = [f"{tree}(parent, name, weight) as (values {rows})", f"{tree}0 as (select doc_id, '' as node from documents)"]
    steps += [
        f"{tree}{i + 1} as (select d.doc_id, min(struct_pack(draw := {draw}, name := c.name)).name as node"
        f" from {tree}{i} d join {tree} c on c.parent = d.node group by d.doc_id)"
        for i in range(3)
    ]
    return ",\n".join(steps)


OP4_SQL = f"""
with {_placed_sql("tree", planned(SHARDS))},
{_placed_sql("larger", planned(SHARDS + 1))},
sized as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::bigint) as bytes,
    ('0x' || substr(md5(doc_id || ':slot'), 1, 12))::bigint % {SLOT_PARTS} as part
  from documents
), summed as (
  select doc_id, size::bigint as size, part,
    xor(4294967295::bigint, coalesce(list_reduce(bytes, lambda c, x: xor(c >> 8,
      ({[_crc_entry(n) for n in range(256)]}::bigint[])[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295)) as text_crc32
  from sized
)
select s.doc_id, size, text_crc32, 'key' as law, a.node::int as shard,
  row_number() over (partition by a.node order by part, s.doc_id, text_crc32, size) - 1 as slot,
  b.node::int as grown_shard
from summed s join tree3 a using (doc_id) join larger3 b using (doc_id)
"""
