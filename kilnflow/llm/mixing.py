"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, gone through at most ``epochs``
times. An entry's virtual finish time is the source's words up to and with it, divided by
the source's target. All entries are range-sorted by finish time and cut where the words
reach the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnflow.llm.common import documents, hash48, repeated, restored, source_key, staged, word_count

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words.
SHARE = 1.5
#: Times a document may be taken.
EPOCHS = 2
#: A source's shuffled order is summed in so many parts.
PARTS = 1024


def source_targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Target of each source (``skey``, ``source_size``, ``target``).

    Sources share ``share`` of all words by weight; none gets more than ``epochs`` times its
    words, and what it can't use goes to the others by weight. In order of words per weight
    the sources that reach their limit come first: for each, the level is what is left after
    those before it, by the weights from it on.
    """
    # Sources by code point, null last: its key is the empty one.
    place = Window.orderBy(F.col("skey") == "", "skey")
    rank = F.row_number().over(place) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    each = (
        sizes.groupBy("skey")
        .agg(F.sum("words").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * epochs)
    )
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = (
        each.withColumn("budget", F.sum("source_size").over(whole) * share)
        .withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(onward))
        .withColumn(
            "full",
            F.col("limit") * F.col("weights") <= F.col("weight") * (F.col("budget") - F.col("used")),
        )
    )
    free = F.when(~F.col("full"), F.col("weight"))
    level = (
        F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0))
    ) / F.sum(free).over(whole)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * level)
    return levels.select("skey", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, size: Column, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """How often each document is taken.

    One row per distinct (``doc_id``, ``skey``, ``words``) with ``rows`` (rows of ``docs``
    like it, which are taken together), ``source_size``, ``target`` and ``times``.
    """
    sizes = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            source_key(F.col("source")).alias("skey"),
            size.alias("words"),
        )
        .groupBy("doc_id", "skey", "words")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("weighed", F.col("words") * F.col("rows"))
        .withColumn("key", hash48(F.col("doc_id"), "shuffle"))
        .withColumn("part", F.shiftright("key", 48 - 10).cast("int")),
        "mix-sizes",
    )
    targets = source_targets(sizes.select("skey", F.col("weighed").alias("words")), share, epochs)
    sums = sizes.groupBy("skey", "part").agg(F.sum("weighed").alias("in_part"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))
        .select("skey", "part", "start")
        .join(targets, "skey")
    )
    queue = Window.partitionBy("skey", "part").orderBy("key", "doc_id", "words")
    queued = staged(
        sizes.withColumn("upto", F.sum("weighed").over(queue.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["skey", "part"])
        .select(
            "doc_id",
            "skey",
            "words",
            "rows",
            "weighed",
            "key",
            "source_size",
            "target",
            (F.col("start") + F.col("upto")).alias("upto"),
        ),
        "mix-queues",
    )

    def finish(epoch: Column | int) -> Column:
        return (F.col("upto") + F.col("source_size") * epoch) / F.col("target")

    order = ("finish", "skey", "epoch", "key", "doc_id", "words")
    entries = (
        queued.filter("weighed > 0 and target > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("finish", finish(F.col("epoch")))
        .select(*order, "weighed")
    )
    ranged = staged(
        entries.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-order"
    )
    cut = _cut(ranged, order, share)
    taken: Column = F.lit(0)
    if cut is not None:
        for epoch in range(epochs):
            at = F.struct(finish(epoch).alias("finish"), "skey", F.lit(epoch).alias("epoch"), "key", "doc_id", "words")
            taken = taken + F.when(at <= F.struct(*(F.lit(cut[c]).alias(c) for c in order)), 1).otherwise(0)
        taken = F.when((F.col("weighed") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return queued.withColumn("times", taken.cast("int"))


def _cut(ranged: DataFrame, order: tuple[str, ...], share: float):
    """The last entry within the budget, or None.

    The words of each range say which one the budget ends in; only that one is summed up row
    by row.
    """
    by_range = Window.orderBy("range")
    ends = (
        ranged.groupBy("range")
        .agg(F.sum("weighed").alias("words"))
        .withColumn("end", F.sum("words").over(by_range))
        .withColumn("budget", F.sum("words").over(Window.partitionBy()) * share / EPOCHS)
    )
    crossing = ends.filter("end > budget").orderBy("range").select(
        "range", (F.col("budget") - F.col("end") + F.col("words")).alias("left")
    ).first()
    if crossing is None:
        rest = ranged
    else:
        upto = F.sum("weighed").over(Window.partitionBy("range").orderBy(*order))
        here = ranged.filter(F.col("range") == crossing["range"]).withColumn("upto", upto)
        within = here.filter(F.col("upto") <= crossing["left"]).drop("upto")
        rest = within.unionByName(ranged.filter(F.col("range") < crossing["range"]))
    last = rest.agg(F.max(F.struct(*order)).alias("cut")).first()
    return last["cut"] if last else None


def mixture(docs: DataFrame) -> DataFrame:
    """What the mix takes of every row of ``docs``, in words.

    ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``. Texts that are null or have
    no words have size 0 and are not taken; a null source is a source of its own, the last.
    Identical rows are taken together. The order depends on ``doc_id`` alone, so reruns agree.
    """
    plan = plan_mix(docs, word_count(F.col("text")))
    return repeated(plan, "rows", "row").select(
        "doc_id",
        F.col("words").alias("size"),
        "source_size",
        "target",
        (F.col("words") * F.col("times")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    size = word_count(F.col("text"))
    plan = plan_mix(docs, size).filter("times > 0").select("doc_id", "skey", "words", "times")
    keys = {
        "doc_id": F.col("doc_id").cast("long"),
        "skey": source_key(F.col("source")),
        "words": size,
    }
    return restored(docs, plan, keys, "times")


def op2_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


OP2_SQL = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(doc_id || ':shuffle'), 1, 12))::bigint as key
  from documents
), ranked as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source
), ordered as (
  select *, row_number() over (order by 2.0 * source_size / weight, source nulls last) as place,
    1.5::double * sum(source_size) over () as budget
  from ranked
), filled as (
  select *, 2 * source_size * sum(weight) over (order by place rows between current row and unbounded following)
      <= weight * (budget - coalesce(sum(2 * source_size) over (order by place rows between unbounded preceding and 1 preceding), 0)) as is_full
  from ordered
), targets as (
  select source, source_size, case when is_full then (2 * source_size)::double else weight * (
      (budget - coalesce(sum(2 * source_size) filter (is_full) over (), 0))::double
      / (sum(weight) filter (not is_full) over ())::double) end as target
  from filled
), queued as (
  select s.*, t.source_size, t.target,
    sum(s.size) over (partition by s.source order by s.key, s.doc_id)::bigint as upto
  from sized s join targets t on s.source is not distinct from t.source
), entries as (
  select *, epoch, (upto + source_size * epoch)::double / target as finish
  from queued, (values (0), (1)) e(epoch) where size > 0 and target > 0
), taken as (
  select doc_id, size, sum(size) over (
      order by finish, coalesce('=' || source, ''), epoch, key, doc_id rows unbounded preceding) as words,
    0.75::double * sum(size) over () as budget
  from entries
)
select q.doc_id, q.size, q.source_size, q.target,
  (q.size * (select count(*) from taken t where t.doc_id = q.doc_id and t.words <= t.budget))::bigint as taken
from queued q
"""
