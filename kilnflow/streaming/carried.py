"""Streams that carry state from event to event, as table work on every micro-batch.

A micro-batch is put behind a few rows of what came before it, the table operator runs over
both, and the rows that the next batch needs are written as a new version of a small carried
table. So a busy key is cut into chunks over many tasks, as in a table, and no key's rows are
ever held together. The carried table has a bounded number of rows per key:

* the two newest versions are kept, so a batch that is run again begins from the same state
  and replaces its own output, and a read costs the same however many batches there were;
* a key whose newest event is older than the newest of all by more than ``forget`` is left out:
  that run is over, and a later event of it begins anew.

Events must come in order per key. One that is not after the newest event carried for its key
is late: it changes nothing, and goes to ``late`` if that is given. Within a batch order does
not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kilnflow.operators import timing
from kilnflow.operators.timing import AGO, STEP
from kilnflow.session import exists, remove, subfolders, workspace
from kilnflow.streaming.progress import Sink

FORGET = "30 days"
KEPT_VERSIONS = 2

Stage = Callable[[DataFrame, str], DataFrame]
#: From a batch, what was carried (or nothing) and the batch's number to the rows to send and
#: those to carry.
Step = Callable[[DataFrame, DataFrame | None, Stage, int], tuple[DataFrame, DataFrame]]


class Versions:
    """A table that every micro-batch replaces: one folder per batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _written(self) -> list[int]:
        found = [f for f in subfolders(self.spark, self.path) if f.startswith("version=")]
        return sorted(
            int(f.removeprefix("version=")) for f in found if exists(self.spark, f"{self.path}/{f}/_SUCCESS")
        )

    def _read(self, versions: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/version={versions[-1]}") if versions else None

    def before(self, batch_id: int) -> DataFrame | None:
        """What the batches before this one left."""
        return self._read([v for v in self._written() if v < batch_id])

    def newest(self) -> DataFrame | None:
        return self._read(self._written())

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        for old in [v for v in self._written() if v <= batch_id][:-KEPT_VERSIONS]:
            remove(self.spark, f"{self.path}/version={old}")


def carrying(spark: SparkSession, path: str, step: Step, sink: Sink) -> Sink:
    """For ``foreachBatch``: run ``step`` over each batch and what the batch before left at ``path``.

    The batch is read once and then worked on in ``spark``, where plans adapt to it.
    """
    versions = Versions(spark, path)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        with workspace(spark) as stage:
            out, kept = step(stage(batch, "batch"), versions.before(batch_id), stage, batch_id)
            sink(out, batch_id)
            versions.write(kept, batch_id)

    return deliver


def _with_carried(new: DataFrame, carried: DataFrame | None, schema: str) -> DataFrame:
    """Carried rows and new ones; ``schema`` names the columns that only the former have."""
    if carried is None:
        empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]
        return new.select("*", *empty, F.lit(False).alias("_old"))
    return carried.withColumn("_old", F.lit(True)).unionByName(
        new.withColumn("_old", F.lit(False)), allowMissingColumns=True
    )


def _in_order(
    new: DataFrame,
    carried: DataFrame | None,
    key: str,
    order: Sequence[str],
    late: Sink | None,
    batch_id: int,
) -> DataFrame:
    """The rows after the newest carried one of their key."""
    if carried is None:
        return new
    newest = carried.groupBy(F.col(key).alias("_of")).agg(F.max(F.struct(*order)).alias("_newest"))
    marked = new.join(newest, F.col(key).eqNullSafe(F.col("_of")), "left").withColumn(
        "_late", F.coalesce(F.struct(*order) <= F.col("_newest"), F.lit(False))
    )
    if late is not None:
        late(marked.where("_late").select(*new.columns), batch_id)
    return marked.where("not _late").select(*new.columns)


def _remembered(kept: DataFrame, key: str, at: str, forget: str) -> DataFrame:
    """Rows of keys with an event in the time before the newest of all."""
    newest = kept.agg(F.max(at)).scalar()
    last = F.max(at).over(Window.partitionBy(key))
    return kept.withColumn("_last", last).where(
        F.col("_last") >= newest - F.expr(f"interval {forget}")
    ).drop("_last")


# --- component times --------------------------------------------------------------------

_RESETS = "_resets long"


def component_times_step(forget: str = FORGET, late: Sink | None = None) -> Step:
    """Elapsed time at each end, and the component's percent of its run so far.

    Takes ``run_id, component, kind, ts, seq``. Carried per run: its newest event (kind
    ``seen``), the last reset with the number of resets, and per component the start in force
    and the last timed end with its start: three rows a component and two a run.
    """
    order = ["ts", "seq"]

    def step(
        batch: DataFrame, carried: DataFrame | None, stage: Stage, batch_id: int
    ) -> tuple[DataFrame, DataFrame]:
        slim = batch.select("run_id", "component", "kind", F.col("ts").cast("timestamp").alias("ts"), "seq")
        fresh = _in_order(slim, carried, "run_id", order, late, batch_id)
        events = stage(_with_carried(fresh, carried, _RESETS), "events")
        ends = stage(timing.component_times(events, resets="_resets"), "ends")
        return ends.where("not _old").select(
            "run_id", "segment", "component", "seq", "elapsed_s", "matched", "percent"
        ), _remembered(stage(_events_to_carry(events, ends), "kept"), "run_id", "ts", forget)

    return step


def _events_to_carry(events: DataFrame, ends: DataFrame) -> DataFrame:
    def latest(kind: Column) -> Column:
        return F.max(F.when(kind, F.struct("ts", "seq")))

    resets = F.sum(F.when(F.col("kind") == "reset", F.coalesce("_resets", F.lit(1))))
    runs = events.groupBy(F.col("run_id").alias("_run")).agg(
        latest(F.lit(True)).alias("_seen"), latest(F.col("kind") == "reset").alias("_reset"), resets.alias("_resets")
    )
    of_run = F.col("run_id").eqNullSafe(F.col("_run"))

    def rows(table: DataFrame, at: str, kind: str, component: Column, resets: Column) -> DataFrame:
        return table.where(f"{at} is not null").select(
            F.col("_run").alias("run_id"), component.alias("component"), F.lit(kind).alias("kind"),
            F.col(f"{at}.ts").alias("ts"), F.col(f"{at}.seq").alias("seq"), resets.cast("long").alias("_resets"),
        )

    none = F.lit(None)
    out = rows(runs, "_seen", "seen", none.cast("string"), none)
    out = out.union(rows(runs, "_reset", "reset", none.cast("string"), F.col("_resets")))
    # Per component, only what came after the last reset of its run is still in force.
    begun = events.where("kind = 'start'").groupBy("run_id", "component").agg(F.max(F.struct("ts", "seq")).alias("_start"))
    timed = ends.where("matched").groupBy("run_id", "component").agg(
        F.max(F.struct("ts", "seq", "_start")).alias("_end")
    )
    since = begun.join(runs, of_run).where("_reset is null or _start > _reset")
    both = timed.join(runs, of_run).where("_reset is null or struct(_end.ts, _end.seq) > _reset")
    of = F.col("component")
    pairs = both.withColumn("_begin", F.col("_end._start"))
    return out.union(rows(since, "_start", "start", of, none)).union(
        rows(pairs, "_end", "end", of, none)
    ).union(rows(pairs, "_begin", "start", of, none)).distinct()


# --- slow-down and breaks ---------------------------------------------------------------

_HANDLED = f"{STEP} long, {AGO} long"


def thermal_step(
    batch_size: int | None = 10,
    batch_cooling_s: int = 60,
    cooling_s: int = 30,
    window: int = 5,
    threshold: float = 1.5,
    baseline: float | None = None,
    forget: str = FORGET,
    late: Sink | None = None,
    rows: int | None = None,
) -> Step:
    """State and breaks of each timing, as ``timing.break_schedule`` gives them for a table.

    Takes ``session_id, ts, event_id, elapsed_s``. Carried per session: its first three and its
    last ``window`` timings, how many it had, and how long ago the last slow one was.
    """
    order = ["ts", "event_id"]

    def step(
        batch: DataFrame, carried: DataFrame | None, stage: Stage, batch_id: int
    ) -> tuple[DataFrame, DataFrame]:
        slim = batch.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "elapsed_s")
        fresh = _in_order(slim, carried, "session_id", order, late, batch_id)
        log = stage(_with_carried(fresh, carried, _HANDLED), "log")
        state = timing.item_state(log, window, threshold, baseline, ["session_id"], order, "elapsed_s", rows)
        done = stage(timing.scheduled(state, batch_size, batch_cooling_s, cooling_s), "state")
        out = done.where("not _old").select(
            "session_id", "seq", "event_id", "baseline", "performance_ratio", "is_throttled",
            "needs_break", "takes_break", "cooling_s",
        )
        return out, _remembered(stage(_timings_to_carry(done, window), "kept"), "session_id", "ts", forget)

    return step


def _timings_to_carry(done: DataFrame, window: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    last = done.withColumn("_back", back).where(F.col("_back") <= window)
    first = done.where("seq <= 3").withColumn("_back", F.lit(None).cast("int"))
    few = last.union(first).groupBy("session_id", "ts", "event_id", "elapsed_s", "seq", "needs_break", "_opened", AGO).agg(
        F.min("_back").alias("_back")
    )
    before = F.lag("seq", 1, 0).over(Window.partitionBy("session_id").orderBy("seq"))
    flagged = F.coalesce(F.col("seq") - F.col(AGO), F.when(F.col("needs_break"), F.col("seq")), F.col("_opened"))
    return few.select(
        "session_id", "ts", "event_id", "elapsed_s",
        (F.col("seq") - before).cast("long").alias(STEP),
        F.when(F.col("_back") == 1, F.col("seq") - flagged).cast("long").alias(AGO),
    )


# --- newest version of each key ---------------------------------------------------------


def newest_step(
    partial: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    at: str = "ts",
    forget: str = FORGET,
) -> Step:
    """One row per key: ``partial`` of a batch, then ``merge`` of its rows and those carried.

    Both aggregate by key. A key whose ``at`` is older than the newest by more than ``forget`` is
    left out. What is sent is what is carried.
    """
    def step(
        batch: DataFrame, carried: DataFrame | None, stage: Stage, batch_id: int
    ) -> tuple[DataFrame, DataFrame]:
        rows = partial(batch)
        merged = stage(merge(rows if carried is None else carried.unionByName(rows)), "merged")
        newest = merged.agg(F.max(at)).scalar()
        kept = merged.where(F.col(at) >= newest - F.expr(f"interval {forget}"))
        return kept, kept

    return step


def _nothing(rows: DataFrame, batch_id: int) -> None:
    """The carried table itself is the result."""


def keep_newest(spark: SparkSession, path: str, step: Step) -> Sink:
    """For ``foreachBatch``: the table at ``path`` (:class:`Versions`) always has each key's row."""
    return carrying(spark, path, step, _nothing)


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink: Sink | None = None
) -> StreamingQuery:
    """Run a stream over the files there are now, into Parquet or a ``foreachBatch`` sink."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", path)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
