"""Progress events as streams: newest state, run status, progress, idle sessions, fan-out.

Each function is a transformation of a streaming DataFrame or of its micro-batches and works
on a table as well, so the table result is the stream's twin. A watermark bounds what
:func:`idle_windows` remembers; newest states, statuses and open sessions are one small row
per key in a carried table that forgets (``kilnflow.streaming.carried``).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.operators.requests import progress_eta, stage_progress
from kilnflow.session import remove, subfolders


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each run.

    Aggregates per task before the shuffle, so a busy run sends one row per task.
    """
    rest = [c for c in events.columns if c not in ("run_id",)]
    newest = F.max_by(F.struct(*rest), F.struct("ts", "seq"))
    return events.groupBy("run_id").agg(newest.alias("_e")).select("run_id", "_e.*")


def status_parts(events: DataFrame) -> DataFrame:
    """What is to be known of a run's events to tell its status, mergeable by :func:`merge_status`."""
    failed = (F.col("component") == "idle") & F.col("message").startswith("Error:")
    done = F.col("component") == "complete"
    status = F.when(done, "complete").when(failed, "failed").otherwise("active")
    return events.groupBy("run_id").agg(
        F.max_by(status, F.struct("ts", "seq")).alias("status"),
        F.bool_or(done).alias("ever_completed"),
        F.bool_or(failed).alias("ever_failed"),
        F.count(F.lit(1)).alias("events"),
        F.max(F.struct("ts", "seq")).alias("at"),
    ).select("*", "at.*").drop("at")


def merge_status(parts: DataFrame) -> DataFrame:
    """Parts of the same runs as one."""
    return parts.groupBy("run_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.bool_or("ever_completed").alias("ever_completed"),
        F.bool_or("ever_failed").alias("ever_failed"),
        F.sum("events").alias("events"),
        F.max(F.struct("ts", "seq")).alias("at"),
    ).select("*", "at.*").drop("at")


def run_status(events: DataFrame) -> DataFrame:
    """Status of each run by its newest event, and whether it ever completed or failed."""
    return status_parts(events).drop("ts", "seq")


def stream_progress(events: DataFrame) -> DataFrame:
    """Stage and time left of each event; stateless, append mode."""
    return stage_progress(progress_eta(events))


def idle_windows(
    events: DataFrame, key: str = "user_id", gap_s: str = "gap_s", watermark: str = "1 hour"
) -> DataFrame:
    """Sessions of the keys that have a time-out, closed by idleness; append mode.

    Keys without a time-out have one session each: :func:`open_sessions`. (A session window
    drops rows whose gap is null.)
    """
    timed = events.where(F.col(gap_s).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.concat(F.col(gap_s).cast("string"), F.lit(" seconds"))
    return (
        timed.withWatermark("ts", watermark)
        .groupBy(key, F.session_window("ts", gap).alias("_w"))
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("events"),
        )
        .drop("_w")
    )


def open_sessions(events: DataFrame, key: str = "user_id", gap_s: str = "gap_s") -> DataFrame:
    """The one session of each key without a time-out."""
    return (
        events.where(F.col(gap_s).isNull())
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(key)
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("events"),
        )
    )


def merge_sessions(parts: DataFrame, key: str = "user_id") -> DataFrame:
    """Parts of the same open sessions as one."""
    return parts.groupBy(key).agg(
        F.min("started").alias("started"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events")
    )


LOG = logging.getLogger(__name__)

Sink = Callable[[DataFrame, int], None]


def parquet_sink(path: str) -> Sink:
    """Writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write




class Ledger:
    """Which sinks of a stream are out, and the first batch each missed, in a folder.

    Keep it beside the stream's checkpoint: a driver that starts again reads it there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def missed(self) -> dict[str, int]:
        found = [f for f in subfolders(self.spark, self.path) if f.startswith("sink=")]
        out = {}
        for folder in found:
            rows = self.spark.read.schema("batch_id long").json(f"{self.path}/{folder}").collect()
            if rows:
                out[unquote(folder.removeprefix("sink="))] = min(r.batch_id for r in rows)
        return out

    def enter(self, name: str, batch_id: int) -> None:
        row = self.spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1)
        row.write.mode("overwrite").json(f"{self.path}/sink={quote(name, safe='')}")

    def clear(self, name: str) -> None:
        remove(self.spark, f"{self.path}/sink={quote(name, safe='')}")


def fan_out(
    sinks: Mapping[str, Sink],
    on_error: Callable[[str, int, Exception], None] | None = None,
    ledger: Ledger | None = None,
) -> Sink:
    """For ``foreachBatch``: give each batch to every sink; one that fails is left out of
    the later ones, and the others still get theirs.

    The result's ``missed`` maps each such sink to the first batch it did not get. With a
    ``ledger`` that is written down before the batch is done, and a sink in it stays out, also
    when the stream starts again, until :func:`replay` has given it what it missed. Without
    ``on_error`` the loss is logged. The batch is kept while the sinks read it, so the source
    is read once.
    """
    missed: dict[str, int] = ledger.missed() if ledger else {}
    alive = {name: sink for name, sink in sinks.items() if name not in missed}

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, sink in list(alive.items()):
                try:
                    sink(batch, batch_id)
                except Exception as problem:  # any sink may fail in its own way
                    del alive[name]
                    missed[name] = batch_id
                    if ledger is not None:
                        ledger.enter(name, batch_id)
                    if on_error is not None:
                        on_error(name, batch_id, problem)
                    else:
                        LOG.warning("sink %s is left out from batch %s on: %s", name, batch_id, problem)
        finally:
            batch.unpersist()

    deliver.missed = missed
    return deliver


def replay(ledger: Ledger, name: str, sink: Sink, path: str) -> list[int]:
    """Give a sink the batches it missed, from where :func:`parquet_sink` wrote all of them.

    A sink takes a batch again in place of the same one before, so an interrupted replay is
    run again. Afterwards the sink is in the stream again from its next start on; do this while
    the stream stands still. Gives the numbers of the batches.
    """
    first = ledger.missed().get(name)
    if first is None:
        return []
    names = [f for f in subfolders(ledger.spark, path) if f.startswith("batch_id=")]
    batches = sorted(n for n in (int(f.removeprefix("batch_id=")) for f in names) if n >= first)
    for batch_id in batches:
        sink(ledger.spark.read.parquet(f"{path}/batch_id={batch_id}"), batch_id)
    ledger.clear(name)
    return batches
