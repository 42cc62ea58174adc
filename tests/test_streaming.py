"""Streams over several micro-batches against their table twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from kilnflow.operators import timing
from kilnflow.operators.ordered import ROWS_CONF
from kilnflow.session import scratch_path, subfolders
from kilnflow.streaming import carried, progress

START = datetime.datetime(2025, 10, 18)
SCHEMA = "key long, ts timestamp, seq long, kind string, component string, value double, gap_s int"


@pytest.fixture(scope="module")
def batches(spark):
    """Three files in time order; one key has half of the rows."""
    rng = random.Random(2)
    path = scratch_path(spark, "stream-input")
    rows = []
    for seq in range(600):
        key = 1 if seq % 2 else rng.randrange(2, 9)
        kind = rng.choices(["start", "end", "reset"], [5, 5, 1])[0]
        gap = None if key % 3 == 0 else 60 * key
        rows.append((key, START + datetime.timedelta(seconds=seq * 37), seq, kind,
                     rng.choice("abc"), rng.choice([1.0, 2.0, 3.0, 9.0]), gap))
    for i in range(3):
        part = spark.createDataFrame(rows[i * 200 : (i + 1) * 200], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def table_and_stream(spark, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return spark, spark.read.parquet(path), stream


def collect(spark, stream):
    path = scratch_path(spark, "stream-out")
    query = carried.run_available(stream, path, scratch_path(spark, "checkpoint"))
    assert query.lastProgress is not None
    return path


def stepped(spark, stream, step, state=None):
    """What a carrying stream sends, with the numbers of its batches."""
    out, state = scratch_path(spark, "sent"), state or scratch_path(spark, "state")
    sink = carried.carrying(spark, state, step, progress.parquet_sink(out))
    carried.run_available(stream, "", scratch_path(spark, "checkpoint"), sink=sink)
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*"), state


COMPONENTS = ["key as run_id", "component", "kind", "ts", "seq"]
TIMINGS = ["key as session_id", "ts", "seq as event_id", "value as elapsed_s"]


def shares_one_by_one(rows):
    """Segment, elapsed, matched and percent at each end, with dictionaries."""
    out, segment, starts, times = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
        run, component = r["run_id"], r["component"]
        mine, last = starts.setdefault(run, {}), times.setdefault(run, {})
        if r["kind"] == "reset":
            segment[run] = segment.get(run, 0) + 1
            mine.clear()
            last.clear()
        elif r["kind"] == "start":
            mine[component] = r["ts"]
        elif r["kind"] == "end":
            elapsed = (r["ts"] - mine[component]).total_seconds() if component in mine else 0.0
            if component in mine:
                last[component] = elapsed
            total = sum(last.values())
            share = last.get(component, 0.0) / total * 100 if total else None
            out[r["seq"]] = (run, segment.get(run, 0), component, elapsed, component in mine, share)
    return out


def shown(rows):
    return {r["seq"]: (r["run_id"], r["segment"], r["component"], r["elapsed_s"], r["matched"], r["percent"]) for r in rows}


def same(got, want):
    assert got.keys() == want.keys() and len(want) > 5
    for k, w in want.items():
        assert got[k][:5] == pytest.approx(w[:5]) if not isinstance(w[2], str) else got[k][:3] == w[:3]
        assert got[k][3] == pytest.approx(w[3]) and got[k][4] == w[4]
        assert (got[k][5] is None) == (w[5] is None) and got[k][5] == (w[5] and pytest.approx(w[5]))


@pytest.mark.parametrize("rows_per_chunk", [None, 9])
def test_component_times(spark, batches, rows_per_chunk):
    spark, table, stream = table_and_stream(spark, batches)
    want = shares_one_by_one(table.selectExpr(*COMPONENTS).collect())
    if rows_per_chunk:
        spark.conf.set(ROWS_CONF, rows_per_chunk)
    try:
        twin = timing.component_times(table.selectExpr(*COMPONENTS)).collect()
        same(shown(twin), want)
        sent, _ = stepped(spark, stream.selectExpr(*COMPONENTS), carried.component_times_step())
        same(shown(sent.collect()), want)
    finally:
        spark.conf.unset(ROWS_CONF)


@pytest.mark.parametrize("baseline,rows_per_chunk", [(2.0, None), (None, 7)])
def test_thermal(spark, batches, baseline, rows_per_chunk):
    """One session has half of the rows; with small chunks it is spread over tasks."""
    spark, table, stream = table_and_stream(spark, batches)
    options = dict(batch_size=4, window=3, threshold=1.5, baseline=baseline)
    twin = timing.break_schedule(table.selectExpr(*TIMINGS), **options).collect()
    step = carried.thermal_step(**options, rows=rows_per_chunk)
    sent, _ = stepped(spark, stream.selectExpr(*TIMINGS), step)
    got = {r["event_id"]: r for r in sent.collect()}
    assert {r["batch_id"] for r in got.values()} == {0, 1, 2}
    assert len(got) == len(twin) == 600
    for r in twin:
        g = got[r["event_id"]]
        for c in ("seq", "baseline", "is_throttled", "needs_break", "takes_break", "cooling_s"):
            assert g[c] == r[c], c
        assert g["performance_ratio"] == pytest.approx(r["performance_ratio"])


def test_what_is_carried_is_small(spark, batches):
    spark, table, stream = table_and_stream(spark, batches)
    _, state = stepped(spark, stream.selectExpr(*TIMINGS), carried.thermal_step(window=3))
    kept = carried.Versions(spark, state).newest()
    assert kept.groupBy("session_id").count().agg(F.max("count")).first()[0] <= 6
    assert [f for f in sorted(subfolders(spark, state))] == ["version=1", "version=2"]
    _, state = stepped(spark, stream.selectExpr(*COMPONENTS), carried.component_times_step())
    kept = carried.Versions(spark, state).newest()
    assert kept.groupBy("run_id").count().agg(F.max("count")).first()[0] <= 2 + 3 * 3


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


EVENTS = "run_id long, component string, kind string, ts timestamp, seq long"


def test_late_events_and_finished_runs(spark):
    """A late event changes nothing and is handed over; a run that is over begins anew."""
    batches = [
        [(1, "a", "start", at(0), 1), (1, "a", "end", at(10), 3), (2, "a", "reset", at(5), 2), (2, "a", "start", at(6), 4)],
        [(1, "a", "start", at(10), 2), (1, "a", "start", at(4), 90), (1, "a", "end", at(30), 5), (3, "b", "start", at(40), 6)],
        [(3, "b", "end", at(5000), 7)],
        [(2, "a", "end", at(5001), 8), (3, "b", "end", at(5002), 9)],
    ]
    out, late = scratch_path(spark, "sent"), []
    step = carried.component_times_step("1 hour", lambda rows, i: late.extend((i, r) for r in rows.collect()))
    deliver = carried.carrying(spark, scratch_path(spark, "state"), step, progress.parquet_sink(out))
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, EVENTS)
        deliver(frame, i)
        # A batch that is run again sends the same.
        deliver(frame, i)
    got = {r["seq"]: (r["segment"], r["elapsed_s"], r["matched"], r["percent"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        3: (0, 10.0, True, 100.0), 5: (0, 30.0, True, 100.0), 7: (0, 4960.0, True, 100.0),
        # Run 2 was last seen more than an hour before 5000: its reset and start are forgotten.
        8: (0, 0.0, False, None), 9: (0, 4962.0, True, 100.0),
    }
    assert {(i, r["seq"]) for i, r in late} == {(1, 2), (1, 90)}


def test_newest_rows_are_one_small_table(spark, batches):
    spark, table, stream = table_and_stream(spark, batches)
    names = ["key as run_id", "ts", "seq", "component", "kind as message"]
    for partial, merge, twin in (
        (progress.latest_state, progress.latest_state, progress.latest_state),
        (progress.status_parts, progress.merge_status, progress.status_parts),
    ):
        state = scratch_path(spark, "newest")
        sink = carried.keep_newest(spark, state, carried.newest_step(partial, merge))
        carried.run_available(stream.selectExpr(*names), "", scratch_path(spark, "checkpoint"), sink=sink)
        kept = carried.Versions(spark, state).newest()
        want = twin(table.selectExpr(*names)).select(*kept.columns)
        assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
        assert len(subfolders(spark, state)) == 2


def test_old_keys_are_forgotten(spark):
    step = carried.newest_step(progress.latest_state, progress.latest_state, forget="1 hour")
    state = scratch_path(spark, "newest")
    deliver = carried.keep_newest(spark, state, step)
    for i, rows in enumerate([[(1, "a", "x", at(0), 1), (2, "a", "x", at(3000), 2)], [(3, "a", "x", at(4000), 3)]]):
        deliver(spark.createDataFrame(rows, EVENTS), i)
    assert {r["run_id"] for r in carried.Versions(spark, state).newest().collect()} == {2, 3}


def test_run_status(spark):
    rows = [(1, 1, "diffusion", "x"), (1, 2, "complete", "x"), (2, 1, "idle", "Error: no memory"),
            (3, 1, "idle", "Ready"), (4, 1, "complete", "x"), (4, 2, "input", "x")]
    events = spark.createDataFrame(rows, "run_id int, seq int, component string, message string").withColumn(
        "ts", F.timestamp_seconds("seq")
    )
    got = {r["run_id"]: (r["status"], r["ever_completed"], r["ever_failed"])
           for r in progress.run_status(events).collect()}
    assert got == {1: ("complete", True, False), 2: ("failed", False, True),
                   3: ("active", False, False), 4: ("active", True, False)}


def test_idle_windows_close_sessions(spark, batches):
    session, table, stream = table_and_stream(spark, batches)
    path = collect(session, progress.idle_windows(stream, "key", watermark="10 minutes"))
    got = {(r["key"], r["started"], r["last_seen"], r["events"]) for r in session.read.parquet(path).collect()}
    twin = timing.idle_sessions(table, ["key"], ["ts", "seq"]).where("key % 3 <> 0").collect()
    every = {(r["key"], r["started"], r["last_seen"], r["events"]) for r in twin}
    end = START + datetime.timedelta(seconds=599 * 37)
    closed = {s for s in every if s[2] + datetime.timedelta(seconds=60 * s[0], minutes=11) < end}
    assert closed and closed <= got <= every
    state = scratch_path(session, "open")
    step = carried.newest_step(
        lambda e: progress.open_sessions(e, "key"), lambda p: progress.merge_sessions(p, "key"), at="last_seen"
    )
    carried.run_available(stream, "", scratch_path(session, "checkpoint"), sink=carried.keep_newest(session, state, step))
    opened = {r["key"]: r["events"] for r in carried.Versions(session, state).newest().collect()}
    assert opened == {r["key"]: r["events"] for r in timing.idle_sessions(
        table, ["key"], ["ts", "seq"]).where("key % 3 = 0").collect()}


def test_fan_out_drops_only_the_failing_sink(spark, batches):
    session, table, stream = table_and_stream(spark, batches)
    good, calls, errors = scratch_path(session, "good"), [], []

    def failing(batch, batch_id):
        calls.append(batch_id)
        raise OSError("gone")

    deliver = progress.fan_out(
        {"failing": failing, "good": progress.parquet_sink(good)},
        lambda name, batch_id, problem: errors.append((name, batch_id)),
    )
    carried.run_available(stream, "", scratch_path(session, "fan-state"), sink=deliver)
    assert calls == [0] and errors == [("failing", 0)]
    assert session.read.parquet(good).count() == 600


def test_a_repeated_batch_replaces_itself(spark):
    path = scratch_path(spark, "repeat")
    sink = progress.parquet_sink(path)
    for _ in range(2):
        sink(spark.range(5), 0)
    assert spark.read.parquet(path).count() == 5


def test_streams_read_a_folder_of_files(spark, data, tmp_path):
    """Several files in several micro-batches give what the one file gives."""
    from kilnflow.plans import catalog

    spark.read.parquet(f"{data}/events.parquet").repartitionByRange(3, "ts").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    spark.conf.set(catalog.STREAM_BYTES_CONF, "1")
    try:
        for name in ("T1_latest_state", "T2_stream_progress", "T5_run_status", "T7_fan_out"):
            one = catalog.QUERIES[name](spark, data).collect()
            many = catalog.QUERIES[name](spark, str(tmp_path)).collect()
            assert one and sorted(map(str, one)) == sorted(map(str, many)), name
    finally:
        spark.conf.unset(catalog.STREAM_BYTES_CONF)


def test_fan_out_says_what_a_sink_missed(spark):
    from kilnflow.streaming import progress

    def broken(batch, batch_id):
        if batch_id == 2:
            raise OSError("gone")

    got = []
    deliver = progress.fan_out({"broken": broken, "good": lambda b, i: got.append(i)})
    for i in range(4):
        deliver(spark.range(1), i)
    assert deliver.missed == {"broken": 2} and got == [0, 1, 2, 3]


def test_a_failed_sink_stays_out_until_it_is_replayed(spark):
    ledger = progress.Ledger(spark, scratch_path(spark, "ledger"))
    every, weak = scratch_path(spark, "every"), scratch_path(spark, "weak")
    down = {"now": True}

    def receiver(batch, batch_id):
        if down["now"] and batch_id == 1:
            raise OSError("gone")
        progress.parquet_sink(weak)(batch, batch_id)

    def started():
        return progress.fan_out({"we/ak": receiver, "every": progress.parquet_sink(every)}, lambda *_: None, ledger)

    deliver = started()
    for i in (0, 1):
        deliver(spark.range(i, i + 1), i)
    down["now"] = False
    # The driver starts again: what the sink missed is known, and it gets nothing more.
    assert progress.Ledger(spark, ledger.path).missed() == {"we/ak": 1}
    deliver = started()
    deliver(spark.range(2, 3), 2)
    assert {r["id"] for r in spark.read.parquet(weak).collect()} == {0}
    for _ in range(2):
        progress.replay(ledger, "we/ak", receiver, every)
    assert ledger.missed() == {}
    started()(spark.range(3, 4), 3)
    assert sorted(r["id"] for r in spark.read.parquet(weak).collect()) == [0, 1, 2, 3]
