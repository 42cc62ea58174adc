"""Timing operators: literal traps and an independent step-by-step model."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kilnflow.functions import rates
from kilnflow.operators import timing


def log_of(spark, sessions):
    rows = [
        (s, i, i, float(v)) for s, values in sessions.items() for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "session_id string, ts int, event_id int, elapsed_s double")


class Model:
    """One timing at a time, with a list and counters."""

    def __init__(self, window, threshold, baseline, batch, batch_s, cool_s):
        self.recent, self.seen, self.since = [], 0, 0
        self.window, self.threshold, self.baseline = window, threshold, baseline
        self.batch, self.batch_s, self.cool_s = batch, batch_s, cool_s

    def before(self):
        slow = False
        if self.recent and self.baseline:
            slow = max(self.recent) / self.baseline >= self.threshold
        boundary = self.batch is not None and self.since >= self.batch
        if slow or boundary:
            self.since = 0
        return slow, boundary, self.batch_s if boundary else self.cool_s if slow else 0

    def record(self, value):
        self.recent = (self.recent + [value])[-self.window :]
        self.seen += 1
        self.since += 1
        if self.baseline is None and self.seen == 3:
            self.baseline = statistics.median(self.recent)
        if self.baseline is None:
            return None
        return self.baseline / statistics.mean(self.recent)


@pytest.mark.parametrize("rows", [4, 10**6])
@pytest.mark.parametrize(
    "window,threshold,baseline,batch",
    [(5, 1.5, None, 10), (5, 1.3, 4.0, 3), (2, 1.5, None, 1), (1, 2.0, None, 4), (7, 1.1, 9.0, None)],
)
def test_schedule_follows_the_model(spark, rows, window, threshold, baseline, batch):
    rng = random.Random(window * 100 + rows)
    sessions = {f"s{i}": [rng.choice([1, 2, 3, 4, 6, 9, 15]) for _ in range(n)]
                for i, n in enumerate([1, 2, 3, 4, 9, 30, 160])}
    plan = timing.break_schedule(
        log_of(spark, sessions), batch, 60, 30, window, threshold, baseline, rows=rows
    )
    got = {(r["session_id"], r["ts"]): r for r in plan.collect()}
    for name, values in sessions.items():
        model = Model(window, threshold, baseline, batch, 60, 30)
        for i, value in enumerate(values):
            r = got[name, i]
            slow, boundary, cooling = model.before()
            ratio = model.record(value)
            assert r["seq"] == i + 1
            assert r["needs_break"] == slow
            assert r["at_batch_boundary"] == boundary
            assert r["takes_break"] == (slow or boundary)
            assert r["cooling_s"] == cooling
            assert r["baseline"] == model.baseline
            if ratio is None:
                assert r["recent_times"] is None and r["is_throttled"] is None
            else:
                assert r["performance_ratio"] == pytest.approx(ratio)
                assert r["is_throttled"] == (ratio < 1 / threshold)
                assert r["recent_times"] == model.recent


@pytest.mark.parametrize("window,expected", [(5, 2.0), (2, 5.5), (1, 9.0)])
def test_baseline_uses_the_window(spark, window, expected):
    log = log_of(spark, {"a": [1, 2, 9, 100, 100], "short": [1, 2]})
    got = dict(timing.learn_baseline(log, window).collect())
    assert got == {"a": expected, "short": None}


def test_break_on_max_inclusive_not_mean(spark):
    flags = timing.needs_break(log_of(spark, {"a": [1, 1, 15, 1]}), threshold=1.5, baseline=10.0)
    assert [r["needs_break"] for r in flags.orderBy("ts").collect()] == [False, False, False, True]


def test_flat_items_break_at_batches(spark):
    plan = timing.break_schedule(log_of(spark, {"a": [1.0] * 12}), batch_size=5)
    assert [r["seq"] for r in plan.where("takes_break").orderBy("seq").collect()] == [6, 11]


def test_zero_baseline_gives_null(spark):
    plan = timing.break_schedule(log_of(spark, {"a": [0, 0, 0, 0]}))
    assert {r["performance_ratio"] for r in plan.collect()} == {None}


def test_stats_of_a_short_session(spark):
    row = timing.timing_stats(log_of(spark, {"a": [3, 5]})).first()
    assert (row["generations"], row["avg_s"], row["baseline"]) == (2, 4.0, None)
    assert row["currently_throttled"] is False and row["breaks_taken"] == 0


def events_of(spark, rows):
    return spark.createDataFrame(rows, "run_id int, component string, kind string, at int, seq int").withColumn(
        "ts", F.timestamp_seconds("at")
    )


def test_start_is_not_consumed_and_missing_start_is_no_timing(spark):
    events = events_of(
        spark,
        [(1, "a", "start", 0, 1), (1, "a", "end", 2, 2), (1, "a", "end", 5, 3), (1, "b", "end", 6, 4)],
    )
    got = {r["seq"]: (r["elapsed_s"], r["matched"]) for r in timing.pair_start_end(events).collect()}
    assert got == {2: (2.0, True), 3: (5.0, True), 4: (0.0, False)}
    share = timing.component_share(timing.pair_start_end(events).where("matched")).collect()
    assert [(r["component"], r["elapsed_s"], r["percent"]) for r in share] == [("a", 5.0, 100.0)]


def test_reset_forgets_starts(spark):
    events = events_of(
        spark, [(1, "a", "start", 0, 1), (1, "b", "reset", 1, 2), (1, "a", "end", 2, 3)]
    )
    pairs = timing.pair_start_end(timing.run_segments(events), ["run_id", "segment", "component"])
    assert [(r["segment"], r["elapsed_s"], r["matched"]) for r in pairs.collect()] == [(1, 0.0, False)]


def test_share_of_nothing_gives_no_rows(spark):
    times = spark.createDataFrame([(1, "a", 0.0, 1)], "run_id int, component string, elapsed_s double, seq int")
    assert timing.component_share(times).count() == 0


def test_stage_breakdown_denominator(spark):
    times = spark.createDataFrame(
        [(1, "input", 2.0), (1, "text-encode", 1.0), (1, "text-embed", 3.0), (1, "start", 9.0),
         (2, "input", 2.0), (2, "total", 8.0), (3, "output", 2.0), (3, "total", 0.0)],
        "run_id int, component string, elapsed_s double",
    )
    got = {(r["run_id"], r["stage"]): (r["stage_s"], r["percent"]) for r in timing.stage_breakdown(times).collect()}
    assert len(got) == 15
    assert got[1, "stageEncoding"] == (4.0, 400.0)
    assert got[2, "stageInput"] == (2.0, 25.0)
    assert got[3, "stageOutput"] == (2.0, 200.0)
    assert got[3, "stageDecoding"] == (0.0, 0.0)


def test_guide_efficiency(spark):
    log = spark.createDataFrame([(1, 228, 530.0)], "run_id int, steps int, elapsed_s double")
    row = timing.session_efficiency(log, 1.0).first()
    assert row["wasted_s"] == 302.0
    assert row["loss_pct"] == pytest.approx(56.98, abs=0.01)


def test_idle_gap_is_inclusive_and_null_never_closes(spark):
    rows = [("a", 0, 1, 10), ("a", 9, 2, 10), ("a", 19, 3, 10), ("b", 0, 1, None), ("b", 10**6, 2, None)]
    events = spark.createDataFrame(rows, "user_id string, at int, event_id int, gap_s int").withColumn(
        "ts", F.timestamp_seconds("at")
    )
    got = sorted((r["user_id"], r["session_no"], r["events"]) for r in timing.idle_sessions(events).collect())
    assert got == [("a", 1, 2), ("a", 2, 1), ("b", 1, 2)]


def test_rates_and_labels(spark):
    row = spark.range(1).select(
        rates.per_second(F.lit(10.0), F.lit(0.0)).alias("none"),
        rates.ratio(F.lit(1.0), F.lit(0.0)).alias("null"),
        rates.duration_text(F.lit(60.0)).alias("d60"),
        rates.duration_text(F.lit(60.5)).alias("d605"),
        rates.duration_text(F.lit(125.0)).alias("d125"),
        rates.percent_done(F.lit(3), F.lit(0)).alias("full"),
        rates.performance_label(F.lit(0.125)).alias("even"),
        rates.performance_label(F.lit(None).cast("double")).alias("unknown"),
        rates.throttle_label(F.lit(None).cast("boolean")).alias("normal"),
    ).first()
    assert (row["none"], row["null"]) == (0.0, None)
    assert (row["d60"], row["d605"], row["d125"]) == ("60s", "1m 0s", "2m 5s")
    assert row["full"] == 100.0
    assert (row["even"], row["unknown"]) == ("Performance: 12%", "Establishing baseline...")
    assert row["normal"] == "NORMAL"


def test_rows_of_cut_keys_move_once(spark):
    """The final plan reads what the one window has written: only edges and sums are shuffled."""
    log = log_of(spark, {"hot": [1 + i % 7 for i in range(300)], "small": [2, 3, 4]})
    for made in (timing.break_schedule(log, rows=20), timing.rolling_state(log, rows=20)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        rows = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(rows) == 2 and plan.count("Exchange hashpartitioning") == 2
