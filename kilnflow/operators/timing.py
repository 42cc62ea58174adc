"""Session timings: slow-down against a session's own baseline, breaks, stage shares.

A timing log has one row per finished item: session key(s), order column(s) and one elapsed
column. The unit (per step or per item) is the caller's; the baseline must use the same one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnflow.constants import DISPLAY_STAGES, PHASES, STAGE_OF_COMPONENT
from kilnflow.functions.rates import ratio
from kilnflow.operators.ordered import (
    CHUNK,
    HELPERS,
    SPLIT,
    Running,
    across_chunks,
    attach,
    chunk_window,
    cut,
    first_rows,
    is_whole,
    last_n,
    previous,
    running,
)
from kilnflow.session import staged

SESSION = ("session_id",)
ORDER = ("ts", "event_id")

#: Columns of rows that a stream has handled before: how many items a row stands for, and how
#: many items ago the last slow one was.
STEP = "_step"
AGO = "_ago"


def _learned(first: Sequence[Column], window: int) -> Column:
    """Median of those of the first three timings that a window holds at the third."""
    held = list(first)[-window:]
    if len(held) == 3:
        a, b, c = held
        middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    else:
        middle = sum(held[1:], held[0]) / len(held)
    return F.when(first[2].isNotNull(), middle)


def learn_baseline(
    log: DataFrame,
    window: int = 5,
    keys: Sequence[str] = SESSION,
    order: Sequence[str] = ORDER,
    elapsed: str = "elapsed_s",
) -> DataFrame:
    """Baseline per session: median of the timings the window holds at the third one."""
    heads = first_rows(log, keys, order, elapsed, 3, "_head")
    first = [F.get("_head", F.lit(i)) for i in range(3)]
    return heads.select(*keys, _learned(first, window).alias("baseline"))


def item_state(
    log: DataFrame,
    window: int,
    threshold: float,
    baseline: float | None,
    keys: Sequence[str],
    order: Sequence[str],
    elapsed: str,
    rows: int | None,
) -> DataFrame:
    """Per item: position, state after it (mean, ratio, ...), the flag before it, and ``_opened``,
    the last flagged position before it.

    With cut keys the rows move once: everything that a chunk knows by itself is computed in its
    window and written, and what it needs of the chunks before it is made from the first and
    last rows of each, read back by rank. Rows with ``STEP`` were handled before: they count as
    that many items, and their flag is not computed again.
    """
    keys, order = list(keys), list(order)
    resumed = STEP in log.columns
    log = cut(log, keys, order, rows)
    whole = is_whole(log)
    kept = [c for c in log.columns if c not in HELPERS]
    if not whole:
        heads = first_rows(log.where(SPLIT), keys, order, elapsed, 3, "_head")
        log = attach(log, heads, keys)
    ordered = chunk_window(keys, order)
    upto = ordered.rowsBetween(-(window - 1), 0)
    ahead = ordered.rowsBetween(-window, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    out = log.select(
        "*",
        F.row_number().over(ordered).alias("_rank"),
        (F.sum(F.coalesce(STEP, F.lit(1))).over(so_far) if resumed else F.row_number().over(ordered))
        .cast("long").alias("_at"),
        F.collect_list(elapsed).over(upto).alias("_recent"),
        F.sum(elapsed).over(upto).alias("_sum"),
        F.max(elapsed).over(upto).alias("_max"),
        F.max(elapsed).over(ahead).alias("_past_max"),
        *[F.nth_value(elapsed, i).over(so_far).alias(f"_first{i}") for i in (1, 2, 3)],
        *([] if whole else [F.lead(F.lit(True), window).over(ordered).isNull().alias("_ends")]),
    )

    # The first rows of a later chunk are decided when the chunks before it are known.
    early = max(window, 3)
    decided = F.lit(True) if whole else ~F.col(SPLIT) | (F.col("_rank") > early)
    if baseline is None:
        first = [F.col(f"_first{i}") for i in (1, 2, 3)]
        if not whole:
            first = [F.when(F.col(SPLIT), F.get("_head", F.lit(i))).otherwise(f) for i, f in enumerate(first)]
        known = _learned(first, window)
    else:
        known = F.lit(float(baseline))

    def base(seq: Column, from_item: int) -> Column:
        return known if baseline is not None else F.when(seq >= from_item, known)

    def is_slow(past_max: Column, seq: Column) -> Column:
        return F.coalesce(F.try_divide(past_max, base(seq, 4)) >= threshold, F.lit(False))

    new = F.col(STEP).isNull() if resumed else F.lit(True)
    slow = new & is_slow(F.col("_past_max"), F.col("_at"))
    mark = F.when(decided & slow, F.col("_at"))
    if resumed:
        mark = F.coalesce(F.when(decided, F.col("_at") - F.col(AGO)), mark)
    out = out.withColumn("_mark", mark).withColumn(
        "_opened", F.max("_mark").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    )
    if whole:
        out = out.withColumns({
            "seq": F.col("_at"), "recent_times": F.col("_recent"), "recent_max": F.col("_max"),
            "recent_mean": F.col("_sum") / F.least("_rank", F.lit(window)), "_slow": slow,
        })
    else:
        out = staged(out.withColumn("_known", known), "item-state")
        known = F.col("_known")
        edges = _chunk_edges(out, window, early, keys, elapsed, threshold, baseline is None, resumed)
        out = attach(out, edges, [*keys, CHUNK])
        # What a row's own chunk lacks of the window comes from the tail.
        rank = F.col("_rank")
        reaches_back = F.col("_tail").isNotNull() & (rank <= window)
        lacking = last_n(F.col("_tail"), F.greatest(F.lit(window) - rank, F.lit(0)))
        lacking_past = last_n(F.col("_tail"), F.lit(window + 1) - rank)
        held_sum = F.aggregate(lacking, F.lit(0.0), lambda a, b: a + b) + F.col("_sum")
        before = F.coalesce(F.col("_before"), F.lit(0))
        early_marks = F.filter("_early", lambda e: e["rank"] < rank)
        out = out.withColumns({
            "seq": F.col("_at") + before,
            "recent_times": F.when(reaches_back, F.concat(lacking, F.col("_recent"))).otherwise(F.col("_recent")),
            "recent_mean": F.when(reaches_back, held_sum / (F.size(lacking) + rank)).otherwise(
                F.col("_sum") / F.least(rank, F.lit(window))
            ),
            "recent_max": F.when(reaches_back, F.greatest(F.array_max(lacking), F.col("_max"))).otherwise(F.col("_max")),
            "_past_max": F.when(
                reaches_back, F.greatest(F.array_max(lacking_past), F.col("_past_max"))
            ).otherwise(F.col("_past_max")),
            "_opened": F.greatest(
                F.col("_opened") + before, F.col("_opened_before"),
                F.array_max(F.transform(early_marks, lambda e: e["at"])) + before,
            ),
        })
        out = out.withColumn("_slow", new & is_slow(F.col("_past_max"), F.col("seq")))
    performance = F.try_divide(F.col("baseline"), F.col("recent_mean"))
    return out.withColumn("baseline", base(F.col("seq"), 3)).select(
        *kept,
        "seq",
        "baseline",
        *[
            F.when(F.col("baseline").isNotNull(), F.col(c)).alias(c)
            for c in ("recent_times", "recent_mean", "recent_max")
        ],
        performance.alias("performance_ratio"),
        (performance < F.lit(1.0 / threshold)).alias("is_throttled"),
        F.try_divide(F.col("_past_max"), base(F.col("seq"), 4)).alias("slowdown_before"),
        F.col("_slow").alias("needs_break"),
        "_opened",
    )


def _chunk_edges(
    state: DataFrame, window: int, early: int, keys: list[str], elapsed: str, threshold: float, learns: bool, resumed: bool
) -> DataFrame:
    """What each chunk of a cut key needs of those before it, from the written ``state``.

    Items and the last timings before it (``_before``, ``_tail``), the last flagged position
    before it (``_opened_before``), and its own first rows that are flagged (``_early``). Only
    chunk 0 can be empty, so ``window`` chunks back always suffice.
    """
    rank, at = F.col("_rank"), F.col("_at")
    ends = state.where(SPLIT).where(F.col("_ends") | (rank <= early))
    new = F.col(STEP).isNull() if resumed else F.lit(True)
    ago = (at - F.col(AGO)) if resumed else F.lit(None).cast("long")
    opening = F.struct(rank.alias("rank"), F.col(elapsed).alias("v"), at.alias("at"), new.alias("new"), ago.alias("marked"))
    chunks = ends.groupBy(*keys, SPLIT, CHUNK).agg(
        F.max("_at").alias("_n"),
        F.greatest(F.max("_opened"), F.max("_mark")).alias("_marked"),
        F.max("_known").alias("_known"),
        F.sort_array(F.collect_list(F.when(F.col("_ends"), F.struct("_rank", F.col(elapsed).alias("v")))))["v"].alias("_end"),
        F.sort_array(F.collect_list(F.when(rank <= early, opening))).alias("_start"),
    )
    along = across_chunks(keys)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *keys, CHUNK, "_start", "_marked", "_known",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        last_n(F.flatten(F.collect_list("_end").over(along.rowsBetween(-window, -1))), window).alias("_tail"),
    )

    def decided(e: Column) -> Column:
        """The row with its position in the chunk if it is flagged."""
        own = F.transform(F.filter("_start", lambda o: o["rank"] < e["rank"]), lambda o: o["v"])
        past = F.array_max(last_n(F.concat(F.coalesce("_tail", F.array().cast("array<double>")), own), F.lit(window)))
        known = F.when(F.col("_before") + e["at"] > 3, F.col("_known")) if learns else F.col("_known")
        flagged = e["new"] & F.coalesce(F.try_divide(past, known) >= threshold, F.lit(False))
        return F.struct(e["rank"].alias("rank"), F.coalesce(F.when(flagged, e["at"]), e["marked"]).alias("at"))

    chunks = chunks.withColumn("_early", F.filter(F.transform("_start", decided), lambda e: e["at"].isNotNull()))
    marks = F.greatest(F.col("_marked"), F.array_max(F.transform("_early", lambda e: e["at"]))) + F.col("_before")
    return chunks.withColumn("_marks", marks).select(
        *keys, CHUNK, "_before", "_tail", "_early", F.max("_marks").over(before).alias("_opened_before")
    )


def rolling_state(
    log: DataFrame,
    window: int = 5,
    threshold: float = 1.5,
    baseline: float | None = None,
    keys: Sequence[str] = SESSION,
    order: Sequence[str] = ORDER,
    elapsed: str = "elapsed_s",
    rows: int | None = None,
) -> DataFrame:
    """State after each item over the last ``window`` timings; null before a baseline."""
    state = item_state(log, window, threshold, baseline, keys, order, elapsed, rows)
    return state.drop("slowdown_before", "needs_break", "_opened")


def needs_break(
    log: DataFrame,
    window: int = 5,
    threshold: float = 1.5,
    baseline: float | None = None,
    keys: Sequence[str] = SESSION,
    order: Sequence[str] = ORDER,
    elapsed: str = "elapsed_s",
    rows: int | None = None,
) -> DataFrame:
    """Flag before each item: slowest recent timing at or over threshold x baseline."""
    state = item_state(log, window, threshold, baseline, keys, order, elapsed, rows)
    kept = [c for c in log.columns if c not in HELPERS]
    return state.select(*kept, "seq", "slowdown_before", "needs_break")


def break_schedule(
    log: DataFrame,
    batch_size: int | None = 10,
    batch_cooling_s: int = 60,
    cooling_s: int = 30,
    window: int = 5,
    threshold: float = 1.5,
    baseline: float | None = None,
    keys: Sequence[str] = SESSION,
    order: Sequence[str] = ORDER,
    elapsed: str = "elapsed_s",
    rows: int | None = None,
) -> DataFrame:
    """Breaks before items: when slow, or after ``batch_size`` items without a break.

    The slow flag does not depend on breaks, so the items since the last break follow from
    the last flagged item alone: after it, and after every ``batch_size`` items, the count
    starts again. ``batch_size=None`` plans slow-down breaks only.
    """
    state = item_state(log, window, threshold, baseline, keys, order, elapsed, rows)
    return scheduled(state, batch_size, batch_cooling_s, cooling_s).drop("_opened")


def scheduled(
    state: DataFrame, batch_size: int | None, batch_cooling_s: int, cooling_s: int
) -> DataFrame:
    """The breaks of items whose state is known."""
    if batch_size is None:
        boundary = F.lit(False)
    else:
        since = F.col("seq") - F.coalesce(F.col("_opened"), F.lit(1))
        boundary = (F.col("seq") > 1) & (since % batch_size == 0)
    takes = F.col("needs_break") | boundary
    duration = F.when(boundary, batch_cooling_s).when(F.col("needs_break"), cooling_s).otherwise(0)
    return state.select(
        "*",
        boundary.alias("at_batch_boundary"),
        takes.alias("takes_break"),
        duration.alias("cooling_s"),
    )


def timing_stats(
    log: DataFrame,
    batch_size: int | None = 10,
    batch_cooling_s: int = 60,
    cooling_s: int = 30,
    window: int = 5,
    threshold: float = 1.5,
    baseline: float | None = None,
    keys: Sequence[str] = SESSION,
    order: Sequence[str] = ORDER,
    elapsed: str = "elapsed_s",
    rows: int | None = None,
) -> DataFrame:
    """One row per session: counts, range, baseline, state at its last item, breaks."""
    items = break_schedule(
        log, batch_size, batch_cooling_s, cooling_s, window, threshold, baseline,
        keys, order, elapsed, rows,
    )
    throttled = F.max_by(F.col("is_throttled"), F.col("seq"))
    return (
        items.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("generations"),
            F.avg(elapsed).alias("avg_s"),
            F.min(elapsed).alias("min_s"),
            F.max(elapsed).alias("max_s"),
            F.max_by("baseline", "seq").alias("baseline"),
            F.max_by("performance_ratio", "seq").alias("current_ratio"),
            F.coalesce(throttled, F.lit(False)).alias("currently_throttled"),
            F.sum(F.col("takes_break").cast("int")).alias("breaks_taken"),
            F.sum("cooling_s").alias("total_cooling_s"),
        )
    )


# --- component events -------------------------------------------------------------------


def run_segments(
    events: DataFrame,
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("ts", "seq"),
    rows: int | None = None,
) -> DataFrame:
    """Number the stretches between resets of a run; the reset row opens the new one."""
    resets = F.when(F.col("kind") == "reset", 1).otherwise(0)
    return running(events, keys, order, {"segment": Running("sum", resets)}, rows=rows)


def pair_start_end(
    events: DataFrame,
    keys: Sequence[str] = ("run_id", "component"),
    order: Sequence[str] = ("ts", "seq"),
    rows: int | None = None,
) -> DataFrame:
    """Elapsed seconds at each end since the latest start, which stays in force.

    An end without a start gives 0 and ``matched`` false; such rows are not timings.
    """
    started = F.when(F.col("kind") == "start", F.struct(*order))
    paired = running(events, keys, order, {"_start": Running("max", started)}, rows=rows)
    seconds = (
        F.unix_micros(F.col(order[0]).cast("timestamp"))
        - F.unix_micros(F.col(f"_start.{order[0]}").cast("timestamp"))
    ) / 1e6
    return (
        paired.where(F.col("kind") == "end")
        .withColumn("matched", F.col("_start").isNotNull())
        .withColumn("elapsed_s", F.coalesce(seconds, F.lit(0.0)))
        .drop("_start")
    )


def component_times(
    events: DataFrame,
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("ts", "seq"),
    resets: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """At each end: segment, elapsed seconds, and the component's percent of the run so far.

    A component counts with its last elapsed time; a reset forgets all of them. The percent is
    null while the times sum to 0. ``resets`` names a column that says how many resets a
    reset row stands for. Times are added up in microseconds, exactly.
    """
    keys, order = list(keys), list(order)
    weight = F.coalesce(F.col(resets), F.lit(1)) if resets else F.lit(1)
    step = F.when(F.col("kind") == "reset", weight).otherwise(0)
    seen = running(events, keys, order, {"segment": Running("sum", step)}, rows=rows)
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    started = F.when(F.col("kind") == "start", F.struct(*order, micros.alias("us")))
    inside = [*keys, "segment"]
    paired = running(seen, [*inside, "component"], order, {"_start": Running("max", started)}, rows=rows)
    ends = paired.where(F.col("kind") == "end").withColumn("_us", micros - F.col("_start.us"))
    earlier = previous(ends, [*inside, "component"], order, "_us", "_earlier", rows)
    change = F.coalesce(F.col("_us"), F.lit(0)) - F.coalesce(F.col("_earlier"), F.lit(0))
    total = running(earlier, inside, order, {"_total": Running("sum", change)}, rows=rows)
    of_component = F.coalesce(F.col("_us"), F.lit(0))
    return total.select(
        *[c for c in events.columns if c != "kind"],
        "segment",
        (of_component / 1e6).alias("elapsed_s"),
        F.col("_start").isNotNull().alias("matched"),
        (of_component / F.nullif("_total", F.lit(0)) * 100).alias("percent"),
        "_start",
    )


def latest_per_component(
    times: DataFrame, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("seq",)
) -> DataFrame:
    """The last elapsed time of each component of a run."""
    # A single order column stays a plain number, which lets Spark aggregate by hash.
    newest = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return times.groupBy(*keys, "component").agg(F.max_by("elapsed_s", newest).alias("elapsed_s"))


def component_share(
    times: DataFrame, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Percent of a run's time per component; runs that sum to 0 give no rows.

    The window sees one row per component of a run, not the events.
    """
    total = F.sum("elapsed_s").over(Window.partitionBy(*keys))
    return (
        latest_per_component(times, keys, order)
        .withColumn("total_s", total)
        .where(F.col("total_s") != 0)
        .withColumn("percent", F.col("elapsed_s") / F.col("total_s") * 100)
    )


def map_stage(
    times: DataFrame, stages: Mapping[str, str] = STAGE_OF_COMPONENT, keep_total: bool = False
) -> DataFrame:
    """Replace components by their stage; components without one are dropped."""
    pairs = [F.lit(x) for pair in stages.items() for x in pair]
    known = list(stages) + (["total"] if keep_total else [])
    return times.where(F.col("component").isin(known)).withColumn(
        "stage", F.create_map(*pairs)[F.col("component")]
    )


def stage_breakdown(
    times: DataFrame,
    stages: Mapping[str, str] = STAGE_OF_COMPONENT,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Time and percent of every stage of a run, absent ones as 0.

    Takes one row per (run, component). The component ``total`` is the denominator, and a
    missing or zero one counts as 1.
    """
    per_stage = [
        F.coalesce(
            F.sum(
                F.when(
                    F.col("component").isin([c for c, s in stages.items() if s == stage]),
                    F.col("elapsed_s"),
                )
            ),
            F.lit(0.0),
        ).alias(stage)
        for stage in DISPLAY_STAGES
    ]
    declared = F.max(F.when(F.col("component") == "total", F.col("elapsed_s")))
    divisor = F.coalesce(F.nullif(F.col("_total"), F.lit(0.0)), F.lit(1.0))
    cells = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(s).alias("stage_s")) for s in DISPLAY_STAGES]
    )
    percent = F.when(divisor > 0, F.col("stage_s") / divisor * 100).otherwise(0.0)
    return (
        times.groupBy(*keys)
        .agg(*per_stage, declared.alias("_total"))
        .select(*keys, "_total", F.inline(cells))
        .withColumn("percent", percent)
        .drop("_total")
    )


# --- step logs --------------------------------------------------------------------------


def session_efficiency(
    log: DataFrame, normal_s_per_step: float, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Actual against ideal time of a session; loss is wasted over actual."""
    sums = log.groupBy(*keys).agg(
        F.sum("elapsed_s").alias("actual_s"),
        (F.sum("steps") * F.lit(float(normal_s_per_step))).alias("ideal_s"),
    )
    wasted = F.col("actual_s") - F.col("ideal_s")
    return sums.withColumn("wasted_s", wasted).withColumn(
        "loss_pct", F.try_divide(F.col("wasted_s"), F.col("actual_s")) * 100
    )


def batch_summary(log: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Items, total and mean time of each batch."""
    return (
        log.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("items"), F.sum("elapsed_s").alias("total_s"))
        .withColumn("mean_s", F.try_divide(F.col("total_s"), F.col("items")))
    )


def phase_profile(
    log: DataFrame, phases: Sequence[tuple[str, int, int | None]] = PHASES
) -> DataFrame:
    """Range of seconds per step for each range of step counts."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("steps") >= low)
                    & (F.lit(True) if high is None else F.col("steps") <= high),
                    F.lit(name),
                )
                for name, low, high in phases
            ]
        )
    )
    return (
        log.select(F.explode(hits).alias("phase"), ratio("elapsed_s", "steps").alias("_rate"))
        .groupBy("phase")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.min("_rate").alias("min_s_per_step"),
            F.max("_rate").alias("max_s_per_step"),
        )
    )


def idle_sessions(
    events: DataFrame,
    keys: Sequence[str] = ("user_id",),
    order: Sequence[str] = ("ts", "event_id"),
    gap_s: str = "gap_s",
    rows: int | None = None,
) -> DataFrame:
    """Sessions closed by idleness; a null gap never closes one.

    The gap belongs to the key (each key has one time-out). A row opens a session when the
    row before it is at least the gap older.
    """
    keys, order = list(keys), list(order)
    at = order[0]
    seen = previous(events, keys, order, at, "_seen", rows, keep_chunks=True)
    idle = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(
        F.col("_seen").cast("timestamp")
    )
    opens = F.col("_seen").isNull() | F.coalesce(idle >= F.col(gap_s).cast("long") * 1_000_000, F.lit(False))
    numbered = running(
        seen, keys, order, {"session_no": Running("sum", opens.cast("int"))}
    )
    return numbered.groupBy(*keys, "session_no").agg(
        F.min(at).alias("started"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("events")
    )
