"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.constants import COMPONENT_MODES, MODELS
from kilnflow.functions import payload, rates, text, vectors
from kilnflow.operators import assets, audit, edits, infer, lookups, naming, requests, timing
from kilnflow.plans import feeds
from kilnflow.session import scratch_path, table
from kilnflow.sources import files
from kilnflow.streaming import carried, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def r6(column: str | Column, name: str | None = None, places: int = 6) -> Column:
    """Doubles are compared to six places, or to more where values end in a tie at six."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, places).alias(name or column)


def day_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- sources and sinks ------------------------------------------------------------------


@query("S1_read_prompts")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "prompts")
    feeds.prompts(spark, sf).select("text").write.text(folder)
    return files.read_prompts(spark, folder).select("prompt")


@query("S2_read_requests")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    parsed = files.parse_requests(feeds.calls(spark, sf).drop("name"), "arguments")
    return parsed.select(
        "call_id", "prompt", "seed", "num_inference_steps", "return_base64", "request_error"
    )


@query("S2_read_request_files")
def s2_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "requests")
    feeds.requests(spark, sf).select(
        F.when(F.col("seed") != 1, F.col("prompt")).alias("prompt"),
        "width",
        "height",
        "num_inference_steps",
        F.col("request_id").alias("seed"),
    ).write.json(folder)
    return files.read_requests(spark, folder, files.VISUAL_REQUEST, files.VISUAL_DEFAULTS).select(
        "prompt", "width", "height", "num_inference_steps", "seed", "mode", "guidance_scale",
        "strength", "request_error",
    )


@query("S3_asset_catalog")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    return assets.describe_assets(feeds.assets(spark, sf)).select("path", "length", r6("size_mb"))


@query("S3_read_asset_catalog")
def s3_files(spark: SparkSession, sf: str) -> DataFrame:
    """One asset file for each source, listed by the reader."""
    folder = scratch_path(spark, "assets")
    names = table(spark, sf, "documents").select("source", F.concat("lang", F.col("doc_id")).alias("value"))
    names.hint("rebalance", "source").write.partitionBy("source").text(folder)
    catalog = files.read_asset_catalog(spark, f"{folder}/source=*", "*.txt")
    source = F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source")
    return assets.describe_assets(catalog).groupBy(source).agg(
        F.sum("length").alias("length"), F.bool_and(F.col("mtime").isNotNull()).alias("dated"),
        F.round(F.sum("size_mb"), 6).alias("size_mb"),
    )


@query("S4_image_dimensions")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    sizes = feeds.requests(spark, sf).select("request_id", "width", "height")

    def number(c: str) -> Column:
        return F.unhex(F.lpad(F.hex(F.coalesce(c, F.lit(0))), 8, "0"))

    signature = F.when(F.col("request_id") % 10 == 9, "FFD8FFE000104A46").otherwise(
        payload.PNG_SIGNATURE
    )
    content = F.concat(
        F.unhex(signature), F.unhex(F.lit("0000000D49484452")), number("width"), number("height")
    )
    size = payload.image_size("content")
    return sizes.withColumn("content", content).select(
        "request_id", size["width"].alias("width"), size["height"].alias("height")
    )


@query("S5_session_layout")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "sessions")
    name = F.concat("source", F.lit(": "), "lang")
    subdir = F.element_at(F.array(F.lit("images"), F.lit("data"), F.lit("notes")),
                          (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(
        "doc_id",
        text.session_key(name, F.lit("2025-10-18").cast("date")).alias("session_key"),
        files.asset_kind(subdir).alias("kind"),
    )
    files.write_session_layout(rows, base)
    return spark.read.parquet(base).select("doc_id", "session_key", "kind")


@query("S6_payload_round_trip")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    encoded = payload.encode_payload(F.encode("text", "UTF-8"))
    url = F.when(
        F.col("prompt_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), encoded)
    ).otherwise(encoded)
    sent = feeds.prompts(spark, sf).select("prompt_id", encoded.alias("encoded"), url.alias("url"))
    decoded = F.decode(payload.decode_payload("url"), "UTF-8").alias("decoded")
    return sent.select("prompt_id", "encoded", decoded)


def _write_state_events(spark: SparkSession, sf: str) -> str:
    folder = scratch_path(spark, "events")
    metrics = F.when(F.col("total") > 0, F.create_map(F.lit("time_per_step"), "time_per_step"))
    feeds.state_events(spark, sf).select(
        "run_id", "seq", "component", "progress", "total", "message",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        metrics.alias("metrics"),
    ).write.json(folder)
    return folder


def _shown_state_events(events: DataFrame) -> DataFrame:
    return events.select(
        "run_id", "seq", "component", "progress", "total", "message",
        F.unix_micros("ts").alias("ts_micros"),
        F.size("metrics").alias("metrics"),
        r6(F.try_element_at("metrics", F.lit("time_per_step")), "time_per_step"),
    )


@query("S7_read_state_events")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return _shown_state_events(files.read_state_events(spark, _write_state_events(spark, sf)))


@query("S7_stream_state_events")
def s7_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = files.read_state_events(spark, _write_state_events(spark, sf), stream=True)
    path = scratch_path(spark, "events-read")
    carried.run_available(_shown_state_events(events), path, scratch_path(spark, "events-state"))
    return spark.read.parquet(path)


@query("S8_write_results")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "results")
    checked = requests.validate_requests(feeds.requests(spark, sf))
    outcomes = checked.select(
        "request_id", "width", "height", "seed",
        F.concat(text.slugify("prompt"), F.lit(".png")).alias("image_path"),
        F.get("reasons", F.lit(0)).alias("error"),
    )
    files.write_results(outcomes, folder)
    return spark.read.parquet(folder)


@query("S8_batch_results")
def s8_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The outcomes of batches of ten requests; the files of every seventh were there before."""
    checked = requests.validate_requests(feeds.requests(spark, sf))
    outcomes = checked.select(
        F.floor(F.col("request_id") / 10).alias("batch_id"), F.col("request_id").alias("position"),
        F.concat(text.slugify("prompt"), F.lit(".png")).alias("image_path"),
        F.when(F.col("request_id") % 3 == 0, F.get("reasons", F.lit(0))).alias("error"),
    )
    existing = outcomes.where(F.col("position") % 7 == 0).select(F.col("image_path").alias("path"))
    return files.batch_result_rows(outcomes, existing).select(
        "batch_id", "success", "message", F.array_join("image_paths", "|").alias("image_paths"), "count"
    )


# --- projections, filters, validation ---------------------------------------------------


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    found = requests.lookup_model(feeds.requests(spark, sf), MODELS, list(MODELS))
    return requests.resolve_defaults(found)


@query("P1_resolve_defaults")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select(
        "request_id", "height", "width", "num_inference_steps", "seed", "seeded"
    )


@query("P2_validate_requests")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return requests.validate_requests(feeds.requests(spark, sf)).select(
        "request_id",
        F.concat_ws("; ", "reasons").alias("reasons"),
        F.concat_ws("; ", "warnings").alias("warnings"),
        "accepted",
    )


@query("P3_route_mode")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return requests.route_mode(feeds.mode_requests(spark, sf)).select(
        "request_id", "effective_mode", "mode_description", "mode_note"
    )


@query("P4_route_pipeline")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Acme/FLUX-"), "p_type"))
        .otherwise(F.col("p_type"))
        .alias("model_id"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 10).alias("guidance_scale"),
    )
    return requests.route_pipeline(models).select("p_partkey", "pipeline", r6("guidance"))


@query("P5_derive_shapes")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return requests.derive_shapes(resolved(spark, sf)).select(
        "request_id",
        F.col("latent.height").alias("latent_height"),
        F.col("latent.width").alias("latent_width"),
        F.col("latent.channels").alias("channels"),
    )


@query("P6_prompt_preview")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.prompts(spark, sf).select("prompt_id", text.prompt_preview("text").alias("preview"))


@query("P7_completed_stages")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return requests.stage_progress(feeds.component_times(spark, sf)).select(
        "seq", "component", "stage_index", F.concat_ws(",", "stages_done").alias("stages_done")
    )


@query("P8_throughput")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    elapsed = F.when(F.col("l_partkey") % 9 == 0, F.lit(0.0)).otherwise(F.col("elapsed_s"))
    steps = F.when(F.col("l_partkey") % 8 == 0, F.lit(0.0)).otherwise(F.col("steps"))
    log = feeds.step_log(spark, sf).withColumn("elapsed_s", elapsed).withColumn("steps", steps)
    return log.select(
        "run_id", "item", "l_partkey", "l_suppkey",
        r6(rates.per_second("steps", "elapsed_s"), "steps_per_s", 10),
        r6(rates.ratio("elapsed_s", "steps"), "s_per_step", 10),
        r6(rates.ms_per_step("elapsed_s", "steps"), "ms_per_step", 10),
    )


@query("P9_progress_eta")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    log = feeds.step_log(spark, sf).select(
        "run_id", "item", "l_partkey", "l_suppkey",
        (F.col("l_partkey") % 51).alias("progress"),
        F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(50).alias("total"),
        F.when(F.col("item") != 7, F.col("elapsed_s") / 10).alias("time_per_step"),
    )
    return requests.progress_eta(log).select(
        "run_id", "item", "l_partkey", "l_suppkey", r6("percent"), r6("remaining_s"), "remaining"
    )


@query("P10_sample_every_n")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return assets.sample_every_n(events, ["user_id"], ["ts", "event_id"], 5).select(
        "user_id", "event_id", "step_index"
    )


@query("P11_parse_size")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 6 == 0, F.col("p_type"))
        .otherwise(F.concat((F.col("p_size") * 8).cast("string"), F.lit("x"), F.col("p_partkey").cast("string")))
        .alias("size"),
    )
    parsed = text.parse_size("size")
    return sizes.select("p_partkey", parsed["width"].alias("width"), parsed["height"].alias("height"))


@query("P12_dispatch_calls")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return requests.dispatch_calls(feeds.calls(spark, sf)).select(
        "call_id", "name", F.array_join("prompts", "|").alias("prompts"), "width", "height",
        "num_inference_steps", "seed", "success", "error",
    )


@query("P13_throttle_label")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    state = timing.rolling_state(feeds.timing_log(spark, sf))
    return state.select(
        "session_id", "event_id",
        rates.performance_label("performance_ratio").alias("performance"),
        rates.throttle_label("is_throttled").alias("status"),
    )


# --- joins ------------------------------------------------------------------------------


@query("J1_lookup_model")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    asked = feeds.requests(spark, sf).withColumn(
        "model", F.when(F.col("request_id") % 17 == 0, "dalle").otherwise(F.col("model"))
    )
    found = requests.lookup_model(asked, MODELS, list(MODELS))
    return found.select(
        "request_id", "model", "model_id", "default_steps",
        F.col("default_size.h").alias("default_height"),
        "keep_loaded", "idle_timeout", "model_error",
    )


def _asked_modes(spark: SparkSession, sf: str) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in ("text2img", "img2img", "llm", "audio2text", "upscale")])
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.get(modes, (F.col("event_id") % 5).cast("int")).alias("mode"),
    )


@query("J2_active_components")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    per_mode = _asked_modes(spark, sf).groupBy("mode").agg(F.count(F.lit(1)).alias("requests"))
    return lookups.active_components(per_mode).select("mode", "component", "is_active", "requests")


@query("J2_dimmed_rows")
def j2_rows(spark: SparkSession, sf: str) -> DataFrame:
    row_of = {c: c.split("-")[0] for c in COMPONENT_MODES}
    return lookups.dimmed_rows(_asked_modes(spark, sf), row_of).select("request_id", "row")


@query("J3_map_stage")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return timing.map_stage(feeds.component_times(spark, sf)).select(
        "run_id", "seq", "component", "stage"
    )


@query("J4_zip_by_position")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "documents").select("doc_id", "n_chars")
    right = table(spark, sf, "benchmark").select("item_id", "text")
    return lookups.zip_by_position(left, right, ["n_chars", "doc_id"], ["item_id"]).select(
        "position", "doc_id", "item_id", "text"
    )


@query("J5_region_mask")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    regions = edits.replay_edits(feeds.edit_log(spark, sf))
    return edits.region_mask(feeds.points(spark, sf), regions)


@query("J5_region_mask_per_image")
def j5_image(spark: SparkSession, sf: str) -> DataFrame:
    log = feeds.edit_log(spark, sf)
    per_image = feeds.points(spark, sf).withColumn("image_id", F.col("point_id") % 100)
    return edits.region_mask(per_image, edits.replay_edits(log), ["image_id"])


@query("J6_sweep")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    return requests.sweep(prompts, seeds=2)


@query("J7_apply_overrides")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    base = feeds.requests(spark, sf).select("request_id", "width", "height", "model")
    over = feeds.requests(spark, sf).where(F.col("request_id") % 4 == 0).select(
        F.when(F.col("request_id") % 8 == 0, F.col("request_id") + 10_000_000)
        .otherwise(F.col("request_id"))
        .alias("request_id"),
        F.lit(None).cast("int").alias("width"),
        (F.col("height") + 1).alias("height"),
        F.lit("local").alias("model"),
    )
    return lookups.apply_overrides(base, over, "request_id")


# --- aggregations -----------------------------------------------------------------------


@query("A1_component_share")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return timing.component_share(feeds.component_times(spark, sf)).select(
        "run_id", "component", r6("elapsed_s"), r6("percent")
    )


@query("A1_component_share_from_events")
def a1_events(spark: SparkSession, sf: str) -> DataFrame:
    segments = timing.run_segments(feeds.component_events(spark, sf))
    pairs = timing.pair_start_end(segments, ["run_id", "segment", "component"]).where("matched")
    return timing.component_share(pairs, ["run_id", "segment"], ["ts", "seq"]).select(
        "run_id", "segment", "component", r6("elapsed_s"), r6("percent")
    )


@query("A2_stage_breakdown")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    times = timing.latest_per_component(feeds.component_times(spark, sf))
    totals = (
        times.where(F.col("run_id") % 2 == 0)
        .groupBy("run_id")
        .agg(F.sum("elapsed_s").alias("elapsed_s"))
        .withColumn("component", F.lit("total"))
    )
    return timing.stage_breakdown(times.unionByName(totals)).select(
        "run_id", "stage", r6("stage_s"), r6("percent")
    )


@query("A3_timing_stats")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return timing.timing_stats(feeds.timing_log(spark, sf)).select(
        "session_id", "generations", r6("avg_s", places=8), r6("min_s"), r6("max_s"), r6("baseline"),
        r6("current_ratio"), "currently_throttled", "breaks_taken", "total_cooling_s",
    )


@query("A4_learn_baseline")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return timing.learn_baseline(feeds.timing_log(spark, sf)).select("session_id", r6("baseline"))


@query("A4_learn_baseline_window_2")
def a4_two(spark: SparkSession, sf: str) -> DataFrame:
    return timing.learn_baseline(feeds.timing_log(spark, sf), window=2).select(
        "session_id", r6("baseline")
    )


@query("A5_session_efficiency")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return timing.session_efficiency(feeds.step_log(spark, sf), 1.5).select(
        "run_id", r6("actual_s"), r6("ideal_s"), r6("wasted_s"), r6("loss_pct")
    )


@query("A6_batch_summary")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return timing.batch_summary(feeds.step_log(spark, sf)).select(
        "run_id", "items", r6("total_s"), r6("mean_s", places=8)
    )


@query("A7_phase_profile")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return timing.phase_profile(
        feeds.step_log(spark, sf).withColumn("steps", F.col("steps") * 2)
    ).select("phase", "items", r6("min_s_per_step"), r6("max_s_per_step"))


@query("A8_pixel_diff")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    def shades(c: str) -> Column:
        return F.transform(c, lambda x: F.floor(x * 8).cast("int"))

    pairs = feeds.vector_pairs(spark, sf).select(
        "pair_id", shades("u").alias("a"),
        F.when(F.col("pair_id") % 10 == 0, shades("u")).otherwise(shades("t")).alias("b"),
    )
    diff = vectors.pixel_diff("a", "b")
    return pairs.select("pair_id", r6(diff["percent"], "percent"), diff["equal"].alias("equal"))


AUDIT_TITLES = ("&amp;", "ad 0", "Home", "copyright")
AUDIT_NEEDED = ("<html", "<head", "<body", "<style>", "<script>")


@query("A9_content_audit")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return audit.content_audit(pages, "<p>", AUDIT_TITLES, AUDIT_NEEDED).select(
        "page_id", "marker_count", F.array_join("missing_titles", "|").alias("missing_titles"),
        "found_titles", "passed",
    )


@query("A9_title_report")
def a9_titles(spark: SparkSession, sf: str) -> DataFrame:
    return audit.title_report(table(spark, sf, "pages"), AUDIT_TITLES)


# --- windows ----------------------------------------------------------------------------


@query("W1_rolling_state")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.transform(
        "recent_times", lambda x: F.round(x * 100).cast("long").cast("string")
    )
    return timing.rolling_state(feeds.timing_log(spark, sf)).select(
        "session_id", "event_id", "seq", r6("baseline"), r6("recent_mean"), r6("recent_max"),
        F.array_join(cents, ",").alias("recent_cents"), r6("performance_ratio"), "is_throttled",
    )


@query("W2_needs_break")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return timing.needs_break(feeds.timing_log(spark, sf)).select(
        "session_id", "event_id", "seq", r6("slowdown_before"), "needs_break"
    )


@query("W2_needs_break_given_baseline")
def w2_given(spark: SparkSession, sf: str) -> DataFrame:
    flags = timing.needs_break(feeds.timing_log(spark, sf), threshold=1.3, baseline=45.0)
    return flags.select("session_id", "event_id", "seq", r6("slowdown_before"), "needs_break")


@query("W3_break_schedule")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return timing.break_schedule(feeds.timing_log(spark, sf)).select(
        "session_id", "event_id", "seq", "needs_break", "at_batch_boundary", "takes_break",
        "cooling_s",
    )


@query("W3_break_schedule_high_baseline")
def w3_high(spark: SparkSession, sf: str) -> DataFrame:
    plan = timing.break_schedule(
        feeds.timing_log(spark, sf), batch_size=5, baseline=120.0, threshold=1.3
    )
    return plan.select("session_id", "event_id", "seq", "at_batch_boundary", "takes_break", "cooling_s")


@query("W4_pair_start_end")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return timing.pair_start_end(feeds.component_events(spark, sf)).select(
        "run_id", "component", "seq", r6("elapsed_s"), "matched"
    )


@query("W5_run_segments")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return timing.run_segments(feeds.component_events(spark, sf)).select("run_id", "seq", "segment")


@query("W6_number_items")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    prompts = feeds.prompts(spark, sf).select("prompt_id", "mode")
    return assets.number_items(prompts, ["mode"], ["prompt_id"])


@query("W6_number_all_items")
def w6_all(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return assets.number_items(orders, [], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("W7_unique_names")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    slugs = feeds.prompts(spark, sf).select("prompt_id", text.slugify("text").alias("slug"))
    taken = table(spark, sf, "benchmark").select(text.slugify("text").alias("name"))
    return naming.unique_names(slugs, taken).select("prompt_id", "slug", "name_index", "name")


@query("W7_unique_names_contested")
def w7_contested(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one word and perhaps a counter, so requests spell names made for others."""
    key = F.col("p_partkey")
    slug = F.concat(
        F.regexp_extract("p_name", "^[a-z]+", 0),
        F.when(key % 3 == 0, F.concat(F.lit("_"), (key % 40 + 1).cast("string"))).otherwise(""),
    )
    named = table(spark, sf, "part").select(key.alias("prompt_id"), slug.alias("slug"))
    return naming.unique_names(named).select("prompt_id", "slug", "name_index", "name")


@query("W8_random_pick")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.random_pick(feeds.prompts(spark, sf)).select("mode", "prompt_id", "text")


@query("W8_pick_for_modes")
def w8_modes(spark: SparkSession, sf: str) -> DataFrame:
    picks = lookups.random_pick(feeds.prompts(spark, sf), seed=7)
    asked = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"\.com/([a-z]+)/", 1).alias("mode"))
    return lookups.pick_for_modes(asked, picks, default="en").select("page_id", "mode", "prompt_id")


@query("W9_replay_edits")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return edits.replay_edits(feeds.edit_log(spark, sf)).select(
        "image_id", "seq", "rect_id", r6("x1"), r6("y1"), r6("x2"), r6("y2")
    )


@query("W10_consecutive_duplicates")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.array("event_type").alias("frame")
    )
    return assets.consecutive_duplicates(
        frames, ["user_id"], ["ts", "event_id"], "frame"
    ).select("user_id", "event_id", "is_duplicate")


@query("W10_consecutive_duplicate_vectors")
def w10_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return assets.consecutive_duplicates(
        table(spark, sf, "embeddings"), ["label"], ["vec_id"], "embedding"
    ).select("vec_id", "is_duplicate")


# --- sort, top-k, sets ------------------------------------------------------------------


@query("K1_latest_asset")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return assets.latest_asset(feeds.assets(spark, sf)).select("path", day_time("mtime"), "length")


@query("K2_new_assets")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    after = feeds.assets(spark, sf)
    return assets.new_assets(after.where("was_there"), after).select("path", day_time("mtime"))


@query("K3_first_occurrence")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split(F.concat("url", F.lit("/fr/de/fr")), "/")
    kept = text.first_occurrence(parts, "fr")
    return table(spark, sf, "pages").select("page_id", F.array_join(kept, "/").alias("kept"))


# --- scalar functions -------------------------------------------------------------------


@query("X1_slugify")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.prompts(spark, sf).select(
        "prompt_id", text.slugify("text").alias("slug"), text.slugify("text", 30).alias("slug_30")
    )


@query("X2_session_key")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("prompt_id") % 300).cast("int"))
    return feeds.prompts(spark, sf).select(
        "prompt_id",
        text.session_key("text").alias("plain"),
        text.session_key("mode", day).alias("dated"),
        text.all_steps_key("text", day).alias("all_steps"),
    )


@query("X3_normalize_base")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    root = F.when(F.col("page_id") % 2 == 0, "/data/").otherwise("")
    middle = F.regexp_extract("url", "([a-z]+/[0-9]+)", 1)
    tail = F.element_at(F.array(F.lit("/outputs"), F.lit("/x//./outputs/y"), F.lit("")),
                        (F.col("page_id") % 3 + 1).cast("int"))
    path = F.concat(root, F.lit("outputs/"), middle, tail)
    lone = F.when(F.col("page_id") % 5 == 0, F.concat(root, middle, F.lit("/outputs"))).otherwise(path)
    return table(spark, sf, "pages").select("page_id", text.normalize_base(lone).alias("base"))


@query("X4_sequence_name")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.step_of_total_name("l_linenumber", "l_partkey").alias("frame"),
        text.steps_name(F.lit("sunset"), F.col("l_linenumber")).alias("short"),
        text.steps_name(F.lit("study"), F.col("l_orderkey"), 4).alias("long"),
    )


@query("X5_token_count")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.prompts(spark, sf).select("prompt_id", text.token_count("text").alias("tokens"))


@query("X6_escape_markup")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.escape_markup("html").alias("escaped"))


@query("X7_labels")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return feeds.requests(spark, sf).select(
        "request_id", text.size_label(size).alias("size"), text.seed_label("seed").alias("seed")
    )


@query("V1_guidance_blend")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.vector_pairs(spark, sf).select(
        "pair_id", F.posexplode(vectors.guidance_blend("u", "t")).alias("i", "_v")
    ).select("pair_id", "i", r6("_v", "value"))


@query("V2_quantize_u8")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(vectors.quantize_u8("embedding", 0.25)).alias("i", "level")
    )


@query("V3_split_join")
def v3(spark: SparkSession, sf: str) -> DataFrame:
    halves = vectors.split_pair(vectors.join_pair("u", "t"))
    pairs = feeds.vector_pairs(spark, sf).select("pair_id", halves.alias("_h"))
    zipped = F.arrays_zip(F.col("_h.first").alias("first"), F.col("_h.second").alias("second"))
    return pairs.select("pair_id", F.posexplode(zipped).alias("i", "_z")).select(
        "pair_id", "i",
        r6(F.col("_z.first").cast("double"), "first"),
        r6(F.col("_z.second").cast("double"), "second"),
    )


# --- streams ----------------------------------------------------------------------------


STREAM_BYTES_CONF = "spark.kilnflow.maxBytesPerTrigger"
#: The queries show every key; a running stream forgets sooner.
NEVER = "1000 years"


def _event_stream(spark: SparkSession, sf: str, batch_bytes: str = str(1 << 30)) -> DataFrame:
    """The events table, a file or a folder of files, as a stream.

    A micro-batch takes whole files up to about the given size, so the files' sizes bound it.
    The path is a pattern because a stream takes a plain path for a folder.
    """
    return (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .option("maxBytesPerTrigger", batch_bytes)
        .parquet(f"{sf}/events.parque[t]")
    )


def _stream(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame], sink: progress.Sink, name: str) -> None:
    """Run a stream over the events there are, batch by batch into ``sink``."""
    events = _event_stream(spark, sf, spark.conf.get(STREAM_BYTES_CONF, str(1 << 30)))
    carried.run_available(make(events), "", scratch_path(spark, f"{name}-checkpoint"), sink=sink)


def _appended(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows that a stream in append mode has written."""
    events = _event_stream(spark, sf, spark.conf.get(STREAM_BYTES_CONF, str(1 << 30)))
    path = scratch_path(spark, name)
    carried.run_available(make(events), path, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.parquet(path)


def _stepped(
    spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame], step: carried.Step, name: str
) -> DataFrame:
    """The rows that a carrying stream has sent."""
    path = scratch_path(spark, name)
    sink = carried.carrying(spark, scratch_path(spark, f"{name}-state"), step, progress.parquet_sink(path))
    _stream(spark, sf, make, sink, name)
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id")


def _newest(
    spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame], step: carried.Step, name: str
) -> DataFrame:
    """The table of newest rows that a stream keeps."""
    state = scratch_path(spark, f"{name}-state")
    _stream(spark, sf, make, carried.keep_newest(spark, state, step), name)
    return carried.Versions(spark, state).newest()


@query("T1_latest_state")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    step = carried.newest_step(progress.latest_state, progress.latest_state, forget=NEVER)
    return _newest(spark, sf, feeds.as_state_events, step, "latest").select(
        "run_id", "seq", "component", "progress", "total", "message", r6("time_per_step")
    )


@query("T2_stream_progress")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    def shown(events: DataFrame) -> DataFrame:
        return progress.stream_progress(feeds.as_state_events(events)).select(
            "run_id", "seq", "stage_index", r6("percent"), r6("remaining_s"), "remaining"
        )

    return _appended(spark, sf, shown, "progress")


@query("T3_stream_component_times")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    step = carried.component_times_step(forget=NEVER)
    return _stepped(spark, sf, feeds.as_component_events, step, "components").select(
        "run_id", "segment", "component", "seq", r6("elapsed_s"), "matched", r6("percent")
    )


@query("T4_stream_thermal")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return _stepped(spark, sf, feeds.as_timing_log, carried.thermal_step(forget=NEVER), "thermal").select(
        "session_id", "event_id", "seq", r6("baseline"), r6("performance_ratio"),
        "is_throttled", "needs_break", "takes_break", "cooling_s",
    )


@query("T5_run_status")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    step = carried.newest_step(progress.status_parts, progress.merge_status, forget=NEVER)
    return _newest(spark, sf, feeds.as_state_events, step, "status").drop("ts", "seq")


@query("T6_idle_sessions")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return timing.idle_sessions(feeds.idle_events(spark, sf)).select(
        "user_id", "session_no", day_time("started"), day_time("last_seen"), "events"
    )


@query("T6_open_sessions_stream")
def t6_open(spark: SparkSession, sf: str) -> DataFrame:
    step = carried.newest_step(
        progress.open_sessions, progress.merge_sessions, at="last_seen", forget=NEVER
    )
    return _newest(spark, sf, feeds.as_idle_events, step, "open").select(
        "user_id", day_time("started"), day_time("last_seen"), "events"
    )


@query("T6_closed_sessions_stream")
def t6_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that the watermark has closed when the events there are have been read."""
    def closed(events: DataFrame) -> DataFrame:
        return progress.idle_windows(feeds.as_idle_events(events), watermark="1 hour")

    return _appended(spark, sf, closed, "closed").select(
        "user_id", day_time("started"), day_time("last_seen"), "events"
    )


@query("T7_fan_out")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    """Two receivers get everything; a third fails, stays out over a restart, and is replayed."""
    first, second, third = (scratch_path(spark, f"fan-{n}") for n in "abc")
    ledger = progress.Ledger(spark, scratch_path(spark, "fan-ledger"))

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise OSError("receiver gone")

    def sinks(last: progress.Sink) -> dict[str, progress.Sink]:
        return {"first": progress.parquet_sink(first), "third": last, "second": progress.parquet_sink(second)}

    def shown(events: DataFrame) -> DataFrame:
        return feeds.as_state_events(events).select("run_id", "seq", "component")

    checkpoint = scratch_path(spark, "fan-checkpoint")
    for last in (broken, progress.parquet_sink(third)):
        events = _event_stream(spark, sf, spark.conf.get(STREAM_BYTES_CONF, str(1 << 30)))
        carried.run_available(shown(events), "", checkpoint, sink=progress.fan_out(sinks(last), ledger=ledger))
    progress.replay(ledger, "third", progress.parquet_sink(third), first)

    def received(name: str, path: str) -> DataFrame:
        rows = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
        return rows.select(F.lit(name).alias("receiver"), "run_id", "seq", "component")

    return received("first", first).union(received("second", second)).union(received("third", third))


# --- caller's functions -----------------------------------------------------------------


def make_norm() -> infer.Predictor:
    return lambda batch: np.sqrt((batch.astype("float64") ** 2).sum(axis=1))


@query("U1_batch_infer")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    vectors_in = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return infer.batch_infer(vectors_in, make_norm, ["embedding"], [[64]]).select(
        "vec_id", r6("value", "norm"), "error"
    )


def make_bytes() -> infer.Predictor:
    return lambda batch: [np.floor(v.astype("float64") * 100).astype("int8").tobytes() for v in batch]


@query("U1_batch_infer_bytes")
def u1_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """A model that gives bytes, as images are: one signed byte per component."""
    vectors_in = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = infer.batch_infer(
        vectors_in, make_bytes, ["embedding"], [[64]], return_type=T.BinaryType()
    )
    return out.select("vec_id", F.lower(F.hex("value")).alias("image"), F.octet_length("value").alias("size"), "error")


@query("U2_with_step_hook")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    def hook(batches):
        for batch in batches:
            batch["captured"] = batch["step_index"] * batch["value"]
            yield batch[["user_id", "event_id", "step_index", "captured"]]

    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return infer.with_step_hook(
        events, hook, "user_id long, event_id long, step_index long, captured double",
        ["user_id"], ["ts", "event_id"], 5,
    ).withColumn("captured", F.round("captured", 6))


@query("U3_expand_batch")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    batches = feeds.prompts(spark, sf).select(
        F.col("prompt_id").alias("batch_id"),
        F.split("text", "\n").alias("prompts"),
        F.lit(42).alias("seed"),
    )
    return requests.expand_batch(batches).select("batch_id", "position", "total", "prompt", "seed")
