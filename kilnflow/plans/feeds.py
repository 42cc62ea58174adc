"""Feeds of the operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.session import table


def as_timing_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.col("value").alias("elapsed_s")
    )


def as_component_events(events: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "start")
        .when(F.col("event_type") == "signup", "reset")
        .otherwise("end")
    )
    return events.select(
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("component"),
        kind.alias("kind"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def as_state_events(events: DataFrame) -> DataFrame:
    component = (
        F.when(F.col("event_type") == "view", "input")
        .when(F.col("event_type") == "click", "encoding")
        .when(F.col("event_type") == "signup", "diffusion")
        .when(F.col("event_type") == "purchase", "complete")
        .otherwise("idle")
    )
    message = F.when(
        F.col("event_type") == "error", F.concat(F.lit("Error: "), F.col("props"))
    ).otherwise(F.col("event_type"))
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        component.alias("component"),
        (F.col("event_id") % 31).cast("int").alias("progress"),
        F.when(F.col("event_id") % 7 == 0, 0).otherwise(30).alias("total"),
        message.alias("message"),
        (F.col("value") / 10).alias("time_per_step"),
    )


def as_idle_events(events: DataFrame) -> DataFrame:
    """Each user works with one model, whose time-out applies (none for the first)."""
    gap = (
        F.when(F.col("user_id") % 4 == 1, 300)
        .when(F.col("user_id") % 4 == 2, 86400)
        .when(F.col("user_id") % 4 == 3, 7200)
    )
    return events.select("user_id", "ts", "event_id", gap.alias("gap_s"))


def timing_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_timing_log(table(spark, sf, "events"))


def component_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_component_events(table(spark, sf, "events"))


def component_times(spark: SparkSession, sf: str) -> DataFrame:
    component = (
        F.when(F.col("event_type") == "view", "input")
        .when(F.col("event_type") == "click", "text-encode")
        .when(F.col("event_type") == "signup", "diffusion")
        .when(F.col("event_type") == "purchase", "vae-decode")
        .otherwise("other")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        component.alias("component"),
        F.col("value").alias("elapsed_s"),
        F.col("event_id").alias("seq"),
    )


def state_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_state_events(table(spark, sf, "events"))


def idle_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_idle_events(table(spark, sf, "events"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    width = F.when(key % 7 != 0, F.col("p_size") * 8 + (key % 2).cast("int"))
    return table(spark, sf, "part").select(
        key.alias("request_id"),
        F.when(key % 11 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("prompt"),
        width.alias("width"),
        F.when(key % 5 == 0, F.lit(0)).otherwise(F.col("p_size") * 16).alias("height"),
        F.col("p_size").alias("num_inference_steps"),
        (key % 3).alias("seed"),
        F.when(key % 13 == 0, "brushnet").otherwise("flux").alias("model"),
    )


def mode_requests(spark: SparkSession, sf: str) -> DataFrame:
    mode = (
        F.when(F.col("event_type") == "view", "text2img")
        .when(F.col("event_type") == "click", "img2img")
        .when(F.col("event_type") == "purchase", "controlnet")
        .when(F.col("event_type") == "error", "upscale")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        mode.alias("mode"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("init_image"),
        ((F.col("event_id") % 10) / 10).alias("strength"),
    )


def step_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("item"),
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").alias("steps"),
        (F.col("l_extendedprice") / 1000).alias("elapsed_s"),
    )


def assets(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    return table(spark, sf, "orders").select(
        path.alias("path"),
        F.col("o_orderdate").alias("mtime"),
        F.floor("o_totalprice").cast("long").alias("length"),
        (F.col("o_orderkey") % 3 != 0).alias("was_there"),
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("lang").alias("mode"), "text"
    )


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    left = vectors.where(F.col("vec_id") % 2 == 0).select(
        F.col("vec_id").alias("pair_id"), F.col("embedding").alias("u")
    )
    right = vectors.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("t"))
    return left.join(right, "pair_id")


def edit_log(spark: SparkSession, sf: str) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "error", "reset")
        .when(F.col("event_type") == "click", "undo")
        .otherwise("add")
    )
    y = (F.col("event_id") % 97) * F.lit(1.0)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.col("value").alias("x1"),
        y.alias("y1"),
        (F.col("value") + 10).alias("x2"),
        (y - 5).alias("y2"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("point_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("x"),
        ((F.col("l_partkey") % 100) * F.lit(1.0)).alias("y"),
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey") % 3
    name = (
        F.when(key == 0, "generate_image").when(key == 1, "generate_images_batch").otherwise("other")
    )
    batch = F.concat(
        F.lit('{"prompts":["'), "p_name", F.lit('","'), "p_brand", F.lit('"]}')
    )
    single = F.concat(
        F.lit('{"prompt":"'), "p_name", F.lit('","seed":'), F.col("p_size").cast("string"), F.lit("}")
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("call_id"),
        name.alias("name"),
        F.when(key == 1, batch).otherwise(single).alias("arguments"),
    )
