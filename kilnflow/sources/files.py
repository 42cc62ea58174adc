"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.constants import BATCH_MADE, IMAGE_MADE
from kilnflow.functions.text import strip

REQUEST = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("num_inference_steps", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("return_base64", T.BooleanType()),
    ]
)
BATCH_REQUEST = T.StructType(
    [T.StructField("prompts", T.ArrayType(T.StringType())), *REQUEST.fields[1:5]]
)
VISUAL_REQUEST = T.StructType(
    [
        *REQUEST.fields[:5],
        T.StructField("mode", T.StringType()),
        T.StructField("guidance_scale", T.DoubleType()),
        T.StructField("init_image", T.StringType()),
        T.StructField("strength", T.DoubleType()),
    ]
)

# What an absent field of a request stands for.
REQUEST_DEFAULTS = {"return_base64": False}
VISUAL_DEFAULTS = {
    "mode": "text2img",
    "num_inference_steps": 30,
    "guidance_scale": 7.5,
    "width": 1024,
    "height": 1024,
    "strength": 0.8,
}

STATE_EVENT = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("component", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("total", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("api_call", T.StringType()),
        T.StructField(
            "component_timing",
            T.StructType(
                [
                    T.StructField("component", T.StringType()),
                    T.StructField("elapsed_time", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("component_percentages", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
CORRUPT = "_corrupt_record"


def clean_prompts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strip each line and drop the blank ones."""
    return lines.withColumn("prompt", strip(column)).where(F.col("prompt") != "").drop(column)


def read_prompts(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """One prompt per line. ``file_path, block_start, line_id`` give the file order.

    A file may be read in several blocks: line ids rise within a block and blocks are told
    apart by where they start, so no file needs to be read by one task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    prompts = clean_prompts(lines)
    if required and prompts.isEmpty():
        raise ValueError(f"no prompts found in {path}")
    return prompts


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def _checked(
    requests: DataFrame, schema: T.StructType, defaults: dict[str, object]
) -> DataFrame:
    required = schema.fieldNames()[0]
    filled = requests.fillna({k: v for k, v in defaults.items() if k in requests.columns})
    error = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed request")).when(
        F.col(required).isNull(), F.lit(f"{required}: field required")
    )
    return filled.withColumn("request_error", error).drop(CORRUPT)


def read_requests(
    spark: SparkSession,
    path: str,
    schema: T.StructType = REQUEST,
    defaults: dict[str, object] = REQUEST_DEFAULTS,
) -> DataFrame:
    """Typed requests from JSON lines; ``request_error`` marks the ones to refuse."""
    raw = spark.read.schema(_with_corrupt(schema)).option(
        "columnNameOfCorruptRecord", CORRUPT
    ).json(path)
    return _checked(raw, schema, defaults)


def parse_requests(
    df: DataFrame,
    column: str,
    schema: T.StructType = REQUEST,
    defaults: dict[str, object] = REQUEST_DEFAULTS,
) -> DataFrame:
    """As :func:`read_requests`, for JSON text in a column."""
    parsed = F.from_json(
        column, _with_corrupt(schema), {"columnNameOfCorruptRecord": CORRUPT}
    )
    kept = [c for c in df.columns if c != column]
    return _checked(df.withColumn("_r", parsed).select(*kept, "_r.*"), schema, defaults)


def read_asset_catalog(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Path, time and length of the files of one folder; their bytes are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.col("modificationTime").alias("mtime"), "length")
    )


def read_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Files of one folder with their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def asset_kind(subdir: Column) -> Column:
    """Folder below the session: images or data; anything else stays in the root."""
    return F.when(subdir.isin("images", "data"), subdir).otherwise("root")


def write_session_layout(df: DataFrame, base: str, mode: str = "append") -> None:
    """Write rows below ``base`` by ``session_key`` and ``kind``.

    The rebalance hint gathers the rows of a folder before the write and, with adaptive
    execution, splits the folders that are too large for one task.
    """
    spread = df.hint("rebalance", "session_key", "kind")
    spread.write.mode(mode).partitionBy("session_key", "kind").parquet(base)


def with_event_time(events: DataFrame) -> DataFrame:
    """Add ``ts`` from the ISO text and give events without metrics an empty map."""
    no_metrics = F.create_map().cast("map<string,double>")
    return events.withColumn("ts", F.to_timestamp("timestamp")).withColumn(
        "metrics", F.coalesce("metrics", no_metrics)
    )


def read_state_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Progress events from JSON lines, as a table or as a stream of files."""
    reader = spark.readStream if stream else spark.read
    return with_event_time(reader.schema(STATE_EVENT).json(path))


def result_rows(outcomes: DataFrame) -> DataFrame:
    """One result per request: failures carry the error text and no file."""
    failed = F.col("error").isNotNull()
    return outcomes.select(
        "request_id",
        (~failed).alias("success"),
        F.coalesce("error", F.lit(IMAGE_MADE)).alias("message"),
        *[F.when(~failed, F.col(c)).alias(c) for c in ("image_path", "width", "height", "seed")],
    )


def batch_result_rows(outcomes: DataFrame, existing: DataFrame) -> DataFrame:
    """One result per batch request: ``batch_id, success, message, image_paths, count``.

    ``outcomes`` has ``batch_id``, ``position`` in the batch, ``image_path`` and ``error``;
    ``existing`` the files that were there before, in ``path``. ``count`` is the number of images
    that were made, ``image_paths`` are the new files among them in order: a file that was there
    is not one, however often it was made again. The first error of a batch is its message,
    and it has no files then. A batch is as long as its one request.
    """
    there = existing.select(F.col("path").alias("image_path")).distinct().withColumn("_there", F.lit(True))
    marked = outcomes.join(there, "image_path", "left")
    made = F.struct("position", "image_path")
    problem = F.when(F.col("error").isNotNull(), F.col("error"))
    batches = marked.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_made"),
        F.min_by(problem, F.when(problem.isNotNull(), F.col("position"))).alias("_error"),
        F.sort_array(F.collect_list(F.when(F.col("_there").isNull() & F.col("image_path").isNotNull(), made))).alias("_files"),
    )
    good = F.col("_error").isNull()
    return batches.select(
        "batch_id",
        good.alias("success"),
        F.coalesce("_error", F.concat(F.lit(BATCH_MADE[0]), F.col("_made").cast("string"), F.lit(BATCH_MADE[1]))).alias("message"),
        F.when(good, F.array_distinct(F.transform("_files", lambda f: f["image_path"]))).otherwise(
            F.array().cast("array<string>")
        ).alias("image_paths"),
        F.when(good, F.col("_made")).otherwise(0).alias("count"),
    )


def write_results(outcomes: DataFrame, path: str) -> None:
    """Append result rows."""
    result_rows(outcomes).write.mode("append").parquet(path)
