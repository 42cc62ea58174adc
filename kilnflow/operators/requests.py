"""Request tables: defaults, validation, routing, expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.constants import (
    ACCEPTED_MODELS,
    ARGUMENT_MISSING,
    BATCH_FUNCTION,
    COMPONENT_ORDER,
    CONTROL_DESCRIPTION,
    DEFAULT_GUIDANCE,
    DEFAULT_MODE,
    FUNCTION_UNKNOWN,
    IMAGE_DESCRIPTION,
    IMAGE_FUNCTION,
    IMAGE_MODES,
    IMAGE_NOTE,
    MODEL_REJECTED,
    MODELS,
    NO_IMAGE_NOTE,
    PROGRESSIVE_STEPS,
    PROMPT_REJECTED,
    SIZE_WARNING,
    TEXT_DESCRIPTION,
)
from kilnflow.functions.rates import duration_text, percent_done, remaining_s
from kilnflow.functions.text import strip

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("model_id", T.StringType()),
        T.StructField("keep_loaded", T.BooleanType()),
        T.StructField("idle_timeout", T.IntegerType()),
        T.StructField("default_steps", T.IntegerType()),
        T.StructField(
            "default_size",
            T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType())]),
        ),
        T.StructField("guidance_scale", T.DoubleType()),
    ]
)


def models_table(spark: SparkSession, models: Mapping[str, Mapping] = MODELS) -> DataFrame:
    """The model settings as a table."""
    fields = [f.name for f in MODEL_SCHEMA.fields[1:]]
    rows = [(name, *[settings.get(f) for f in fields]) for name, settings in models.items()]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def _literal(value: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        parts = value.values() if isinstance(value, Mapping) else value
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(parts, kind.fields)])
    return F.lit(value).cast(kind)


def lookup_model(
    requests: DataFrame, models: DataFrame | Mapping[str, Mapping], known: Sequence[str] = ()
) -> DataFrame:
    """Add the settings of each request's model, and an error where there are none.

    Settings given as a mapping travel inside the expression: no join, so a model that most
    requests ask for costs nothing. A table of the caller's is joined by what Spark knows of
    its size. ``known`` names the models in the error text. The flags read by lenient
    look-ups are False and null for an unknown model.
    """
    names = ", ".join(f"'{n}'" for n in known)
    if isinstance(models, Mapping):
        fields = MODEL_SCHEMA.fields[1:]
        entries = [
            part
            for name, settings in models.items()
            for part in (
                F.lit(name),
                F.struct(*[_literal(settings.get(f.name), f.dataType).alias(f.name) for f in fields]),
            )
        ]
        settings = requests.withColumn("_settings", F.create_map(*entries)[F.col("model")])
        found = settings.select(
            "*", *[F.col(f"_settings.{f.name}") for f in fields], F.col("_settings").isNotNull().alias("_found")
        ).drop("_settings")
    else:
        joined = requests.join(models.withColumn("_found", F.lit(True)), "model", "left")
        found = joined.withColumn("_found", F.coalesce("_found", F.lit(False)))
    error = F.when(
        ~F.col("_found"),
        F.concat(F.lit("Unknown model: "), F.col("model"), F.lit(f". Available: [{names}]")),
    )
    return (
        found.withColumn("model_error", error)
        .withColumn("keep_loaded", F.coalesce("keep_loaded", F.lit(False)))
        .drop("_found")
    )


def _or_default(value: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.col(value), F.lit(0)), default)


def resolve_defaults(requests: DataFrame) -> DataFrame:
    """Fill sizes and steps from the model settings; 0 counts as missing there.

    Takes the output of :func:`lookup_model`. The seed is left alone: 0 is a seed.
    """
    return requests.withColumns(
        {
            "height": _or_default("height", F.col("default_size.h")),
            "width": _or_default("width", F.col("default_size.w")),
            "num_inference_steps": _or_default("num_inference_steps", F.col("default_steps")),
            "seeded": F.col("seed").isNotNull(),
        }
    )


def validate_requests(
    requests: DataFrame, accepted: Sequence[str] = ACCEPTED_MODELS
) -> DataFrame:
    """Add ``reasons`` to reject, ``warnings`` and ``accepted``; sizes only warn."""
    blank = F.coalesce(strip("prompt") == "", F.lit(True))
    other = ~F.coalesce(F.col("model").isin(list(accepted)), F.lit(False))
    odd = (F.col("height") % 8 != 0) | (F.col("width") % 8 != 0)
    reasons = F.array_compact(
        F.array(
            F.when(other, F.concat(F.lit(MODEL_REJECTED), F.col("model"))),
            F.when(blank, F.lit(PROMPT_REJECTED)),
        )
    )
    warnings = F.array_compact(
        F.array(F.when(odd, F.lit(SIZE_WARNING)))
    )
    return requests.withColumns(
        {"reasons": reasons, "warnings": warnings, "accepted": F.size(reasons) == 0}
    )


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests."""
    return validated.where("accepted"), validated.where(~F.col("accepted"))


def route_mode(requests: DataFrame) -> DataFrame:
    """Effective mode and texts; the description keeps the mode asked for."""
    asked = F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.lit(DEFAULT_MODE))
    wants_image = asked.isin(list(IMAGE_MODES))
    has_image = F.col("init_image").isNotNull()
    description = (
        F.when(asked == "text2img", F.lit(TEXT_DESCRIPTION))
        .when(
            asked == "img2img",
            F.concat(
                F.lit(IMAGE_DESCRIPTION[0]),
                F.col("strength").cast("string"),
                F.lit(IMAGE_DESCRIPTION[1]),
            ),
        )
        .when(asked == "controlnet", F.lit(CONTROL_DESCRIPTION))
        .otherwise(F.lit("text2img"))
    )
    note = F.when(wants_image, F.when(has_image, IMAGE_NOTE).otherwise(NO_IMAGE_NOTE))
    return requests.withColumns(
        {
            "effective_mode": F.when(wants_image & ~has_image, DEFAULT_MODE).otherwise(asked),
            "mode_description": description,
            "mode_note": note.otherwise(F.lit("")),
        }
    )


def route_pipeline(df: DataFrame, model_id: str = "model_id") -> DataFrame:
    """Pipeline family by model id; only the second family takes guidance."""
    is_flux = F.lower(F.col(model_id)).contains("flux")
    guidance = F.coalesce(F.col("guidance_scale"), F.lit(DEFAULT_GUIDANCE))
    return df.withColumns(
        {
            "pipeline": F.when(is_flux, "flux").otherwise("sdxl"),
            "guidance": F.when(~is_flux, guidance),
        }
    )


def derive_shapes(requests: DataFrame) -> DataFrame:
    """Latent height and width (an eighth, floored) and channels."""
    return requests.withColumn(
        "latent",
        F.struct(
            F.floor(F.col("height") / 8).cast("int").alias("height"),
            F.floor(F.col("width") / 8).cast("int").alias("width"),
            F.lit(4).alias("channels"),
        ),
    )


def expand_batch(batches: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One request per prompt, in order, sharing the other columns.

    An empty list is an error in one entry point and no work in the other: by default it
    gives one row with ``batch_error``, with ``allow_empty`` none.
    """
    rest = [c for c in batches.columns if c != "prompts"]
    total = F.coalesce(F.size("prompts"), F.lit(0)).alias("total")
    explode = F.posexplode if allow_empty else F.posexplode_outer
    out = batches.select(*rest, total, explode("prompts").alias("_at", "prompt"))
    error = F.when(F.col("_at").isNull(), F.lit("Prompts list cannot be empty"))
    return out.withColumn("position", F.col("_at") + 1).withColumn("batch_error", error).drop("_at")


def sweep(
    prompts: DataFrame,
    steps: Sequence[int] = PROGRESSIVE_STEPS,
    first_seed: int = 42,
    seeds: int = 1,
) -> DataFrame:
    """Job plan: each prompt with each step count and seeds ``first_seed + i``."""
    last = first_seed + seeds - 1
    return prompts.withColumn("steps", F.explode(F.array(*[F.lit(s) for s in steps]))).withColumn(
        "seed", F.explode(F.sequence(F.lit(first_seed), F.lit(last)))
    )


def stage_progress(events: DataFrame) -> DataFrame:
    """Index of the component in the display order and the links already passed."""
    order = F.array(*[F.lit(c) for c in COMPONENT_ORDER])
    index = F.coalesce(F.array_position(order, F.col("component")) - 1, F.lit(-1)).cast("int")
    return events.withColumn("stage_index", index).withColumn(
        "stages_done", F.slice(order, F.lit(1), F.greatest(F.col("stage_index"), F.lit(0)))
    )


def progress_eta(events: DataFrame) -> DataFrame:
    """Percent done and time left of each progress event."""
    left = remaining_s("progress", "total", "time_per_step")
    return events.withColumns(
        {
            "percent": percent_done("progress", "total"),
            "remaining_s": left,
            "remaining": duration_text(left),
        }
    )


# --- function calls ---------------------------------------------------------------------

IMAGE_CALL = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("num_inference_steps", T.IntegerType()),
        T.StructField("seed", T.LongType()),
    ]
)
BATCH_CALL = T.StructType(
    [
        T.StructField("prompts", T.ArrayType(T.StringType())),
        T.StructField("num_inference_steps", T.IntegerType()),
    ]
)


def dispatch_calls(calls: DataFrame) -> DataFrame:
    """Typed arguments of the two known functions; anything else is an error record.

    ``error`` is null on the rows to run; ``where(error is not null)`` is the dead letter.
    """
    one = F.from_json("arguments", IMAGE_CALL)
    many = F.from_json("arguments", BATCH_CALL)
    is_one, is_many = F.col("name") == IMAGE_FUNCTION, F.col("name") == BATCH_FUNCTION
    prompts = F.when(is_one & F.col("_one.prompt").isNotNull(), F.array("_one.prompt")).when(
        is_many, F.col("_many.prompts")
    )
    steps = F.when(is_one, F.col("_one.num_inference_steps")).when(
        is_many, F.col("_many.num_inference_steps")
    )
    known = F.coalesce(is_one | is_many, F.lit(False))
    required = F.when(is_one, "prompt").otherwise("prompts")
    error = F.when(~known, F.concat(F.lit(FUNCTION_UNKNOWN), F.col("name"))).when(
        F.col("prompts").isNull(), F.concat(F.lit(ARGUMENT_MISSING), required)
    )
    return (
        calls.withColumn("_one", F.when(is_one, one))
        .withColumn("_many", F.when(is_many, many))
        .withColumns(
            {
                "prompts": prompts,
                "width": F.when(is_one, F.coalesce("_one.width", F.lit(1024))),
                "height": F.when(is_one, F.coalesce("_one.height", F.lit(1024))),
                "num_inference_steps": F.when(known, F.coalesce(steps, F.lit(30))),
                "seed": F.col("_one.seed"),
            }
        )
        .withColumn("error", error)
        .withColumn("success", F.col("error").isNull())
        .drop("_one", "_many")
    )
