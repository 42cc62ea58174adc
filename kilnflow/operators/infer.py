"""Running a caller's model or step callback over rows in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.operators.assets import sample_every_n

Predictor = Callable[..., np.ndarray]


def batch_infer(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    inputs: Sequence[str],
    shapes: Sequence[Sequence[int] | None] | None = None,
    batch_size: int = 256,
    seed: int | None = None,
    fail_fast: bool = False,
    return_type: T.DataType | None = None,
) -> DataFrame:
    """Add ``value`` and ``error``: one number per row from the caller's predictor, or one
    value of ``return_type`` (bytes, text, an array) where that is given.

    ``make_predictor`` runs once per Python worker, on first use. Every batch gets the same
    ``seed`` (as a keyword, when given). A failing batch is tried again row by row and only
    the rows that fail carry an error; ``fail_fast`` aborts instead.
    """

    if return_type is not None:
        result = T.StructType(
            [T.StructField("value", return_type), T.StructField("error", T.StringType())]
        )
        infer = _object_udf(make_predictor, result, shapes, batch_size, seed, fail_fast)
        out = df.withColumn("_out", infer(*[F.col(c) for c in inputs]))
        return out.select(*df.columns, "_out.value", "_out.error")

    def make_guarded() -> Callable[..., dict]:
        predict = make_predictor()
        options = {} if seed is None else {"seed": seed}

        def one(row: tuple) -> tuple[float, str | None]:
            try:
                return float(predict(*[np.asarray([v]) for v in row], **options)[0]), None
            except Exception as problem:  # the caller's model may raise anything
                return float("nan"), str(problem)

        def run(*columns: np.ndarray) -> dict:
            try:
                values = np.asarray(predict(*columns, **options), dtype="float64")
                errors = [None] * len(values)
            except Exception:
                if fail_fast:
                    raise
                values, errors = zip(*(one(row) for row in zip(*columns)))
            return {"value": np.asarray(values), "error": np.asarray(errors, dtype=object)}

        return run

    result = T.StructType(
        [T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())]
    )
    infer = predict_batch_udf(
        make_guarded,
        return_type=result,
        batch_size=batch_size,
        input_tensor_shapes=None if shapes is None else list(shapes),
    )
    out = df.withColumn("_out", infer(*[F.col(c) for c in inputs]))
    value = F.when(F.col("_out.error").isNull(), F.col("_out.value"))
    return out.withColumn("value", value).withColumn("error", F.col("_out.error")).drop("_out")


def _object_udf(
    make_predictor: Callable[[], Predictor],
    result: T.StructType,
    shapes: Sequence[Sequence[int] | None] | None,
    batch_size: int,
    seed: int | None,
    fail_fast: bool,
) -> Callable:
    """The caller's predictor for results that are not numbers; same rules for failures."""
    options = {} if seed is None else {"seed": seed}

    def tensor(column: pd.Series, shape: Sequence[int] | None) -> np.ndarray:
        if not shape:
            return column.to_numpy()
        return np.asarray(column.tolist()).reshape(len(column), *shape)

    def infer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        predict = make_predictor()

        def attempt(columns: list[np.ndarray]) -> tuple[list, list]:
            try:
                values = list(predict(*columns, **options))
                return values, [None] * len(values)
            except Exception as problem:  # the caller's model may raise anything
                if fail_fast:
                    raise
                if len(columns[0]) == 1:
                    return [None], [str(problem)]
            rows = [attempt([c[i : i + 1] for c in columns]) for i in range(len(columns[0]))]
            return [v for r in rows for v in r[0]], [e for r in rows for e in r[1]]

        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            columns = [tensor(c, s) for c, s in zip(batch, shapes or [None] * len(batch))]
            values, errors = [], []
            for at in range(0, len(batch[0]), batch_size):
                got, failed = attempt([c[at : at + batch_size] for c in columns])
                values += got
                errors += failed
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    infer.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(infer, result)


def with_step_hook(
    df: DataFrame,
    hook: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str | T.StructType,
    keys: Sequence[str],
    order: Sequence[str],
    n: int = 1,
    rows: int | None = None,
) -> DataFrame:
    """Hand every n-th step (with its index) to the caller's function, batch by batch."""
    return sample_every_n(df, keys, order, n, rows).mapInPandas(hook, schema)
