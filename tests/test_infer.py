"""Running a caller's functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnflow.operators.infer import batch_infer, with_step_hook


def make_picky():
    def predict(values, seed=0):
        if (values < 0).any():
            raise ValueError("negative input")
        return np.sqrt(values) + seed

    return predict


def test_only_failing_rows_carry_an_error(spark):
    rows = spark.createDataFrame([(1, 4.0), (2, -1.0), (3, 9.0)], "id int, v double").coalesce(1)
    got = {r["id"]: (r["value"], r["error"]) for r in batch_infer(rows, make_picky, ["v"], batch_size=10).collect()}
    assert got == {1: (2.0, None), 2: (None, "negative input"), 3: (3.0, None)}


def test_every_batch_gets_the_same_seed(spark):
    rows = spark.range(40).select(F.col("id").cast("double").alias("v"))
    out = batch_infer(rows, make_picky, ["v"], batch_size=3, seed=100).collect()
    assert all(r["value"] == pytest.approx(100 + r["v"] ** 0.5) for r in out)


def test_fail_fast(spark):
    rows = spark.createDataFrame([(-1.0,)], "v double")
    with pytest.raises(Exception, match="negative input"):
        batch_infer(rows, make_picky, ["v"], fail_fast=True).collect()


def test_hook_sees_every_nth_step(spark):
    steps = spark.range(12).select(F.lit(1).alias("run"), F.col("id").alias("step"))

    def hook(batches):
        for batch in batches:
            yield batch[["run", "step_index"]]

    got = with_step_hook(steps, hook, "run int, step_index long", ["run"], ["step"], 4, rows=2).collect()
    assert sorted(r["step_index"] for r in got) == [0, 4, 8]


def test_results_of_other_types(spark):
    """Bytes and arrays come back; only the rows that fail carry an error."""
    from pyspark.sql import types as T

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "id int, v array<double>")

    def make_bytes():
        def predict(batch):
            if (batch[:, 0] == 3).any():
                raise ValueError("three")
            return [bytes([int(x)]) for x in batch[:, 0]]

        return predict

    out = batch_infer(rows, make_bytes, ["v"], [[2]], batch_size=4, return_type=T.BinaryType())
    got = {r["id"]: (r["value"], r["error"]) for r in out.collect()}
    assert got == {i: (None, "three") if i == 3 else (bytes([i]), None) for i in range(7)}
    doubled = batch_infer(
        rows, lambda: lambda batch: batch * 2, ["v"], [[2]], return_type=T.ArrayType(T.DoubleType())
    )
    assert {r["id"]: r["value"] for r in doubled.collect()} == {i: [2.0 * i, 2.0] for i in range(7)}
