"""Sources and sinks on files written here."""

import json
import os
import struct

import pytest

from kilnflow.functions.payload import image_size
from kilnflow.operators.assets import describe_assets
from kilnflow.sources import files


def test_prompts_keep_file_order_over_splits(spark, tmp_path):
    lines = [f"  prompt {i} \t" if i % 4 else "   " for i in range(20_000)]
    (tmp_path / "p.txt").write_text("\r\n".join(lines), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        prompts = files.read_prompts(spark, str(tmp_path))
        assert prompts.rdd.getNumPartitions() > 3
        got = [r["prompt"] for r in prompts.orderBy("file_path", "block_start", "line_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [s.strip() for s in lines if s.strip()]


def test_no_prompts_is_an_error(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" \n\n")
    assert files.read_prompts(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        files.read_prompts(spark, str(tmp_path), required=True)


def test_requests(spark, tmp_path):
    rows = ['{"prompt":"a","seed":0}', '{"width":8}', "not json", '{"prompt":"b","return_base64":true,"width":64}']
    (tmp_path / "r.json").write_text("\n".join(rows))
    got = files.read_requests(spark, str(tmp_path)).collect()
    assert [r["request_error"] for r in got] == [None, "prompt: field required", "malformed request", None]
    assert (got[0]["seed"], got[0]["return_base64"]) == (0, False)
    assert (got[3]["width"], got[3]["return_base64"]) == (64, True)


def test_batch_and_visual_requests(spark):
    df = spark.createDataFrame([('{"prompts":["a","b"],"seed":3}',), ("{}",)], "body string")
    batch = files.parse_requests(df, "body", files.BATCH_REQUEST, {}).collect()
    assert batch[0]["prompts"] == ["a", "b"] and batch[1]["request_error"] == "prompts: field required"
    seen = spark.createDataFrame([('{"prompt":"a"}',)], "body string")
    row = files.parse_requests(seen, "body", files.VISUAL_REQUEST, files.VISUAL_DEFAULTS).first()
    assert (row["mode"], row["width"], row["guidance_scale"], row["strength"]) == ("text2img", 1024, 7.5, 0.8)


def test_catalog_and_dimensions(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + bytes(1048576 - 24)
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.png").write_bytes(png)
    listing = files.read_asset_catalog(spark, str(tmp_path))
    row = describe_assets(listing).collect()
    assert [(os.path.basename(r["path"]), r["size_mb"]) for r in row] == [("a.png", 1.0)]
    size = files.read_images(spark, str(tmp_path)).select(image_size("content").alias("s")).first()["s"]
    assert tuple(size) == (640, 480)


def test_layout(spark, tmp_path):
    base = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "s_20251018", "images"), (2, "s_20251018", "data"), (3, "t", "root")],
                                 "id int, session_key string, kind string")
    files.write_session_layout(rows, base)
    assert os.path.isdir(f"{base}/session_key=s_20251018/kind=images")
    assert spark.read.parquet(base).count() == 3


def test_state_events(spark, tmp_path):
    rows = [{"run_id": 1, "seq": 1, "component": "input", "progress": 0, "total": 0, "message": "m",
             "timestamp": "2025-10-18T10:00:00.250000"},
            {"run_id": 1, "seq": 2, "component": "diffusion", "progress": 1, "total": 2, "message": "m",
             "timestamp": "2025-10-18T10:00:01", "metrics": {"time_per_step": 2.0},
             "component_timing": {"component": "start", "elapsed_time": 0.3},
             "component_percentages": {"start": 100.0}}]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = files.read_state_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert got[0]["metrics"] == {} and got[0]["component_timing"] is None
    assert got[0]["ts"].microsecond == 250000
    assert got[1]["metrics"] == {"time_per_step": 2.0} and got[1]["component_timing"]["elapsed_time"] == 0.3
    assert files.read_state_events(spark, str(tmp_path), stream=True).isStreaming


def test_results_append(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a.png", 8, 8, 0, None), (2, "b.png", 8, 8, 1, "no memory")],
        "request_id int, image_path string, width int, height int, seed int, error string",
    )
    files.write_results(rows, str(tmp_path / "r"))
    files.write_results(rows, str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert got.count() == 4
    bad = got.where("not success").first()
    assert (bad["message"], bad["image_path"], bad["seed"]) == ("no memory", None, None)
