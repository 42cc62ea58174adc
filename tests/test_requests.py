"""Request operators: literal cases of the traps."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kilnflow.constants import COMPONENT_MODES, MODELS
from kilnflow.operators import assets, audit, lookups, requests


def asked(spark, rows):
    return spark.createDataFrame(
        rows,
        "request_id int, prompt string, width int, height int, num_inference_steps int, seed long, model string",
    )


def test_defaults(spark):
    rows = asked(spark, [(1, "a", None, 0, 0, 0, "flux"), (2, "a", 512, 256, 5, None, "flux"),
                         (3, "a", None, None, None, 1, "brushnet")])
    found = requests.lookup_model(rows, requests.models_table(spark), list(MODELS))
    got = {r["request_id"]: r for r in requests.resolve_defaults(found).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["num_inference_steps"]) == (1024, 1024, 30)
    assert got[1]["seed"] == 0 and got[1]["seeded"] and not got[2]["seeded"]
    assert (got[2]["width"], got[2]["height"], got[2]["num_inference_steps"]) == (512, 256, 5)
    assert got[3]["height"] is None and got[3]["num_inference_steps"] == 30


def test_unknown_model(spark):
    found = requests.lookup_model(
        asked(spark, [(1, "a", 8, 8, 1, 1, "dalle")]), requests.models_table(spark), list(MODELS)
    ).first()
    assert found["model_error"] == (
        "Unknown model: dalle. Available: ['flux', 'sdxl', 'controlnet', 'brushnet']"
    )
    assert found["keep_loaded"] is False and found["idle_timeout"] is None


def test_validation(spark):
    rows = asked(spark, [(1, "\t ", 8, 8, 1, 1, "flux"), (2, "ok", 1023, 1024, 1, 1, "flux"),
                         (3, "ok", 8, 8, 1, 1, "sdxl"), (4, None, None, None, 1, 1, None)])
    checked = requests.validate_requests(rows)
    got = {r["request_id"]: r for r in checked.collect()}
    assert got[1]["reasons"] == ["Prompt cannot be empty"]
    assert got[2]["accepted"] and len(got[2]["warnings"]) == 1
    assert got[3]["reasons"] == ["Model not available: sdxl"]
    assert not got[4]["accepted"] and got[4]["warnings"] == []
    good, bad = requests.split_requests(checked)
    assert (good.count(), bad.count()) == (1, 3)


def test_route_mode(spark):
    rows = spark.createDataFrame(
        [(None, None, 0.8), ("", None, 0.8), ("img2img", None, 0.8), ("img2img", "x", 0.5), ("upscale", None, 0.8)],
        "mode string, init_image string, strength double",
    )
    got = [tuple(r)[3:] for r in requests.route_mode(rows).collect()]
    assert got[0] == ("text2img", "Text-to-Image (generate from scratch)", "") == got[1]
    assert got[2][:2] == ("text2img", "Image-to-Image (transform existing image, strength=0.8)")
    assert got[2][2].startswith("WARNING") and got[3][2].startswith("Reference image received")
    assert got[4] == ("upscale", "text2img", "")


def test_expand_batch(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], 5), (2, [], 6)], "id int, prompts array<string>, seed int")
    strict = requests.expand_batch(rows).orderBy("id", "position").collect()
    assert [(r["id"], r["position"], r["prompt"], r["seed"]) for r in strict] == [
        (1, 1, "a", 5), (1, 2, "b", 5), (2, None, None, 6)
    ]
    assert strict[2]["batch_error"] == "Prompts list cannot be empty"
    assert requests.expand_batch(rows, allow_empty=True).count() == 2


def test_stage_progress(spark):
    rows = spark.createDataFrame([("input",), ("diffusion",), ("other",)], "component string")
    got = {r["component"]: (r["stage_index"], r["stages_done"]) for r in requests.stage_progress(rows).collect()}
    assert got["input"] == (0, []) and got["other"] == (-1, [])
    assert got["diffusion"] == (4, ["input", "api", "loading", "encoding"])


def test_dispatch(spark):
    rows = spark.createDataFrame(
        [("generate_image", '{"prompt":"a","width":64}'), ("generate_image", '{"width":64}'),
         ("generate_images_batch", '{"prompts":["a","b"],"num_inference_steps":5}'), ("nope", "{}")],
        "name string, arguments string",
    )
    got = requests.dispatch_calls(rows).collect()
    assert (got[0]["prompts"], got[0]["width"], got[0]["height"], got[0]["success"]) == (["a"], 64, 1024, True)
    assert got[1]["error"] == "Missing required argument: prompt"
    assert (got[2]["prompts"], got[2]["num_inference_steps"], got[2]["width"]) == (["a", "b"], 5, None)
    assert got[3]["error"] == "Unknown function: nope"


def test_sweep_sizes(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert requests.sweep(prompts).count() == 20
    plan = requests.sweep(prompts, (10, 20, 30), 42, 15)
    assert plan.count() == 90 and plan.agg(F.max("seed")).first()[0] == 56


def test_components_of_modes(spark):
    rows = spark.createDataFrame([(1, "llm"), (2, "unheard")], "request_id int, mode string")
    active = lookups.active_components(rows)
    assert active.count() == 2 * len(COMPONENT_MODES)
    on = {m: {r["component"] for r in active.where(F.col("mode") == m).where("is_active").collect()}
          for m in ("llm", "unheard")}
    assert on["llm"] == {"input", "api", "text-encode", "llm-inference", "text-decode", "output"}
    assert on["unheard"] == {"input", "api", "output"}


def test_overrides_replace_whole_entries(spark):
    schema = "name string, steps int, size int"
    base = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], schema)
    over = spark.createDataFrame([("b", 9, None), ("c", 5, 6)], schema)
    got = sorted(tuple(r) for r in lookups.apply_overrides(base, over, "name").collect())
    assert got == [("a", 1, 2), ("b", 9, None), ("c", 5, 6)]


def test_zip_stops_at_the_shorter(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i int, x string")
    b = spark.createDataFrame([(9, "z"), (8, "y")], "j int, y string")
    got = sorted((r["x"], r["y"]) for r in lookups.zip_by_position(a, b, ["i"], ["j"], rows=1).collect())
    assert got == [("a", "y"), ("b", "z")]


def test_pick_falls_back(spark):
    prompts = spark.createDataFrame(
        [(1, "text2img", "t"), (2, "llm", "l"), (3, "llm", "m")], "prompt_id int, mode string, text string"
    )
    picks = lookups.random_pick(prompts, 1)
    assert picks.count() == 2
    wanted = spark.createDataFrame([(1, "llm"), (2, "none"), (3, None)], "id int, mode string")
    got = {r["id"]: r["text"] for r in lookups.pick_for_modes(wanted, picks).collect()}
    assert got[1] in "lm" and got[2] == got[3] == "t"


def test_samples_start_at_zero(spark):
    steps = spark.range(20).withColumn("run", F.lit(1))
    got = assets.sample_every_n(steps, ["run"], ["id"], 5, rows=3).orderBy("id").collect()
    assert [r["step_index"] for r in got] == [0, 5, 10, 15] == [r["id"] for r in got]


def test_latest_asset(spark):
    rows = spark.createDataFrame([("b", 2, 1), ("a", 2, 1), ("z", 1, 1)], "path string, mtime int, length int")
    assert assets.latest_asset(rows).first()["path"] == "b"
    none = rows.where("false")
    assert assets.latest_asset(none, required=False).count() == 0
    with pytest.raises(PySparkException, match="no asset found"):
        assets.latest_asset(none).collect()


def test_new_assets_oldest_first(spark):
    schema = "path string, mtime int"
    after = spark.createDataFrame([("c", 1), ("a", 2), ("b", 2), ("old", 0)], schema)
    before = spark.createDataFrame([("old", 0)], schema)
    assert [r["path"] for r in assets.new_assets(before, after).collect()] == ["c", "a", "b"]


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([[1], [1], [2], [1]])], "r int, i int, v array<int>")
    got = assets.consecutive_duplicates(rows, ["r"], ["i"], "v", rows=1).orderBy("i").collect()
    assert [r["is_duplicate"] for r in got] == [False, True, False, False]


def test_audit(spark):
    pages = spark.createDataFrame([(1, '<p><p class="t">One</p>'), (2, "")], "page_id int, html string")
    got = {r["page_id"]: r for r in audit.content_audit(pages, "<p", ["One", "Two"], ["</p>"], '"t">').collect()}
    assert (got[1]["marker_count"], got[1]["missing_titles"], got[1]["passed"]) == (2, ["Two"], True)
    assert (got[2]["marker_count"], got[2]["found_titles"], got[2]["passed"]) == (0, 0, False)


def test_settings_in_a_mapping_need_no_join(spark):
    rows = asked(spark, [(1, "a", None, 0, 0, 0, "flux"), (2, "a", 8, 8, 1, 1, "dalle"), (3, "a", 8, 8, 1, 1, None)])
    inside = requests.lookup_model(rows, MODELS, list(MODELS))
    joined = requests.lookup_model(rows, requests.models_table(spark), list(MODELS))
    assert sorted(map(str, inside.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_dimmed_rows_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "text2img"), (2, "nothing"), (3, None)], "id int, mode string")
    row_of = {c: c.split("-")[0] for c in COMPONENT_MODES}
    out = lookups.dimmed_rows(rows, row_of)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["row"]) for r in out.collect()}
    active = lookups.active_components(rows).collect()
    lit = {(r["id"], row_of[r["component"]]) for r in active if r["is_active"]}
    assert got == {(r["id"], row_of[r["component"]]) for r in active} - lit
