"""Edit replay and masks against brute force."""

import random

import pytest

from kilnflow.operators.edits import region_mask, replay_edits

SCHEMA = "image_id int, seq int, op string, x1 double, y1 double, x2 double, y2 double"


def replay(rows):
    stacks = {}
    for image, seq, op, x1, y1, x2, y2 in sorted(rows):
        stack = stacks.setdefault(image, [])
        if op == "add":
            stack.append((seq, min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)))
        elif op == "undo":
            stack[-1:] = []
        else:
            stack.clear()
    return sorted((i, n, *r) for i, s in stacks.items() for n, r in enumerate(s, 1))


def edits(seed, count, weights):
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        image = 1 if rng.random() < 0.5 else rng.randrange(2, 8)
        op = rng.choices(["add", "undo", "reset"], weights)[0]
        rows.append((image, seq, op, *[round(rng.uniform(0, 40), 1) for _ in range(4)]))
    return rows


@pytest.mark.parametrize("rows", [2, 9, 10**6])
@pytest.mark.parametrize("weights", [(6, 3, 0.1), (3, 4, 0.3), (5, 1, 1)])
def test_replay(spark, rows, weights):
    log = edits(rows % 97, 400, weights)
    got = replay_edits(spark.createDataFrame(log, SCHEMA), rows=rows).collect()
    assert sorted(
        (r["image_id"], r["rect_id"], r["seq"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got
    ) == replay(log)


def test_literal_cases(spark):
    ops = ["add", "add", "undo", "add", "reset", "add"]
    log = [(1, i, op, 1.0, 2.0, 0.0, 5.0) for i, op in enumerate(ops)] + [(2, 0, "undo", 0.0, 0.0, 1.0, 1.0)]
    got = replay_edits(spark.createDataFrame(log, SCHEMA)).collect()
    assert [(r["image_id"], r["seq"], r["x1"], r["x2"]) for r in got] == [(1, 5, 0.0, 1.0)]


@pytest.mark.parametrize("by", [(), ("image_id",)])
def test_mask(spark, by):
    rng = random.Random(3)
    regions = []
    for _ in range(60):
        x, y = rng.uniform(-20, 60), rng.uniform(-20, 60)
        w, h = rng.choice([(0, 0), (0.3, 0.2), (5, 1), (8, 8), (0, 12), (40, 2)])
        regions.append((rng.randrange(3), round(x), round(y), round(x) + w, round(y) + h))
    points = [(i, rng.randrange(3), float(rng.randrange(-20, 60)), float(rng.randrange(-20, 60))) for i in range(800)]
    points += [(1000 + i, 0, float(x1), float(y2)) for i, (_, x1, _, _, y2) in enumerate(regions)]
    inside = sorted(
        i for i, image, x, y in points
        if any((not by or im == image) and x1 <= x <= x2 and y1 <= y <= y2 for im, x1, y1, x2, y2 in regions)
    )
    out = region_mask(
        spark.createDataFrame(points, "id int, image_id int, x double, y double"),
        spark.createDataFrame(
            [tuple(map(float, r[1:])) + (r[0],) for r in regions],
            "x1 double, y1 double, x2 double, y2 double, image_id int",
        ),
        by,
    )
    assert sorted(r["id"] for r in out.collect()) == inside


def test_no_regions_no_mask(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    none = spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double")
    assert region_mask(points, none).count() == 0


def test_mask_plan_has_no_nested_loop(spark):
    points = spark.range(100).selectExpr("id", "double(id) as x", "double(id) as y")
    regions = spark.range(100).selectExpr(
        "double(id) as x1", "double(id) as y1", "double(id + 3) as x2", "double(id + 2) as y2"
    )
    plan = region_mask(points, regions)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("cell_pieces,quarterings", [(1, 3), (4, 40), (64, 40)])
def test_crowded_regions(spark, cell_pieces, quarterings):
    """Many regions on a small area, slivers and points among them, nested and repeated ones too."""
    rng = random.Random(8)
    regions = [(4.0 - i / 50, 4.0 - i / 60, 4.0 + i / 50, 4.0 + i / 60) for i in range(60)]
    for _ in range(400):
        x, y = round(rng.uniform(0, 8), 2), round(rng.uniform(0, 8), 2)
        w, h = rng.choice([(0, 0), (0, 3), (2.5, 0), (0.02, 0.02), (0.5, 0.01), (0.3, 0.3)])
        regions.append((x, y, x + w, y + h))
    regions += regions[:30]
    points = [(i, round(rng.uniform(-1, 9), 2), round(rng.uniform(-1, 9), 2)) for i in range(1500)]
    points += [(2000 + i, r[2], r[1]) for i, r in enumerate(regions)]
    inside = sorted(i for i, x, y in points if any(a <= x <= c and b <= y <= d for a, b, c, d in regions))
    out = region_mask(
        spark.createDataFrame(points, "id int, x double, y double"),
        spark.createDataFrame(regions, "x1 double, y1 double, x2 double, y2 double"),
        cell_pieces=cell_pieces, quarterings=quarterings,
    )
    assert sorted(r["id"] for r in out.collect()) == inside
