"""Unique names against the one-by-one rule."""

import random

import pytest

from kilnflow.operators.naming import Steps, unique_names


def one_by_one(slugs, existing):
    taken, names = set(existing), []
    for slug in slugs:
        name, i = slug, 0
        while name in taken:
            i += 1
            name = f"{slug}_{i}"
        taken.add(name)
        names.append(f"{name}.png")
    return names


def names_of(spark, slugs, existing=(), rows=None, run=4096):
    asked = spark.createDataFrame(list(enumerate(slugs)), "prompt_id int, slug string")
    files = spark.createDataFrame([(n,) for n in existing], "name string")
    out = unique_names(asked, files, rows=rows, run=run).orderBy("prompt_id").collect()
    return [r["name"] for r in out]


def test_literal_case(spark):
    assert names_of(spark, ["a", "a_1", "a"], ["a"]) == ["a_1.png", "a_1_1.png", "a_2.png"]


def test_gaps_in_files(spark):
    slugs, files = ["a"] * 6 + ["b"], ["a", "a_2", "a_3", "a_7", "a_07", "b_1"]
    assert names_of(spark, slugs, files) == one_by_one(slugs, files)


@pytest.mark.parametrize("rows,run", [(3, 2), (10**6, 4096), (10**6, 1)])
@pytest.mark.parametrize("seed", range(2))
def test_random_families(spark, seed, rows, run):
    rng = random.Random(seed)
    pool = ["a", "a_1", "a_2", "a_1_1", "a_1_2", "a_3", "b", "b_1", "c", "a_2_1", "a_1_1_1", "x_y"]
    weights = [30, 8, 8, 6, 4, 4, 20, 3, 5, 3, 2, 5]
    slugs = rng.choices(pool, weights, k=150)
    files = rng.sample(["a", "a_4", "a_1_3", "b_2", "b_2_1", "zz", "c", "c_1", "a_9", "a_1_1"], rng.randrange(0, 8))
    assert names_of(spark, slugs, files, rows, run) == one_by_one(slugs, files)


def test_many_counted_names_beside_their_stem(spark):
    slugs = ["frame", "frame"] + [f"frame_{i}" for i in range(1, 40)] + ["frame"] * 5
    assert names_of(spark, slugs) == one_by_one(slugs, [])
    late = [f"frame_{i}" for i in range(1, 40)] + ["frame"] * 5
    assert names_of(spark, late) == one_by_one(late, [])


def test_many_contested_names_in_runs(spark):
    rng = random.Random(5)
    slugs = ["frame"] * 40 + [f"frame_{rng.randrange(1, 120)}" for _ in range(90)]
    rng.shuffle(slugs)
    files = [f"frame_{i}" for i in range(20, 60, 7)]
    assert names_of(spark, slugs, files, None, 8) == one_by_one(slugs, files)


@pytest.mark.parametrize("seed", range(20))
def test_steps_compose(seed):
    """Whatever the skips before a run, its steps say what the walk does."""
    rng = random.Random(seed)
    j, rows = 0, []
    for _ in range(60):
        j += rng.randrange(1, 4)
        rows.append((j, rng.random() < 0.2, rng.randrange(0, 80), rng.choice([5, 30, 80])))
    steps = Steps()
    for j, always, before, n in rows:
        steps.then(max(0, j - n + 1), 2**63 - 1 if always else j - before)
    for start in range(150):
        skips = start
        for j, always, before, n in rows:
            skips += j - skips < n and (always or before <= j - skips)
        assert steps.after(start) == skips
    assert len(steps.at) <= 2 * len(rows) + 1
