"""Ordered scans against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from kilnflow.operators import ordered
from kilnflow.operators.ordered import Running, cut, number_rows, previous, running


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have one key, another third one time; a few keys are null."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"k{rng.randrange(20)}")
        time = 7 if i % 3 == 1 else rng.randrange(1000)
        rows.append((key, time, i, rng.randrange(-50, 50)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, t int, id int, v int").repartition(5)


def by_key(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["key"], []).append(r)
    return {k: sorted(rs, key=lambda r: (r["t"], r["id"])) for k, rs in groups.items()}


@pytest.mark.parametrize("rows", [1, 10, 100, 10**6])
def test_running_matches_python(skewed, rows):
    out = running(
        skewed,
        ["key"],
        ["t", "id"],
        {
            "n": Running("count"),
            "s": Running("sum", F.col("v")),
            "hi": Running("max", F.col("v")),
            "lo": Running("min", F.col("v")),
        },
        rows=rows,
    )
    for group in by_key(out).values():
        values = []
        for i, r in enumerate(group, 1):
            values.append(r["v"])
            assert (r["n"], r["s"], r["hi"], r["lo"]) == (i, sum(values), max(values), min(values))


@pytest.mark.parametrize("rows", [10, 10**6])
def test_reverse_exclusive(skewed, rows):
    out = running(
        skewed, ["key"], ["t", "id"], {"later": Running("sum", F.col("v")), "left": Running("count")},
        inclusive=False, reverse=True, rows=rows,
    )
    for group in by_key(out).values():
        for i, r in enumerate(group):
            rest = [x["v"] for x in group[i + 1 :]]
            assert r["left"] == len(rest)
            assert r["later"] == (sum(rest) if rest else None)


@pytest.mark.parametrize("rows", [3, 10**6])
def test_previous(skewed, rows):
    for group in by_key(previous(skewed, ["key"], ["t", "id"], "v", "before", rows=rows)).values():
        values = [None] + [r["v"] for r in group]
        assert [r["before"] for r in group] == values[:-1]


@pytest.mark.parametrize("rows", [9, 10**6])
def test_whole_table_numbering(skewed, rows):
    numbered = number_rows(skewed, [], ["t", "id"], rows=rows)
    got = sorted((r["position"], r["t"], r["id"]) for r in numbered.collect())
    assert [g[0] for g in got] == list(range(1, 901))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_hot_key_is_spread(skewed):
    chunks = cut(skewed, ["key"], ["t", "id"], 10).groupBy("key", "_chunk").count().collect()
    hot = [r["count"] for r in chunks if r["key"] == "hot"]
    assert len(hot) > 10
    assert max(hot) < 100


def test_equal_times_are_spread(skewed):
    at_seven = cut(skewed.where("t = 7").withColumn("key", F.lit("x")), ["key"], ["t", "id"], 10)
    assert at_seven.select("_chunk").distinct().count() > 10


def test_chunks_follow_the_order(skewed):
    for group in by_key(cut(skewed, ["key"], ["t", "id"], 10)).values():
        chunks = [r["_chunk"] for r in group]
        assert chunks == sorted(chunks)


def test_no_more_cut_points_than_tasks_can_use(spark, skewed):
    chunks = cut(skewed, ["key"], ["t", "id"], 1)
    cuts = chunks.groupBy("key").agg(F.max("_chunk").alias("n")).agg(F.sum("n")).first()[0]
    assert 0 < cuts <= ordered.useful_cuts(spark)
    numbered = number_rows(skewed, ["key"], ["t", "id"], rows=1)
    for group in by_key(numbered).values():
        assert [r["position"] for r in group] == list(range(1, len(group) + 1))


def test_no_row_carries_the_cut_points(skewed):
    """Chunks come from a literal: no join, no subquery, no array in any row."""
    plan = cut(skewed, ["key"], ["t", "id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" not in plan and "from_json" not in plan


def test_no_filter_stays_above_the_shuffle_of_small_keys(skewed):
    """Totals are carried for split keys only: their filter sits at the scan side."""
    twice = running(
        number_rows(skewed, ["key"], ["t", "id"], rows=50, keep_chunks=True),
        ["key"], ["t", "id"], {"s": Running("sum", F.col("v"))},
    )
    plan = twice._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    for line in plan.splitlines():
        assert "Filter _split" not in line


def test_plans_stay_small_with_many_partitions(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        twice = running(
            number_rows(skewed, ["key"], ["t", "id"], rows=50, keep_chunks=True),
            ["key"], ["t", "id"], {"s": Running("sum", F.col("v"))},
        )
        assert len(twice._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_only_rows_of_cut_keys_are_looked_up(skewed, capsys):
    """The cut points' keys are told by their hashes, nulls too; a row of another key needs no bisection."""
    _, hashes = ordered._cut_points(skewed, ["key"], ["t", "id"], 40)
    out = cut(skewed, ["key"], ["t", "id"], 40)
    rows = out.withColumn("h", F.xxhash64(F.struct("key"))).collect()
    assert {r["h"] for r in rows if r["_split"]} == set(hashes)
    assert {r["key"] for r in rows} > {r["key"] for r in rows if r["_split"]} >= {"hot"}
    assert all(r["_chunk"] == 0 for r in rows if not r["_split"])
    out.explain(True)
    plan = capsys.readouterr().out
    assert "CASE WHEN xxhash64(struct(key" in plan.split("Optimized Logical Plan")[1]
