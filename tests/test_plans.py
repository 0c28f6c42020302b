from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.plans import commit, shards, splits


@given(st.dictionaries(st.text("abcdef", min_size=1), st.integers(1, 50), min_size=1, max_size=20), st.integers(1, 5))
def test_least_loaded_keeps_all(sizes, slots):
    plan = shards.least_loaded(list(sizes.items()), slots)
    assert sorted(s for slot in plan for s in slot) == sorted(sizes.items())
    loads = [sum(n for _, n in slot) for slot in plan]
    assert max(loads) - min(loads) <= max(sizes.values())


def test_aligned():
    assert shards.aligned(10, 18, 6) == 12 and shards.aligned(7, 4, 6) == 8 and shards.aligned(0, 4, 6) == 0
    assert shards.padded_samples([[("a", 7)], [("b", 5)]], 4, 2) == (8, 4)
    assert splits.steps_per_epoch(100, 18) == (5, 10)
    assert [splits.lane_batch(n, 4) for n in (0, 3, 50, 1000)] == [1, 1, 13, 100]


def test_planned(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "shard string, n long")
    assert sorted(r.shard for r in shards.planned(df, "shard", "n", 2).collect()) == ["a", "b", "c"]


def test_splits(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"))
    held = splits.group_holdout(df, "g", order="id")
    assert held.filter("split = 'eval'").select("g").distinct().collect()[0].g == "0" and held.count() == 100
    sample = splits.seeded_sample(df, "id", 28, 10).collect()
    assert [r.target for r in sample] == list(range(10)) and sample == splits.seeded_sample(df.repartition(7), "id", 28, 10).collect()
    places = splits.shuffled(df, "g", "id", 1, 0)
    assert sorted(r.place for r in places.filter("g = '1'").collect()) == list(range(33))
    assert places.collect() != splits.shuffled(df, "g", "id", 1, 1).collect()
    with pytest.raises(ValueError):
        splits.head_tail(df, 90, 20, "id")
    done = df.limit(5)
    assert splits.seed_plan(df, done, "id", 8, "id").count() == 3
    with pytest.raises(ValueError):
        splits.seed_plan(df, done, "id", 200, "id")


def test_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    assert commit.commit(spark, df, path, "b1", expected=5) == 5
    assert commit.commit(spark, df, path, "b1") == 0
    with pytest.raises(ValueError, match="not 6"):
        commit.commit(spark, df, path, "b2", expected=6)
    assert commit.read_committed(spark, path).count() == 5


def test_reconcile_and_flush(spark):
    schema = "id int, reference string, size int"
    staged = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 9), (4, "d", 4)], schema)
    jobs = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], schema)
    got = {r.id: r.verdict for r in commit.reconciled(staged, jobs, staged.filter("id = 1")).collect()}
    assert got == {1: "committed", 2: "kept", 3: "invalid", 4: "invalid"}
    pending = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, ready_at timestamp")
    due = lambda **kw: commit.flush_due(pending, **{"batch": 9, "lanes": 4, "terminal": False, "now": "2024-01-01 00:01:00"} | kw)
    assert not due() and due(terminal=True) and due(lanes=1) and due(now="2024-01-01 00:06:00")
    assert not commit.flush_due(pending.limit(0), 1, 1, True)
    files = spark.createDataFrame([("x", 1, "aa"), ("y", 2, "bb")], "name string, size int, sha256 string")
    bad = commit.verified(files, files.filter("name = 'x'")).collect()
    assert [(r.name, r.verdict) for r in bad] == [("y", "missing")]
