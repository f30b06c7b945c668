import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import features, ordering, permute


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 10_007])
def test_every_number_is_hit_once(spark, n):
    a, b = permute.domain(n)
    assert a * b >= n
    want = [permute.scramble_int(i, n, 5, 3) for i in range(n)]
    assert sorted(want) == list(range(n))
    got = spark.range(n).select(F.col("id").alias("i"), permute.scramble("id", n, 5, 3).alias("x")).collect()
    assert {r.i: r.x for r in got} == dict(enumerate(want))
    sql = duckdb.sql(f"WITH q AS (SELECT range AS i FROM range({n})) {permute.scramble_sql('q', 5, 4, walks=40 if n < 10 else 4)}").fetchall()
    assert {i: x for number, i, x in sql if number == 3} == dict(enumerate(want))


def test_permutations_differ_and_look_random():
    n = 10_007
    x = np.array([[permute.scramble_int(i, n, 42, k) for i in range(n)] for k in range(2)])
    i = np.arange(n)
    for p in x:
        assert abs(np.corrcoef(i, p)[0, 1]) < 0.04 and (p == i).sum() < 10
    assert abs(np.corrcoef(x[0], x[1])[0, 1]) < 0.04
    for n in (15_013, 10**9 + 7, 10**12 + 39):
        a, b = permute.domain(n)
        assert 0 <= a * b - n <= n**0.5 / 50


def test_numbers_beyond_n_walk_on(spark, monkeypatch):
    """With one width to choose from, many numbers lie beyond n."""
    monkeypatch.setattr(permute, "TRIED", 1)
    permute.domain.cache_clear()
    n = 103
    a, b = permute.domain(n)
    assert a * b > n and len(permute.beyond(n, 1, 0)) == a * b - n
    got = spark.range(n).select(permute.scramble("id", n, 1, 0).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))
    permute.domain.cache_clear()


def test_placebos_sort_the_rows_once_and_move_columns_together(spark):
    cols = features.stat_columns("g")
    df = spark.range(500).select(F.col("id").alias("job"), *[(F.col("id") * 10 + j).cast("double").alias(c) for j, c in enumerate(cols)])
    made = features.placebos(df, key="job", groups=["g"], count=20, seed=1, name="p")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("rangepartitioning") == 0
    rows = made.toPandas()
    assert len(rows) == 500 and len(rows.columns) == 81
    for k in range(20):
        first = rows[f"p{k:02d}__{features.STATS[0]}"]
        assert sorted(first) == [10.0 * i for i in range(500)]
        for j, s in enumerate(features.STATS):
            assert (rows[f"p{k:02d}__{s}"] == first + j).all()


def test_placebos_are_made_by_tasks_of_counted_ranks(spark, monkeypatch):
    """The number of tasks that hold wide rows follows the ranks."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 10)
    df = spark.range(700).selectExpr("id AS job", *[f"CAST(id AS DOUBLE) AS g__{s}" for s in features.STATS])
    out = features.placebos(df, key="job", groups=["g"], count=2, seed=1, name="p")
    assert out.rdd.getNumPartitions() == 70
    assert sorted(r.p00__mean for r in out.collect()) == list(range(700))
