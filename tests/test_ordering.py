import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordering, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, many ties."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(3000) < 0.7, "hot", rng.choice(list("abc"), 3000))
    pdf = pd.DataFrame({"id": np.arange(3000), "k": key, "v": np.round(rng.normal(size=3000), 1), "m": rng.integers(0, 5, 3000)})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_cumsum(skewed, descending):
    pdf, df = skewed
    cells = df.groupBy("k", "v").agg(F.sum("m").alias("m"))
    got = ordering.running_totals(cells, ["k"], "v", ["m"], descending=descending).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = pdf.groupby(["k", "v"], as_index=False).m.sum().sort_values(["k", "v"], ascending=[True, not descending])
    want["run"] = want.groupby("k").m.cumsum()
    want["tot"] = want.groupby("k").m.transform("sum")
    want = want.sort_values(["k", "v"]).reset_index(drop=True)
    assert (got.run_m == want.run).all() and (got.tot_m == want.tot).all()


def test_running_totals_cut_by_value(skewed):
    pdf, df = skewed
    cells = df.groupBy("k", "v").agg(F.sum("m").alias("m"))
    got = ordering.running_totals(cells, ["k"], "v", ["m"], chunk=F.floor("v")).toPandas().sort_values(["k", "v"])
    want = pdf.groupby(["k", "v"], as_index=False).m.sum().sort_values(["k", "v"])
    assert (got.run_m.to_numpy() == want.groupby("k").m.cumsum().to_numpy()).all()


def test_average_rank_matches_pandas(skewed):
    pdf, df = skewed
    got = ordering.average_rank(df, ["k"], "v", "r").toPandas().sort_values("id")
    want = pdf.groupby("k").v.rank(ascending=False, method="average")
    assert (got.r.to_numpy() == want.to_numpy()).all()


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = ordering.exact_quantiles(df, ["k"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["lo", "mid", "hi"]].astype(float), np.percentile(g.v, [2.5, 50, 97.5]))


def test_row_index_is_a_dense_order(skewed):
    pdf, df = skewed
    got = ordering.row_index(df.select("id", "v"), [], ["v", "id"], "i").toPandas().sort_values("i")
    assert got.i.tolist() == list(range(3000))
    assert got.id.tolist() == pdf.sort_values(["v", "id"]).id.tolist()


def test_consecutive_pairs_cross_chunks_and_gaps(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot"] * 8 + ["b", "c"], 800), "t": rng.integers(0, 4000, 800) ** 2 // 100})
    pdf = pdf.drop_duplicates(["k", "t"])
    df = spark.createDataFrame(pdf)
    got = ordering.consecutive_pairs(df, ["k"], "t", ["t"], chunk=F.floor(F.col("t") / 997)).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    want["prev"] = want.groupby("k").t.shift()
    assert len(got) == len(want)
    assert got.prev_t.fillna(-1).tolist() == want.prev.fillna(-1).tolist()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 5, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_over_any_number_of_ranges(spark, skewed, width, descending):
    """Keys with NULL and NaN, one key over many ranges, many keys in one range, ints and doubles."""
    rng = np.random.default_rng(width)
    pdf = pd.DataFrame({"v": rng.permutation(4000), "n": rng.integers(-3, 9, 4000), "x": rng.normal(size=4000)})
    pdf["k"] = np.where(pdf.v % 10 < 9, 7.0, rng.integers(0, 300, 4000) * 1.0)
    pdf.loc[pdf.v % 97 == 0, "k"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("v") % 101 == 0, None).otherwise(F.col("k")))
    got = ordering.running_totals(df, ["k"], "v", ["n", "x"], descending=descending, width=width).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault("null" if r.k is None else str(r.k), []).append(r)
    want = {}
    for rows in groups.values():
        n = x = 0
        for r in sorted(rows, key=lambda r: -r.v if descending else r.v):
            n, x = n + r.n, x + r.x
            want[r.v] = (n, x, sum(q.n for q in rows))
    assert len(got) == len(want) == 4000
    for r in got:
        n, x, total = want[r.v]
        assert r.run_n == n and r.tot_n == total and abs(r.run_x - x) < 1e-9


def test_hot_key_lies_in_many_ranges_behind_one_exchange(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"), F.lit(1).alias("n"))
    placed = ordering.placed_sums(df, ["k"], "v", ["n"], width=16)
    plan = _plan(placed)
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1 and "Window" not in plan
    sizes = [r["count"] for r in placed.filter("k = 'hot'").groupBy("__range").count().collect()]
    assert len(sizes) >= 13 and max(sizes) < 5_000
    edges = placed.filter("__range_tail AND __range_edge > 0").groupBy("__range").count().collect()
    assert all(r["count"] <= 2 for r in edges)


def test_plans_limit_groups_on_the_map_side_and_avoid_nested_loops(spark, skewed):
    from tidegauge.operators import cohort, windows

    _, df = skewed
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(cohort.seeded_sample(df, ["k"], 5, "id", 1)).count("WindowGroupLimit") == 2
    wins = df.select("k", F.col("id").alias("t0"), (F.col("id") + 10).alias("t1"))
    joined = windows.interval_join(df, wins, node="k", ts="m", t0="t0", t1="t1", bucket_ms=10)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    small = windows.interval_join(df, wins, node="k", ts="m", t0="t0", t1="t1", bucket_ms=10)
    assert "BroadcastHashJoin" in plan(small)


def test_windows_of_many_buckets_and_rows_without_a_key(spark):
    wins = spark.createDataFrame([(1, 0, 1000)], "k int, t0 long, t1 long")
    df = spark.range(0, 1200, 7).selectExpr("1 AS k", "id AS m")
    assert windows.interval_join(df, wins, node="k", ts="m", t0="t0", t1="t1", bucket_ms=10).count() == 143
    rows = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "key string, at int, n int")
    got = sorted((str(r.key), r["at"], r.run_n, r.tot_n) for r in ordering.running_totals(rows, ["key"], "at", ["n"]).collect())
    assert got == [("None", 1, 2, 5), ("None", 2, 5, 5), ("a", 1, 5, 5)]
