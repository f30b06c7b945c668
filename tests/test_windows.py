import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegauge import session
from tidegauge.functions import columns as C
from tidegauge.operators import checks, windows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_interval_join_is_half_open_and_finds_all_windows(spark):
    readings = spark.createDataFrame([(1, t, float(t)) for t in (99, 100, 149, 150, 199, 200)] + [(2, 120, 5.0)], "node int, ts bigint, value double")
    wins = spark.createDataFrame([("a", 1, 100, 200), ("b", 1, 150, 151), ("c", 3, 0, 1000), ("empty", 1, 100, 100)], "job string, node int, t0 bigint, t1 bigint")
    for bucket in (7, 100, 10_000):
        got = windows.interval_join(readings, wins, node="node", ts="ts", t0="t0", t1="t1", bucket_ms=bucket)
        assert rows(got, "job", "ts") == [("a", 100), ("a", 149), ("a", 150), ("a", 199), ("b", 150)]


def test_event_alignment_with_negative_times(spark):
    readings = spark.createDataFrame([(1, t, 1.0) for t in (-50, -1, 0, 49, 50)], "node int, ts bigint, value double")
    events = spark.createDataFrame([(9, 1, 0)], "ev int, node int, at bigint")
    near = windows.event_aligned(readings, events, node="node", ts="ts", at="at", before_ms=50, after_ms=50)
    assert rows(near, "rel_ms") == [(-50,), (-1,), (0,), (49,)]
    profile = windows.aligned_profile(near, value="value", lo_ms=-50, hi_ms=50, bin_ms=25)
    assert rows(profile, "bin", "n", "mean_value") == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def test_profile_keeps_empty_bins_and_finds_the_step(spark):
    near = spark.createDataFrame([(0, 10.0), (1, 20.0), (25, 90.0)], "rel_ms bigint, value double")
    profile = windows.aligned_profile(near, value="value", lo_ms=-10, hi_ms=30, bin_ms=10)
    assert rows(profile, "bin", "n", "mean_value") == [(0, 0, 0.0), (1, 2, 15.0), (2, 0, 0.0), (3, 1, 90.0)]
    step = windows.largest_step(profile).first()
    assert (step.bin, step.bin_start_ms, step.from_value, step.to_value) == (3, 20, 0.0, 90.0)


def test_asof_forward_cases(spark):
    readings = spark.createDataFrame([(1, 100, 1.0), (1, 200, 2.0), (1, 200, 3.0), (1, 300, 4.0)], "node int, ts bigint, value double")
    # exact, first at or after, next too far, past the last within and beyond the tolerance, unknown node
    grid = spark.createDataFrame([(1, 100), (1, 185), (1, 120), (1, 315), (1, 321), (2, 100)], "node int, g bigint")
    got = windows.asof_match(grid, readings, node="node", at="g", ts="ts", value="value", tolerance_ms=20)
    assert rows(got.fillna(-1), "node", "g", "match_ts", "match_value") == [
        (1, 100, 100, 1.0), (1, 120, -1, -1.0), (1, 185, 200, 2.0), (1, 315, 300, 4.0), (1, 321, -1, -1.0), (2, 100, -1, -1.0),
    ]
    near = windows.asof_match(grid, readings, node="node", at="g", ts="ts", value="value", tolerance_ms=20, direction="nearest")
    assert (1, 120, 100) in rows(near.fillna(-1), "node", "g", "match_ts")


@pytest.mark.parametrize("direction", ["forward", "nearest"])
@pytest.mark.parametrize("tolerance", [0, 1, 7, 60])
def test_asof_equals_brute_force(spark, direction, tolerance):
    """Ties, repeated times and points, nodes without readings or without a name, negative times; no join in the plan."""
    rng = np.random.default_rng(tolerance)
    readings = [(int(n), int(t), float(v)) for n, t, v in zip(rng.choice([1, 1, 1, 2, 3], 300), rng.integers(-200, 1500, 300), rng.integers(0, 9, 300))] + [(None, 50, 1.0), (1, None, 1.0)]
    grid = [(i, int(n), int(t)) for i, (n, t) in enumerate(zip(rng.choice([1, 1, 2, 4], 400), rng.integers(-300, 1700, 400)))] + [(400, None, 50), (401, 1, None), (402, 1, 5), (402, 1, 5)]
    g = spark.createDataFrame(grid, "id int, node int, at bigint")
    r = spark.createDataFrame(readings, "node int, ts bigint, value double")
    made = windows.asof_match(g, r, node="node", at="at", ts="ts", value="value", tolerance_ms=tolerance, direction=direction)
    assert made.columns == ["id", "node", "at", "match_ts", "match_value"]
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, n, t in grid:
        mine = [x for x in readings if x[0] == n and n is not None and t is not None and x[1] is not None]
        near = [x for x in mine if abs(x[1] - t) <= tolerance]
        hit = None
        if direction == "nearest":
            hit = min(near, key=lambda x: (abs(x[1] - t), x[1], x[2]), default=None)
        else:
            hit = min((x for x in near if x[1] >= t), key=lambda x: x[1:], default=None)
            if hit is None and mine and max(x[1] for x in mine) < t:
                hit = max(near, key=lambda x: x[1:], default=None)
        want.append((i, n, t, *(hit[1:] if hit else (None, None))))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)


def test_asof_meets_no_more_rows_than_there_are(spark):
    """A thousand readings and a thousand points within one tolerance: the merge has their sum, not their product."""
    g = spark.range(1000).select(F.lit(1).alias("node"), (F.col("id") * 2).alias("at"))
    r = spark.range(1000).select(F.lit(1).alias("node"), (F.col("id") * 2 + 1).alias("ts"), F.col("id").cast("double").alias("value"))
    made = windows.asof_match(g, r, node="node", at="at", ts="ts", value="value", tolerance_ms=10_000)
    out = made.collect()
    assert len(out) == 1000 and all(x.match_ts == x["at"] + 1 for x in out)
    plan = made._jdf.queryExecution().executedPlan()
    seen = []

    def walk(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            seen.append(metrics.apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    assert seen and max(seen) <= 2000 + 10


def test_idle_gap_drops_the_first_job_of_a_node(spark):
    hour = 3600
    jobs = spark.createDataFrame([(1, 5, 0, 5 * hour), (2, 5, 9 * hour, 14 * hour), (3, 5, 15 * hour, 30 * hour), (4, 6, 0, 9 * hour)], "job int, node int, s bigint, e bigint")
    jobs = jobs.select("job", "node", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    prev = windows.previous_on_node(jobs, node="node", start="s", end="e", job="job", chunk=F.date_trunc("hour", "s"))
    assert rows(windows.idle_before(prev, start="s", end="e", min_idle_s=3 * hour, min_length_s=4 * hour), "job") == [(2,)]


def test_lagged_correlation_skips_flat_and_sparse_matches(spark):
    data = [(1, 0, k, float(k), 10 * k, 2.0 * k) for k in range(5)] + [(2, 0, k, float(k), 10 * k, 7.0) for k in range(5)]
    data += [(3, 0, k, float(k), None if k else 1, None if k else 1.0) for k in range(5)]
    m = spark.createDataFrame(data, "id int, shift_ms bigint, k int, sample double, match_ts bigint, match_value double")
    got = windows.lagged_correlation(m, ids=["id"]).collect()
    assert [r.id for r in got] == [1] and abs(got[0]["corr"] - 1) < 1e-12


def test_keep_first_and_reconcile(spark):
    d = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, 1, "only")], "k int, o int, x string")
    assert rows(windows.keep_first(d, ["k"], ["o"]), "k", "x") == [(1, "first"), (2, "only")]
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, s bigint").select("k", F.timestamp_seconds("s").alias("t"))
    b = spark.createDataFrame([(1, 10), (2, 17), (3, 0)], "k int, s bigint").select("k", F.timestamp_seconds("s").alias("t"))
    r = windows.reconcile(a, b, "k", ["t"]).first()
    assert (r.matched, r.max_diff_t) == (2, 3.0)


def test_multiset_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(checks.multiset_difference(a, b), "x", "side", "n") == [(1, "left", 1), (2, "left", 1), (3, "right", 1)]
    assert checks.multiset_difference(a, a).count() == 0


def test_array_std_and_rounding(spark):
    d = spark.createDataFrame([([1.0, 3.0, 100.0],), ([],), ([5.0],)], "a array<double>")
    assert [r[0] for r in d.select(C.prefix_stddev_pop("a", 2)).collect()] == [1.0, None, 0.0]
    one = spark.range(1).select(C.half_even(F.lit(0.5)), C.half_even(F.lit(1.5)), C.floor_div(F.lit(-1), 1000)).first()
    assert tuple(one) == (0.0, 2.0, -1)
    f = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "x double").select(C.finite("x")).collect()
    assert [r[0] for r in f] == [True, False, False, False]


def test_asof_tasks_follow_the_counted_rows(spark, monkeypatch):
    from tidegauge.operators import ordering

    monkeypatch.setattr(ordering, "TASK_ROWS", 10)
    readings = spark.range(500).selectExpr("id % 7 AS node", "id * 10 AS ts", "CAST(id AS DOUBLE) AS value")
    grid = spark.range(100).selectExpr("id % 7 AS node", "id * 31 AS at")
    out = windows.asof_match(grid, readings, node="node", at="at", ts="ts", value="value", tolerance_ms=100)
    assert out.rdd.getNumPartitions() == 160
    rows = {r["node"]: [] for r in readings.collect()}
    for r in readings.collect():
        rows[r["node"]].append(r.ts)
    for r in out.collect():
        ahead = [t for t in rows[r.node] if r["at"] <= t <= r["at"] + 100]
        assert r.match_ts == min(ahead, default=None)


def test_asof_deals_only_readings_of_nodes_with_points_from_short_files(spark, monkeypatch):
    """One node of fifty has points: the others' readings are not sent, and the rest stands in files of few rows."""
    monkeypatch.setattr(windows, "FILE_ROWS", 25, raising=False)
    written = []
    write = session.materialize
    monkeypatch.setattr(windows, "materialize", lambda df, name, **more: written.append((name, write(df, name, **more))) or written[-1][1], raising=False)
    r = spark.range(5000).select((F.col("id") % 50).alias("node"), F.col("id").alias("ts"), F.col("id").cast("double").alias("value")).coalesce(1)
    g = spark.range(100).select(F.lit(7).cast("bigint").alias("node"), (F.col("id") * 50).alias("at"))
    got = windows.asof_match(g, r, node="node", at="at", ts="ts", value="value", tolerance_ms=60).collect()
    assert len(got) == 100 and all(x.match_ts == x["at"] + 7 for x in got)
    kept = dict(written)["asof-readings"]
    assert kept.count() == 100 and len(kept.inputFiles()) == 4
