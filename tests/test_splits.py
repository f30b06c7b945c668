import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import splits


def by_position(end, positive):
    """Row-position form of the same split: the oracle for the threshold form."""
    order = np.argsort(end, kind="stable")
    t, p = np.asarray(end)[order], np.asarray(positive)[order]

    def past_ties(times, i):
        return i if i == 0 or i >= len(times) else int(np.searchsorted(times, times[i - 1], side="right"))

    def halves(lo, hi):
        cut = past_ties(t[lo:hi], int(round(0.8 * (hi - lo))))
        return set(order[lo : lo + cut]), set(order[lo + cut : hi])

    run = np.cumsum(p)
    first = lambda share: past_ties(t, int(np.argmax(run >= share * run[-1] / 3)) + 1)
    edges = [0, first(1), first(2), len(t)]
    out = {"main": halves(0, len(t))}
    out.update({f"block{k + 1}": halves(edges[k], edges[k + 1]) for k in range(3)})
    return out


@pytest.fixture(scope="module")
def populations():
    rng = np.random.default_rng(11)
    frames = []
    for pop in range(12):
        n = int(rng.integers(5, 300))
        end = rng.integers(0, int(rng.integers(2, 60)), n) * 40_000
        frames.append(pd.DataFrame({"pop": pop, "id": np.arange(n), "end_s": end, "target_a": np.where(rng.random(n) < 0.3, 1.0, 0.0), "user": rng.integers(0, 9, n)}))
    return pd.concat(frames, ignore_index=True)


def test_threshold_form_equals_row_positions(spark, populations):
    df = spark.createDataFrame(populations).withColumn("end", F.timestamp_seconds("end_s"))
    got = splits.temporal_splits(df, population="pop", end="end", positive=F.col("target_a") == 1)
    got = got.select("pop", "split", "role", "id").toPandas()
    for pop, g in populations.groupby("pop"):
        want = by_position(g.end_s.to_numpy(), g.target_a.to_numpy())
        mine = got[got["pop"] == pop]
        for split, (train, test) in want.items():
            s = mine[mine.split == split]
            assert set(s[s.role == "train"].id) == train, (pop, split)
            assert set(s[s.role == "test"].id) == test, (pop, split)


def test_no_violations_and_detects_broken_splits(spark):
    rows = spark.range(200).select(F.lit("p").alias("pop"), "id", F.timestamp_seconds(F.col("id") * 5000).alias("end"), (F.col("id") % 3 == 0).cast("double").alias("target_a"))
    placed = splits.temporal_splits(rows, population="pop", end="end", positive=F.col("target_a") == 1)
    total = rows.groupBy("pop").agg(F.count("*").alias("jobs"))
    assert splits.split_violations(placed, population="pop", end="end", total=total).count() == 0
    broken = placed.filter("NOT (split = 'block1' AND id = 0)").withColumn("role", F.when((F.col("split") == "main") & (F.col("id") == 199), "train").otherwise(F.col("role")))
    found = {r.violation for r in splits.split_violations(broken, population="pop", end="end", total=total).collect()}
    assert found == {"main: train not before test", "blocks do not hold every row"}


def test_floors_per_queue(spark):
    d = spark.createDataFrame([("p", "main", "test", "1", 1.0)] * 3 + [("p", "main", "test", "7", 1.0)] + [("p", "main", "train", "1", 1.0)] * 9, "pop string, split string, role string, qos string, target_a double")
    pos = splits.positives_per_test(d, population="pop", queue="qos", queues=["1", "11"], targets={"target_a": "a"})
    got = {r.split: r.positives for r in pos.collect()}
    # sets without any row are listed: they are the ones most below the floor
    assert got == {"main": 4, "main, queue 1": 3, "main, queue 11": 0, "block1": 0, "block2": 0, "block3": 0}
    assert splits.below_floor(pos, 4).count() == 5


def test_every_asked_rule_has_a_row(spark):
    d = spark.createDataFrame([("R1", "main", "test", 1, 1.0)], "rule string, split string, role string, user int, target_a double")
    out = splits.rule_viability(d, rule="rule", user="user", targets={"target_a": "a"}, main="target_a", rules=["R1", "R50"])
    assert {r.rule: (r.jobs, r.min_block_pos) for r in out.collect()} == {"R1": (1, 0), "R50": (0, 0)}
