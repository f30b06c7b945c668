import math

import numpy as np
import pytest

from tidegauge.operators import completeness, inventory
from tidegauge.session import materialize


def test_inventory_traits(spark):
    # channel a: 20 s beat with a repeated time, a gap beyond the last bin and a NaN; channel z: constant
    times = [0, 20, 20, 40, 60, 60 + 5000]
    values = [1.0, 2.0, 2.0, math.nan, 5.0, 4.0]
    data = [("a", 1, t * 1000, v) for t, v in zip(times, values)] + [("z", 1, t * 1000, 0.0) for t in (0, 10, 30)]
    df = spark.createDataFrame(data, "channel string, node int, ts_ms bigint, value double")
    for chunk in (15_000, 10**9):
        got = {r.channel: r for r in inventory.channel_inventory(df, channel="channel", node="node", ts_ms="ts_ms", value="value", chunk_ms=chunk).collect()}
        a, z = got["a"], got["z"]
        assert (a.rows, a.nodes, a.cadence_s, a.median_interval_s) == (6, 1, 20, 20)
        assert (a.rises, a.falls, a.vmin, a.vmax) == (1, 1, 1.0, 5.0)
        assert a.share_at_cadence == pytest.approx(3 / 5) and not a.cumulative and not a.constant
        assert z.constant and z.rises_share is None and not z.cumulative and z.zero_share == 1.0
        assert z.cadence_s == 10  # 10 s and 20 s once each: the smaller wins


def test_interval_histogram_ends(spark):
    df = spark.createDataFrame([("a", 1, t, 1.0) for t in (0, 0, 3_599_999, 7_199_999, 99_999_999)], "channel string, node int, ts_ms bigint, value double")
    for chunk in (1000, 10**12):
        cells, nodes = inventory.interval_cells(df, channel="channel", node="node", ts_ms="ts_ms", value="value", max_interval_s=3600, chunk_ms=chunk)
        hist = inventory.interval_histogram(cells, channel="channel")
        assert sorted((r.interval_s, r.n) for r in hist.collect()) == [(0, 1), (3599, 1), (3600, 2)]
        assert nodes.first().nodes == 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_states_of_months_merge_to_the_whole(spark, seed):
    """Cuts anywhere, also inside chunks; nodes that are silent in a month; single readings; repeated times."""
    rng = np.random.default_rng(seed)
    n = 400
    rows = [(str(c), int(k), int(t), None if v == 0 else float(v)) for c, k, t, v in zip(rng.choice(["a", "b"], n), rng.choice([1, 1, 1, 2, 3], n), np.sort(rng.integers(0, 90_000, n)) * 100, rng.integers(0, 5, n))]
    df = spark.createDataFrame(rows, "channel string, node int, ts_ms bigint, value double")
    names = {"channel": "channel", "node": "node", "ts_ms": "ts_ms", "value": "value", "max_interval_s": 300}
    cuts = [-1, *sorted(int(x) for x in rng.integers(0, 9_000_000, 3)), 10**9]
    states = None
    for lo, hi in zip(cuts, cuts[1:]):
        part = inventory.interval_state(df.filter((df.ts_ms > lo) & (df.ts_ms <= hi)), **names, chunk_ms=1_000_000)
        states = part if states is None else states.unionByName(part)
    got, got_nodes = inventory.merge_states(materialize(states, "states"), **names)
    want, want_nodes = inventory.interval_cells(df, **names, chunk_ms=1_000_000)
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    # a reading behind a cut counts among those without a predecessor; pairs and totals are the same
    assert order(inventory.interval_histogram(got, channel="channel").filter("n > 0")) == order(inventory.interval_histogram(want, channel="channel").filter("n > 0"))
    whole = lambda cells, nodes: order(inventory.inventory_of(cells, nodes, channel="channel", max_interval_s=300))
    assert whole(got, got_nodes) == whole(want, want_nodes)


#: published figures of a 19-channel inventory: channel -> (cadence, source)
BEATS = {
    "mem_total": (60, "ganglia"), "mem_free": (40, "ganglia"), "mem_cached": (40, "ganglia"), "mem_buffers": (40, "ganglia"), "swap_free": (40, "ganglia"),
    "cpu_wio": (90, "ganglia"), "proc_run": (80, "ganglia"), "load_one": (90, "ganglia"), "total_power": (20, "IPMI"), "ambient": (20, "IPMI"),
}


def test_group_cadence_strings(spark):
    inv = spark.createDataFrame([(c, s, b) for c, (b, s) in BEATS.items()], "channel string, source string, cadence_s bigint")
    groups = {"mem_active": ["mem_total", "mem_free", "mem_cached", "mem_buffers"], "node_power": ["total_power"]}
    got = {r.group: r for r in inventory.metric_groups(inv, groups, channel="channel", source="source").collect()}
    assert got["mem_active"].cadence_s == "40/60" and got["mem_active"].source == "ganglia"
    assert got["mem_active"].channels == "mem_total, mem_free, mem_cached, mem_buffers"
    assert got["node_power"].cadence_s == "20"


@pytest.fixture(scope="module")
def small(spark):
    """Two channels (20 and 40 s, window 80 s), job 1 on two nodes (one silent in x), job 2 complete, job 3 silent."""
    counts = spark.createDataFrame([("x", 1, 10, 5), ("y", 1, 10, 2), ("y", 1, 11, 1), ("x", 2, 10, 4), ("y", 2, 10, 2)], "channel string, job_id int, node int, n bigint")
    wins = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "job_id int, node int")
    beats = spark.createDataFrame([("x", 20), ("y", 40)], "channel string, cadence_s int")
    fr = completeness.node_fractions(counts, beats, channel="channel", window_s=80)
    per_job = completeness.job_fractions(fr, completeness.nodes_per_job(wins, job="job_id"), job="job_id", channel="channel")
    return wins, fr, per_job


def test_fractions_cap_and_count_silent_nodes(small):
    _, _, per_job = small
    got = {(r.channel, r.job_id): r.frac for r in per_job.collect()}
    assert got == {("x", 1): 0.5, ("y", 1): 0.75, ("x", 2): 1.0, ("y", 2): 1.0}


def test_typical_delivery_ignores_silent_windows(small):
    got = {r.channel: r for r in completeness.typical_delivery(small[1], channel="channel").collect()}
    assert got["x"].median == 1.0 and got["y"].median == 1.0 and got["y"].p25 == 0.75 and got["y"].share_ge == pytest.approx(2 / 3)


def test_rules_and_flags(spark, small):
    wins, fr, per_job = small
    typical = completeness.typical_delivery(fr, channel="channel")
    thr = completeness.rule_thresholds(typical, {"R50": 0.5, "R80": 0.8, "R1": 1e-6}, channel="channel", relative={"Rrel": 0.8})
    members = completeness.rule_membership(per_job, thr, job="job_id", channel="channel")
    assert sorted((r.job_id, r.rule) for r in members.collect()) == [(1, "R1"), (1, "R50"), (2, "R1"), (2, "R50"), (2, "R80"), (2, "Rrel")]
    flags = completeness.completeness_table(
        wins.select("job_id").distinct(), per_job, members, job="job_id", channel="channel", channels=["x", "y"],
        rules={"R1": "complete", "R80": "complete_strict"}, sources={"first": ["x"], "both": ["x", "y"]},
    )
    got = {r.job_id: (r.frac_x, r.complete, r.complete_strict, r.has_first, r.has_both) for r in flags.collect()}
    assert got == {1: (0.5, 1, 0, 1, 1), 2: (1.0, 1, 1, 1, 1), 3: (0.0, 0, 0, 0, 0)}


@pytest.mark.parametrize("t1, strict, relative, want", [(True, 100, 5, "R80"), (False, 100, 100, "Rrel"), (False, 100, 99, "R1"), (True, 99, 100, "Rrel")])
def test_primary_rule_procedure(spark, t1, strict, relative, want):
    via = spark.createDataFrame([("R80", strict), ("Rrel", relative), ("R1", 124), ("R60", 103), ("R100", 21)], "rule string, min_block_pos bigint")
    t = spark.range(1).selectExpr(f"{str(t1).lower()} AS t1")
    got = {r.rule: r for r in completeness.choose_rule(via, t, floor=100, strict="R80", relative="Rrel", fallback="R1").collect()}
    assert {r.primary_rule for r in got.values()} == {want} and got[want].outcome == "primary"
    assert got["R60"].outcome == "not in procedure" and got["R100"].outcome == "fails T2"
