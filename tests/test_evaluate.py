import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bootstrap, evaluate


def ap_by_definition(y, score, w=None):
    """Step-wise area: thresholds are the distinct scores from the top."""
    y, score = np.asarray(y, float), np.asarray(score)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    pos, area, last = (w * y).sum(), 0.0, 0.0
    if pos == 0:
        return None
    for s in sorted(set(score), reverse=True):
        m = score >= s
        if (w * m).sum() == 0:
            continue
        recall = (w * y * m).sum() / pos
        area += (recall - last) * (w * y * m).sum() / (w * m).sum()
        last = recall
    return area


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    frames = []
    for k in range(6):
        n = int(rng.integers(50, 900))
        y = (rng.random(n) < rng.uniform(0.05, 0.4)).astype(int)
        frames.append(pd.DataFrame({"k": k, "y": y, "score": np.round(rng.random(n) + y * rng.random(), int(rng.integers(1, 4))), "w": rng.integers(0, 4, n), "u": rng.integers(0, 40, n)}))
    frames.append(pd.DataFrame({"k": 99, "y": 0, "score": [0.1, 0.2], "w": 1, "u": [1, 2]}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("weight", [None, "w"])
def test_average_precision_equals_the_definition(scored, weight):
    pdf, df = scored
    got = {r.k: r.ap for r in evaluate.average_precision(df, keys=["k"], y="y", score="score", weight=weight, name="ap").collect()}
    for k, g in pdf.groupby("k"):
        want = ap_by_definition(g.y, g.score, None if weight is None else g.w)
        assert got[k] is None if want is None else abs(got[k] - want) < 1e-12


def test_bootstrap_weights_move_users_together(spark):
    df = spark.createDataFrame([("t", 1), ("t", 1), ("t", 2), ("t", 3), ("t", 3), ("t", 3)], "k string, u int")
    w = bootstrap.bootstrap_weights(df, keys=["k"], cluster="u", n_boot=50, seed=0).toPandas()
    assert (w.groupby("b").weight.sum() == 3).all() and w.b.nunique() == 50 and not w.duplicated(["u", "b"]).any()


def test_weights_equal_the_draws_by_definition(spark):
    """Several keys, chunks that end inside a key, and weights that need two bytes."""
    sizes = {"a": 11, "b": 1, "c": 4}
    df = spark.createDataFrame([(k, u) for k, n in sizes.items() for u in range(n)], "k string, u int")
    got = bootstrap.bootstrap_weights(df, keys=["k"], cluster="u", n_boot=71, seed=3, chunk=4).collect()
    want = Counter()
    for k, n in sizes.items():
        for b in range(71):
            for i in range(n):
                h = hashlib.md5(f"3|{b // 4}|{i}".encode()).hexdigest()
                want[k, int(h[8 * (b % 4) : 8 * (b % 4) + 8], 16) * n >> 32, b] += 1
    assert {(r.k, r.u, r.b): r.weight for r in got} == want
    blobs = pa.array([np.array([1, 300, 2], "<u2").tobytes(), np.array([7, 8, 9], np.uint8).tobytes()])
    assert bootstrap.unpack_weights(blobs, 3).tolist() == [[1, 300, 2], [7, 8, 9]]


@pytest.mark.parametrize("cells, lane", [(3, 7), (25, 40), (1 << 14, 1 << 16)])
def test_bootstrap_average_precision_equals_brute_force(spark, scored, cells, lane):
    """Ranges and lanes of every size: scores hotter than a range, sets of one score, sets without positives."""
    pdf, _ = scored
    base = pdf[pdf.k.isin([0, 99])].copy()
    sets = pd.concat([base.assign(fs="B0"), base.assign(fs="g", score=np.round(base.score * 7 % 1, 1)), base.assign(fs="one", score=0.5)])
    df = spark.createDataFrame(sets)
    got = bootstrap.average_precision(df, test_keys=["k"], set_keys=["fs"], y="y", score="score", cluster="u", n_boot=25, seed=5, cells=cells, lane=lane).toPandas()
    w = bootstrap.bootstrap_weights(df, keys=["k"], cluster="u", n_boot=25, seed=5).toPandas().set_index(["k", "u", "b"]).weight.to_dict()
    assert len(got) == 2 * 3 * 25
    for r in got.itertuples():
        g = sets[(sets.k == r.k) & (sets.fs == r.fs)]
        want = ap_by_definition(g.y, g.score, [w.get((r.k, u, r.b), 0) for u in g.u])
        assert (pd.isna(r.ap) and want is None) or abs(r.ap - want) < 1e-9


def test_ranges_and_lanes_keep_their_bounds(spark):
    """The number of ranges follows the cells; a score with half of them is split; a lane has few cells too many."""
    rng = np.random.default_rng(2)
    n = 6000
    pdf = pd.DataFrame({"t": np.where(np.arange(n) < 5000, "x", "y"), "fs": rng.choice(["a", "b"], n), "score": np.where(rng.random(n) < 0.5, 7.0, np.round(rng.random(n), 3)), "slot": np.arange(n), "__p": 1, "__q": 0})
    cells = spark.createDataFrame(pdf)
    placed = bootstrap.placed_cells(cells, test_keys=["t"], set_keys=["fs"], score="score", limit=100, lane=400).toPandas()
    assert len(placed) == n
    units = placed.groupby(["t", "fs", "__part", "__sub"])
    assert units.size().max() <= 200 and len(units) > 50
    assert (placed.groupby(["t", "fs", "score"])["__part"].nunique() == 1).all()
    for _, g in placed.groupby(["t", "fs"]):  # ranges are in the order of falling scores
        edges = g.groupby("__part").score.agg(["min", "max"]).sort_index()
        assert (edges["min"].to_numpy()[:-1] > edges["max"].to_numpy()[1:]).all()
    lanes = placed.groupby(["t", "__lane"]).size()
    assert lanes.max() <= 400 + 200
    assert bootstrap.lane_bytes(bootstrap.LANE + 2 * bootstrap.CELLS, 2 * bootstrap.CELLS, 1000) < 320 << 20


def test_a_lane_holds_what_the_formula_says(spark):
    import tracemalloc

    rng = np.random.default_rng(0)
    n, n_boot = 4000, 1000
    left = pa.table({"fs": ["a"] * n, "score": rng.random(n), "__part": np.zeros(n, np.int64), "__sub": np.zeros(n, np.int32), "slot": np.arange(n), "__p": np.ones(n, np.int64), "__q": np.ones(n, np.int64)})
    right = pa.table({"slot": np.arange(n), "w": [rng.poisson(1, n_boot).astype(np.uint8).tobytes() for _ in range(n)], "b0": pa.nulls(n, pa.int32())})
    tracemalloc.start()
    out = bootstrap._lane(left, right, ["fs"], "score", n_boot, True, ["fs", "__part"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n_boot // bootstrap.SLICE
    # the strings of bytes stand beside the matrix while it is made
    assert peak <= bootstrap.lane_bytes(n, n, n_boot) + n * n_boot


def test_paired_gain_of_a_copy_is_zero(spark, scored):
    pdf, _ = scored
    g = pdf[pdf.k == 1]
    df = spark.createDataFrame(pd.concat([g.assign(fs="B0"), g.assign(fs="same"), g.assign(fs="best", score=g.y.astype(float))])).withColumn("m", F.lit("HGB"))
    got = {r.fs: r for r in evaluate.paired_gains(df, test_keys=["k"], set_keys=["m", "fs"], set_col="fs", baseline="B0", y="y", score="score", cluster="u", n_boot=40, seed=1).collect()}
    same = got["same"]
    assert (same.delta, same.ci_low, same.ci_high) == pytest.approx((0.0, 0.0, 0.0), abs=1e-12) and same.p == 1.0
    assert got["best"].delta > 0 and got["best"].ci_low > 0 and got["best"].p == 0.0 and got["best"].resamples == 40


def test_pooled_and_queue_tags(spark):
    df = spark.createDataFrame([("main", "1"), ("main", "5"), ("block1", "1"), ("block2", "1")], "split string, qos string")
    p = evaluate.pooled(df, split="split", parts=["block1", "block2", "block3"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in p} == {"main": 2, "block1": 1, "block2": 1, "pooled": 2}
    q = evaluate.subset_tags(df, split="split", main="main", queue="qos", queues=["1", "11"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in q} == {"main": 2, "block1": 1, "block2": 1, "queue 1": 1}


def test_weight_sums_and_blocks_of_draws(spark, monkeypatch):
    """Sums per cluster equal those of the single weights, with a NULL key; draws made in several blocks and pieces are those of md5."""
    df = spark.createDataFrame([("a", u) for u in range(9)] + [(None, u) for u in range(3)], "k string, u int")
    args = dict(keys=["k"], cluster="u", n_boot=30, seed=3)
    want = {}
    for r in bootstrap.bootstrap_weights(df, **args).collect():
        d, n, m, c = want.get((r.k, r.u), (0, 0, 0, 0))
        want[r.k, r.u] = (d + r.weight, n + 1, max(m, r.weight), c + r.weight**2 * (r.b + 1))
    got = {(r.k, r.u): (r.draws, r.resamples, r.most, r.checksum) for r in bootstrap.weight_sums(df, **args).collect()}
    assert got == want and len(got) == 12
    monkeypatch.setattr(bootstrap, "BLOCK", 50)
    monkeypatch.setattr(bootstrap, "PIECE", 7)
    n, size, found = 120, 32, Counter()
    units = pa.RecordBatch.from_pydict({"k": ["x"] * 3, "clusters": [n] * 3, "q": [2] * 3, "block": [0, 1, 2]})
    for batch in bootstrap._drawn(iter([units]), ["k"], 11, 3, size):
        for chunk, q, draws in zip(*(batch.column(c).to_pylist() for c in ("chunk", "q", "draws"))):
            found.update((chunk * size + int(p) // 4, 4 * q + int(p) % 4) for p in np.frombuffer(draws, "<u2"))
    made = Counter()
    for i in range(n):
        h = hashlib.md5(f"3|2|{i}".encode()).hexdigest()
        made.update((int(h[8 * r : 8 * r + 8], 16) * n >> 32, 8 + r) for r in range(3))
    assert found == made


@pytest.mark.parametrize("tied, wide, fan, cells, lane", [(0, 5, 2, 3, 7), (0, 1 << 15, 64, 3, 7), (4, 1 << 15, 64, 3, 7), (1e9, 5, 2, 3, 7)])
def test_areas_by_blocks_and_by_lanes_are_the_same(spark, scored, tied, wide, fan, cells, lane):
    """Every set by blocks (many blocks, several rounds of adding), some of them, none; counts above one, a NULL key."""
    pdf, _ = scored
    base = pd.concat([pdf[pdf.k.isin([0, 99])], pdf[pdf.k == 0]])
    sets = pd.concat([base.assign(fs="B0"), base.assign(fs="g", score=np.round(base.score * 7 % 1, 1)), base.assign(fs=None, score=0.5)])
    df = spark.createDataFrame(sets[["k", "u", "y", "score", "fs"]], "k long, u long, y double, score double, fs string")
    got = bootstrap.average_precision(
        df, test_keys=["k"], set_keys=["fs"], y="y", score="score", cluster="u", n_boot=130, seed=5, cells=cells, lane=lane, tied=tied, wide=wide, fan=fan
    ).collect()
    w = {(r.k, r.u, r.b): r.weight for r in bootstrap.bootstrap_weights(df, keys=["k"], cluster="u", n_boot=130, seed=5).collect()}
    assert len(got) == 2 * 3 * 130
    for r in got[::7]:
        g = sets[(sets.k == r.k) & (sets.fs.isna() if r.fs is None else sets.fs == r.fs)]
        want = ap_by_definition(g.y, g.score, [w.get((r.k, u, r.b), 0) for u in g.u])
        assert r.ap is None and want is None or abs(r.ap - want) < 1e-9


def test_users_are_counted_by_tasks_of_counted_rows(spark, scored):
    pdf, df = scored
    out = evaluate.performance(df, keys=["k"], y="y", score="score", user="u")
    assert "RepartitionByExpression [k" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.users for r in out.collect()} == pdf.groupby("k").u.nunique().to_dict()


@pytest.mark.parametrize("tied", [4, 1e9])
def test_an_array_of_scores_gives_what_a_row_per_set_gives(spark, scored, tied):
    """Some sets by blocks, none; gains, intervals and counted positives, too."""
    pdf, _ = scored
    base = pdf[pdf.k.isin([0, 99])]
    scores = [base.score, np.round(base.score * 7 % 1, 1), pd.Series(0.5, index=base.index)]
    sets = [("m", "B0"), ("m", "g"), ("n", "B0")]
    arrays = spark.createDataFrame(base[["k", "u", "y"]].assign(score=[list(map(float, s)) for s in zip(*scores)]), "k long, u long, y double, score array<double>")
    long = spark.createDataFrame(pd.concat([base[["k", "u", "y"]].assign(m=m, fs=fs, score=s) for (m, fs), s in zip(sets, scores)]))
    args = dict(test_keys=["k"], set_keys=["m", "fs"], y="y", score="score", cluster="u", n_boot=30, seed=5)
    key = lambda r: (r.k, r.m, r.fs, r.b)
    want = {key(r): r.ap for r in bootstrap.average_precision(long, **args, tied=1e9).collect()}
    got = {key(r): r.ap for r in bootstrap.average_precision(arrays, **args, sets=sets, tied=tied).collect()}
    assert len(want) == 2 * 3 * 30 and got.keys() == want.keys()
    assert all((got[r] is None and want[r] is None) or abs(got[r] - want[r]) < 1e-9 for r in want)
    if tied == 4:
        both = [evaluate.paired_gains(df, **args, set_col="fs", baseline="B0", **more) for df, more in ((long, {}), (arrays, {"sets": sets}))]
        a, b = (df.toPandas().sort_values(["k", "m", "fs"]).reset_index(drop=True) for df in both)
        assert len(a) == 1  # the other test has no positives
        pd.testing.assert_frame_equal(a, b)


def test_cells_are_packed_by_set_and_block_and_large_clusters_are_added_up(monkeypatch):
    rng = np.random.default_rng(3)
    n = 5000
    slot = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 90, n))
    scores, y = rng.integers(0, 6, (n, 2)).astype(float), rng.integers(0, 2, n)
    lots = [[40, None] if s % 2 else [40, 41] for s in slot]
    rows = pa.table({"slot": slot, "__p": pa.array(y, pa.int32()), "__q": pa.array(1 - y, pa.int32()), "__first": np.full(n, 10), "__lots": pa.array(lots, pa.list_(pa.int64())), "__scores": scores.tolist()})
    want = Counter()
    for s, c, label, own in zip(slot, scores, y, lots):
        for place, (score, lot) in enumerate(zip(c, own)):
            if lot is not None:
                want[lot, s // 20, 10 + place, int(bootstrap._falling(np.array([score]))[0]), s, label] += 1
    for hot in (1 << 12, 100):
        monkeypatch.setattr(bootstrap, "HOT", hot)
        got, sent = Counter(), 0
        for batch in bootstrap._packed_cells(iter(rows.to_batches(max_chunksize=700)), 20):
            for lot, block, number, blob in zip(*(batch.column(c).to_pylist() for c in ("__lot", "__block", "__set", "cells"))):
                for c in np.frombuffer(blob, bootstrap._CELL):
                    sent += int(c["slot"] == 7)
                    for label, name in ((1, "p"), (0, "q")):
                        got[lot, block, number, int(c["key"]), int(c["slot"]), label] += int(c[name])
        assert +got == want
        assert (sent <= 6) == (hot == 100)  # one set, six scores


def test_scores_keep_their_order_as_numbers():
    values = np.array([np.nan, np.inf, 1e300, 2.5, 0.0, -0.0, -2.5, -np.inf])
    keys = bootstrap._falling(values)
    assert (np.diff(keys) >= 0).all() and len(np.unique(keys)) == 7 and keys[4] == keys[5]
    big = np.array([2**62 + 1, 2**62, 0, -5])
    assert (np.diff(bootstrap._falling(big)) > 0).all()


@pytest.mark.parametrize("dense, clusters", [(4, 120), (0, 120), (4, 3)])
def test_a_block_counts_the_draws_that_are_sent_to_it(monkeypatch, dense, clusters):
    """As counts of half a byte, as draws, and where counts pass 15; several blocks of draws, a last quad of three."""
    monkeypatch.setattr(bootstrap, "BLOCK", 50)
    monkeypatch.setattr(bootstrap, "DENSE", dense)
    n_boot, size, seed = 11, 32, 3
    units = [(q, block) for q in range(3) for block in range(-(-clusters // 50))]
    if clusters == 3:  # the same words for many slots: every draw falls on one slot
        monkeypatch.setattr(bootstrap, "_quad_words", lambda seed, q, first, count: np.zeros((4, count), np.uint32))
        clusters, units = 40, [(q, 0) for q in range(3)]
    table = pa.RecordBatch.from_pydict({"k": ["x"] * len(units), "clusters": [clusters] * len(units), "q": [u[0] for u in units], "block": [u[1] for u in units]})
    sent = pa.Table.from_batches(list(bootstrap._dealt(iter([table]), ["k"], n_boot, seed, size)))
    assert set(sent.column("dense").to_pylist()) == ({False} if clusters == 40 or not dense else {True} if clusters % 50 == 0 else {True, False})
    want = np.zeros((-(-clusters // size) * size, n_boot), int)
    for b in range(n_boot):
        for i in range(clusters):
            h = hashlib.md5(f"{seed}|{b // 4}|{i}".encode()).hexdigest() if clusters != 40 else "0" * 32
            want[int(h[8 * (b % 4) : 8 * (b % 4) + 8], 16) * clusters >> 32, b] += 1
    for chunk in range(-(-clusters // size)):
        own = sent.filter(pa.array([c == chunk for c in sent.column("chunk").to_pylist()]))
        got = bootstrap._block_weights(own, n_boot, size)
        assert got.shape == (size + 1, 16) and not got[size].any() and not got[:, n_boot:].any()
        assert (got[:size, :n_boot] == want[chunk * size : (chunk + 1) * size]).all()


def test_coarser_sets_are_added_up_from_finer_ones(monkeypatch):
    """Three steps of one score are gathered once; a set of other rows or another order is gathered for itself."""
    rng = np.random.default_rng(4)
    n, n_boot, size = 3000, 21, 64
    slot, y = rng.integers(0, size, n) + 2 * size, rng.integers(0, 2, n)
    fine, other = rng.integers(0, 50, n), rng.integers(0, 9, n)
    scores = {5: fine, 6: fine // 3, 7: fine // 7, 8: other, 9: 20 - other}
    counts = rng.poisson(1, (6, 4, size)).astype(np.uint8)
    sent = pa.table({"q": np.arange(6), "dense": [True] * 6, "draws": pa.array([(c[0::2] | c[1::2] << 4).tobytes() for c in counts], pa.binary())})
    number, blobs, want = [], [], {}
    w = counts.reshape(24, size)[:n_boot].T.astype(int)
    for s, score in scores.items():
        for a in range(0, n, 700):
            cells = np.zeros(len(slot[a : a + 700]), bootstrap._CELL)
            cells["key"], cells["slot"], cells["p"], cells["q"] = bootstrap._falling(score[a : a + 700].astype(float)), slot[a : a + 700], y[a : a + 700], 1 - y[a : a + 700]
            if s == 6:  # a merged cell counts for more than one row
                cells["p"] *= 3
            number.append(s)
            blobs.append(cells.tobytes())
        for v in np.unique(score):
            rows = score == v
            times = 3 if s == 6 else 1
            want[s, int(bootstrap._falling(np.array([float(v)]))[0])] = ((w[slot[rows] - 2 * size] * (times * y[rows])[:, None]).sum(axis=0), (w[slot[rows] - 2 * size] * (1 - y[rows])[:, None]).sum(axis=0))
    calls, sums = [], bootstrap._level_sums
    monkeypatch.setattr(bootstrap, "_level_sums", lambda *args: calls.append(args[4]) or sums(*args))
    left = pa.table({"__block": np.full(len(number), 2), "__set": number, "cells": pa.array(blobs, pa.binary())})
    out = bootstrap._block_sums(left, sent, n_boot, size, 64)
    assert sorted(calls) == [9, 9, 17, 17, 50, 50]  # 7 comes from 5, 9 from 8; 6 has other counts
    got = {}
    for r in out.to_pylist():
        keys = np.frombuffer(r["keys"], "<i8")
        tp, fp = (np.frombuffer(r[c], f"<u{len(r[c]) // (len(keys) * r['width'])}").reshape(len(keys), -1) for c in ("tp", "fp"))
        got.update({(r["__set"], int(k)): (p, q) for k, p, q in zip(keys, tp, fp)})
    assert got.keys() == want.keys() and all((got[k][0] == want[k][0]).all() and (got[k][1] == want[k][1]).all() for k in want)


def test_sets_by_blocks_write_no_weights(spark, scored, monkeypatch):
    pdf, _ = scored
    df = spark.createDataFrame(pdf[pdf.k == 0].assign(fs="B0"))
    written, write = [], bootstrap.materialize
    monkeypatch.setattr(bootstrap, "materialize", lambda df, name, **more: written.append(name) or write(df, name, **more))
    bootstrap.average_precision(df, test_keys=["k"], set_keys=["fs"], y="y", score="score", cluster="u", n_boot=5, seed=5, tied=0)
    assert "bootstrap-vectors" not in written and "bootstrap-lots" in written


def test_scores_of_arrays_are_added_up_before_they_are_sent(spark, monkeypatch):
    """No row is made per place; several flushes, NULL and NaN keys and scores, both zeros, a NULL label, no row at all."""
    monkeypatch.setattr(evaluate, "HELD", 7)
    nan = float("nan")
    data = [(k, [0.0 if i % 2 else -0.0, float(i % 3), None if i % 5 == 0 else nan], [1.0, 0.0, None][i % 3], 0.5 + i % 2) for i in range(40) for k in ("a", None)]
    df = spark.createDataFrame(data, "k string, score array<double>, y double, w double").coalesce(2)
    sets = [("m", "x"), ("m", "z"), ("n", "x")]
    for weight in (None, "w"):
        args = dict(keys=["k", "model", "fs"], y="y", score="score", weight=weight)
        got = evaluate.score_cells(df, **args, set_keys=["model", "fs"], sets=sets)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = evaluate.score_cells(bootstrap.unfolded(df, set_keys=["model", "fs"], score="score", sets=sets), **args)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 2 * 6
    assert evaluate.score_cells(df.filter("k = 'none'"), **args, set_keys=["model", "fs"], sets=sets).count() == 0


def array_rows(n, low, high, slots, seed=6, first=10, lots=(40, None, 41)):
    rng = np.random.default_rng(seed)
    slot, y, scores = rng.integers(0, slots, n), rng.integers(0, 2, n), rng.integers(low, high, (n, 3)).astype(float)
    slot = np.where(rng.random(n) < 0.3, 7, slot)
    columns = {"slot": slot, "__p": pa.array(y, pa.int32()), "__q": pa.array(1 - y, pa.int32()), "__first": np.full(n, first)}
    return pa.table({**columns, "__lots": pa.array([list(lots)] * n, pa.list_(pa.int64())), "__scores": scores.tolist()})


@pytest.mark.parametrize("hot, odd", [(1 << 12, None), (100, None), (1 << 12, 0.5), (1 << 12, 1e6), (1 << 12, float("nan"))])
def test_rows_are_packed_once_for_all_sets(monkeypatch, hot, odd):
    """The same cells as a cell per set gives, in less than a third of the bytes where scores are whole and small."""
    rows = array_rows(4000, -5, 9, 90)
    if odd is not None:
        scores = rows.column("__scores").to_pylist()
        scores[5][0] = odd
        rows = rows.set_column(rows.schema.get_field_index("__scores"), "__scores", pa.array(scores))
    monkeypatch.setattr(bootstrap, "HOT", hot)
    want, got, size = Counter(), Counter(), [0, 0]
    for batch in bootstrap._packed_cells(iter(rows.to_batches(max_chunksize=700)), 20):
        for lot, block, number, blob in zip(*(batch.column(c).to_pylist() for c in ("__lot", "__block", "__set", "cells"))):
            size[0] += len(blob)
            for c in np.frombuffer(blob, bootstrap._CELL).tolist():
                want[lot, block, number, c[0], c[1], 1] += c[2]
                want[lot, block, number, c[0], c[1], 0] += c[3]
    packed = pa.Table.from_batches(list(bootstrap._packed_rows(iter(rows.to_batches(max_chunksize=700)), 20)))
    for lot, block in set(zip(*(packed.column(c).to_pylist() for c in ("__lot", "__block")))):
        own = packed.filter(pa.array([a == (lot, block) for a in zip(*(packed.column(c).to_pylist() for c in ("__lot", "__block")))]))
        for number, cells, keys, code in bootstrap._sets_of(own):
            assert (np.diff(keys) > 0).all()
            for (slot, p, q), key in zip(cells.tolist(), keys[code].tolist()):
                got[lot, block, number, key, slot, 1] += p
                got[lot, block, number, key, slot, 0] += q
    assert +got == +want and {k[2] for k in got} == {10, 12}
    size[1] = sum(len(x or b"") for c in ("cells", "scores") for x in packed.column(c).to_pylist())
    if odd is None and hot > 100:
        assert size[1] <= 4000 * 2 * (12 + 2) < size[0]


def test_rows_of_a_test_need_equally_many_scores():
    rows = array_rows(3, 0, 5, 4)
    rows = rows.set_column(rows.schema.get_field_index("__scores"), "__scores", pa.array([[1.0, 2.0, 3.0], [1.0], [1.0, 2.0, 3.0]]))
    with pytest.raises(ValueError, match="different numbers of scores"):
        list(bootstrap._packed_rows(iter(rows.to_batches()), 20))


def test_near_blocks_are_added_up_before_they_are_sent():
    rows = array_rows(4000, 0, 30, 96, lots=(40, 40, 40))
    left = pa.Table.from_batches(list(bootstrap._packed_rows(iter(rows.to_batches()), 32)))
    counts = np.random.default_rng(1).poisson(1, (3, 40, 4, 32)).astype(np.uint8)
    right = pa.table({"__block": np.repeat(np.arange(3), 40), "q": np.tile(np.arange(40), 3), "dense": [True] * 120, "draws": pa.array([(c[0::2] | c[1::2] << 4).tobytes() for b in counts for c in b], pa.binary())})
    near = bootstrap._near_sums(left, right, 157, 32, 64)
    assert near.num_rows == 3 * 2  # a row per set and slice, not per block
    w = counts.reshape(3, 160, 32).transpose(0, 2, 1).reshape(96, 160)[:, :157].astype(int)
    slot, label, score = rows.column("slot").to_numpy(), rows.column("__p").to_numpy(), np.array(rows.column("__scores").to_pylist())
    for r in near.to_pylist():
        keys = np.frombuffer(r["keys"], "<i8")
        own = score[:, r["__set"] - 10]
        for c, y in (("tp", label), ("fp", 1 - label)):
            sums = np.frombuffer(r[c], f"<u{len(r[c]) // (len(keys) * r['width'])}").reshape(len(keys), -1)
            want = [(w[slot[own == v]] * y[own == v][:, None]).sum(axis=0) for v in np.unique(own)[::-1]]
            assert (sums == np.array(want)[:, r["b0"] : r["b0"] + r["width"]]).all()


def test_whole_small_scores_of_arrays_are_counted(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(["a", None][i % 2], [float(x) for x in rng.integers(-40, 40, 3)], float(i % 3 == 0)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, score array<double>, y double").coalesce(1)
    args = dict(keys=["k", "fs"], y="y", score="score")
    sets = [("x",), ("z",), ("w",)]
    want = evaluate.score_cells(bootstrap.unfolded(df, set_keys=["fs"], score="score", sets=sets), **args).collect()
    got = evaluate.score_cells(df, **args, set_keys=["fs"], sets=sets).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    one = pa.array([[1.0, -2.0], [1.0, 5.0], [1.0, -2.0]])
    code, place, score, tp, fp = evaluate._counted_places(one, np.array([0, 0, 1]), pa.array([1.0, 0.0, 1.0]), pa.array([0.0, 1.0, 0.0]))
    assert list(zip(code.tolist(), *(x.to_pylist() for x in (place, score, tp, fp)))) == [(0, 0, 1.0, 1.0, 1.0), (1, 0, 1.0, 1.0, 0.0), (0, 1, -2.0, 1.0, 0.0), (0, 1, 5.0, 0.0, 1.0), (1, 1, -2.0, 1.0, 0.0)]
    for other in ([[1.0], [0.5]], [[1.0], [None]], [[1.0], [float("nan")]], [[1.0], [1e5]], [[1.0], [1.0, 2.0]], [[], []]):
        assert evaluate._counted_places(pa.array(other, pa.list_(pa.float64())), np.array([0, 0]), pa.array([1.0, 0.0]), pa.array([0.0, 1.0])) is None


def test_what_is_known_of_gains_is_not_made_again(spark, scored, monkeypatch):
    pdf, _ = scored
    rows = pdf[pdf.k == 0]
    df = spark.createDataFrame(pd.concat([rows.assign(fs="B0"), rows.assign(fs="g", score=-rows.score)]))
    args = dict(test_keys=["k"], set_keys=["fs"], set_col="fs", baseline="B0", y="y", score="score", cluster="u", n_boot=20, seed=1)
    want = evaluate.paired_gains(df, **args).collect()
    cells = evaluate.score_cells(df, keys=["k", "fs"], y="y", score="score").cache()
    known = dict(cells=cells, ap=evaluate.average_precision_of_cells(cells, keys=["k", "fs"], score="score", name="ap"), slots=bootstrap.indexed_clusters(df, keys=["k"], cluster="u"))
    written = []
    for module in (bootstrap, evaluate):
        monkeypatch.setattr(module, "materialize", lambda df, name, write=module.materialize, **more: written.append(name) or write(df, name, **more))
    got = evaluate.paired_gains(df, **args, **known).collect()
    assert not {"score-cells", "bootstrap-clusters"} & set(written) and "bootstrap-lots" in written
    assert sorted(map(repr, got)) == sorted(map(repr, want))
