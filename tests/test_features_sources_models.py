import pytest
from pyspark.sql import functions as F

from tidegauge.operators import completeness, features, models
from tidegauge.operators.small import literal_table
from tidegauge.plans import settings
from tidegauge.plans.stages import analyses
from tidegauge.session import is_one_machine, scratch_path
from tidegauge.sources import tables


def test_two_level_mean_weights_nodes_equally(spark):
    data = [(1, "c", 10, 0, 100, 1.0), (1, "c", 10, 0, 150, 3.0), (1, "c", 11, 0, 199, 10.0), (1, "c", 10, 0, 20_100, 7.0), (1, "c", 10, 0, 20_200, float("nan"))]
    df = spark.createDataFrame(data, "job int, channel string, node int, t0 bigint, ts bigint, value double")
    got = features.window_series(df, job="job", channel="channel", node="node", ts="ts", t0="t0", value="value", cadence_s=20).collect()
    assert sorted((r.bin, r.value, r.ts, r.n_nodes) for r in got) == [(0, 6.0, 199, 2), (1, 7.0, 20_200, 1)]


def test_composed_group_needs_every_part(spark):
    s = [(1, "total", 0, 100.0), (1, "total", 1, 110.0), (1, "free", 0, 10.0), (1, "cached", 0, 20.0), (1, "free", 1, 10.0), (2, "free", 0, 1.0), (2, "cached", 0, 1.0)]
    df = spark.createDataFrame(s, "job int, channel string, bin bigint, value double")
    g = features.group_series(df, {"active": ["total", "free", "cached"], "pair": ["free", "cached"]}, job="job", channel="channel", composed={"active": ("total", ["free", "cached"])})
    wide = {r.job: r for r in features.wide_stats(features.group_stats(g, job="job"), ["active", "pair"], job="job").collect()}
    assert (wide[1].active__mean, wide[1].active__std, wide[1].pair__mean, wide[1].pair__std) == (75.0, 0.0, 12.5, 2.5)
    assert wide[2].active__mean is None and wide[2].pair__mean == 1.0


def test_placebo_moves_the_four_columns_together(spark):
    df = spark.range(300).select(F.col("id").alias("job"), *[(F.col("id") * m).cast("double").alias(f"g__{s}") for m, s in enumerate(features.STATS, 1)])
    got = features.placebos(df, key="job", groups=["g"], count=2, seed=42, name="p").toPandas().sort_values("job")
    for k in ("00", "01"):
        assert sorted(got[f"p{k}__min"]) == [float(i) for i in range(300)]
        assert (got[f"p{k}__std"] == 4 * got[f"p{k}__min"]).all()
        assert (got[f"p{k}__min"] == got.job).mean() < 0.05
    assert (got["p00__min"] != got["p01__min"]).mean() > 0.9


def test_request_columns_sort_categories_as_numbers(spark):
    df = spark.createDataFrame([("11", 1, None), ("2", 2, 5), ("1", 3, 6)], "qos string, n int, t int")
    cats = features.category_list(df, "qos")
    out, names = features.request_columns(df, categories={"qos": cats}, numeric=["n", "t"])
    assert names == ["b0_qos_1", "b0_qos_2", "b0_qos_11", "b0_n", "b0_t"]
    assert out.filter("qos = '11'").select(*names).first()[:4] == (0, 0, 1, 1.0)
    assert features.forbidden_columns([*names, "b0_user_id"], settings.FORBIDDEN) == ["b0_user_id"]
    shares = {r.column_name: r.missing_share for r in features.missing_shares(out, ["b0_n", "b0_t"]).collect()}
    assert shares == {"b0_n": 0.0, "b0_t": pytest.approx(1 / 3)}


def test_many_categories_of_any_kind(spark):
    df = spark.range(1500).selectExpr("cast(id AS string) AS qos").unionByName(spark.createDataFrame([("high",), ("low",), (None,)], "qos string"))
    cats = features.category_list(df, "qos")
    assert cats[:3] == ["0", "1", "2"] and cats[-2:] == ["high", "low"] and len(cats) == 1502


def test_many_channels_and_thresholds(spark):
    channels = spark.range(1500).selectExpr("cast(id AS string) AS channel", "20 AS cadence_s")
    counts = channels.selectExpr("channel", "1 AS job_id", "2 AS node", "60 AS n")
    assert completeness.node_fractions(counts, channels, channel="channel", window_s=1200.0).filter("frac = 1").count() == 1500
    free = spark.createDataFrame([("R0", "a", 0.0), ("R0", "b", 0.0)], "rule string, channel string, threshold double")
    frac = spark.createDataFrame([(1, "a", 0.5)], "job_id int, channel string, frac double")
    jobs = spark.createDataFrame([(1,), (2,)], "job_id int")
    assert completeness.rule_membership(frac, free, job="job_id", channel="channel", jobs=jobs).count() == 2


def test_a_cluster_must_name_its_shared_folder():
    assert is_one_machine("local[8]") and is_one_machine("local") and not is_one_machine("local-cluster[3,2,1024]") and not is_one_machine("yarn")


def test_lake_scan_prunes_and_pushes(spark):
    root = scratch_path(spark, "test-lake")
    df = spark.createDataFrame(
        [(m, p, c, 1000 * n, float(n), str(n)) for m in ("20-05", "20-06") for p, c in (("ipmi_pub", "ambient"), ("ganglia_pub", "load_one"), ("ipmi_pub", "fan0_0")) for n in range(4)],
        "year_month string, plugin string, metric string, t bigint, value double, node string",
    ).withColumn("timestamp", F.timestamp_millis("t")).drop("t")
    tables.write_lake(df, root)
    got = tables.lake_readings(spark, root, channels={"ambient": "ipmi_pub", "load_one": "ganglia_pub"}, months=["20-06"], nodes=[2, 3])
    assert sorted((r.channel, r.node, r.ts_ms, r.value) for r in got.collect()) == [("ambient", 2, 2000, 2.0), ("ambient", 3, 3000, 3.0), ("load_one", 2, 2000, 2.0), ("load_one", 3, 3000, 3.0)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "year_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(node, [2,3])" in plan


def test_refresh_replaces_only_its_channels(spark):
    out = scratch_path(spark, "test-windows")
    rows = spark.createDataFrame([("a", 1, 1, 5, 1.0), ("b", 1, 1, 6, 2.0)], "channel string, job_id int, node int, ts_ms bigint, value double")
    wanted = literal_table(spark, [("a",), ("b",), ("c",)], "channel string")
    assert tables.missing_keys(spark, out, wanted, "channel").count() == 3
    tables.write_windows(rows.filter("channel = 'a'"), out)
    assert sorted(r.channel for r in tables.missing_keys(spark, out, wanted, "channel").collect()) == ["b", "c"]
    tables.write_windows(rows.filter("channel = 'b'").withColumn("value", F.lit(9.0)), out)
    assert sorted((r.channel, r.value) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 9.0)]


def test_materialize_uses_the_folder_the_session_names(spark):
    from tidegauge import session

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    table = session.materialize(spark.range(3), "x")
    assert table.count() == 3
    if named is not None:
        assert all(named.removeprefix("file:") in f for f in table.inputFiles())


def test_grid_size_of_the_full_study(spark):
    parts = analyses(settings.Study(), ["b0_x"])
    assert [len(a.feature_sets()) for a in parts] == [31, 26, 31]
    assert models.grid(spark.range(1), parts, ["a", "b"], ["main", "block1", "block2", "block3"]).count() == 1696


@pytest.mark.parametrize("spec", [models.ModelSpec("HGB", "boosted", {"maxIter": 5}), models.ModelSpec("RF", "forest", {"numTrees": 5})])
def test_models_take_missing_values_and_importance_sees_the_signal(spark, spec):
    y = (F.col("id") % 4 == 0).cast("double")
    df = spark.range(600).select(
        F.col("id").alias("job"), y.alias("y"), F.when(F.col("id") % 5 != 0, y * 2 + F.rand(1)).alias("signal"), F.rand(2).alias("noise"), F.lit(None).cast("double").alias("empty")
    ).cache()
    cols = ["noise", "empty", "signal"]
    model, floors = models.fit_model(df, columns=cols, label="y", spec=spec)
    out = models.score_model(model, floors, df, columns=cols, label="y", keep=["job"])
    assert out.count() == 600 and out.filter("score < 0 OR score > 1").count() == 0
    drop = {c: models.permutation_importance(model, floors, df, key="job", columns=cols, permuted=[c], label="y", repeats=2).first().importance for c in ("signal", "empty")}
    assert drop["signal"] > 0.1 and abs(drop["empty"]) < 1e-12


def test_importance_of_any_columns_of_one_model(spark):
    """Columns that do not stand last are moved too, and every other column keeps its place in the model."""
    from pyspark.sql import functions as F

    from tidegauge.operators import models, ordering

    rows = spark.range(400).select(
        F.col("id").alias("job"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("role"), (F.hash("id") % 2 == 0).cast("double").alias("y"), F.lit(1.0).alias("same")
    ).withColumn("told", F.col("y") * 3)
    columns = ["told", "same"]
    v = models.vectors(rows, key="job", label="y", columns=columns)
    model = models.fit_slice(v, columns, models.ModelSpec("RF", "forest", {"numTrees": 5, "maxDepth": 2}))
    ranked = ordering.row_index(v.test, [], ["job"], "__i")
    scores = models.score_slice(model, v, columns, ["job"])
    drop = {p: models.importance_slice(model, v, ranked, scores, key="job", columns=columns, permuted=[p], repeats=2).first().importance for p in columns}
    assert drop["told"] > 0.2 and abs(drop["same"]) < 1e-9
