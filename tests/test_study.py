"""The stages end to end on a small invented cluster: lake, job table, features, splits, fits, verdict."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import models
from tidegauge.plans import stages
from tidegauge.plans.settings import Study
from tidegauge.session import materialize, scratch_path
from tidegauge.sources import tables
from tidegauge.sources.ledger import Ledger

STUDY = Study(
    cohort_start="2020-05-06 00:00:00",
    channels={"mem_total": "ganglia_pub", "mem_free": "ganglia_pub", "total_power": "ipmi_pub", "dead": "ipmi_pub"},
    groups={"mem_active": ["mem_total", "mem_free"], "node_power": ["total_power"]},
    composed={"mem_active": ("mem_total", ["mem_free"])},
    months=["20-05"],
    n_placebos=2,
    n_boot=20,
    floor=1,
)
N_JOBS, N_NODES, STEP_S = 160, 4, 40


@pytest.fixture(scope="module")
def world(spark):
    start = F.timestamp_seconds(F.lit(1589000000) + F.floor(F.col("id") / N_NODES) * 3600)
    state = F.when(F.col("id") % 5 == 0, "FAILED").when(F.col("id") % 7 == 0, "TIMEOUT").when(F.col("id") % 31 == 30, "CANCELLED").otherwise("COMPLETED")
    jobs = spark.range(N_JOBS).select(
        F.col("id").alias("job_id"), (F.col("id") % 11).alias("user_id"), state.alias("job_state"), start.alias("start_time"),
        (start + F.expr("INTERVAL 30 MINUTES")).alias("end_time"), F.lit(1800).cast("bigint").alias("run_time"), F.lit(60).alias("time_limit"),
        F.when(F.col("id") % 2 == 0, "1").otherwise("11").alias("qos"), F.lit("1").alias("partition"), (F.col("id") % 3).alias("mem_req"),
        *[F.lit(1).alias(c) for c in ("num_nodes_req", "num_nodes_alloc", "num_cores_req", "num_gpus_req", "cores_per_task")],
        F.when(F.col("id") % 40 == 39, 0).otherwise(4).alias("num_gpus_alloc"), F.when(F.col("id") % 6 != 0, 1).alias("num_tasks"),
        F.array((F.col("id") % N_NODES).cast("int")).alias("nodes"),
    )
    per_node = N_JOBS // N_NODES * 3600 // STEP_S
    at = F.lit(1589000000) + F.floor(F.col("id") / N_NODES) * STEP_S
    node, draw = F.col("id") % N_NODES, F.rand(3)
    hot = (F.floor((F.col("id") / N_NODES) * STEP_S / 3600) * N_NODES + node) % 5 == 0
    value = {"mem_total": F.lit(1000.0), "mem_free": 300 + 10 * draw, "total_power": F.when(hot, 500.0).otherwise(200.0) + 20 * draw, "dead": F.lit(0.0)}
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(STUDY.channels[c]).alias("plugin"), v.alias("value")) for c, v in value.items()])
    raw = spark.range(per_node * N_NODES).select(
        F.lit("20-05").alias("year_month"), F.timestamp_seconds(at).alias("timestamp"), node.cast("string").alias("node"), F.explode(cells).alias("c")
    ).select("year_month", "timestamp", "node", "c.*")
    root = scratch_path(spark, "study-lake")
    tables.write_lake(raw, root)
    return jobs, root


def test_study_end_to_end(spark, world, monkeypatch):
    job_table, root = world
    jobs = materialize(stages.cohort_stage(job_table, STUDY), "jobs")
    assert jobs.filter("job_state = 'CANCELLED'").count() == 0 and jobs.filter("target_a = 1 AND job_state <> 'FAILED'").count() == 0
    wins = materialize(stages.windows_stage(jobs, STUDY), "windows")
    out = scratch_path(spark, "study-windows")
    assert stages.refresh_window_readings(spark, root, out, wins, STUDY) == sorted((c, "20-05") for c in STUDY.channels)
    assert stages.refresh_window_readings(spark, root, out, wins, STUDY) == []
    inside = stages.window_readings(spark, out)
    assert inside.filter("ts_ms < t0_ms OR ts_ms >= t0_ms + 1200000").count() == 0
    inv = materialize(stages.inventory_stage(tables.lake_readings(spark, root, channels=STUDY.channels, months=STUDY.months), STUDY), "inventory")
    got = {r.channel: r for r in inv.collect()}
    kept = scratch_path(spark, "study-inventory")
    assert stages.refresh_inventory(spark, root, kept, STUDY) == sorted((c, "20-05") for c in STUDY.channels) and stages.refresh_inventory(spark, root, kept, STUDY) == []
    merged = {r.channel: r for r in stages.merged_inventory_stage(spark, kept, STUDY).collect()}
    assert {c: r.asDict() for c, r in merged.items()} == {c: r.asDict() for c, r in got.items()}
    assert got["total_power"].cadence_s == STEP_S and got["dead"].constant and got["mem_total"].constant
    # keep mem_total as a channel although it is flat here: it is the total of a composed group
    inv = inv.withColumn("constant", F.col("channel") == "dead")
    done = stages.completeness_stage(jobs, wins, inside, inv, STUDY)
    report = {r.rule: r for r in stages.rules_report(done["outcome"]).collect()}
    assert report["R80"].outcome == "primary" and report["R80"].jobs == jobs.filter("gpu").count()
    pops = {r.population: r.jobs for r in stages.populations_report(jobs, done["flags"]).collect()}
    assert pops["reference"] == jobs.count() and pops["gpu"] == pops["complete"] == pops["strict"]
    table, request = stages.features_stage(jobs, done["flags"], inside, inv, STUDY)
    table = materialize(table, "features")
    assert request[:3] == ["b0_qos_1", "b0_qos_11", "b0_partition_1"] and table.count() == pops["gpu"]
    assert table.filter("mem_active__mean IS NULL OR node_power__std IS NULL OR placebo_complete01__max IS NULL").count() == 0
    members = materialize(stages.splits_stage(table), "members")
    primary = stages.analyses(STUDY, request, boosted={"maxIter": 3, "minInstancesPerNode": 5}, forest={"numTrees": 3})[0]
    small = models.Analysis(primary.name, primary.population, primary.groups, primary.baseline, primary.models[:2], primary.placebo, 1)
    fits = scratch_path(spark, "study-fits")
    go = lambda: stages.fit_stage(members, small, "a", split_names=["main", "block1"], sets=["B0", "node_power", "placebo00"], folder=fits)
    preds, imps = go()
    # a unit whose scores are there without a commit is fitted again, and nothing else
    fitted, real = [], models.fit_slice
    kept = Ledger(spark, f"{fits}/ledger").done().filter("unit <> 'primary|a|main|HGB|node_power'").cache()
    assert kept.count() == 11
    kept.write.mode("overwrite").parquet(f"{fits}/ledger_kept")
    spark.read.parquet(f"{fits}/ledger_kept").write.mode("overwrite").parquet(f"{fits}/ledger")
    assert go()[0].filter("model = 'HGB'").select("split", "feature_set").distinct().count() == 6
    monkeypatch.setattr(models, "fit_slice", lambda *a: fitted.append(a) or real(*a))
    preds, imps = go()
    assert fitted == []
    assert preds.select("split", "model", "feature_set").distinct().count() == 2 * 2 * 3 and imps.count() == 4
    best = {(r.model, r.feature_set): r.importance for r in imps.collect()}
    assert best[("HGB", "node_power")] > best[("HGB", "placebo00")]
    meta = jobs.select("job_id", "user_id", "qos", F.col("target_a").alias("y"))
    scored = materialize(preds.join(meta, "job_id"), "scored")
    with pytest.raises(Exception, match="no importance for"):
        stages.gains_stage(scored, imps.filter("feature_set <> 'placebo00'"), keys=[], cluster="user_id", queue="qos", queues=STUDY.queues, n_boot=5)
    gains = stages.gains_stage(scored, imps, keys=[], cluster="user_id", queue="qos", queues=STUDY.queues, n_boot=STUDY.n_boot)
    row = gains.filter("model = 'HGB' AND feature_set = 'node_power'").first()
    assert row.delta_main > 0 and row.pos_main > 0 and row.p_holm_pooled is not None and row.delta_queue11 is not None
