from pyspark.sql import functions as F

from tidegauge.operators import ordering
from tidegauge.session import scratch_path
from tidegauge.sources import tables
from tidegauge.sources.ledger import Ledger

UNITS = ["channel", "month"]


def wanted(spark, *units):
    return spark.createDataFrame(list(units), "channel string, month string")


def source(spark):
    rows = [("a", "20-05", i, i % 3, 10 * i, float(i)) for i in range(40)] + [("a", "20-06", i, 0, i, 1.0) for i in range(7)] + [("b", "20-05", 1, 1, 1, 5.0)]
    return spark.createDataFrame(rows, "channel string, month string, job_id int, node int, ts_ms int, value double")


def test_units_are_read_once_and_new_months_do_not_touch_old_ones(spark):
    out, asked = scratch_path(spark, "ledger"), []

    def extract(units):
        asked.append(units)
        return source(spark).join(wanted(spark, *units), UNITS, "left_semi").withColumn("run", F.lit(len(asked)))

    go = lambda *units: tables.refresh_units(spark, out, f"{out}_ledger", wanted(spark, *units), extract, directories=UNITS)
    # channel c has no readings at all, and is not sought again
    assert go(("c", "20-05")) == [("c", "20-05")] and go(("c", "20-05")) == []
    first = [("a", "20-05"), ("b", "20-05"), ("c", "20-05")]
    assert go(*first) == first[:2] and go(*first) == []
    assert go(*first, ("a", "20-06"), ("b", "20-06")) == [("a", "20-06"), ("b", "20-06")]
    assert len(asked) == 3
    got = tables.committed_units(spark, out, f"{out}_ledger", directories=UNITS)
    assert {(r.channel, r.month, r.run): r["count"] for r in got.groupBy("channel", "month", "run").count().collect()} == {("a", "20-05", 2): 40, ("b", "20-05", 2): 1, ("a", "20-06", 3): 7}
    assert {r.unit: r.rows for r in Ledger(spark, f"{out}_ledger").done().collect()} == {"a|20-05": 40, "b|20-05": 1, "c|20-05": 0, "a|20-06": 7, "b|20-06": 0}


def test_a_half_written_unit_is_not_read_and_written_again(spark):
    out = scratch_path(spark, "ledger-half")
    rows = source(spark)
    # a run that ended before its commit: part of one unit is there, without a ledger row
    tables.write_windows(rows.filter("channel = 'a' AND month = '20-05' AND job_id < 5"), out, directories=UNITS)
    tables.refresh_units(spark, out, f"{out}_ledger", wanted(spark, ("b", "20-05")), lambda u: rows.filter("channel = 'b'"), directories=UNITS)
    read = lambda: tables.committed_units(spark, out, f"{out}_ledger", directories=UNITS)
    assert [r.channel for r in read().collect()] == ["b"]
    todo = tables.refresh_units(spark, out, f"{out}_ledger", wanted(spark, ("a", "20-05"), ("b", "20-05")), lambda u: rows.join(wanted(spark, *u), UNITS, "left_semi"), directories=UNITS)
    assert todo == [("a", "20-05")]
    assert {r.channel: r["count"] for r in read().groupBy("channel").count().collect()} == {"a": 40, "b": 1}


def test_files_of_a_directory_follow_its_rows(spark):
    """One node has nearly all rows of one channel: the whole sort key is hashed, and the number of tasks is counted."""
    rows = spark.range(6000).select(F.lit("a").alias("channel"), F.lit(1).alias("node"), F.col("id").alias("ts_ms")).unionByName(
        spark.range(10).select(F.lit("b").alias("channel"), F.lit(2).alias("node"), F.col("id").alias("ts_ms"))
    )
    salted = tables._salted(rows, ["channel"], ["node", "ts_ms"], file_rows=500)
    assert salted.count() == 6010 and salted.columns == rows.columns
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # these few rows would be put together again
    try:
        assert salted.withColumn("p", F.spark_partition_id()).filter("channel = 'a'").select("p").distinct().count() > 1
    finally:
        spark.conf.set(key, "true")


def test_several_paths_in_one_scan_keep_the_first_row_of_a_key(spark):
    root = scratch_path(spark, "paths")
    rows = {"z": [(1, "z0"), (2, "z1"), (1, "z2")], "a": [(2, "a0"), (3, "a1"), (3, "a2"), (None, "a3")]}
    for name, data in rows.items():
        spark.createDataFrame(data, "k int, v string").coalesce(1).write.parquet(f"{root}/{name}")
    read = tables.read_several(spark, [f"{root}/z", f"{root}/a"], ["k", "v"])
    assert read.count() == 7
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    got = lambda d: {r.k: r.v for r in tables.first_in_files(d, ["k"]).collect()}
    assert got(read) == {1: "z0", 2: "z1", 3: "a1", None: "a3"}
    assert got(read.repartition(5)) == got(read)
    assert got(tables.read_several(spark, [f"{root}/a", f"{root}/z"], ["k", "v"]))[2] == "a0"


def test_first_rows_are_found_by_tasks_of_counted_rows(spark, tmp_path, monkeypatch):
    """Many files: the number of tasks that sort rows follows the rows, and the first row is the same."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 2)
    for name in ("b", "a"):
        spark.range(40).selectExpr("id % 20 AS k", f"concat('{name}', id) AS v").repartitionByRange(12, "v").write.parquet(str(tmp_path / name))
    read = tables.read_several(spark, [str(tmp_path / "b"), str(tmp_path / "a")], ["k", "v"])
    first = {}
    for r in read.orderBy("__place").collect():
        first.setdefault(r.k, r.v)
    got = tables.first_in_files(read, ["k"])
    assert {r.k: r.v for r in got.collect()} == first and {v[0] for v in first.values()} == {"b"}
    assert "RepartitionByExpression [__place" in got._jdf.queryExecution().optimizedPlan().toString() and ", 40" in got._jdf.queryExecution().optimizedPlan().toString()
