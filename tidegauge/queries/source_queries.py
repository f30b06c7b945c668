"""Sources and sinks: a partitioned lake, CSV, JSON, nested columns, incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators.small import literal_table
from tidegauge.queries import base
from tidegauge.queries.base import query, rounded, table
from tidegauge.session import materialize, scratch_path
from tidegauge.sources import tables

PLUGIN = {"click": "web", "view": "web", "signup": "web", "purchase": "shop", "error": "shop"}


def _lake(spark, sf) -> str:
    """All events written as a lake: year_month / plugin / metric, node as text, times as timestamps."""
    root = scratch_path(spark, "lake")
    plugin = F.create_map(*[F.lit(x) for pair in PLUGIN.items() for x in pair])
    events = table(spark, sf, "events").select(
        F.date_format("ts", "yy-MM-dd").alias("year_month"), plugin[F.col("event_type")].alias("plugin"), F.col("event_type").alias("metric"),
        F.col("ts").cast("timestamp").alias("timestamp"), "value", F.col("user_id").cast("string").alias("node"),
    )
    tables.write_lake(events, root)
    return root


@query("""
SELECT event_type AS channel, CASE WHEN event_type IN ('purchase', 'error') THEN 'shop' ELSE 'web' END AS source, user_id::INTEGER AS node,
  count(*) AS n, min(epoch_us(ts) // 1000) AS first_ms, round(avg(value), 6) AS mean_value
FROM events WHERE event_type IN ('click', 'error') AND strftime(ts, '%y-%m-%d') IN ('24-01-05', '24-01-06', '24-01-20') GROUP BY ALL""")
def lake_scan(spark, sf):
    got = tables.lake_readings(spark, _lake(spark, sf), channels={"click": "web", "error": "shop"}, months=["24-01-05", "24-01-06", "24-01-20"])
    out = got.groupBy("channel", "source", "node").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.avg("value").alias("mean_value"))
    return rounded(out, "mean_value")


@query("SELECT event_type AS channel, user_id::INTEGER AS node, epoch_us(ts) // 1000 AS ts_ms, value FROM events WHERE user_id IN (3, 14, 59)")
def lake_node_pushdown(spark, sf):
    got = tables.lake_readings(spark, _lake(spark, sf), channels=PLUGIN, nodes=[3, 14, 59])
    return got.select("channel", "node", "ts_ms", "value")


@query("SELECT o_orderkey AS job_id, o_orderpriority AS priority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join_keys(spark, sf):
    keys = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("job_id"))
    jobs = tables.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority"]).toDF("job_id", "priority")
    return tables.only_keys(jobs, keys, ["job_id"])


@query("""
SELECT vec_id, len(embedding)::INTEGER AS samples, round(embedding[1]::DOUBLE, 6) AS first_sample FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def nested_late_filter(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    traces = tables.only_keys(tables.read_parquet(spark, f"{sf}/embeddings.parquet", ["vec_id", "embedding"]), good, ["vec_id"])
    return rounded(traces.select("vec_id", F.size("embedding").alias("samples"), F.col("embedding")[0].cast("double").alias("first_sample")), "first_sample")


@query("SELECT o_orderpriority AS queue, count(*) AS jobs, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1")
def csv_roundtrip(spark, sf):
    out = rounded(table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.count("*").alias("jobs"), F.avg("o_totalprice").alias("mean_price")), "mean_price", digits=4)
    path = scratch_path(spark, "csv")
    tables.write_result_csv(out, path)
    return tables.read_csv(spark, path, "queue string, jobs bigint, mean_price double")


@query("SELECT o_orderstatus AS state, list_sort(list(DISTINCT substr(o_orderpriority, 1, 1)))::VARCHAR AS queues, count(*) AS jobs FROM orders GROUP BY 1")
def json_roundtrip(spark, sf):
    out = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(
        F.sort_array(F.collect_set(F.substring("o_orderpriority", 1, 1))).alias("queues"), F.count("*").alias("jobs")
    )
    path = scratch_path(spark, "json")
    tables.write_json(out, path)
    back = tables.read_json(spark, path, "state string, queues array<string>, jobs bigint")
    return back.withColumn("queues", F.concat(F.lit("["), F.array_join("queues", ", "), F.lit("]")))


@query(f"""
SELECT channel, CASE WHEN ts_ms < 1705363200000 THEN 'first' ELSE 'second' END AS half, count(*) AS n, CAST(sum(ts_ms % 1000) AS BIGINT) AS check_sum,
  CASE WHEN channel = 'click' THEN 1 WHEN ts_ms < 1705363200000 THEN 2 ELSE 3 END AS run
FROM ({base.PAIRS_SQL}) GROUP BY ALL""")
def incremental_refresh(spark, sf):
    """Units of channel and half: one channel first, then the first half of all, then the rest; each is read once."""
    path = scratch_path(spark, "window-readings")
    half = F.when(F.col("ts_ms") < 1705363200000, "first").otherwise("second")
    pairs = materialize(base.window_pairs(spark, sf).select("channel", half.alias("half"), "job_id", "node", "ts_ms", "value"), "window-pairs")
    units = ["channel", "half"]
    wanted = literal_table(spark, [(c, h) for c in base.CHANNELS for h in ("first", "second")], "channel string, half string")
    run = 0
    for condition in ("channel = 'click'", "half = 'first'", "true", "true"):
        run += 1

        def extract(todo, run=run):
            listed = literal_table(spark, todo, "channel string, half string")
            return pairs.join(listed, units, "left_semi").withColumn("run", F.lit(run))

        tables.refresh_units(spark, path, f"{path}_ledger", wanted.filter(condition), extract, directories=units)
    done = tables.committed_units(spark, path, f"{path}_ledger", directories=units)
    return done.groupBy("channel", "half", "run").agg(F.count("*").alias("n"), F.sum(F.col("ts_ms") % 1000).alias("check_sum")).select("channel", "half", "n", "check_sum", "run")


@query("""
SELECT 'orders' AS part, o_orderkey AS job_id, NULL::DOUBLE AS quantity, o_totalprice AS price FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'lines', l_orderkey, l_quantity, NULL FROM lineitem WHERE l_returnflag = 'R'""")
def union_mixed_schemas(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.lit("orders").alias("part"), F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.lit("lines").alias("part"), F.col("l_orderkey").alias("job_id"), F.col("l_quantity").alias("quantity"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""
SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE WHEN month(o_orderdate) = 6 OR o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS price,
  CASE WHEN month(o_orderdate) = 6 THEN 'june' WHEN o_orderkey % 3 = 0 THEN 'third' ELSE 'all' END AS origin FROM orders""")
def several_paths_dedup(spark, sf):
    """Three month tables of jobs in one scan; a job that stands in several keeps its row of the path listed first."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("price"), "o_orderdate")
    parts = {
        "june": orders.filter(F.month("o_orderdate") == 6),
        "third": orders.filter("job_id % 3 = 0"),
        "all": orders.withColumn("price", F.col("price") + 1),
    }
    root, paths = scratch_path(spark, "months"), []
    for name, rows in parts.items():
        paths.append(f"{root}/{name}")
        # a job twice in one file: the copy behind it must not win
        again = rows.withColumn("price", F.explode(F.array("price", F.lit(-1.0)))) if name == "june" else rows
        tables.write_parquet(again.drop("o_orderdate").withColumn("origin", F.lit(name)).select("job_id", "user_id", "price", "origin"), paths[-1])
    return tables.first_in_files(tables.read_several(spark, paths, ["job_id", "user_id", "price", "origin"]), ["job_id"])


@query("SELECT user_id AS node FROM events WHERE event_type = 'error' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct_nodes(spark, sf):
    a = base.readings(spark, sf).filter("channel = 'error'").select("node")
    b = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return a.union(b).distinct()


@query("""
SELECT o_orderkey AS job_id, date_trunc('day', o_orderdate)::VARCHAR AS day, strftime(o_orderdate, '%Y-%m') AS month,
  (floor(-(o_totalprice) / 1000))::BIGINT AS floor_down, round_even(o_totalprice / 10, 0) AS half_even, sign(o_totalprice - 250000)::DOUBLE AS side,
  round(o_totalprice / nullif(o_custkey % 5, 0), 6) AS guarded, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS days
FROM orders""")
def scalar_functions(spark, sf):
    o = table(spark, sf, "orders")
    out = o.select(
        F.col("o_orderkey").alias("job_id"),
        F.date_format(F.date_trunc("day", "o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("day"),
        C.month_of("o_orderdate").alias("month"),
        C.floor_div(-F.col("o_totalprice"), 1000).alias("floor_down"),
        C.half_even(F.col("o_totalprice") / 10).alias("half_even"),
        F.signum(F.col("o_totalprice") - 250000).alias("side"),
        C.ratio("o_totalprice", F.col("o_custkey") % 5).alias("guarded"),
        C.span_days(F.lit("1995-01-01"), "o_orderdate").alias("days"),
    )
    return rounded(out, "guarded")
