"""The driver tables in the roles the operators expect, in Spark and as SQL fragments.

Jobs are orders, nodes are suppliers or event users, readings are events or
unpivoted order lines, and windows start at purchase events.  Every frame is
over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import cohort, windows
from tidegauge.operators.small import literal_table
from tidegauge.session import configure


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the equivalent SQL."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        REGISTRY[fn.__name__] = Query(run, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ orders as jobs

TARGETS = {"target_a": (["F"], "O"), "target_b": (["P"], "O")}
SUFFIX = {"target_a": "a", "target_b": "b"}

JOBS_SQL = """
SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderstatus AS job_state,
       substr(o_orderpriority, 1, 1) AS queue, o_totalprice AS price,
       CAST(floor(o_totalprice) AS BIGINT) AS run_time, o_orderdate AS start_time,
       o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) AS end_time,
       CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS target_a,
       CASE o_orderstatus WHEN 'P' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS target_b
FROM orders"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.floor("o_totalprice").cast("bigint")
    end = F.timestamp_millis(C.epoch_ms("o_orderdate") + 1000 * seconds)
    frame = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("job_state"),
        F.substring("o_orderpriority", 1, 1).alias("queue"),
        F.col("o_totalprice").alias("price"),
        seconds.alias("run_time"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        end.alias("end_time"),
    )
    return cohort.with_targets(frame, "job_state", TARGETS)


#: Jobs on nodes: the suppliers of an order's lines.
JOB_NODES_SQL = "SELECT DISTINCT l_orderkey AS job_id, l_suppkey AS node FROM lineitem"


def job_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("node")).distinct()


# ------------------------------------------------------------------ events as telemetry

HOUR_MS = 3_600_000
WINDOW_S = 48 * 3600
WINDOW_MS = WINDOW_S * 1000

#: Seconds between expected readings of each event channel.
CADENCE = {"click": 21600, "view": 21600, "error": 43200, "purchase": 43200, "signup": 86400}
CHANNELS = list(CADENCE)
SOURCES = {"web": ["click", "view", "signup"], "shop": ["purchase", "error"]}
GROUPS = {"traffic": ["click", "view"], "failure": ["error"], "sales": ["purchase"], "net": ["signup", "click", "view"]}
COMPOSED = {"net": ("signup", ["click", "view"])}

CADENCE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {s})" for c, s in CADENCE.items()) + ") AS c(channel, cadence_s)"

READINGS_SQL = "SELECT event_type AS channel, user_id AS node, epoch_us(ts) // 1000 AS ts_ms, value FROM events"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("channel"), F.col("user_id").alias("node"), C.epoch_ms("ts").alias("ts_ms"), "value"
    )


def channel_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(CADENCE.items()), "channel string, cadence_s int")


#: Purchases as jobs on two nodes each; the amount decides the final state.
SALES_SQL = """
SELECT event_id AS job_id, user_id, epoch_us(ts) // 1000 AS t0_ms, ts AS start_time, ts + INTERVAL 48 HOUR AS end_time, value,
       [user_id, (user_id + 37) % (SELECT count(*) FROM customer)] AS nodes,
       CASE WHEN value > 60 THEN 'F' WHEN value < 15 THEN 'P' ELSE 'O' END AS job_state,
       CASE WHEN value > 60 THEN 1.0::DOUBLE WHEN value < 15 THEN NULL ELSE 0.0::DOUBLE END AS target_a,
       CASE WHEN value > 60 THEN NULL WHEN value < 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_b
FROM events WHERE event_type = 'purchase'"""

WINDOWS_SQL = f"SELECT job_id, unnest(nodes) AS node, t0_ms, t0_ms + {WINDOW_MS} AS t1_ms FROM ({SALES_SQL})"

PAIRS_SQL = f"""
SELECT w.job_id, w.node, r.channel, r.ts_ms, r.value, w.t0_ms
FROM ({READINGS_SQL}) r JOIN ({WINDOWS_SQL}) w ON r.node = w.node AND r.ts_ms >= w.t0_ms AND r.ts_ms < w.t1_ms"""


def sales(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("value") > 60, "F").when(F.col("value") < 15, "P").otherwise("O")
    frame = (
        table(spark, sf, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("job_id"),
            "user_id",
            C.epoch_ms("ts").alias("t0_ms"),
            F.col("ts").cast("timestamp").alias("start_time"),
            (F.col("ts").cast("timestamp") + F.expr("INTERVAL 48 HOURS")).alias("end_time"),
            "value",
            F.array(F.col("user_id"), (F.col("user_id") + 37) % table(spark, sf, "customer").count()).alias("nodes"),
            state.alias("job_state"),
        )
    )
    return cohort.with_targets(frame, "job_state", TARGETS)


def sale_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.node_windows(sales(spark, sf), job="job_id", t0_ms="t0_ms", nodes="nodes", window_ms=WINDOW_MS)


def window_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return windows.interval_join(
        readings(spark, sf), sale_windows(spark, sf), node="node", ts="ts_ms", t0="t0_ms", t1="t1_ms", bucket_ms=WINDOW_MS
    )


# ------------------------------------------------------------------ order lines as a dense lake

MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}

LINES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS channel, l_suppkey AS node, epoch_us(l_shipdate) // 1000 AS ts_ms, {col} AS value FROM lineitem" for c, col in MEASURES.items()
)


def line_readings(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(col).alias("value")) for c, col in MEASURES.items()])
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_suppkey").alias("node"), C.epoch_ms("l_shipdate").alias("ts_ms"), F.explode(cells).alias("c"))
        .select("c.channel", "node", "ts_ms", "c.value")
    )


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines (and -0.0 folded to 0.0)."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def millis(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[C.epoch_ms(c).alias(c) if c in names else F.col(c) for c in df.columns])
