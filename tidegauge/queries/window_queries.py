"""Windows, interval and as-of joins, clock checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import checks, cohort, windows
from tidegauge.queries import base
from tidegauge.queries.base import HOUR_MS, JOB_NODES_SQL, JOBS_SQL, PAIRS_SQL, READINGS_SQL, SALES_SQL, WINDOWS_SQL, query, rounded, table


@query(WINDOWS_SQL)
def explode_nodes(spark, sf):
    return base.sale_windows(spark, sf)


@query(PAIRS_SQL)
def window_interval_join(spark, sf):
    return base.window_pairs(spark, sf).select("job_id", "node", "channel", "ts_ms", "value", "t0_ms")


@query(f"SELECT channel, job_id, node, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY channel, job_id, node")
def reading_counts(spark, sf):
    return base.window_pairs(spark, sf).groupBy("channel", "job_id", "node").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1""")
def dedup_keep_first(spark, sf):
    lines = table(spark, sf, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    first = windows.keep_first(lines, ["l_orderkey", "l_linenumber"], order)
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"""
WITH s AS (SELECT l_orderkey AS job_id, min(l_shipdate) AS start_time, max(l_shipdate) AS end_time FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS matched,
  round(max(abs(epoch_us(j.start_time) // 1000 - epoch_us(s.start_time) // 1000)) / 1000.0, 3)::DOUBLE AS max_diff_start_time,
  round(max(abs(epoch_us(j.end_time) // 1000 - epoch_us(s.end_time) // 1000)) / 1000.0, 3)::DOUBLE AS max_diff_end_time
FROM ({JOBS_SQL}) j JOIN s USING (job_id)""")
def reconcile_tables(spark, sf):
    shipped = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(F.min("l_shipdate").alias("start_time"), F.max("l_shipdate").alias("end_time"))
    )
    return windows.reconcile(base.jobs(spark, sf), shipped, "job_id", ["start_time", "end_time"])


PREVIOUS_SQL = f"""
SELECT node, job_id, epoch_us(start_time) // 1000 AS start_ms, epoch_us(end_time) // 1000 AS end_ms,
  lag(epoch_us(end_time) // 1000) OVER (PARTITION BY node ORDER BY start_time, job_id) AS prev_end_ms
FROM ({JOBS_SQL}) JOIN ({JOB_NODES_SQL}) USING (job_id)"""


def _with_previous(spark, sf):
    placed = base.jobs(spark, sf).join(base.job_nodes(spark, sf), "job_id").select("node", "job_id", "start_time", "end_time")
    return windows.previous_on_node(placed, node="node", start="start_time", end="end_time", job="job_id")


@query(PREVIOUS_SQL)
def previous_job_on_node(spark, sf):
    return _with_previous(spark, sf).select(
        "node", "job_id", C.epoch_ms("start_time").alias("start_ms"), C.epoch_ms("end_time").alias("end_ms"),
        C.epoch_ms("prev_end_time").alias("prev_end_ms"),
    )


@query(f"""
SELECT node, job_id, start_ms - prev_end_ms AS idle_ms FROM ({PREVIOUS_SQL})
WHERE start_ms - prev_end_ms > 10800000 AND end_ms - start_ms > 14400000""")
def idle_gaps(spark, sf):
    idle = windows.idle_before(_with_previous(spark, sf), start="start_time", end="end_time", min_idle_s=3 * 3600, min_length_s=4 * 3600)
    return idle.select("node", "job_id", (C.epoch_ms("start_time") - C.epoch_ms("prev_end_time")).alias("idle_ms"))


PROFILE_SQL = f"""
WITH p AS (SELECT floor((r.ts_ms - e.t0_ms + {96 * HOUR_MS}) / {6 * HOUR_MS})::BIGINT AS bin, r.value
  FROM ({READINGS_SQL}) r JOIN ({SALES_SQL}) e ON r.node = e.user_id
   AND r.ts_ms >= e.t0_ms - {96 * HOUR_MS} AND r.ts_ms < e.t0_ms + {96 * HOUR_MS}),
a AS (SELECT bin, count(value) AS n, sum(value::DECIMAL(28, 10))::DOUBLE / count(value) AS m FROM p GROUP BY bin)
SELECT s.bin, s.bin * {6 * HOUR_MS} - {96 * HOUR_MS} AS bin_start_ms, coalesce(a.n, 0) AS n, round(coalesce(a.m, 0.0), 6) AS mean_value
FROM (SELECT unnest(range(32))::BIGINT AS bin) s LEFT JOIN a USING (bin)"""


def _profile(spark, sf):
    events = base.sales(spark, sf).select("job_id", F.col("user_id").alias("node"), "t0_ms")
    near = windows.event_aligned(base.readings(spark, sf), events, node="node", ts="ts_ms", at="t0_ms", before_ms=96 * HOUR_MS, after_ms=96 * HOUR_MS)
    return windows.aligned_profile(near, value="value", lo_ms=-96 * HOUR_MS, hi_ms=96 * HOUR_MS, bin_ms=6 * HOUR_MS, places=10)


@query(PROFILE_SQL)
def event_profile(spark, sf):
    return rounded(_profile(spark, sf), "mean_value")


@query(f"""
WITH d AS (SELECT bin, bin_start_ms, lag(mean_value) OVER (ORDER BY bin) AS from_value, mean_value AS to_value FROM ({PROFILE_SQL}))
SELECT * FROM d WHERE from_value IS NOT NULL ORDER BY to_value - from_value DESC, bin LIMIT 1""")
def profile_largest_step(spark, sf):
    return rounded(windows.largest_step(_profile(spark, sf)), "from_value", "to_value")


GRID_SQL = f"""
SELECT vec_id, vec_id % (SELECT count(*) FROM customer) AS node, 1704067200000 + (vec_id % 240) * {HOUR_MS} AS start_ms, h * {HOUR_MS} AS shift_ms, k::INTEGER AS k,
  embedding[k + 1] AS sample, 1704067200000 + (vec_id % 240) * {HOUR_MS} + h * {HOUR_MS} + k * {6 * HOUR_MS} AS grid_ms
FROM embeddings, (SELECT unnest([-48, -24, 0, 24, 48])::BIGINT AS h), (SELECT unnest(range(48)) AS k)"""

FORWARD_SQL = f"""
WITH g AS ({GRID_SQL}), r AS ({READINGS_SQL}), e AS (SELECT node, max(ts_ms) AS last_ms FROM r GROUP BY node),
u AS (SELECT node, ts_ms, min(value) AS lo, max(value) AS hi FROM r GROUP BY node, ts_ms),
nx AS (SELECT g.*, u.ts_ms AS next_ms, u.lo FROM g ASOF LEFT JOIN u ON g.node = u.node AND g.grid_ms <= u.ts_ms),
la AS (SELECT nx.*, e.last_ms, u.hi FROM nx LEFT JOIN e ON nx.node = e.node LEFT JOIN u ON u.node = e.node AND u.ts_ms = e.last_ms)
SELECT vec_id, shift_ms, k, sample,
  CASE WHEN next_ms <= grid_ms + {24 * HOUR_MS} THEN next_ms WHEN last_ms < grid_ms AND last_ms >= grid_ms - {24 * HOUR_MS} THEN last_ms END AS match_ts,
  CASE WHEN next_ms <= grid_ms + {24 * HOUR_MS} THEN lo WHEN last_ms < grid_ms AND last_ms >= grid_ms - {24 * HOUR_MS} THEN hi END AS match_value
FROM la"""


def _grid(spark, sf):
    traces = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % table(spark, sf, "customer").count()).alias("node"), (F.lit(1704067200000) + (F.col("vec_id") % 240) * HOUR_MS).alias("start_ms"), "embedding"
    )
    return windows.grid_points(
        traces, ids=["vec_id", "node"], start_ms="start_ms", values="embedding", n=48, step_ms=6 * HOUR_MS, shifts_ms=[h * HOUR_MS for h in (-48, -24, 0, 24, 48)]
    )


def _asof(spark, sf, direction):
    return windows.asof_match(
        _grid(spark, sf), base.readings(spark, sf), node="node", at="grid_ms", ts="ts_ms", value="value",
        tolerance_ms=24 * HOUR_MS, direction=direction,
    )


@query(f"SELECT vec_id, shift_ms, k, match_ts, match_value FROM ({FORWARD_SQL})")
def asof_forward(spark, sf):
    return _asof(spark, sf, "forward").select("vec_id", "shift_ms", "k", "match_ts", "match_value")


@query(f"""
WITH g AS ({GRID_SQL}), r AS ({READINGS_SQL}),
n AS (SELECT vec_id, shift_ms, k, min(ROW(abs(ts_ms - grid_ms), ts_ms, value)) AS m
  FROM g JOIN r ON g.node = r.node AND abs(ts_ms - grid_ms) <= {24 * HOUR_MS} GROUP BY ALL)
SELECT g.vec_id, g.shift_ms, g.k, n.m[2] AS match_ts, n.m[3] AS match_value FROM g LEFT JOIN n USING (vec_id, shift_ms, k)""")
def asof_nearest(spark, sf):
    return _asof(spark, sf, "nearest").select("vec_id", "shift_ms", "k", "match_ts", "match_value")


CORR_SQL = f"""
SELECT vec_id, shift_ms, avg(CASE WHEN match_ts IS NULL THEN 0.0 ELSE 1.0 END) AS matched_share,
  covar_pop(sample, match_value) / (stddev_pop(sample) FILTER (match_ts IS NOT NULL) * stddev_pop(match_value)) AS corr
FROM ({FORWARD_SQL}) GROUP BY vec_id, shift_ms
HAVING avg(CASE WHEN match_ts IS NULL THEN 0.0 ELSE 1.0 END) >= 0.8 AND stddev_pop(match_value) > 0"""


@query(f"SELECT vec_id, shift_ms, round(matched_share, 6) AS matched_share, round(corr, 6) AS corr FROM ({CORR_SQL})")
def lagged_correlation(spark, sf):
    return rounded(windows.lagged_correlation(_asof(spark, sf, "forward"), ids=["vec_id"]), "matched_share", "corr")


@query(f"SELECT shift_ms, round(quantile_cont(corr, 0.5), 6) AS median_corr FROM ({CORR_SQL}) GROUP BY shift_ms")
def lagged_correlation_median(spark, sf):
    per_key = windows.lagged_correlation(_asof(spark, sf, "forward"), ids=["vec_id"])
    return rounded(windows.median_correlation(per_key), "median_corr")


@query("""
WITH s AS (SELECT vec_id, list_aggregate(embedding[1:48]::DOUBLE[], 'stddev_pop') AS sd FROM embeddings)
SELECT vec_id, round(sd, 6) AS sd FROM s WHERE sd > 0.12""")
def array_trace_std(spark, sf):
    traces = table(spark, sf, "embeddings").select("vec_id", C.prefix_stddev_pop("embedding", 48).alias("sd"))
    return rounded(traces.filter(F.col("sd") > 0.12), "sd")


@query(f"""
WITH h AS (SELECT job_id, job_state, ('0x' || substr(md5('1|' || job_id), 1, 8))::BIGINT AS u FROM ({SALES_SQL})),
s AS (SELECT job_id FROM h QUALIFY row_number() OVER (PARTITION BY job_state ORDER BY u, job_id) <= 5)
SELECT channel, count(*) FILTER (ts_ms % 7 <> 0) AS readings, count(*) FILTER (ts_ms % 7 = 0) AS mismatches FROM ({PAIRS_SQL}) JOIN s USING (job_id) GROUP BY channel
HAVING count(*) FILTER (ts_ms % 7 <> 0) > 0""")
def extraction_audit(spark, sf):
    # a seeded sample of windows, extracted by the interval join and again by a plain per-node filter; the first extraction
    # then loses every reading at a time that 7 divides, and the audit has to count them
    sample = cohort.seeded_sample(base.sales(spark, sf).select("job_id", "job_state"), ["job_state"], 5, "job_id", 1)
    saved = base.window_pairs(spark, sf).join(sample, "job_id", "left_semi").select("job_id", "node", "channel", "ts_ms", "value")
    saved = saved.filter(F.col("ts_ms") % 7 != 0)
    some = base.sale_windows(spark, sf).join(sample, "job_id", "left_semi")
    direct = base.readings(spark, sf).join(some, "node").filter(C.in_half_open("ts_ms", "t0_ms", "t1_ms"))
    diff = checks.multiset_difference(saved, direct).groupBy("channel").agg(F.sum("n").alias("mismatches"))
    counts = saved.groupBy("channel").agg(F.count("*").alias("readings"))
    return counts.join(diff, "channel", "left").select("channel", "readings", F.coalesce("mismatches", F.lit(0).cast("bigint")).alias("mismatches"))


@query(f"SELECT min(ts_ms - t0_ms) AS min_rel_ms, max(ts_ms - t0_ms) AS max_rel_ms FROM ({PAIRS_SQL})")
def window_bounds(spark, sf):
    from tidegauge.operators import features

    return features.window_bounds(base.window_pairs(spark, sf), ts="ts_ms", t0="t0_ms")
