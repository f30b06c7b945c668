"""Window features, request columns, placebos."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import checks, features, permute
from tidegauge.queries import base
from tidegauge.queries.base import CADENCE_SQL, JOBS_SQL, PAIRS_SQL, SALES_SQL, query, rounded, table

GROUP_NAMES = list(base.GROUPS)

SERIES_SQL = f"""
WITH b AS (SELECT p.*, floor((ts_ms - t0_ms) / (cadence_s * 1000.0))::BIGINT AS bin FROM ({PAIRS_SQL}) p JOIN ({CADENCE_SQL}) c USING (channel)),
n AS (SELECT job_id, channel, node, bin, avg(value) AS v, max(ts_ms) AS ts_ms FROM b GROUP BY ALL)
SELECT job_id, channel, bin, avg(v) AS value, max(ts_ms) AS ts, count(*) AS n_nodes FROM n GROUP BY job_id, channel, bin"""

GROUP_SERIES_SQL = f"""
WITH s AS ({SERIES_SQL}),
m AS (SELECT * FROM (VALUES ('traffic', 'click'), ('traffic', 'view'), ('failure', 'error'), ('sales', 'purchase')) AS v(grp, channel)),
t AS (SELECT job_id, avg(value) AS total FROM s WHERE channel = 'signup' GROUP BY job_id)
SELECT job_id, grp, bin, avg(value) AS value FROM s JOIN m USING (channel) GROUP BY job_id, grp, bin
UNION ALL
SELECT a.job_id, 'net', a.bin, t.total - a.value - b.value FROM s a JOIN s b ON a.job_id = b.job_id AND a.bin = b.bin AND b.channel = 'view'
JOIN t ON t.job_id = a.job_id WHERE a.channel = 'click'"""

STATS_SQL = f"""
SELECT job_id, grp, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std FROM ({GROUP_SERIES_SQL}) GROUP BY job_id, grp"""

WIDE_COLS = [f"{g}__{s}" for g in GROUP_NAMES for s in features.STATS]

WIDE_SQL = (
    "SELECT job_id, "
    + ", ".join(f"max({s}) FILTER (grp = '{g}') AS {g}__{s}" for g in GROUP_NAMES for s in features.STATS)
    + f" FROM ({STATS_SQL}) GROUP BY job_id"
)


def series(spark, sf):
    beats = base.channel_table(spark)
    pairs = base.window_pairs(spark, sf).join(beats, "channel")
    return features.window_series(pairs, job="job_id", channel="channel", node="node", ts="ts_ms", t0="t0_ms", value="value", cadence_s="cadence_s")


def stats(spark, sf):
    grouped = features.group_series(series(spark, sf), base.GROUPS, job="job_id", channel="channel", composed=base.COMPOSED)
    return features.group_stats(grouped, job="job_id")


def wide(spark, sf):
    return features.wide_stats(stats(spark, sf), GROUP_NAMES, job="job_id")


@query(f"SELECT job_id, {', '.join(f'round({c}, 6) AS {c}' for c in WIDE_COLS)} FROM ({WIDE_SQL})")
def window_features(spark, sf):
    return rounded(wide(spark, sf), *WIDE_COLS)


@query(f"SELECT job_id, channel, bin, round(value, 6) AS value, ts, n_nodes FROM ({SERIES_SQL})")
def two_level_mean(spark, sf):
    return rounded(series(spark, sf), "value")


@query(f"SELECT job_id, bin, round(value, 6) AS value FROM ({GROUP_SERIES_SQL}) WHERE grp = 'net'")
def composed_series(spark, sf):
    grouped = features.group_series(series(spark, sf), {"net": base.GROUPS["net"]}, job="job_id", channel="channel", composed=base.COMPOSED)
    return rounded(grouped.select("job_id", "bin", "value"), "value")


@query(f"SELECT job_id, grp, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std FROM ({STATS_SQL})")
def group_stats(spark, sf):
    return rounded(stats(spark, sf), "min", "max", "mean", "std")


ONE_HOT_SQL = (
    "SELECT job_id, "
    + ", ".join(f"(queue = '{q}')::INTEGER AS b0_queue_{q}" for q in "12345")
    + f", price AS b0_price, run_time::DOUBLE AS b0_run_time FROM ({JOBS_SQL})"
)


def request(spark, sf):
    jobs = base.jobs(spark, sf)
    return features.request_columns(jobs, categories={"queue": features.category_list(jobs, "queue")}, numeric=["price", "run_time"])


@query(ONE_HOT_SQL)
def one_hot_request(spark, sf):
    frame, names = request(spark, sf)
    return frame.select("job_id", *names)


@query(f"""
SELECT 'b0_run_time' AS column_name, count(run_time) AS n FROM ({JOBS_SQL})""")
def forbidden_columns(spark, sf):
    # the leakage guard names the offending column; its filled rows are counted
    frame, names = request(spark, sf)
    bad = features.forbidden_columns(names, ["runtime", "run_time", "end_time", "user_id", "nodes_alloc"])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(F.col(c)).alias("n")) for c in bad])
    return frame.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


ASSEMBLED_SQL = f"""
SELECT j.job_id, j.user_id, j.job_state, j.value AS amount, w.* EXCLUDE (job_id) FROM ({SALES_SQL}) j LEFT JOIN ({WIDE_SQL}) w USING (job_id)"""


def assembled(spark, sf):
    jobs = base.sales(spark, sf).select("job_id", "user_id", "job_state", F.col("value").alias("amount"), "target_a", "target_b", "end_time")
    flags = base.sales(spark, sf).select("job_id")
    return features.assemble(jobs, flags, wide(spark, sf), job="job_id")


@query(f"SELECT job_id, user_id, job_state, amount, {', '.join(f'round({c}, 6) AS {c}' for c in WIDE_COLS)} FROM ({ASSEMBLED_SQL})")
def feature_assembly(spark, sf):
    out = assembled(spark, sf).select("job_id", "user_id", "job_state", "amount", *WIDE_COLS)
    return rounded(out, *WIDE_COLS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM ({ASSEMBLED_SQL})" for c in WIDE_COLS))
def missing_share(spark, sf):
    return rounded(features.missing_shares(assembled(spark, sf), WIDE_COLS), "missing_share")


@query(f"""
SELECT job_state, round(avg(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in WIDE_COLS)} THEN 1.0 ELSE 0.0 END), 6) AS any_missing_share
FROM ({ASSEMBLED_SQL}) GROUP BY job_state""")
def any_missing_share(spark, sf):
    out = assembled(spark, sf).groupBy("job_state").agg(F.avg(features.any_missing(WIDE_COLS).cast("double")).alias("any_missing_share"))
    return rounded(out, "any_missing_share")


# ------------------------------------------------------------------ placebos over the order lines

PLACEBO_GROUPS = ["quantity", "price"]

LINE_STATS_SQL = (
    "SELECT l_orderkey AS job_id, "
    + ", ".join(
        f"min({c}) AS {g}__min, max({c}) AS {g}__max, avg({c}) AS {g}__mean, stddev_pop({c}) AS {g}__std"
        for g, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"))
    )
    + " FROM lineitem GROUP BY l_orderkey"
)


def line_stats(spark, sf):
    aggs = []
    for g, c in (("quantity", "l_quantity"), ("price", "l_extendedprice")):
        aggs += [F.min(c).alias(f"{g}__min"), F.max(c).alias(f"{g}__max"), F.avg(c).alias(f"{g}__mean"), F.stddev_pop(c).alias(f"{g}__std")]
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(*aggs)


N_PLACEBOS = 20


def _placebo_columns(k: int, group: str) -> str:
    return ", ".join(f"round(max(g.{group}__{s}) FILTER (number = {k}), 6) AS placebo{k:02d}__{s}" for s in features.STATS)


@query(f"""
WITH s AS ({LINE_STATS_SQL}), q AS (SELECT *, row_number() OVER (ORDER BY job_id) - 1 AS i FROM s), m AS ({permute.scramble_sql('q', 42, N_PLACEBOS)})
SELECT t.job_id, {', '.join(_placebo_columns(k, PLACEBO_GROUPS[k % 2]) for k in range(N_PLACEBOS))}
FROM q t JOIN m ON m.x = t.i JOIN q g ON g.i = m.i GROUP BY t.job_id""")
def placebo_permutation(spark, sf):
    made = features.placebos(line_stats(spark, sf), key="job_id", groups=PLACEBO_GROUPS, count=N_PLACEBOS, seed=42, name="placebo")
    return rounded(made, *[c for c in made.columns if c != "job_id"])


@query(f"""
WITH s AS (SELECT job_id, quantity__mean AS m FROM ({LINE_STATS_SQL})),
d AS (SELECT v, sum(d) AS net FROM (SELECT CASE WHEN job_id % 101 = 5 THEN m + 1000 ELSE m END AS v, 1 AS d FROM s UNION ALL SELECT m, -1 FROM s) GROUP BY v)
SELECT count(*) FILTER (net <> 0) AS mismatches, (SELECT count(*) FROM s) AS jobs FROM d""")
def marginal_check(spark, sf):
    """A placebo has the values of its column, each as often; every 101st job's real value is moved away, which the check counts."""
    right = line_stats(spark, sf)
    made = features.placebos(right, key="job_id", groups=PLACEBO_GROUPS, count=2, seed=42, name="placebo")
    moved = F.when(F.col("job_id") % 101 == 5, F.col("quantity__mean") + 1000).otherwise(F.col("quantity__mean"))
    real = right.withColumn("quantity__mean", moved)
    odd = checks.marginal_mismatches(real, made, "quantity__mean", "placebo00__mean")
    found = odd.agg(F.count("*").alias("mismatches"), F.lit(0).cast("bigint").alias("jobs"))
    counted = made.agg(F.lit(0).cast("bigint").alias("mismatches"), F.count("*").alias("jobs"))
    return found.unionByName(counted).agg(F.sum("mismatches").alias("mismatches"), F.sum("jobs").alias("jobs"))
