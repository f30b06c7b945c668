"""Cohorts, labels, profiles, populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import checks, cohort
from tidegauge.queries import base
from tidegauge.queries.base import JOBS_SQL, query, rounded, table


@query(f"""
SELECT job_id, job_state, run_time AS runtime_s, epoch_us(start_time) // 1000 AS t0_ms, queue FROM ({JOBS_SQL})
WHERE start_time >= TIMESTAMP '1996-01-01' AND end_time <= TIMESTAMP '2001-01-31 23:00:00'
  AND job_state IS DISTINCT FROM 'P' AND run_time >= 20000""")
def cohort_filter(spark, sf):
    kept = cohort.select_cohort(
        base.jobs(spark, sf), start="start_time", end="end_time", state="job_state", first_start="1996-01-01 00:00:00",
        last_end="2001-01-31 23:00:00", excluded_state="P", min_runtime_s=20000,
    )
    return kept.select("job_id", "job_state", "runtime_s", "t0_ms", "queue").orderBy("t0_ms", "job_id")


@query("""
SELECT o_orderstatus AS job_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders GROUP BY o_orderstatus""")
def state_share(spark, sf):
    return rounded(cohort.value_shares(base.jobs(spark, sf), ["job_state"]), "share")


@query("SELECT round(avg(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1.0 ELSE 0.0 END), 6) AS failed_share FROM orders")
def union_share(spark, sf):
    return rounded(cohort.union_share(base.jobs(spark, sf), "job_state", ["F", "P"], "failed_share"), "failed_share")


@query(f"SELECT count(*) AS n, epoch_us(min(start_time)) // 1000 AS first, epoch_us(max(end_time)) // 1000 AS last FROM ({JOBS_SQL})")
def table_extent(spark, sf):
    return base.millis(cohort.extent(base.jobs(spark, sf), "start_time", "end_time"), "first", "last")


@query(f"SELECT job_id, target_a, target_b FROM ({JOBS_SQL})")
def three_valued_labels(spark, sf):
    return base.jobs(spark, sf).select("job_id", "target_a", "target_b")


COHORT_TAGS_SQL = f"""
SELECT 'all' AS population, * FROM ({JOBS_SQL})
UNION ALL SELECT 'large' AS population, * FROM ({JOBS_SQL}) WHERE price > 250000"""


@query(f"""
WITH t AS ({COHORT_TAGS_SQL}), l AS (
  SELECT population, 'a' AS target, target_a AS label FROM t UNION ALL SELECT population, 'b', target_b FROM t)
SELECT population, target, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS prevalence
FROM l WHERE label IS NOT NULL GROUP BY population, target""")
def prevalence_by_cohort(spark, sf):
    tagged = cohort.tag_rows(base.jobs(spark, sf), {"all": F.lit(True), "large": F.col("price") > 250000})
    long = cohort.long_labels(tagged, ["population"], base.SUFFIX)
    out = long.groupBy("population", "target").agg(F.sum("label").cast("bigint").alias("positives"), F.avg("label").alias("prevalence"))
    return rounded(out, "prevalence")


@query(f"""
SELECT count(*) AS n, count(*) FILTER (price > 250000) AS kept, count(*) FILTER (NOT price > 250000) AS removed,
  round(avg(CASE WHEN price > 250000 THEN 0.0 ELSE 1.0 END), 6) AS removed_share,
  count(*) FILTER (run_time < 100000) AS removed_by_other,
  count(DISTINCT user_id) FILTER (price > 250000) AS users_kept
FROM ({JOBS_SQL})""")
def distinct_users_conditional(spark, sf):
    flagged = cohort.with_flag(base.jobs(spark, sf), "large", F.col("price") > 250000)
    return rounded(cohort.flag_effect(flagged, "large", F.col("run_time") >= 100000, "user_id"), "removed_share")


@query("""
WITH j AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS nodes FROM lineitem GROUP BY l_orderkey)
SELECT round(lines / nodes, 6) AS ratio, count(*) AS n FROM j GROUP BY round(lines / nodes, 6)""")
def gpu_ratio_distribution(spark, sf):
    per_job = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("nodes"))
    return per_job.groupBy(F.round(C.ratio("lines", "nodes"), 6).alias("ratio")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def key_uniqueness(spark, sf):
    return checks.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS job_id, CAST(floor(o_totalprice) AS BIGINT) + 1 AS run_time FROM orders WHERE o_orderkey % 97 = 3")
def duration_mismatches(spark, sf):
    """Every 97th job is given a wrong recorded duration, which the check has to find, and nothing else."""
    wrong = base.jobs(spark, sf).withColumn("run_time", F.col("run_time") + (F.col("job_id") % 97 == 3).cast("bigint"))
    found = checks.duration_mismatches(wrong, start="start_time", end="end_time", recorded_s="run_time")
    return found.select("job_id", "run_time")


POPULATIONS_SQL = f"""
SELECT 'reference' AS population, * FROM ({JOBS_SQL})
UNION ALL SELECT 'large', * FROM ({JOBS_SQL}) WHERE price > 250000
UNION ALL SELECT 'urgent', * FROM ({JOBS_SQL}) WHERE queue IN ('1', '2')"""


def populations(spark, sf):
    return cohort.tag_rows(
        base.jobs(spark, sf), {"reference": F.lit(True), "large": F.col("price") > 250000, "urgent": F.col("queue").isin("1", "2")}
    )


@query(f"""
SELECT population, count(*) AS jobs, count(DISTINCT user_id) AS users,
  count(*) FILTER (target_a = 1) AS pos_a, round(avg(target_a), 6) AS prev_a,
  count(*) FILTER (target_b = 1) AS pos_b, round(avg(target_b), 6) AS prev_b
FROM ({POPULATIONS_SQL}) GROUP BY population""")
def populations_overlap(spark, sf):
    out = cohort.label_summary(populations(spark, sf), ["population"], base.SUFFIX, "user_id")
    return rounded(out, "prev_a", "prev_b")


@query(f"""
SELECT strftime(start_time, '%Y-%m-%d') AS day, count(*) AS n,
  round(avg(CASE WHEN price > 250000 THEN 1.0 ELSE 0.0 END), 6) AS large_share
FROM ({JOBS_SQL}) GROUP BY 1""")
def coverage_by_day(spark, sf):
    out = cohort.share_by(base.jobs(spark, sf).withColumn("day", C.day_of("start_time")), ["day"], {"large_share": F.col("price") > 250000})
    return rounded(out, "large_share")


@query(f"""
SELECT strftime(end_time, '%Y-%m') AS month, count(*) AS n, round(avg(target_a), 6) AS rate_a
FROM ({JOBS_SQL}) WHERE price > 250000 GROUP BY 1""")
def failure_rate_by_month(spark, sf):
    frame = base.jobs(spark, sf).filter(F.col("price") > 250000).withColumn("month", C.month_of("end_time"))
    return rounded(cohort.share_by(frame, ["month"], {"rate_a": F.col("target_a")}), "rate_a")


@query(f"""
WITH c AS (SELECT job_state, strftime(start_time, '%Y-%m-%d') AS day, queue IN ('1', '2') AS kind,
             CASE WHEN price > 250000 THEN 1.0 ELSE 0.0 END AS flag FROM ({JOBS_SQL})),
d AS (SELECT job_state, flag, flag - avg(flag) OVER (PARTITION BY day) AS d1,
        flag - avg(flag) OVER (PARTITION BY day, kind) AS d2 FROM c),
a AS (SELECT job_state, count(*) AS jobs, avg(flag) AS flag_share, avg(d1) AS e1, avg(d2) AS e2 FROM d GROUP BY job_state)
SELECT o.job_state, o.position, a.jobs, round(a.flag_share, 6) AS flag_share,
  round(a.e1, 6) + 0.0 AS excess_same_day, round(a.e2, 6) + 0.0 AS excess_same_day_kind
FROM (VALUES ('O', 0), ('F', 1), ('P', 2), ('X', 3)) AS o(job_state, position) LEFT JOIN a USING (job_state)""")
def excess_vs_day_type(spark, sf):
    frame = base.jobs(spark, sf).select(
        "job_state", C.day_of("start_time").alias("day"), F.col("queue").isin("1", "2").alias("kind"), (F.col("price") > 250000).cast("int").alias("flag")
    )
    out = cohort.excess_by_state(frame, "job_state", "flag", "day", "kind", ["O", "F", "P", "X"])
    return rounded(out, "flag_share", "excess_same_day", "excess_same_day_kind")


@query(f"""
WITH c AS (SELECT user_id, count(*) AS n FROM ({JOBS_SQL}) WHERE target_a = 1 GROUP BY user_id),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS rn FROM c)
SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS n, round(sum(n) FILTER (rn <= 10) / sum(n), 6) AS top_share FROM r""")
def concentration_topk(spark, sf):
    failures = base.jobs(spark, sf).filter(F.col("target_a") == 1)
    return rounded(cohort.concentration(failures, [], "user_id", 10), "top_share")


@query(f"""
WITH h AS (SELECT job_id, job_state, ('0x' || substr(md5('42|' || job_id), 1, 8))::BIGINT AS u FROM ({JOBS_SQL}))
SELECT job_id, job_state FROM h QUALIFY row_number() OVER (PARTITION BY job_state ORDER BY u, job_id) <= 300""")
def seeded_sample(spark, sf):
    return cohort.seeded_sample(base.jobs(spark, sf).select("job_id", "job_state"), ["job_state"], 300, "job_id", 42)


@query("""
WITH n AS (SELECT l_orderkey AS job_id, count(DISTINCT l_suppkey) AS nodes FROM lineitem GROUP BY l_orderkey)
SELECT round(avg(CASE WHEN nodes > 1 THEN 1.0 ELSE 0.0 END), 6) AS multi_share,
  round(avg(CASE WHEN nodes > 1 THEN 1.0 ELSE 0.0 END) FILTER (o_orderstatus = 'F'), 6) AS multi_share_of_failures,
  round(count(*) FILTER (nodes > 1) / count(*) FILTER (o_orderstatus <> 'P'), 6) AS kept_ratio
FROM n JOIN orders ON job_id = o_orderkey""")
def multi_node_shares(spark, sf):
    nodes = base.job_nodes(spark, sf).groupBy("job_id").agg(F.count("*").alias("nodes"))
    joined = base.jobs(spark, sf).join(nodes, "job_id")
    multi = (F.col("nodes") > 1).cast("double")
    out = joined.agg(
        F.avg(multi).alias("multi_share"),
        F.avg(F.when(F.col("job_state") == "F", multi)).alias("multi_share_of_failures"),
        C.ratio(F.count_if(F.col("nodes") > 1), F.count_if(F.col("job_state") != "P")).alias("kept_ratio"),
    )
    return rounded(out, "multi_share", "multi_share_of_failures", "kept_ratio")


@query("""
SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality, toxic""")
def missing_label_profile(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(cohort.value_shares(joined, ["quality", "toxic"]), "share")
