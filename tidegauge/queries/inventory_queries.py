"""Channel inventory and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import checks, cohort, completeness, inventory, splits
from tidegauge.operators.small import literal_table
from tidegauge.queries import base
from tidegauge.queries.base import CADENCE_SQL, LINES_SQL, PAIRS_SQL, READINGS_SQL, SALES_SQL, WINDOW_S, query, rounded
from tidegauge.session import materialize, scratch_path
from tidegauge.sources import tables

MAX_S = 86_400


def inventory_sql(readings: str, max_s: int) -> str:
    return f"""
WITH p AS (SELECT channel, node, value,
    floor((ts_ms - lag(ts_ms) OVER w) / 1000)::BIGINT AS gap, value - lag(value) OVER w AS change
  FROM ({readings}) WINDOW w AS (PARTITION BY channel, node ORDER BY ts_ms, value)),
h AS (SELECT channel, least(gap, {max_s}) AS interval_s, count(*) AS n FROM p WHERE gap IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY channel ORDER BY interval_s) AS cum, sum(n) OVER (PARTITION BY channel) AS tot FROM h),
m AS (SELECT channel, arg_max(interval_s, n * 1000000 - interval_s) FILTER (interval_s > 0 AND interval_s < {max_s}) AS mode_s,
    min(interval_s) FILTER (cum >= tot / 2) AS median_interval_s, max(tot) AS tot FROM c GROUP BY channel),
t AS (SELECT channel, count(*) AS rows, count(DISTINCT node) AS nodes, count(*) FILTER (change > 0) AS rises,
    count(*) FILTER (change < 0) AS falls, count(*) FILTER (value = 0) AS zeros, min(value) AS vmin, max(value) AS vmax FROM p GROUP BY channel)
SELECT t.channel, rows, nodes, coalesce(mode_s, 0) AS cadence_s, median_interval_s,
  round(coalesce(h.n, 0) / m.tot, 6)::DOUBLE AS share_at_cadence, rises, falls,
  round(rises / nullif(rises + falls, 0), 6) AS rises_share, coalesce(rises / nullif(rises + falls, 0) >= 0.99, false) AS cumulative,
  round(zeros / rows, 6) AS zero_share, vmin = vmax AS constant, vmin, vmax
FROM t LEFT JOIN m USING (channel) LEFT JOIN h ON h.channel = t.channel AND h.interval_s = coalesce(mode_s, 0)"""


HIST_SQL = f"""
WITH p AS (SELECT channel, floor((ts_ms - lag(ts_ms) OVER (PARTITION BY channel, node ORDER BY ts_ms, value)) / 1000)::BIGINT AS gap FROM ({READINGS_SQL}))
SELECT channel, least(gap, {MAX_S}) AS interval_s, count(*) AS n FROM p WHERE gap IS NOT NULL GROUP BY ALL"""


def _cells(spark, sf):
    cells, _ = inventory.interval_cells(base.readings(spark, sf), channel="channel", node="node", ts_ms="ts_ms", value="value", max_interval_s=MAX_S)
    return cells


def _inventory(spark, sf):
    return inventory.channel_inventory(base.readings(spark, sf), channel="channel", node="node", ts_ms="ts_ms", value="value", max_interval_s=MAX_S)


@query(HIST_SQL)
def interval_histogram(spark, sf):
    return inventory.interval_histogram(_cells(spark, sf), channel="channel")


@query(f"""
WITH h AS (SELECT * FROM ({HIST_SQL}) WHERE interval_s < 3600)
SELECT channel, interval_s, n, round(n / sum(n) OVER (PARTITION BY channel), 6) AS share FROM h""")
def interval_head_shares(spark, sf):
    hist = inventory.interval_histogram(_cells(spark, sf), channel="channel")
    return rounded(inventory.head_shares(hist, channel="channel", bins=3600), "share")


@query(inventory_sql(READINGS_SQL, MAX_S))
def channel_inventory(spark, sf):
    return rounded(_inventory(spark, sf), "share_at_cadence", "rises_share", "zero_share")


@query(inventory_sql(READINGS_SQL, MAX_S))
def inventory_by_weeks(spark, sf):
    """The same inventory from states kept per channel and week; later weeks are added without reading earlier ones."""
    path = scratch_path(spark, "inventory-weeks")
    units = ["channel", "week"]
    weekly = base.readings(spark, sf).withColumn("week", F.floor(F.col("ts_ms") / (7 * 24 * 3_600_000)))
    names = {"channel": "channel", "node": "node", "ts_ms": "ts_ms", "value": "value", "max_interval_s": MAX_S}
    weeks = sorted(r.week for r in weekly.select("week").distinct().collect())  # a row per week

    def extract(todo):
        parts = None
        for week in sorted({w for _, w in todo}):
            part = weekly.filter((F.col("week") == week) & F.col("channel").isin([c for c, w in todo if w == week]))
            part = inventory.interval_state(part, **names).withColumn("week", F.lit(week).cast("bigint"))
            parts = part if parts is None else parts.unionByName(part)
        return materialize(parts, "inventory-state")

    for known in (weeks[:1], weeks):
        wanted = literal_table(spark, [(c, w) for c in base.CHANNELS for w in known], "channel string, week bigint")
        tables.refresh_units(spark, path, f"{path}_ledger", wanted, extract, directories=units, sort_by=["interval_s", "e_ts_ms", "e_node"])
    state = tables.committed_units(spark, path, f"{path}_ledger", directories=units)
    cells, nodes = inventory.merge_states(state, **names)
    return rounded(inventory.inventory_of(cells, nodes, channel="channel", max_interval_s=MAX_S), "share_at_cadence", "rises_share", "zero_share")


@query(inventory_sql(LINES_SQL, 864_000))
def line_channel_inventory(spark, sf):
    # many readings share a timestamp here, so 0 s intervals and ties are the rule
    out = inventory.channel_inventory(
        base.line_readings(spark, sf), channel="channel", node="node", ts_ms="ts_ms", value="value", max_interval_s=864_000, chunk_ms=28 * 86_400_000
    )
    return rounded(out, "share_at_cadence", "rises_share", "zero_share")


@query(f"""
WITH i AS ({inventory_sql(READINGS_SQL, MAX_S)})
SELECT channel, cadence_s, median_interval_s FROM i WHERE cadence_s <> median_interval_s""")
def cadence_mismatches(spark, sf):
    return checks.cadence_mismatches(_inventory(spark, sf)).select("channel", "cadence_s", "median_interval_s")


def _with_source(inv):
    return inv.withColumn("source", F.when(F.col("channel").isin(base.SOURCES["shop"]), "shop").otherwise("web"))


@query(f"""
WITH i AS (SELECT *, CASE WHEN channel IN ('purchase', 'error') THEN 'shop' ELSE 'web' END AS source FROM ({inventory_sql(READINGS_SQL, MAX_S)}))
SELECT source, count(*) AS channels, median(rows) AS median_rows, max(rows) AS max_rows,
  arg_max(channel, ROW(rows, channel)) AS largest FROM i GROUP BY source""")
def inventory_sizes(spark, sf):
    return inventory.size_summary(_with_source(_inventory(spark, sf)), channel="channel", by="source")


@query(f"""
WITH i AS (SELECT *, CASE WHEN channel IN ('purchase', 'error') THEN 'shop' ELSE 'web' END AS source FROM ({inventory_sql(READINGS_SQL, MAX_S)})),
g AS (SELECT * FROM (VALUES (0, 'traffic', 0, 'click'), (0, 'traffic', 1, 'view'), (1, 'failure', 0, 'error'), (2, 'sales', 0, 'purchase'),
  (3, 'net', 0, 'signup'), (3, 'net', 1, 'click'), (3, 'net', 2, 'view')) AS v(position, grp, slot, channel))
SELECT position, grp AS "group", arg_min(source, slot) AS source, string_agg(channel, ', ' ORDER BY slot) AS channels,
  array_to_string(list_sort(list(DISTINCT cadence_s)), '/') AS cadence_s
FROM g JOIN i USING (channel) GROUP BY position, grp""")
def metric_groups(spark, sf):
    return inventory.metric_groups(_with_source(_inventory(spark, sf)), base.GROUPS, channel="channel", source="source")


@query(f"""
WITH i AS ({inventory_sql(READINGS_SQL, MAX_S)})
SELECT constant, string_agg(channel, ', ' ORDER BY rows, channel) AS channels FROM i GROUP BY constant""")
def channels_by_trait(spark, sf):
    inv = _inventory(spark, sf).withColumn("at", F.struct("rows", F.col("channel").alias("c")))
    return inventory.list_by(inv, "constant", "channel", "at", "channels")


# ------------------------------------------------------------------ completeness

COUNTS_SQL = f"SELECT channel, job_id, node, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY channel, job_id, node"

FRACTIONS_SQL = f"""
SELECT c.channel, job_id, node, n, {float(WINDOW_S)} / cadence_s AS expected, least(n, {float(WINDOW_S)} / cadence_s) / ({float(WINDOW_S)} / cadence_s) AS frac
FROM ({COUNTS_SQL}) k JOIN ({CADENCE_SQL}) c USING (channel)"""

JOB_FRAC_SQL = f"SELECT channel, job_id, sum(frac) / 2 AS frac FROM ({FRACTIONS_SQL}) GROUP BY channel, job_id"

TYPICAL_SQL = f"""
SELECT channel, max(expected) AS expected, quantile_cont(frac, 0.5) AS median, quantile_cont(frac, 0.25) AS p25, quantile_cont(frac, 0.75) AS p75,
  avg(CASE WHEN frac >= 0.8 THEN 1.0 ELSE 0.0 END) AS share_ge FROM ({FRACTIONS_SQL}) GROUP BY channel"""

FIXED = {"R10": 0.10, "R25": 0.25, "R50": 0.50, "R1": 1e-6}
RELATIVE = {"Rrel": 0.8}

THRESHOLDS_SQL = f"""
SELECT channel, rule, threshold FROM ({TYPICAL_SQL}), (VALUES {', '.join(f"('{r}', {v}::DOUBLE)" for r, v in FIXED.items())}) AS r(rule, threshold)
UNION ALL SELECT channel, 'Rrel', 0.8 * median FROM ({TYPICAL_SQL})"""

#: dense form: every (job, channel), absent ones 0
MEMBERS_SQL = f"""
SELECT j.job_id, t.rule FROM ({SALES_SQL}) j CROSS JOIN ({THRESHOLDS_SQL}) t LEFT JOIN ({JOB_FRAC_SQL}) f ON f.job_id = j.job_id AND f.channel = t.channel
GROUP BY j.job_id, t.rule HAVING bool_and(coalesce(f.frac, 0.0) >= t.threshold - 1e-9)"""


def node_fractions(spark, sf):
    counts = completeness.reading_counts(base.window_pairs(spark, sf), ["channel", "job_id", "node"])
    return completeness.node_fractions(counts, base.channel_table(spark), channel="channel", window_s=WINDOW_S)


def job_fractions(spark, sf, fractions=None):
    nodes = completeness.nodes_per_job(base.sale_windows(spark, sf), job="job_id")
    return completeness.job_fractions(fractions or node_fractions(spark, sf), nodes, job="job_id", channel="channel")


def members(spark, sf):
    fractions = node_fractions(spark, sf)
    typical = completeness.typical_delivery(fractions, channel="channel")
    thresholds = completeness.rule_thresholds(typical, FIXED, channel="channel", relative=RELATIVE)
    return completeness.rule_membership(job_fractions(spark, sf, fractions), thresholds, job="job_id", channel="channel")


@query(f"SELECT channel, job_id, round(frac, 6) AS frac FROM ({JOB_FRAC_SQL})")
def completeness_fraction(spark, sf):
    return rounded(job_fractions(spark, sf), "frac")


@query(f"SELECT channel, expected, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(share_ge, 6) AS share_ge FROM ({TYPICAL_SQL})")
def typical_delivery(spark, sf):
    out = completeness.typical_delivery(node_fractions(spark, sf), channel="channel")
    return rounded(out, "median", "p25", "p75", "share_ge")


@query(MEMBERS_SQL)
def completeness_rules(spark, sf):
    return members(spark, sf)


def _rule_rows(spark, sf):
    # a stage boundary: the splits read these rows twice
    return materialize(base.sales(spark, sf).join(members(spark, sf), "job_id"), "rule-rows")


SPLIT_LIMITS_SQL = """
e AS (SELECT {pop}, {end} AS end_at, count(*) AS n, count(*) FILTER (target_a = 1) AS pos FROM src GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS run_n, sum(pos) OVER w AS run_pos, sum(n) OVER (PARTITION BY {pop}) AS tot_n, sum(pos) OVER (PARTITION BY {pop}) AS tot_pos
  FROM e WINDOW w AS (PARTITION BY {pop} ORDER BY end_at)),
o AS (SELECT {pop}, min(end_at) FILTER (run_n >= round_even(0.8 * tot_n, 0)) AS main_cut, min(end_at) FILTER (run_pos >= tot_pos / 3) AS b1,
  min(end_at) FILTER (run_pos >= 2 * tot_pos / 3) AS b2 FROM r GROUP BY {pop}),
k AS (SELECT r.*, o.main_cut, o.b1, o.b2, CASE WHEN end_at <= b1 THEN 1 WHEN end_at <= b2 THEN 2 ELSE 3 END AS block FROM r JOIN o USING ({pop})),
z AS (SELECT {pop}, block, min(run_n - n) AS before, max(run_n) AS upto FROM k GROUP BY ALL),
i AS (SELECT {pop}, block, min(end_at) FILTER (run_n - before >= round_even(0.8 * (upto - before), 0) AND round_even(0.8 * (upto - before), 0) > 0) AS cut
  FROM k JOIN z USING ({pop}, block) GROUP BY ALL),
lim AS (SELECT o.*, max(cut) FILTER (block = 1) AS cut1, max(cut) FILTER (block = 2) AS cut2, max(cut) FILTER (block = 3) AS cut3
  FROM o JOIN i USING ({pop}) GROUP BY ALL),
mem AS (
  SELECT src.*, 'main' AS split, CASE WHEN {end} <= main_cut THEN 'train' ELSE 'test' END AS role FROM src JOIN lim USING ({pop})
  UNION ALL
  SELECT src.*, CASE WHEN {end} <= b1 THEN 'block1' WHEN {end} <= b2 THEN 'block2' ELSE 'block3' END,
    CASE WHEN {end} <= (CASE WHEN {end} <= b1 THEN cut1 WHEN {end} <= b2 THEN cut2 ELSE cut3 END) THEN 'train' ELSE 'test' END
  FROM src JOIN lim USING ({pop}))"""

VIABILITY_SQL = f"""
WITH src AS (SELECT j.* EXCLUDE (nodes), m.rule FROM ({SALES_SQL}) j JOIN ({MEMBERS_SQL}) m USING (job_id)),
{SPLIT_LIMITS_SQL.format(pop='rule', end='end_time')},
v AS (SELECT rule, count(*) FILTER (split = 'main') AS jobs, count(*) FILTER (split = 'main' AND target_a = 1) AS pos_a,
  count(*) FILTER (split = 'main' AND target_b = 1) AS pos_b,
  {', '.join(f"count(*) FILTER (split = '{s}' AND role = 'test' AND target_{t} = 1) AS {s}_test_pos_{t}" for s in ('main', 'block1', 'block2', 'block3') for t in 'ab')},
  count(DISTINCT user_id) FILTER (split = 'main' AND role = 'test' AND target_a = 1) AS users_with_failure_in_main_test
FROM mem GROUP BY rule),
zz AS (SELECT r.rule, COLUMNS(v.* EXCLUDE (rule)) FROM (VALUES {', '.join(f"('{r}')" for r in (*FIXED, *RELATIVE))}) AS r(rule) LEFT JOIN v ON v.rule = r.rule),
yy AS (SELECT rule, coalesce(COLUMNS(* EXCLUDE (rule)), 0) FROM zz)
SELECT *, least(block1_test_pos_a, block2_test_pos_a, block3_test_pos_a) AS min_block_pos FROM yy"""


def viability(spark, sf):
    placed = splits.temporal_splits(_rule_rows(spark, sf), population="rule", end="end_time", positive=F.col("target_a") == 1)
    return splits.rule_viability(placed, rule="rule", user="user_id", targets=base.SUFFIX, main="target_a", rules=[*FIXED, *RELATIVE])


@query(VIABILITY_SQL)
def rule_viability(spark, sf):
    return viability(spark, sf)


@query(f"""
WITH v AS ({VIABILITY_SQL}), t AS (SELECT bool_and(median >= 0.8) AS t1 FROM ({TYPICAL_SQL})),
c AS (SELECT t1, CASE WHEN t1 AND bool_or(rule = 'R25' AND min_block_pos >= 10) THEN 'R25'
  WHEN bool_or(rule = 'Rrel' AND min_block_pos >= 10) THEN 'Rrel' ELSE 'R1' END AS primary_rule FROM v, t GROUP BY t1)
SELECT rule, jobs, min_block_pos, t1, min_block_pos >= 10 AS t2, primary_rule,
  CASE WHEN rule = primary_rule THEN 'primary' WHEN rule NOT IN ('R25', 'Rrel', 'R1') AND min_block_pos >= 10 THEN 'not in procedure'
    WHEN min_block_pos < 10 THEN 'fails T2' WHEN rule = 'R25' AND NOT t1 THEN 'fails T1' ELSE 'not needed' END AS outcome
FROM v, c""")
def primary_rule(spark, sf):
    t1 = completeness.typical_test(completeness.typical_delivery(node_fractions(spark, sf), channel="channel"))
    out = completeness.choose_rule(viability(spark, sf), t1, floor=10, strict="R25", relative="Rrel", fallback="R1")
    return out.select("rule", "jobs", "min_block_pos", "t1", "t2", "primary_rule", "outcome")


FLAGS_SQL = f"""
SELECT j.job_id, {', '.join(f"round(coalesce(max(frac) FILTER (channel = '{c}'), 0.0), 6) AS frac_{c}" for c in base.CHANNELS)},
  (j.job_id IN (SELECT job_id FROM ({MEMBERS_SQL}) WHERE rule = 'R1'))::INTEGER AS complete,
  (j.job_id IN (SELECT job_id FROM ({MEMBERS_SQL}) WHERE rule = 'R25'))::INTEGER AS complete_strict,
  (count(*) FILTER (channel IN ('click', 'view', 'signup') AND frac > 0) = 3)::INTEGER AS has_web,
  (count(*) FILTER (channel IN ('purchase', 'error') AND frac > 0) = 2)::INTEGER AS has_shop
FROM ({SALES_SQL}) j LEFT JOIN ({JOB_FRAC_SQL}) f USING (job_id) GROUP BY j.job_id"""


def flags(spark, sf):
    fractions = node_fractions(spark, sf)
    per_job = job_fractions(spark, sf, fractions)
    typical = completeness.typical_delivery(fractions, channel="channel")
    rules = completeness.rule_thresholds(typical, FIXED, channel="channel", relative=RELATIVE)
    return completeness.completeness_table(
        base.sales(spark, sf), per_job, completeness.rule_membership(per_job, rules, job="job_id", channel="channel"), job="job_id", channel="channel",
        channels=base.CHANNELS, rules={"R1": "complete", "R25": "complete_strict"}, sources=base.SOURCES,
    )


@query(FLAGS_SQL)
def completeness_flags(spark, sf):
    return rounded(flags(spark, sf), *[f"frac_{c}" for c in base.CHANNELS])


@query(f"SELECT job_id FROM ({FLAGS_SQL}) WHERE job_id % 5 = 2 AND (complete_strict = 1 OR complete = 0)")
def subset_violations(spark, sf):
    """A fifth of the jobs have the two flags made wrong: the larger population loses them, or the smaller one takes them in."""
    wrong = F.col("job_id") % 5 == 2
    odd = flags(spark, sf).withColumn("__s", F.col("complete_strict"))
    odd = odd.withColumn("complete_strict", F.when(wrong & (F.col("complete") == 0), 1).otherwise(F.col("complete_strict")))
    odd = odd.withColumn("complete", F.when(wrong & (F.col("__s") == 1), 0).otherwise(F.col("complete")))
    return checks.subset_violations(odd, "complete_strict", "complete").select("job_id")


@query(f"""
SELECT count(DISTINCT median) FILTER (cadence_s = 43200) AS distinct_medians, max(median) FILTER (cadence_s = 43200) AS max_median,
  min(median) FILTER (cadence_s <> 43200) AS min_median_others
FROM ({TYPICAL_SQL}) JOIN ({CADENCE_SQL}) USING (channel)""")
def delivery_spread(spark, sf):
    typical = completeness.typical_delivery(node_fractions(spark, sf), channel="channel")
    return completeness.delivery_spread(typical.join(base.channel_table(spark), "channel"), F.col("cadence_s") == 43200)


@query(f"""
WITH c AS (SELECT j.job_state, strftime(j.start_time, '%Y-%m-%d') AS day, j.value > 30 AS kind, f.complete AS flag FROM ({SALES_SQL}) j JOIN ({FLAGS_SQL}) f USING (job_id)),
d AS (SELECT job_state, flag, flag - avg(flag) OVER (PARTITION BY day) AS d1, flag - avg(flag) OVER (PARTITION BY day, kind) AS d2 FROM c),
a AS (SELECT job_state, count(*) AS jobs, avg(flag) AS s, avg(d1) AS e1, avg(d2) AS e2 FROM d GROUP BY job_state)
SELECT o.job_state, o.position, a.jobs, round(s, 6) AS flag_share, round(e1, 6) + 0.0 AS excess_same_day, round(e2, 6) + 0.0 AS excess_same_day_kind
FROM (VALUES ('O', 0), ('F', 1), ('P', 2)) AS o(job_state, position) LEFT JOIN a USING (job_state)""")
def complete_data_by_state(spark, sf):
    joined = base.sales(spark, sf).join(flags(spark, sf), "job_id")
    frame = joined.select("job_state", F.date_format("start_time", "yyyy-MM-dd").alias("day"), (F.col("value") > 30).alias("kind"), F.col("complete").alias("flag"))
    out = cohort.excess_by_state(frame, "job_state", "flag", "day", "kind", ["O", "F", "P"])
    return rounded(out, "flag_share", "excess_same_day", "excess_same_day_kind")
