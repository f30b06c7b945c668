"""The relevance rule and what is read from it, over predictions for all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import evaluate, models, ranking, rules
from tidegauge.operators.small import literal_table
from tidegauge.plans import stages
from tidegauge.queries import base
from tidegauge.queries.base import query, rounded
from tidegauge.queries.split_queries import MODELS, N_BOOT, REAL_SETS, SETS, TESTS_SQL, ap_sql, gains_sql, rank_sql, score_arrays, test_scores
from tidegauge.session import at_once, materialize

QUEUES = ["1", "5"]
FLOOR = 300
LONG_SQL = f"""
SELECT 'a' AS target, job_id, user_id, queue, split, model, feature_set, score, target_a AS y FROM ({TESTS_SQL}) WHERE target_a IS NOT NULL
UNION ALL SELECT 'b', job_id, user_id, queue, split, model, feature_set, score, target_b FROM ({TESTS_SQL}) WHERE target_b IS NOT NULL"""


def _by_target(rows, *columns):
    """Labelled rows of both targets."""
    cells = F.array(F.struct(F.lit("a").alias("target"), F.col("target_a").alias("y")), F.struct(F.lit("b").alias("target"), F.col("target_b").alias("y")))
    long = rows.withColumn("c", F.explode(F.filter(cells, lambda c: c["y"].isNotNull())))
    return long.select("c.target", *columns, "c.y")


def predictions(spark, sf):
    return materialize(_by_target(test_scores(spark, sf), "job_id", "user_id", "queue", "split", "model", "feature_set", "score"), "predictions")


def array_predictions(spark, sf, sets):
    """Predictions with an array of scores, one for each of ``sets``; written once per order, both targets."""
    rows = materialize(score_arrays(spark, sf, sets).drop("job_id").filter("target_a IS NOT NULL OR target_b IS NOT NULL"), "predictions")
    return _by_target(rows, "user_id", "queue", "split", "score")


def gains(spark, sf):
    sets = [(m, s) for m in MODELS for s in SETS]
    preds = array_predictions(spark, sf, sets)
    row = ["target", "model", "feature_set"]

    def points():
        cells = materialize(stages.score_table(preds, keys=["target"], queue="queue", sets=sets), "score-table")
        main = materialize(evaluate.added_cells(cells.filter("split = 'main'"), row, "score"), "main-cells")
        ap = evaluate.average_precision_of_cells(main, keys=row, score="score", name="pr_auc")
        prevalence = main.groupBy(*row).agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fp"))).alias("prevalence"))
        # stands in for permutation importance: how far the set ranks above chance
        return cells, ap.join(prevalence, row).select(*row, (F.col("pr_auc") - F.col("prevalence")).alias("importance"))

    (cells, importance), slots = at_once(spark, points, lambda: stages.booted_clusters(preds, keys=["target"], cluster="user_id"))
    return stages.gains_stage(preds, importance, keys=["target"], cluster="user_id", queue="queue", queues=QUEUES, n_boot=N_BOOT, sets=sets, cells=cells, slots=slots)


def final_table(spark, sf):
    return stages.verdict_stage(gains(spark, sf), keys=["target"], queues=QUEUES, floor=FLOOR)


_PIVOT = ["main", "pooled", "block1", "block2", "block3", "queue 1", "queue 5"]

#: the draws of a resample depend on the user list of the test set, so (target, split) is one key here
_BOOT_SQL = gains_sql(
    "SELECT split || target AS split, model, feature_set, user_id, score, y FROM st WHERE model = 'HGB' AND split = 'pooled' AND feature_set NOT LIKE 'placebo%'", N_BOOT
)

GAINS_CTE = f"""
s0 AS MATERIALIZED ({LONG_SQL}),
st AS (SELECT * FROM s0 UNION ALL SELECT * REPLACE ('pooled' AS split) FROM s0 WHERE split LIKE 'block%'
  UNION ALL SELECT * REPLACE ('queue ' || queue AS split) FROM s0 WHERE split = 'main' AND queue IN ('1', '5')),
p AS ({ap_sql('st', 'target, split, model, feature_set')}), n AS (SELECT target, split, model, feature_set, CAST(sum(y) AS BIGINT) AS pos, avg(y) AS prev FROM st GROUP BY ALL),
d AS (SELECT a.target, a.split, a.model, a.feature_set, a.ap - z.ap AS delta, pos, a.ap - prev AS importance FROM p a
  JOIN p z ON z.target = a.target AND z.split = a.split AND z.model = a.model AND z.feature_set = 'B0'
  JOIN n ON n.target = a.target AND n.split = a.split AND n.model = a.model AND n.feature_set = a.feature_set WHERE a.feature_set <> 'B0'),
bt AS MATERIALIZED ({_BOOT_SQL}),
w AS (SELECT target, model, feature_set, {', '.join(f"max(delta) FILTER (split = '{s}') AS delta_{s.replace(' ', '')}, max(pos) FILTER (split = '{s}') AS pos_{s.replace(' ', '')}" for s in _PIVOT)},
  max(importance) FILTER (split = 'main') AS importance FROM d GROUP BY ALL),
g AS (SELECT w.*, bt.ci_low AS ci_pooled_low, bt.ci_high AS ci_pooled_high, bt.p AS p_pooled FROM w LEFT JOIN bt ON bt.split = 'pooled' || w.target AND bt.model = w.model AND bt.feature_set = w.feature_set)"""

_BLOCKS = ("block1", "block2", "block3")

FINAL_SQL = f"""
WITH {GAINS_CTE},
h AS (SELECT *, {', '.join(f"{rank_sql('delta_' + b, 'target')} AS rank_{b}" for b in _BLOCKS)} FROM g WHERE model = 'HGB' AND feature_set NOT LIKE 'placebo%'),
l AS ({' UNION ALL '.join(f"SELECT target, '{b}' AS block, feature_set, rank_{b} AS rank FROM h" for b in _BLOCKS)}),
i AS (SELECT target, feature_set, sum(rank) AS s FROM l GROUP BY ALL), z AS (SELECT target, count(*) AS n FROM i GROUP BY ALL),
q AS (SELECT target, sum((s - 3 * (n + 1) / 2.0) ** 2) AS ss, max(n) AS n FROM i JOIN z USING (target) GROUP BY target),
t AS (SELECT target, sum(c ** 3 - c) AS t FROM (SELECT target, block, rank, count(*) AS c FROM l GROUP BY ALL) GROUP BY target),
k AS (SELECT target, 12 * ss / (9 * (n ** 3 - n) - 3 * t) AS kendall_w FROM q JOIN t USING (target)),
f AS (SELECT target, quantile_cont(importance, 0.95) AS placebo_p95 FROM g WHERE model = 'HGB' AND feature_set LIKE 'placebo%' GROUP BY target),
o AS (SELECT target, feature_set, max(delta_main) FILTER (model = 'RF') AS delta_rf, max(delta_main) FILTER (model = 'LGBM') AS delta_lgbm FROM g GROUP BY ALL),
c AS (SELECT h.*, kendall_w, placebo_p95, delta_rf, delta_lgbm, (rank_block1 <= 3)::INT + (rank_block2 <= 3)::INT + (rank_block3 <= 3)::INT AS top_blocks,
  pos_block1 < {FLOOR} OR pos_block2 < {FLOOR} OR pos_block3 < {FLOOR} AS block_below_floor FROM h JOIN k USING (target) JOIN f USING (target) JOIN o USING (target, feature_set)),
v AS (SELECT *, delta_main > 0 AND ci_pooled_low > 0 AS A,
  CASE WHEN block_below_floor THEN 'inconclusive' WHEN kendall_w >= 0.7 AND top_blocks >= 2 THEN 'pass' ELSE 'fail' END AS B,
  CASE WHEN pos_queue1 < {FLOOR} OR pos_queue5 < {FLOOR} THEN 'waived' WHEN sign(delta_queue1) = sign(delta_main) AND sign(delta_queue5) = sign(delta_main) THEN 'pass' ELSE 'fail' END AS C,
  importance > placebo_p95 AS D, sign(delta_rf) = sign(delta_main) AS E_rf, sign(delta_lgbm) = sign(delta_main) AS E_lgbm FROM c),
x AS (SELECT *, (CASE WHEN A THEN '' ELSE 'A' END) || (CASE WHEN B = 'pass' THEN '' ELSE 'B' END) || (CASE WHEN C = 'fail' THEN 'C' ELSE '' END) || (CASE WHEN D THEN '' ELSE 'D' END) AS abcd FROM v),
y AS (SELECT *, abcd || (CASE WHEN E_rf AND E_lgbm THEN '' ELSE 'E' END) AS failed, abcd || (CASE WHEN E_rf THEN '' ELSE 'E' END) AS failed_plan FROM x)
SELECT *, CASE WHEN failed = '' THEN 'yes' WHEN failed = 'B' AND B = 'inconclusive' THEN 'inconclusive' ELSE 'no' END AS relevant,
  CASE WHEN failed_plan = '' THEN 'yes' WHEN failed_plan = 'B' AND B = 'inconclusive' THEN 'inconclusive' ELSE 'no' END AS relevant_plan_rule FROM y"""

_NUMBERS = ["delta_main", "delta_pooled", "ci_pooled_low", "ci_pooled_high", "delta_rf", "delta_lgbm", "importance", "placebo_p95", "kendall_w"]
_TEXT = ["rank_block1", "rank_block2", "rank_block3", "A", "B", "C", "D", "E_rf", "E_lgbm", "failed", "relevant", "relevant_plan_rule"]


@query(f"SELECT target, feature_set, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _NUMBERS)}, top_blocks::BIGINT AS top_blocks, {', '.join(_TEXT)} FROM ({FINAL_SQL})")
def relevance_rule(spark, sf):
    out = final_table(spark, sf).select("target", "feature_set", *_NUMBERS, F.col("top_blocks").cast("bigint").alias("top_blocks"), *_TEXT)
    return rounded(out, *_NUMBERS)


_REGULATED, _LOAD = ["balance", "price_max"], ["quantity", "lines"]


@query(f"""
WITH f AS MATERIALIZED ({FINAL_SQL}),
t AS (SELECT target, feature_set, row_number() OVER (PARTITION BY target ORDER BY delta_main DESC, feature_set) AS place FROM f WHERE delta_main > 0),
s AS (SELECT target, string_agg(feature_set, ', ' ORDER BY place) AS top_items, count(*) FILTER (feature_set IN ('balance', 'price_max')) AS reg,
  count(*) FILTER (feature_set IN ('quantity', 'lines')) AS load FROM t WHERE place <= 3 GROUP BY target)
SELECT target, coalesce(max(top_items), '') AS top_items, round(max(kendall_w), 6) AS kendall_w, coalesce(max(reg), 0) >= 2 AND max(kendall_w) >= 0.7 AS reading_1,
  coalesce(max(load), 0) >= 2 OR NOT bool_or(A) AS reading_2, bool_or(relevant = 'yes') AS reading_3, max(kendall_w) < 0.7 OR bool_or(block_below_floor) AS reading_4
FROM f LEFT JOIN s USING (target) GROUP BY target""")
def readings(spark, sf):
    out = rules.readings(
        materialize(final_table(spark, sf), "final"), keys=["target"], item="feature_set", classes={"regulated": _REGULATED, "load": _LOAD}, regulated="regulated", driven="load"
    )
    return rounded(out, "kendall_w")


#: outside signals and the set that stands for each (None: nothing comparable)
SIGNALS = [
    ("basket", "quantity", "direct"),
    ("basket", "lines", "proxy (line count)"),
    ("wealth", "balance", "proxy (account balance)"),
    ("weather", None, "absent: no such column"),
]


@query(f"""
WITH m AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}', {'NULL' if g is None else repr(g)}, '{t}')" for i, (s, g, t) in enumerate(SIGNALS))}) AS v(position, signal, feature_set, mapping)),
f AS MATERIALIZED ({FINAL_SQL})
SELECT m.*, coalesce(a.relevant, 'not testable') AS survives_a, coalesce(b.relevant, 'not testable') AS survives_b FROM m
LEFT JOIN f a ON a.feature_set = m.feature_set AND a.target = 'a' LEFT JOIN f b ON b.feature_set = m.feature_set AND b.target = 'b'""")
def signal_survival(spark, sf):
    mapping = literal_table(spark, [(i, *s) for i, s in enumerate(SIGNALS)], "position int, signal string, feature_set string, mapping string")
    return rules.signal_survival(mapping, final_table(spark, sf), item="feature_set", target="target", targets=["a", "b"])


POINT_SQL = f"WITH s0 AS ({LONG_SQL}), p AS ({ap_sql('s0', 'target, split, model, feature_set')})"


@query(f"""
{POINT_SQL}, n AS (SELECT target, split, model, feature_set, avg(y) AS prev FROM s0 GROUP BY ALL),
d AS (SELECT a.target, a.model, a.feature_set, a.ap - z.ap AS delta, a.ap - prev AS importance FROM p a JOIN n USING (target, split, model, feature_set)
  JOIN p z ON z.target = a.target AND z.split = a.split AND z.model = a.model AND z.feature_set = 'B0' WHERE a.split = 'main' AND a.feature_set <> 'B0'),
f AS (SELECT target, model, quantile_cont(importance, 0.95) AS p95 FROM d WHERE feature_set LIKE 'placebo%' GROUP BY ALL)
SELECT target, model, feature_set, round(importance, 6) AS importance, round(p95, 6) AS placebo_p95, round(delta, 6) AS delta_main FROM d JOIN f USING (target, model)
WHERE importance > p95 AND delta < 0 AND feature_set NOT LIKE 'placebo%'""")
def important_without_gain(spark, sf):
    preds = predictions(spark, sf).filter("split = 'main'")
    keys = ["target", "model"]
    perf = evaluate.performance(preds, keys=[*keys, "feature_set"], y="y", score="score", user="user_id")
    perf = perf.withColumn("importance", F.col("pr_auc") - F.col("prevalence")).withColumn("is_placebo", evaluate.is_placebo("feature_set"))
    main = materialize(evaluate.gain_over_baseline(perf, keys=keys, set_col="feature_set", baseline="B0", value="pr_auc", name="delta_main"), "main-gains")
    floor = evaluate.noise_floor(main, keys=keys, importance="importance", gain="delta_main").withColumnRenamed("importance_p95", "placebo_p95")
    found = rules.important_without_gain(main.filter(~F.col("is_placebo")).join(floor, keys))
    return rounded(found.select("target", "model", "feature_set", "importance", "placebo_p95", "delta_main"), "importance", "placebo_p95", "delta_main")


@query(f"""
WITH s0 AS MATERIALIZED ({LONG_SQL}), s AS MATERIALIZED (SELECT target || split AS split, model, feature_set, user_id, score, y FROM
  (SELECT * FROM s0 UNION ALL SELECT * REPLACE ('pooled' AS split) FROM s0 WHERE split LIKE 'block%') WHERE split IN ('main', 'pooled') AND feature_set NOT LIKE 'placebo%'),
g AS (SELECT * FROM ({gains_sql('SELECT * FROM s', N_BOOT)})),
r AS (SELECT split, model, feature_set, p, row_number() OVER (PARTITION BY split, model ORDER BY p, feature_set) AS i, count(*) OVER (PARTITION BY split, model) AS m FROM g)
SELECT substr(split, 1, 1) AS target, substr(split, 2) AS split, model, feature_set, p, round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY split, model ORDER BY i)), 9) AS p_holm FROM r""")
def holm(spark, sf):
    """Holm over the real sets of every target and model, in the main test and the pooled blocks, from 1,000 resamples."""
    sets = [(m, s) for m in MODELS for s in ["B0", *REAL_SETS]]
    preds = evaluate.pooled(array_predictions(spark, sf, sets), split="split", parts=stages.BLOCKS).filter("split IN ('main', 'pooled')")
    out = evaluate.paired_gains(
        preds, test_keys=["target", "split"], set_keys=["model", "feature_set"], set_col="feature_set", baseline="B0", y="y", score="score", cluster="user_id", n_boot=N_BOOT, sets=sets
    )
    adjusted = ranking.holm(out, ["target", "split", "model"], "p")
    return rounded(adjusted.select("target", "split", "model", "feature_set", "p", "p_holm"), "p_holm", digits=9)


@query(f"""
{POINT_SQL}, d AS (SELECT a.target, a.model, a.split, a.feature_set, a.ap - z.ap AS delta FROM p a JOIN p z ON z.target = a.target AND z.split = a.split AND z.model = a.model AND z.feature_set = 'B0'
  WHERE a.feature_set <> 'B0' AND a.feature_set NOT LIKE 'placebo%')
SELECT target, model, count(*) FILTER (delta > 0 AND split = 'main') AS positive_main, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share,
  arg_max(feature_set, ROW(delta, feature_set)) FILTER (split = 'main') AS largest FROM d GROUP BY target, model""")
def gain_counts(spark, sf):
    ap = evaluate.average_precision(predictions(spark, sf), keys=["target", "model", "split", "feature_set"], y="y", score="score", name="ap")
    out = evaluate.gain_over_baseline(ap, keys=["target", "model", "split"], set_col="feature_set", baseline="B0", value="ap", name="delta")
    real, main = out.filter(~evaluate.is_placebo("feature_set")), F.col("split") == "main"
    agg = real.groupBy("target", "model").agg(
        F.count_if(main & (F.col("delta") > 0)).alias("positive_main"), F.avg((F.col("delta") < 0).cast("double")).alias("negative_share"),
        F.max_by("feature_set", F.when(main, F.struct("delta", "feature_set"))).alias("largest"),
    )
    return rounded(agg, "negative_share")


@query("""
WITH g AS (SELECT p_type AS signal, min(p_name) AS first_name FROM part GROUP BY p_type)
SELECT split_part(first_name, ' ', 1) AS kind, count(*) AS signals FROM g GROUP BY 1""")
def mapping_kinds(spark, sf):
    parts = base.table(spark, sf, "part")
    return rules.mapping_kinds(parts, signal="p_type", text="p_name", position="p_name")


@query(f"""
SELECT a.analysis, s.target, s.split, m.model, f.feature_set, s.jobs AS test_jobs FROM
 (VALUES ('primary'), ('secondary')) AS a(analysis), (SELECT target, split, count(DISTINCT job_id) AS jobs FROM ({LONG_SQL}) GROUP BY ALL) s,
 (VALUES ('HGB'), ('RF')) AS m(model), (VALUES ('B0'), ('quantity'), ('lines'), ('placebo00'), ('placebo01')) AS f(feature_set)
WHERE (a.analysis = 'primary' OR m.model = 'HGB') AND (a.analysis = 'primary' OR f.feature_set <> 'lines')""")
def fit_grid(spark, sf):
    hgb, rf = models.ModelSpec("HGB", "boosted"), models.ModelSpec("RF", "forest")
    plans = [
        models.Analysis("primary", "all", ["quantity", "lines"], ["price"], [hgb, rf], "placebo", 2),
        models.Analysis("secondary", "all", ["quantity"], ["price"], [hgb], "placebo", 2),
    ]
    preds = predictions(spark, sf)
    sizes = preds.groupBy("target", "split").agg(F.countDistinct("job_id").alias("test_jobs"))
    return models.grid(preds, plans, ["a", "b"], ["main", "block1", "block2", "block3"]).join(sizes, ["target", "split"])
