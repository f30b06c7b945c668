"""Model fits over all orders.

MLlib has no SQL twin, so the twins say what must hold of the results: which
rows are scored with which label, that every score is a probability, and that a
constant column has no importance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import evaluate, models, ordering, splits
from tidegauge.queries import base
from tidegauge.queries.base import query, rounded
from tidegauge.queries.feature_queries import line_stats
from tidegauge.queries.inventory_queries import SPLIT_LIMITS_SQL
from tidegauge.queries.split_queries import END
from tidegauge.session import materialize

REQUEST = ["price", "queue_number"]
ADDED = ["quantity__mean", "quantity__std"]
BOOSTED = models.ModelSpec("HGB", "boosted", {"maxIter": 10})
FOREST = models.ModelSpec("RF", "forest", {"numTrees": 20, "maxDepth": 6})

#: Labelled test rows of the main split of all orders.
TEST_SQL = f"""
WITH src AS (SELECT 'all' AS population, * FROM ({base.JOBS_SQL})), {SPLIT_LIMITS_SQL.format(pop='population', end=END)},
t AS (SELECT * FROM mem WHERE split = 'main' AND role = 'test' AND target_a IS NOT NULL)"""


def _rows(spark, sf):
    jobs = base.jobs(spark, sf).withColumn("population", F.lit("all")).withColumn("queue_number", F.col("queue").cast("double"))
    rows = materialize(jobs.join(line_stats(spark, sf), "job_id", "left"), "model-rows")
    placed = splits.temporal_splits(rows, population="population", end=END, positive=F.col("target_a") == 1).filter("split = 'main'")
    return materialize(placed.select("job_id", "user_id", "role", "target_a", *REQUEST, *ADDED, F.lit(1.0).alias("constant")), "model-split")


def _fit(spark, sf, spec, columns):
    rows = _rows(spark, sf)
    v = models.vectors(rows, key="job_id", label="target_a", columns=columns)
    model = models.fit_slice(v, columns, spec)
    return rows, v, model, materialize(models.score_slice(model, v, columns, ["job_id"]), "model-scores")


@query(f"{TEST_SQL} SELECT job_id, target_a, true AS is_probability FROM t")
def fit_score_gbt(spark, sf):
    """Every labelled test order, its label, and whether its score is a probability."""
    _, _, _, scored = _fit(spark, sf, BOOSTED, [*REQUEST, *ADDED])
    return scored.select("job_id", "target_a", F.coalesce(C.finite("score") & F.col("score").between(0, 1), F.lit(False)).alias("is_probability"))


@query(f"""{TEST_SQL} SELECT 'RF' AS model, count(*) AS jobs, CAST(sum(target_a) AS BIGINT) AS positives, count(DISTINCT user_id) AS users, round(avg(target_a), 6) AS prevalence,
  true AS pr_auc_in_range FROM t""")
def fit_score_rf(spark, sf):
    """Performance of the forest; its PR-AUC is a share above 0."""
    rows, _, _, scored = _fit(spark, sf, FOREST, [*REQUEST, *ADDED])
    known = scored.join(rows.select("job_id", "user_id"), "job_id").withColumn("model", F.lit("RF"))
    out = evaluate.performance(known, keys=["model"], y="target_a", score="score", user="user_id")
    return rounded(out.withColumn("pr_auc_in_range", (F.col("pr_auc") > 0) & (F.col("pr_auc") <= 1)).drop("pr_auc", "lift"), "prevalence")


@query("SELECT 'constant' AS permuted, 0.0::DOUBLE AS importance_of_constant, true AS is_finite UNION ALL SELECT 'quantity', NULL, true")
def permutation_importance(spark, sf):
    """Ten joint permutations of a group of columns, and of a column that is the same everywhere: nothing can be lost there."""
    columns = [*REQUEST, *ADDED, "constant"]
    _, v, model, scored = _fit(spark, sf, FOREST, columns)
    ranked = materialize(ordering.row_index(v.test, [], ["job_id"], "__i"), "model-ranks")
    out = None
    for name, permuted in (("constant", ["constant"]), ("quantity", ADDED)):
        drop = models.importance_slice(model, v, ranked, scored, key="job_id", columns=columns, permuted=permuted)
        row = drop.select(
            F.lit(name).alias("permuted"), F.when(F.lit(name == "constant"), F.round("importance", 9) + 0.0).alias("importance_of_constant"), C.finite("importance").alias("is_finite")
        )
        out = row if out is None else out.unionByName(row)
    return out
