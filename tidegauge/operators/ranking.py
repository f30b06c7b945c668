"""Rank statistics over compared items (feature sets, groups).

Unless said otherwise a key here holds one row per compared item, a list the
study fixes, so windows over a key are bounded.  For ranks over data-sized keys
use :func:`tidegauge.operators.ordering.average_rank`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators import ordering
from tidegauge.operators.windows import pearson


def holm(df: DataFrame, keys: Sequence[str], p: str, name: str = "p_holm") -> DataFrame:
    """Holm step-down adjusted p-values within ``keys``; ties get equal values.

    An item without a p-value is no test: it does not count, and its adjusted
    value is NULL.
    """
    order = W.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last())
    size = F.count(p).over(W.partitionBy(*keys))
    stepped = df.withColumn("__s", (size - F.row_number().over(order) + 1) * F.col(p))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__s").over(upto)))
    return stepped.withColumn(name, adjusted).drop("__s")


def holm_real_only(gains: DataFrame, keys: Sequence[str], p: str, name: str) -> DataFrame:
    """Holm over the real groups; placebos keep NULL and do not count as tests."""
    real = holm(gains.filter(~F.col("is_placebo")), keys, p, name)
    return real.unionByName(gains.filter("is_placebo"), allowMissingColumns=True)


def average_rank_over(value: str, keys: Sequence[str], descending: bool = True) -> Column:
    """Average rank as a window expression, for keys with few items."""
    order = W.partitionBy(*keys).orderBy(F.desc(value) if descending else F.asc(value))
    ties = F.count("*").over(W.partitionBy(*keys, value))
    return F.rank().over(order) + (ties - 1) / 2.0


def kendall_w(ranks: DataFrame, *, keys: Sequence[str], rater: str, item: str, rank: str) -> DataFrame:
    """Kendall's W with tie correction per key from long (keys, rater, item, rank); NULL if not defined.

    Three small aggregations: rank sums per item, tie sizes per rater, and one
    projection.  Nothing is pivoted, so items and raters may be many.
    """
    per_item = ranks.groupBy(*keys, item).agg(F.sum(rank).alias("s"), F.count("*").alias("c"))
    s = per_item.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("c").alias("m"), (F.var_pop("s") * F.count("*")).alias("S0")
    )
    ties = (
        ranks.groupBy(*keys, rater, rank).agg(F.count("*").alias("t"))
        .groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("T"))
    )
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    den = m * m * (n * n * n - n) - m * F.col("T")
    both = _join(s, ties, keys)
    # the mean rank sum is m(n+1)/2 for any ranking with average ties, so S is n times the population variance
    return both.select(*keys, F.when(den > 0, 12 * F.col("S0") / den).alias("kendall_w"))


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return a.join(b, list(keys))
    # global aggregates: one row each
    return a.withColumn("__g", F.lit(1)).join(F.broadcast(b.withColumn("__g", F.lit(1))), "__g").drop("__g")


def spearman(df: DataFrame, *, keys: Sequence[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Spearman correlation per key: Pearson of average ranks, exact with ties, ranks distributed."""
    rx = ordering.average_rank(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "__rx")
    ranked = ordering.average_rank(rx, keys, y, "__ry")
    return ranked.groupBy(*keys).agg(pearson("__rx", "__ry").alias(name))


def top_memberships(ranks: DataFrame, *, keys: Sequence[str], item: str, rank: str, k: int, name: str) -> DataFrame:
    """In how many rankings an item is within the first ``k``."""
    return ranks.groupBy(*keys, item).agg(F.count_if(F.col(rank) <= k).alias(name))


def chance_top_in_two_of_three(k: int, n: int) -> Column:
    """Probability that a random item is in the top ``k`` of ``n`` in at least two of three rankings."""
    p = F.lit(float(k)) / F.lit(float(n))
    return 3 * p * p * (1 - p) + p * p * p

