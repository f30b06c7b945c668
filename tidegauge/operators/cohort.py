"""Cohort selection, targets, profiles and populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators.small import literal_table


def select_cohort(
    jobs: DataFrame,
    *,
    start: str,
    end: str,
    state: str,
    first_start: str,
    last_end: str,
    excluded_state: str,
    min_runtime_s: int,
) -> DataFrame:
    """Jobs that start at or after ``first_start``, end by ``last_end``, are not in
    ``excluded_state`` and run at least ``min_runtime_s``; adds ``runtime_s`` and ``t0_ms``.

    The comparisons are on the stored columns themselves, so they reach the
    Parquet scan.  A NULL state is kept.
    """
    kind = dict(jobs.dtypes)[start]
    bound = lambda text: F.lit(text).cast(kind)
    return (
        jobs.filter(F.col(start) >= bound(first_start))
        .filter(F.col(end) <= bound(last_end))
        .filter(C.is_not(state, excluded_state))
        .filter(C.seconds_between(start, end) >= min_runtime_s)
        .withColumn("runtime_s", C.seconds_between(start, end).cast("bigint"))
        .withColumn("t0_ms", C.epoch_ms(start))
    )


def with_targets(jobs: DataFrame, state: str, targets: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Adds one three-valued label per entry: name -> (positive states, baseline state)."""
    return jobs.select("*", *[C.three_valued(state, pos, neg).alias(name) for name, (pos, neg) in targets.items()])


def with_flag(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Boolean flag; an unknown condition counts as false."""
    return df.withColumn(name, F.coalesce(condition, F.lit(False)))


def value_shares(df: DataFrame, by: Sequence[str], *, prefix: str = "") -> DataFrame:
    """Count and share of every combination of ``by`` (the counts table is small, the window runs on it)."""
    counts = df.groupBy(*by).agg(F.count("*").alias(f"{prefix}n"))
    return counts.withColumn(f"{prefix}share", F.col(f"{prefix}n") / F.sum(f"{prefix}n").over(W.partitionBy()))


def union_share(df: DataFrame, column: str, values: Sequence[str], name: str) -> DataFrame:
    """Share of rows whose ``column`` is one of ``values`` (one row)."""
    hit = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.agg(F.avg(hit.cast("double")).alias(name))


def extent(df: DataFrame, first: str, last: str) -> DataFrame:
    """Row count, earliest ``first`` and latest ``last`` (one row)."""
    return df.agg(F.count("*").alias("n"), F.min(first).alias("first"), F.max(last).alias("last"))


def flag_effect(df: DataFrame, flag: str, other_criterion: Column, user: str) -> DataFrame:
    """How many rows and users a flag keeps, what it removes, and what another criterion would remove."""
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(flag)).alias("kept"),
        F.count_if(~F.col(flag)).alias("removed"),
        F.avg((~F.col(flag)).cast("double")).alias("removed_share"),
        F.count_if(~other_criterion).alias("removed_by_other"),
        F.countDistinct(F.when(F.col(flag), F.col(user))).alias("users_kept"),
    )


def tag_rows(df: DataFrame, groups: dict[str, Column], name: str = "population") -> DataFrame:
    """One row per population a row belongs to; populations may overlap.

    A narrow explode of an array with ``len(groups)`` slots, so there is one
    scan instead of one per population.
    """
    tags = F.array(*[F.when(cond, F.lit(label)) for label, cond in groups.items()])
    return df.withColumn(name, F.explode(F.filter(tags, lambda t: t.isNotNull())))


def label_summary(df: DataFrame, by: Sequence[str], targets: dict[str, str], user: str | None = None) -> DataFrame:
    """Rows, users, and per target (label column -> suffix) positives and prevalence; NULL labels are skipped."""
    aggs = [F.count("*").alias("jobs")]
    if user is not None:
        aggs.append(F.countDistinct(user).alias("users"))
    for label, suffix in targets.items():
        aggs += [F.count_if(F.col(label) == 1).alias(f"pos_{suffix}"), F.avg(label).alias(f"prev_{suffix}")]
    return df.groupBy(*by).agg(*aggs)


def long_labels(df: DataFrame, ids: Sequence[str], targets: dict[str, str]) -> DataFrame:
    """(ids, target, label): one row per labelled (row, target)."""
    pairs = F.array(*[F.struct(F.lit(suffix).alias("target"), F.col(label).alias("label")) for label, suffix in targets.items()])
    return df.select(*ids, F.explode(F.filter(pairs, lambda p: p["label"].isNotNull())).alias("p")).select(*ids, "p.target", "p.label")


def share_by(df: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Mean of each expression per key (daily coverage, monthly failure rate, ...)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in values.items()])


def excess_by_state(df: DataFrame, state: str, flag: str, day: str, kind: str, order: Sequence[str]) -> DataFrame:
    """Per state: size, share of ``flag``, and mean deviation from the mean of the same day and of the
    same (day, kind), in the fixed state order.

    The deviation of a state only needs counts per (state, day, kind), so the
    data is aggregated once and the day means are taken over that small table.
    """
    cells = df.groupBy(state, day, kind).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("double")).alias("s"))
    by_day, by_both = W.partitionBy(day), W.partitionBy(day, kind)
    dev = cells.select(
        state,
        "n",
        "s",
        (F.col("s") - F.col("n") * F.sum("s").over(by_day) / F.sum("n").over(by_day)).alias("d1"),
        (F.col("s") - F.col("n") * F.sum("s").over(by_both) / F.sum("n").over(by_both)).alias("d2"),
    )
    out = dev.groupBy(state).agg(
        F.sum("n").alias("jobs"),
        (F.sum("s") / F.sum("n")).alias("flag_share"),
        (F.sum("d1") / F.sum("n")).alias("excess_same_day"),
        (F.sum("d2") / F.sum("n")).alias("excess_same_day_kind"),
    )
    return in_fixed_order(out, state, order)


def in_fixed_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row per listed category, in list order (``position``); absent categories get NULLs."""
    ref = literal_table(df.sparkSession, [(v, i) for i, v in enumerate(order)], f"{column} string, position int")
    return ref.join(df, column, "left").orderBy("position")


def seeded_sample(df: DataFrame, strata: Sequence[str], n: int, key: str, seed: int) -> DataFrame:
    """Exactly ``min(n, size)`` rows per stratum, the ones with the smallest seeded hash of the key.

    The group limit runs on the map side first, so a huge stratum sends at
    most ``n`` rows per task.
    """
    w = W.partitionBy(*strata).orderBy(C.hash_u32(seed, F.col(key)), F.col(key))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def concentration(df: DataFrame, by: Sequence[str], key: str, k: int) -> DataFrame:
    """How many keys there are and which share of all rows the ``k`` largest keys hold."""
    by = list(by)
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    top = (
        counts.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), F.asc(key))))
        .filter(F.col("__rn") <= k)
        .groupBy(*by)
        .agg(F.sum("n").alias("__top"))
    )
    total = counts.groupBy(*by).agg(F.count("*").alias("keys"), F.sum("n").alias("n"))
    if by:
        joined = total.join(top, by)
    else:
        # both sides are one global aggregate row
        joined = total.withColumn("__g", F.lit(1)).join(F.broadcast(top.withColumn("__g", F.lit(1))), "__g").drop("__g")
    return joined.withColumn("top_share", F.col("__top") / F.col("n")).drop("__top")
