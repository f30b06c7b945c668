"""Binned window series, group statistics, request columns and placebos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import ordering, permute
from tidegauge.session import materialize

STATS = ("min", "max", "mean", "std")


def stat_columns(group: str) -> list[str]:
    return [f"{group}__{s}" for s in STATS]


def window_series(
    pairs: DataFrame, *, job: str, channel: str, node: str, ts: str, t0: str, value: str, cadence_s: Column | str | int
) -> DataFrame:
    """(job, channel, bin, value, ts, n_nodes): node means inside each cadence interval, then the mean over nodes.

    Bins count from the job's own start.  The first aggregation is on the full
    key with map-side combine, so neither a large job nor a busy node is a
    single task's problem.
    """
    c = cadence_s if isinstance(cadence_s, Column) else (F.col(cadence_s) if isinstance(cadence_s, str) else F.lit(cadence_s))
    bin_ = C.floor_div(F.col(ts) - F.col(t0), c * 1000)
    per_node = pairs.groupBy(job, channel, node, bin_.alias("bin")).agg(F.avg(C.nan_to_null(value)).alias("v"), F.max(ts).alias("ts"))
    return per_node.groupBy(job, channel, "bin").agg(
        F.avg("v").alias("value"), F.max("ts").alias("ts"), F.count("*").alias("n_nodes")
    )


def group_series(
    series: DataFrame,
    groups: dict[str, Sequence[str]],
    *,
    job: str,
    channel: str,
    composed: dict[str, tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """(job, grp, bin, value): mean over the group's channels present in a bin.

    A composed group ``name: (total, parts)`` is the job's mean of ``total``
    minus the parts of the bin, and exists only in bins that have every part.
    A job has at most channels x bins rows here, so the series is placed by job
    once and all later steps (including :func:`group_stats`) stay local.
    """
    by_job = series.select(job, channel, "bin", "value").repartition(F.col(job))
    plain = {g: chans for g, chans in groups.items() if g not in (composed or {})}
    tags = F.array(*[F.when(F.col(channel).isin(list(chans)), F.lit(g)) for g, chans in plain.items()])
    out = (
        by_job.withColumn("grp", F.explode(F.filter(tags, lambda t: t.isNotNull())))
        .groupBy(job, "grp", "bin")
        .agg(F.avg("value").alias("value"))
    )
    for name, (total, parts) in (composed or {}).items():
        mean_total = F.avg(F.when(F.col(channel) == total, F.col("value"))).over(W.partitionBy(job))
        wide = (
            by_job.filter(F.col(channel).isin([total, *parts]))
            .withColumn("__total", mean_total)
            .groupBy(job, "bin")
            .agg(F.max("__total").alias("__total"), *[F.max(F.when(F.col(channel) == p, F.col("value"))).alias(f"__p{i}") for i, p in enumerate(parts)])
        )
        rest = F.col("__total")
        for i in range(len(parts)):
            rest = rest - F.col(f"__p{i}")
        out = out.unionByName(
            wide.select(job, F.lit(name).alias("grp"), "bin", rest.alias("value")).filter(F.col("value").isNotNull())
        )
    return out


def group_stats(series: DataFrame, *, job: str) -> DataFrame:
    """(job, grp, min, max, mean, std) of a group series; std is the population one."""
    return series.groupBy(job, "grp").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def wide_stats(stats: DataFrame, groups: Sequence[str], *, job: str) -> DataFrame:
    """One row per job, ``<group>__<stat>`` columns; an absent group is NULL.  One aggregation, no join chain."""
    aggs = [F.max(F.when(F.col("grp") == g, F.col(s))).alias(f"{g}__{s}") for g in groups for s in STATS]
    return stats.groupBy(job).agg(*aggs)


def category_list(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a request column, numbers first and in numeric order, then the others.

    The values name output columns, so they must be known when the plan is built.
    """
    rows = df.select(F.col(column).cast("string").alias("v")).distinct().filter("v is not null").collect()
    number = lambda v: (0, int(v), v) if v.lstrip("-").isdecimal() else (1, 0, v)
    return sorted((r.v for r in rows), key=number)


def request_columns(
    df: DataFrame, *, categories: dict[str, Sequence[str]], numeric: Sequence[str], prefix: str = "b0_"
) -> tuple[DataFrame, list[str]]:
    """Adds the request baseline: one 0/1 column per listed category and numeric columns as doubles.

    Returns the frame and the new column names, in order.
    """
    made: dict[str, Column] = {}
    for column, values in categories.items():
        for v in values:
            made[f"{prefix}{column}_{v}"] = F.coalesce(F.col(column).cast("string") == v, F.lit(False)).cast("int")
    for column in numeric:
        made[f"{prefix}{column}"] = F.col(column).cast("double")
    return df.select("*", *[c.alias(n) for n, c in made.items()]), list(made)


def forbidden_columns(columns: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    """Columns whose name contains a forbidden substring; a clean feature set gives an empty list."""
    return [c for c in columns if any(f in c for f in forbidden)]


def assemble(base: DataFrame, flags: DataFrame, telemetry: DataFrame, *, job: str) -> DataFrame:
    """Base rows that have flags, with telemetry where there is some."""
    return base.join(flags, job).join(telemetry, job, "left")


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, missing_share): one pass for all columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.avg(F.col(c).isNull().cast("double")).alias("missing_share")) for c in columns])
    return df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def any_missing(columns: Sequence[str]) -> Column:
    """True when at least one of the columns is NULL."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def window_bounds(series: DataFrame, *, ts: str, t0: str) -> DataFrame:
    """Earliest and latest time after the window start (one row); the latest must stay below the window length."""
    rel = F.col(ts) - F.col(t0)
    return series.agg(F.min(rel).alias("min_rel_ms"), F.max(rel).alias("max_rel_ms"))


def placebos(df: DataFrame, *, key: str, groups: Sequence[str], count: int, seed: int, name: str) -> DataFrame:
    """(key, <name>KK__<stat> ...): for each k the four columns of group ``k mod len(groups)``, rows permuted.

    All rows of ``df`` take part (filter to the population first).  The row at
    rank j by key hands its columns to the row at rank ``permutation k of j``
    (:mod:`permute`): the four columns move together and keep their joint
    distribution.  The rows are ranked once, whatever the number of placebos,
    and the moved columns meet in one aggregation per receiving rank: narrow
    offers travel, and the wide rows are only made by the task that keeps them,
    for a counted number of ranks.
    """
    kinds = [groups[k % len(groups)] for k in range(count)]
    used = list(dict.fromkeys(c for g in kinds for c in stat_columns(g)))
    ranked = materialize(ordering.row_index(df.select(key, *used), [], [key], "__i"), "placebo-ranks")
    n = ranked.count()
    offers = F.array(
        *[
            F.struct(F.lit(k).alias("k"), permute.scramble("__i", n, seed, k).alias("to"), F.array(*[F.col(c).cast("double") for c in stat_columns(g)]).alias("vals"))
            for k, g in enumerate(kinds)
        ]
    )
    width = max(2, len(str(count - 1)))
    cols = [F.max(F.when(F.col("k") == k, F.col("vals")[j])).alias(f"{name}{k:0{width}d}__{s}") for k in range(count) for j, s in enumerate(STATS)]
    moved = ordering.sized(ranked.select(F.explode(offers).alias("o")).select("o.*"), n, "to").groupBy("to").agg(*cols)
    return ordering.sized(ranked.select(key, "__i"), n, "__i").join(moved, F.col("__i") == F.col("to")).drop("__i", "to")
