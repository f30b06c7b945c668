"""Data checks that are themselves queries: each returns the violations or one row of figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import columns as C


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def duration_mismatches(jobs: DataFrame, *, start: str, end: str, recorded_s: str) -> DataFrame:
    """Rows whose recorded duration is not end - start."""
    return jobs.filter(~C.seconds_between(start, end).eqNullSafe(F.col(recorded_s).cast("double")))


def subset_violations(flags: DataFrame, inner: str, outer: str) -> DataFrame:
    """Rows inside the smaller population but not in the larger one."""
    return flags.filter(F.col(inner) > F.col(outer))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side missing from the other, with multiplicity; empty means equal.

    One aggregation of signed counts instead of two ``exceptAll`` passes.
    """
    cols = a.columns
    signed = a.withColumn("__d", F.lit(1)).unionByName(b.select(*cols).withColumn("__d", F.lit(-1)))
    net = signed.groupBy(*cols).agg(F.sum("__d").alias("__net")).filter(F.col("__net") != 0)
    return net.select(*cols, F.when(F.col("__net") > 0, "left").otherwise("right").alias("side"), F.abs("__net").alias("n"))


def marginal_mismatches(a: DataFrame, b: DataFrame, column: str, other: str) -> DataFrame:
    """Values whose number of occurrences differs between ``a.column`` and ``b.other``."""
    return multiset_difference(a.select(F.col(column).alias("value")), b.select(F.col(other).alias("value")))


def cadence_mismatches(inventory: DataFrame) -> DataFrame:
    """Channels whose median interval is not the modal interval."""
    return inventory.filter(~F.col("median_interval_s").eqNullSafe(F.col("cadence_s")))
