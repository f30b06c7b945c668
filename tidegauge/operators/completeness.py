"""How much of the expected telemetry arrived, and which completeness rule to use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def reading_counts(window_readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return window_readings.groupBy(*keys).agg(F.count("*").alias("n"))


def node_fractions(counts: DataFrame, channels: DataFrame, *, channel: str, window_s: float) -> DataFrame:
    """Delivered share of every reporting (channel, job, node): ``min(n, expected) / expected``.

    ``channels`` has one row per channel (``channel``, ``cadence_s``).  Silent
    windows are not materialised: their share is 0, and the job mean divides by
    all nodes of the job, so windows never have to be spread over channels.
    """
    beats = channels.select(channel, (F.lit(float(window_s)) / F.col("cadence_s")).alias("expected"))
    share = F.least(F.col("n").cast("double"), F.col("expected")) / F.col("expected")
    return counts.join(beats, channel).withColumn("frac", share)


def nodes_per_job(windows: DataFrame, *, job: str) -> DataFrame:
    return windows.groupBy(job).agg(F.count("*").alias("nodes"))


def job_fractions(fractions: DataFrame, job_nodes: DataFrame, *, job: str, channel: str) -> DataFrame:
    """Mean over all nodes of a job, silent ones included; a (channel, job) without any reading has no row and means 0."""
    sums = fractions.groupBy(channel, job).agg(F.sum("frac").alias("__s"))
    return sums.join(job_nodes, job).select(channel, job, (F.col("__s") / F.col("nodes")).alias("frac"))


def typical_delivery(fractions: DataFrame, *, channel: str, share_at: float = 0.8) -> DataFrame:
    """Median, quartiles and share at or above ``share_at`` of the windows with at least one reading.

    A fraction takes at most ``expected + 1`` values per channel, so counting
    the values first leaves a table whose size does not grow with the data;
    the exact percentiles then use the counts as frequencies.
    """
    values = fractions.groupBy(channel, "expected", "frac").agg(F.count("*").alias("m"))
    q = lambda p: F.expr(f"percentile(frac, {p}D, m)")
    return values.groupBy(channel).agg(
        F.max("expected").alias("expected"),
        q(0.5).alias("median"),
        q(0.25).alias("p25"),
        q(0.75).alias("p75"),
        (F.sum(F.when(F.col("frac") >= share_at, F.col("m")).otherwise(0)) / F.sum("m")).alias("share_ge"),
    )


def rule_thresholds(typical: DataFrame, fixed: dict[str, float], *, channel: str, relative: dict[str, float] | None = None) -> DataFrame:
    """(rule, channel, threshold): fixed levels for all channels and levels relative to the typical delivery."""
    levels = [F.struct(F.lit(r).alias("rule"), F.lit(float(v)).alias("threshold")) for r, v in fixed.items()]
    levels += [F.struct(F.lit(r).alias("rule"), (F.lit(float(k)) * F.col("median")).alias("threshold")) for r, k in (relative or {}).items()]
    return typical.select(channel, F.explode(F.array(*levels)).alias("l")).select(channel, "l.rule", "l.threshold")


def rule_membership(job_frac: DataFrame, thresholds: DataFrame, *, job: str, channel: str, jobs: DataFrame | None = None) -> DataFrame:
    """(job, rule) for every job that reaches the rule's threshold in all of the rule's channels.

    An absent fraction is 0, so it fails every positive threshold: a job passes
    when it reaches as many channels as the rule asks for.  A rule whose
    thresholds are all 0 asks for nothing; where ``jobs`` is given, all of them
    pass it, those without any reading too.
    """
    level = F.col("threshold") - TOLERANCE
    asked = thresholds.filter(level > 0)
    need = asked.groupBy("rule").agg(F.count("*").alias("__need"))
    rules = asked.join(need, "rule")
    passed = (
        job_frac.join(rules, channel)
        .groupBy(job, "rule")
        .agg(F.count_if(F.col("frac") >= level).alias("__met"), F.max("__need").alias("__need"))
        .filter(F.col("__met") == F.col("__need"))
        .select(job, "rule")
    )
    if jobs is None:
        return passed
    free = thresholds.groupBy("rule").agg(F.max(level).alias("__most")).filter(F.col("__most") <= 0).select("rule")
    return passed.unionByName(jobs.select(job).distinct().crossJoin(free))


def completeness_table(
    jobs: DataFrame,
    job_frac: DataFrame,
    members: DataFrame,
    *,
    job: str,
    channel: str,
    channels: Sequence[str],
    rules: dict[str, str],
    sources: dict[str, Sequence[str]],
) -> DataFrame:
    """One row per job: ``frac_<channel>``, one 0/1 flag per rule (rule -> column) and ``has_<source>``.

    ``has_<source>`` is 1 when every listed channel of the source delivered
    something.
    """
    fracs = job_frac.groupBy(job).agg(
        *[F.max(F.when(F.col(channel) == c, F.col("frac"))).alias(f"frac_{c}") for c in channels],
        *[
            (F.count_if(F.col(channel).isin(list(chans)) & (F.col("frac") > 0)) == len(chans)).cast("int").alias(f"has_{name}")
            for name, chans in sources.items()
        ],
    )
    passed = members.groupBy(job).agg(*[F.max((F.col("rule") == r).cast("int")).alias(col) for r, col in rules.items()])
    zero = {**{f"frac_{c}": 0.0 for c in channels}, **{f"has_{n}": 0 for n in sources}, **{c: 0 for c in rules.values()}}
    return jobs.select(job).join(fracs, job, "left").join(passed, job, "left").fillna(zero)


def typical_test(typical: DataFrame, level: float = 0.8) -> DataFrame:
    """One row, ``t1``: the median delivery reaches ``level`` in every channel."""
    return typical.agg(F.coalesce(F.bool_and(F.col("median") >= level), F.lit(False)).alias("t1"))


def choose_rule(viability: DataFrame, t1: DataFrame, *, floor: int, strict: str, relative: str, fallback: str) -> DataFrame:
    """Which rule is primary, and the outcome of every rule.

    ``viability``: one row per rule with ``min_block_pos``.  ``strict`` needs
    normal delivery (t1) and the floor in every block, else ``relative`` needs
    the floor, else ``fallback``.  The tables hold one row per rule.
    """
    passes = lambda r: F.coalesce(F.bool_or((F.col("rule") == r) & (F.col("min_block_pos") >= floor)), F.lit(False))
    tests = viability.agg(passes(strict).alias("__t2s"), passes(relative).alias("__t2r")).withColumn("__k", F.lit(1))
    verdict = tests.join(t1.withColumn("__k", F.lit(1)), "__k").select(
        "__k", "t1", F.when(F.col("t1") & F.col("__t2s"), F.lit(strict)).when(F.col("__t2r"), F.lit(relative)).otherwise(F.lit(fallback)).alias("primary_rule")
    )
    joined = viability.withColumn("__k", F.lit(1)).join(F.broadcast(verdict), "__k").drop("__k")
    t2 = F.col("min_block_pos") >= floor
    outcome = (
        F.when(F.col("rule") == F.col("primary_rule"), "primary")
        .when(~F.col("rule").isin(strict, relative, fallback) & t2, "not in procedure")
        .when(~t2, "fails T2")
        .when((F.col("rule") == strict) & ~F.col("t1"), "fails T1")
        .otherwise("not needed")
    )
    return joined.withColumn("t2", t2).withColumn("outcome", outcome)


def delivery_spread(typical: DataFrame, at_cadence: Column) -> DataFrame:
    """Distinct and largest median delivery among the channels chosen by ``at_cadence``, smallest among the others."""
    return typical.agg(
        F.countDistinct(F.when(at_cadence, F.col("median"))).alias("distinct_medians"),
        F.max(F.when(at_cadence, F.col("median"))).alias("max_median"),
        F.min(F.when(~at_cadence, F.col("median"))).alias("min_median_others"),
    )
