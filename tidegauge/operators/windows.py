"""Time windows of jobs on nodes, and the joins between windows and readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import ordering
from tidegauge.session import materialize

#: Rows of a file of written readings: Spark counts 4 MB for opening each, so few of them are one task, however well they pack.
FILE_ROWS = 1 << 18




def node_windows(jobs: DataFrame, *, job: str, t0_ms: str, nodes: str, window_ms: int) -> DataFrame:
    """(job, node, t0_ms, t1_ms): one half-open window per job and node of its node array."""
    return jobs.select(F.col(job), F.explode(nodes).alias("node"), F.col(t0_ms).alias("t0_ms")).withColumn(
        "t1_ms", F.col("t0_ms") + F.lit(window_ms)
    )


def interval_join(
    readings: DataFrame,
    windows: DataFrame,
    *,
    node: str,
    ts: str,
    t0: str,
    t1: str,
    bucket_ms: int,
) -> DataFrame:
    """Every (window, reading) pair on the same node with ``t0 <= ts < t1``.

    Each window is unfolded into the fixed time buckets it touches (two at most
    when ``bucket_ms`` is the window length) and each reading lies in exactly
    one, so the join is an equi-join on (node, bucket): Spark hashes, sorts or
    broadcasts it as sizes tell, AQE splits skewed buckets, and one busy node is
    already spread over its buckets.  No pair can appear twice.
    """
    bucketed = readings.withColumn("__bucket", C.floor_div(ts, bucket_ms))
    last = C.floor_div(F.col(t1) - 1, bucket_ms)
    unfolded = windows.filter(F.col(t1) > F.col(t0)).withColumn(
        "__bucket", F.explode(F.sequence(C.floor_div(t0, bucket_ms), last))
    )
    return bucketed.join(unfolded, [node, "__bucket"]).filter(C.in_half_open(ts, t0, t1)).drop("__bucket")


def event_aligned(
    readings: DataFrame,
    events: DataFrame,
    *,
    node: str,
    ts: str,
    at: str,
    before_ms: int,
    after_ms: int,
) -> DataFrame:
    """Readings of the event's node in ``[at - before, at + after)`` with ``rel_ms`` = reading - event."""
    spans = events.withColumn("__t0", F.col(at) - before_ms).withColumn("__t1", F.col(at) + after_ms)
    pairs = interval_join(readings, spans, node=node, ts=ts, t0="__t0", t1="__t1", bucket_ms=before_ms + after_ms)
    return pairs.withColumn("rel_ms", F.col(ts) - F.col(at)).drop("__t0", "__t1")


def aligned_profile(pairs: DataFrame, *, value: str, lo_ms: int, hi_ms: int, bin_ms: int, places: int | None = None) -> DataFrame:
    """Mean value per bin of ``rel_ms`` over ``[lo, hi)``; a bin without readings has mean 0 and count 0.

    ``places``: add values as decimals of so many places and divide once, so that
    the order in which Spark adds them cannot show in the last digit.
    """
    mean = F.avg(value) if places is None else F.sum(F.col(value).cast(f"decimal(28,{places})")).cast("double") / F.count(value)
    n_bins = (hi_ms - lo_ms) // bin_ms
    sums = (
        pairs.filter((F.col("rel_ms") >= lo_ms) & (F.col("rel_ms") < hi_ms))
        .groupBy(C.floor_div(F.col("rel_ms") - lo_ms, bin_ms).alias("bin"))
        .agg(F.count(value).alias("n"), mean.alias("mean_value"))
    )
    scaffold = pairs.sparkSession.range(n_bins).select(F.col("id").alias("bin"))
    return scaffold.join(sums, "bin", "left").select(
        "bin",
        (F.col("bin") * bin_ms + lo_ms).alias("bin_start_ms"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"),
    )


def largest_step(profile: DataFrame) -> DataFrame:
    """The bin entered by the largest rise of the profile (the earliest of equals), with both levels.

    A profile has a fixed, small number of bins.
    """
    w = W.orderBy("bin")
    steps = profile.withColumn("from_value", F.lag("mean_value").over(w)).filter(F.col("from_value").isNotNull())
    key = F.struct((F.col("mean_value") - F.col("from_value")).alias("d"), (-F.col("bin")).alias("b"))
    best = F.max_by(F.struct("bin", "bin_start_ms", "from_value", F.col("mean_value").alias("to_value")), key)
    return steps.agg(best.alias("s")).select("s.*")


def grid_points(series: DataFrame, *, ids: Sequence[str], start_ms: str, values: str, n: int, step_ms: int, shifts_ms: Sequence[int]) -> DataFrame:
    """Unfold the first ``n`` samples of an array sampled every ``step_ms`` from ``start_ms``, once per shift."""
    shift = F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in shifts_ms]))
    return (
        series.select(*ids, start_ms, F.slice(values, 1, n).alias("__head"))
        .select(*ids, start_ms, shift.alias("shift_ms"), F.posexplode("__head").alias("k", "sample"))
        .withColumn("grid_ms", F.col(start_ms) + F.col("shift_ms") + F.col("k").cast("bigint") * step_ms)
    )


def asof_match(
    grid: DataFrame,
    readings: DataFrame,
    *,
    node: str,
    at: str,
    ts: str,
    value: str,
    tolerance_ms: int,
    direction: str = "forward",
) -> DataFrame:
    """As-of join: each grid point with one reading of its node no farther than the tolerance.

    ``forward``: the first reading at or after the point; past the node's last
    reading, that last reading.  ``nearest``: the closest reading, the earlier
    one of equals.  Unmatched points keep NULLs in ``match_ts`` and
    ``match_value``.  Repeated timestamps resolve to the smallest value
    (forward, nearest) or the largest (last reading).

    Points and readings are merged per (node, stretch of time as long as the
    tolerance): a running window each way finds the neighbours, and no point is
    joined to a reading, so no point meets more than one reading a side.  A neighbour can lie
    in the stretch before or behind; the first and last reading of every stretch
    are handed over to those, and the node's last reading marks its own and the next.
    Only readings of nodes that have a point are merged, and both sides are counted
    first, so that a task has a bounded number of rows to sort.  They are written in
    files of ``FILE_ROWS`` before they are dealt: a row group of any size is one task
    of a scan, which would hold all of its rows while it deals them.
    """
    if direction not in ("forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    stretch = max(int(tolerance_ms), 1)
    chunk = lambda t: F.floor(F.col(t) / F.lit(stretch)).alias("__chunk")
    slim = readings.select(F.col(node).alias("__node"), F.col(ts).cast("bigint").alias("__t"), F.col(value).alias("__v")).filter("__node IS NOT NULL AND __t IS NOT NULL")
    # written, so that Spark sees how few they are; other nodes' readings are never sent or held
    nodes = materialize(grid.select(F.col(node).alias("__node")).filter("__node IS NOT NULL").distinct(), "asof-nodes")
    slim = materialize(slim.join(nodes, "__node", "left_semi"), "asof-readings", rows=FILE_ROWS)
    n = slim.count()
    placed = ordering.sized(slim.select("*", chunk("__t")), n, "__node", "__chunk")
    reading = F.struct(F.col("__t").alias("ts"), "lo", "hi").alias("__r")
    once = placed.groupBy("__node", "__chunk", "__t").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).select("__node", "__chunk", "__t", reading)
    edges = once.groupBy("__node", "__chunk").agg(F.min("__r").alias("first"), F.max("__r").alias("last"))
    over = F.explode(F.array(F.struct((F.col("__chunk") - 1).alias("c"), F.col("first").alias("r")), F.struct((F.col("__chunk") + 1).alias("c"), F.col("last").alias("r")))).alias("e")
    handed = edges.select("__node", over).select("__node", F.col("e.c").alias("__chunk"), F.col("e.r.ts").alias("__t"), F.col("e.r").alias("__r"))
    ends = edges.groupBy("__node").agg(F.max("last.ts").alias("__end"))
    ends = ends.select("__node", "__end", F.explode(F.array(F.floor(F.col("__end") / F.lit(stretch)), F.floor(F.col("__end") / F.lit(stretch)) + 1)).alias("__chunk"))

    points = grid.select(F.col(node).alias("__node"), F.col(at).cast("bigint").alias("__t"), chunk(at), F.struct(*grid.columns).alias("__g"))
    merged = points.unionByName(once.unionByName(handed), allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    merged = ordering.sized(merged, grid.count() + 3 * n, "__node", "__chunk")
    part, point = W.partitionBy("__node", "__chunk"), F.col("__g").isNotNull().cast("int")
    # at equal times a point stands before the reading, both ways round
    behind = part.orderBy(F.asc("__t"), F.desc(point)).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = part.orderBy(F.desc("__t"), F.asc(point)).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = merged.select(
        "__t", "__g", F.last("__r", ignorenulls=True).over(behind).alias("__last"), F.last("__r", ignorenulls=True).over(ahead).alias("__next"), F.max("__end").over(part).alias("__end")
    ).filter(F.col("__g").isNotNull())
    near = lambda c: F.abs(F.col(f"{c}.ts") - F.col("__t")) <= tolerance_ms
    pick = lambda c, v: F.struct(F.col(f"{c}.ts").alias("ts"), F.col(f"{c}.{v}").alias("v"))
    if direction == "nearest":
        closer = F.col("__next").isNull() | (F.col("__t") - F.col("__last.ts") <= F.col("__next.ts") - F.col("__t"))
        match = F.when(closer & near("__last"), pick("__last", "lo")).when(near("__next"), pick("__next", "lo"))
    else:
        match = F.when(near("__next"), pick("__next", "lo")).when((F.col("__end") < F.col("__t")) & near("__last"), pick("__last", "hi"))
    found = found.withColumn("__m", match)
    return found.select(*[F.col(f"__g.{c}").alias(c) for c in grid.columns], F.col("__m.ts").alias("match_ts"), F.col("__m.v").alias("match_value"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; NULL when either side does not vary.

    ``corr`` raises on zero variance under ANSI mode.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def lagged_correlation(
    matched: DataFrame, *, ids: Sequence[str], sample: str = "sample", value: str = "match_value", min_share: float = 0.8
) -> DataFrame:
    """Correlation per (ids, shift): only where at least ``min_share`` of the points matched and the readings vary."""
    per_key = matched.groupBy(*ids, "shift_ms").agg(
        F.avg(F.col("match_ts").isNotNull().cast("double")).alias("matched_share"),
        F.stddev_pop(F.when(F.col("match_ts").isNotNull(), F.col(value))).alias("__sd"),
        pearson(sample, F.when(F.col("match_ts").isNotNull(), F.col(value))).alias("corr"),
    )
    return per_key.filter((F.col("matched_share") >= min_share) & (F.col("__sd") > 0)).drop("__sd")


def median_correlation(per_key: DataFrame) -> DataFrame:
    """Median over keys for each shift (exact, distributed)."""
    return ordering.exact_quantiles(per_key, ["shift_ms"], "corr", {"median_corr": 0.5})


def previous_on_node(jobs: DataFrame, *, node: str, start: str, end: str, job: str, chunk: Column | None = None) -> DataFrame:
    """Each (job, node) row with the end of the previous job on that node, ``prev_<end>``."""
    cut = F.date_trunc("month", F.col(start).cast("timestamp")) if chunk is None else chunk
    return ordering.consecutive_pairs(jobs, [node], start, [end], chunk=cut, tiebreak=[job])


def idle_before(jobs_prev: DataFrame, *, start: str, end: str, min_idle_s: float, min_length_s: float) -> DataFrame:
    """Jobs longer than ``min_length_s`` whose node had been idle for more than ``min_idle_s``.

    The first job of a node has no previous end and is left out.
    """
    gap = C.seconds_between(f"prev_{end}", start)
    return jobs_prev.filter(gap > min_idle_s).filter(C.seconds_between(start, end) > min_length_s)


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Inner join of two tables on ``key``; per time column the largest absolute difference in seconds.

    One row: matched keys, and ``max_diff_<column>`` for each column.
    """
    r = right.select(key, *[F.col(c).alias(f"__r_{c}") for c in columns])
    joined = left.select(key, *columns).join(r, key)
    return joined.agg(
        F.count("*").alias("matched"),
        *[F.max(F.abs(C.seconds_between(c, f"__r_{c}"))).alias(f"max_diff_{c}") for c in columns],
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order`` (which should be unique per key).

    An aggregate rather than ``row_number``: copies of one key collapse on the
    map side, so a key with a third of all rows stays cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    order_key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    first = F.min_by(F.struct(*rest), order_key) if rest else F.count("*")
    out = df.groupBy(*keys).agg(first.alias("__first"))
    return out.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)
