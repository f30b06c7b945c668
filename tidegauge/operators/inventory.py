"""Per-channel inventory: cadence, counters, traits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators.small import literal_table
from tidegauge.session import materialize

#: Time span of one unit of work of a (channel, node).  A node that sends every
#: 20 s holds 120,960 readings in it, whatever the length of the lake.
CHUNK_MS = 28 * 24 * 3_600_000


def interval_state(
    readings: DataFrame, *, channel: str, node: str, ts_ms: str, value: str, max_interval_s: int, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """What the inventory keeps of readings: small, and mergeable by union.

    A row per (channel, whole seconds since the previous reading of the node)
    with rows, rises, falls, zeros and range; the last bin holds everything from
    ``max_interval_s`` on, and rows without a predecessor have a NULL interval.
    The first and last reading of every (node, chunk of time) are rows of their
    own (``e_`` columns), so that the pair between two chunks, or between two
    months whose states were made apart, is found from the states alone.

    The readings are shuffled and sorted once, by (channel, node, chunk), and
    combined on the map side.
    """
    seconds = lambda prev: C.floor_div(F.col(ts_ms) - F.col(prev), 1000)
    binned = lambda prev: F.when(
        F.col(prev).isNotNull(), F.least(seconds(prev), F.lit(max_interval_s).cast("bigint"))
    )
    slim = readings.select(
        channel, node, ts_ms, C.nan_to_null(value).alias(value), C.floor_div(ts_ms, chunk_ms).alias("__chunk")
    ).withColumn("__g", F.xxhash64(channel, node, "__chunk"))  # a number to sort by before any text
    w = W.partitionBy("__g", channel, node, "__chunk").orderBy(ts_ms, value)
    local = slim.select(
        channel, node, ts_ms, value, "__chunk", F.lag(ts_ms).over(w).alias("__pt"), F.lag(value).over(w).alias("__pv"),
        F.lead(ts_ms).over(w).alias("__nt"),
    )
    edge = F.col("__pt").isNull() | F.col("__nt").isNull()
    keep = lambda c: F.when(edge, F.col(c)).alias(f"e_{c}")
    change = F.col(value) - F.col("__pv")
    return local.groupBy(
        channel, binned("__pt").alias("interval_s"), keep(node), keep("__chunk"), keep(ts_ms), keep(value)
    ).agg(
        F.count("*").alias("rows"),
        F.count_if(change > 0).alias("rises"),
        F.count_if(change < 0).alias("falls"),
        F.count_if(F.col(value) == 0).alias("zeros"),
        F.min(value).alias("vmin"),
        F.max(value).alias("vmax"),
    )


def merge_states(raw: DataFrame, *, channel: str, node: str, ts_ms: str, value: str, max_interval_s: int) -> tuple[DataFrame, DataFrame]:
    """(cells, nodes) from one or more states together.

    ``cells``: per (channel, interval) the pairs ``n``, rows, rises, falls, zeros
    and range (readings at a cut stand under the NULL interval, pairs under
    theirs).  ``nodes``: (channel, nodes).  States must be of readings that
    don't overlap in time, such as months; a chunk may be cut between two of them.
    ``raw`` is a written table: it is read twice.
    """
    # a chunk's first reading is the one without an interval, an edge the one with a chunk
    seconds = lambda prev: C.floor_div(F.col(ts_ms) - F.col(prev), 1000)
    binned = lambda prev: F.when(F.col(prev).isNotNull(), F.least(seconds(prev), F.lit(max_interval_s).cast("bigint")))
    change = F.col(value) - F.col("__pv")
    inside = raw.select(
        channel, "interval_s", F.when(F.col("interval_s").isNotNull(), F.col("rows")).otherwise(0).alias("n"), "rows", "rises", "falls",
        "zeros", "vmin", "vmax",
    )
    edges = raw.filter("e___chunk IS NOT NULL").select(
        channel, F.col(f"e_{node}").alias(node), F.col("e___chunk").alias("__chunk"), F.col(f"e_{ts_ms}").alias(ts_ms), F.col(f"e_{value}").alias(value),
        F.col("interval_s").isNull().alias("first"),
    )
    # at most two rows per node and chunk, in every state
    across = W.partitionBy(channel, node).orderBy("__chunk", ts_ms, value, F.desc("first"))
    joints = edges.withColumn("__pt", F.lag(ts_ms).over(across)).withColumn("__pv", F.lag(value).over(across))
    joints = joints.filter(F.col("first") & F.col("__pt").isNotNull()).select(
        channel,
        binned("__pt").alias("interval_s"),
        F.lit(1).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("rows"),
        F.when(change > 0, 1).otherwise(0).cast("bigint").alias("rises"),
        F.when(change < 0, 1).otherwise(0).cast("bigint").alias("falls"),
        F.lit(0).cast("bigint").alias("zeros"),
        F.lit(None).cast("double").alias("vmin"),
        F.lit(None).cast("double").alias("vmax"),
    )
    cells = inside.unionByName(joints).groupBy(channel, "interval_s").agg(
        *[F.sum(c).alias(c) for c in ("n", "rows", "rises", "falls", "zeros")], F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")
    )
    return cells, edges.groupBy(channel).agg(F.countDistinct(node).alias("nodes"))


def interval_cells(
    readings: DataFrame, *, channel: str, node: str, ts_ms: str, value: str, max_interval_s: int, chunk_ms: int = CHUNK_MS
) -> tuple[DataFrame, DataFrame]:
    """One pass over the readings: :func:`interval_state`, written, and :func:`merge_states` of it."""
    names = {"channel": channel, "node": node, "ts_ms": ts_ms, "value": value, "max_interval_s": max_interval_s}
    return merge_states(materialize(interval_state(readings, **names, chunk_ms=chunk_ms), "interval-cells"), **names)


def interval_histogram(cells: DataFrame, *, channel: str) -> DataFrame:
    """(channel, interval_s, n): how often each interval between consecutive readings occurs."""
    return cells.filter(F.col("interval_s").isNotNull()).select(channel, "interval_s", "n")


def cadence(hist: DataFrame, *, channel: str, max_interval_s: int) -> DataFrame:
    """Modal interval (0 s and the last bin left out, smallest of equals, 0 if none), histogram median and share at the mode."""
    useful = F.when((F.col("interval_s") > 0) & (F.col("interval_s") < max_interval_s), F.col("n"))
    by_bin = W.partitionBy(channel).orderBy("interval_s")
    ran = hist.withColumn("__cum", F.sum("n").over(by_bin)).withColumn("__tot", F.sum("n").over(W.partitionBy(channel)))
    ran = ran.withColumn("__useful", useful)
    mode = F.coalesce(F.max_by("interval_s", F.when(F.col("__useful").isNotNull(), F.struct("__useful", -F.col("interval_s")))), F.lit(0))
    agg = ran.groupBy(channel).agg(
        mode.cast("bigint").alias("cadence_s"),
        F.min(F.when(F.col("__cum") >= F.col("__tot") / 2, F.col("interval_s"))).alias("median_interval_s"),
        F.max("__tot").alias("__tot"),
    )
    at_mode = hist.select(channel, F.col("interval_s").alias("cadence_s"), F.col("n").alias("__at"))
    return agg.join(at_mode, [channel, "cadence_s"], "left").select(
        channel, "cadence_s", "median_interval_s", C.ratio(F.coalesce("__at", F.lit(0)), "__tot").alias("share_at_cadence")
    )


def channel_inventory(
    readings: DataFrame,
    *,
    channel: str,
    node: str,
    ts_ms: str,
    value: str,
    max_interval_s: int = 3600,
    cumulative_share: float = 0.99,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """One row per channel: rows, nodes, cadence, rise share, zero share, range, ``cumulative`` and ``constant``."""
    cells, nodes = interval_cells(
        readings, channel=channel, node=node, ts_ms=ts_ms, value=value, max_interval_s=max_interval_s, chunk_ms=chunk_ms
    )
    return inventory_of(cells, nodes, channel=channel, max_interval_s=max_interval_s, cumulative_share=cumulative_share)


def inventory_of(cells: DataFrame, nodes: DataFrame, *, channel: str, max_interval_s: int = 3600, cumulative_share: float = 0.99) -> DataFrame:
    """The inventory from merged cells: one row per channel."""
    totals = cells.groupBy(channel).agg(
        *[F.sum(c).alias(c) for c in ("rows", "rises", "falls", "zeros")], F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")
    )
    beat = cadence(interval_histogram(cells, channel=channel), channel=channel, max_interval_s=max_interval_s)
    joined = totals.join(nodes, channel).join(beat, channel, "left")
    rises_share = C.ratio("rises", F.col("rises") + F.col("falls"))
    return joined.select(
        channel,
        "rows",
        "nodes",
        F.coalesce("cadence_s", F.lit(0).cast("bigint")).alias("cadence_s"),
        "median_interval_s",
        "share_at_cadence",
        "rises",
        "falls",
        rises_share.alias("rises_share"),
        F.coalesce(rises_share >= cumulative_share, F.lit(False)).alias("cumulative"),
        C.ratio("zeros", "rows").alias("zero_share"),
        F.coalesce(F.col("vmin") == F.col("vmax"), F.lit(False)).alias("constant"),
        "vmin",
        "vmax",
    )


def head_shares(hist: DataFrame, *, channel: str, bins: int = 361) -> DataFrame:
    """Histogram cut to its first ``bins`` bins, as shares of what is left."""
    head = hist.filter(F.col("interval_s") < bins)
    return head.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(channel)))


def size_summary(inventory: DataFrame, *, channel: str, by: str) -> DataFrame:
    """Median rows, largest rows and the channel that has them, per value of ``by`` (channels are few)."""
    return inventory.groupBy(by).agg(
        F.count("*").alias("channels"),
        F.median("rows").alias("median_rows"),
        F.max("rows").alias("max_rows"),
        F.max_by(channel, F.struct("rows", channel)).alias("largest"),
    )


def list_by(df: DataFrame, key: str, item: str, position: str, name: str, sep: str = ", ") -> DataFrame:
    """Items of a key in position order, joined into one string (for short descriptive lists)."""
    pairs = F.sort_array(F.collect_list(F.struct(position, item)))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p[item].cast("string")), sep).alias(name))


def metric_groups(inventory: DataFrame, groups: dict[str, Sequence[str]], *, channel: str, source: str) -> DataFrame:
    """One row per group: its source, its channels in order, and the distinct cadences joined by "/"."""
    rows = [(i, g, j, c) for i, (g, chans) in enumerate(groups.items()) for j, c in enumerate(chans)]
    ref = literal_table(inventory.sparkSession, rows, f"position int, grp string, slot int, {channel} string")
    joined = F.broadcast(ref).join(inventory.select(channel, source, "cadence_s"), channel)
    ordered = F.sort_array(F.collect_list(F.struct("slot", channel)))
    beats = F.transform(F.sort_array(F.collect_set("cadence_s")), lambda v: v.cast("string"))
    return joined.groupBy("position", F.col("grp").alias("group")).agg(
        F.min_by(source, "slot").alias("source"),
        F.array_join(F.transform(ordered, lambda p: p[channel]), ", ").alias("channels"),
        F.array_join(beats, "/").alias("cadence_s"),
    )
