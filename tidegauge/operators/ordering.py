"""Order-dependent operators that never put a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(x)`` runs each key in one task, so a
key with a third of all rows stalls the job.  The operators here cut every key
into order-preserving chunks first, work inside the chunks, and carry totals
(or the last row) from chunk to chunk through a table with a few rows per chunk.

Two ways to cut:

* by the value itself (``chunk=`` a monotone expression such as the calendar
  day of a timestamp), with windows inside the chunks;
* by ranges of (keys, value): one range exchange whose bounds Spark samples from
  the data and whose width follows the number of rows, then a running sum over
  the sorted rows of each partition.  Only the first and the last key of a
  partition can go on in another one, so a partition carries two rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import materialize


def task_count(spark: SparkSession) -> int:
    """Tasks for a step whose work is far larger than its input bytes, which is all AQE sees."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition ahead of an expansion, by the session's parallelism.

    AQE sizes partitions by the bytes it has seen, so a small table that is
    about to grow a thousandfold would otherwise be expanded by one task.
    """
    return df.repartition(task_count(df.sparkSession), *[F.col(c) for c in by])


#: Rows of a task in a step that holds them all.
TASK_ROWS = 1 << 17


def sized(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Hash-partition ``df`` into tasks of about :data:`TASK_ROWS` of its counted ``rows``, by the session's parallelism at least.

    AQE joins partitions until they have its number of compressed bytes, so a
    task that sorts or hashes wide rows would hold more of them the larger the input.
    """
    return df.repartition(max(task_count(df.sparkSession), -(-rows // TASK_ROWS)), *[F.col(c) for c in by])


# ------------------------------------------------------------------ distributed prefix sums


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: list | None) -> np.ndarray:
    """Where a row's key differs from the row before; ``last`` is the key before the batch (None: there is none)."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for i, k in enumerate(keys):
        col = batch.column(k)
        if last is not None:
            before = pa.concat_arrays([last[i], col.slice(0, len(col) - 1)])
            now, at = col, 0
        else:
            before, now, at = col.slice(0, len(col) - 1), col.slice(1), 1
        differ = pc.fill_null(pc.not_equal(before, now), False)
        if pa.types.is_floating(col.type):  # NaN is one key
            differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(before), pc.is_nan(now)), False)))
        differ = pc.or_(differ, pc.xor(pc.is_null(before), pc.is_null(now)))
        out[at:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _numbers(col: pa.Array, wide: pa.DataType) -> np.ndarray:
    return pc.fill_null(pc.cast(col, wide), 0).to_numpy(zero_copy_only=False)


def _prefix_sums(batches: Iterator[pa.RecordBatch], keys: list[str], measures: list[str], wide: list[pa.DataType], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows: running and total sums of the key inside this partition, and the key's place in it.

    ``__range_edge``: 1 the partition's first key, 2 its last, 3 both, 0 neither.
    ``__range_tail``: the key's last row here.  Batches of the current key are held
    until it ends, because each of its rows gets its total.
    """
    held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []  # pieces of the current key
    sums, last, first_key = [w.to_pandas_dtype()(0) for w in wide], None, True

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        edge = (1 if first_key else 0) | (2 if final else 0)
        for i, (rows, runs) in enumerate(held):
            n = rows.num_rows
            tail = np.zeros(n, bool)
            tail[-1] = i == len(held) - 1
            extra = [pa.array(r, w) for r, w in zip(runs, wide)]
            extra += [pa.array(np.full(n, s), w) for s, w in zip(sums, wide)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra, pa.array(np.full(n, edge, np.int32)), pa.array(tail)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch, keys, last)
        last = [batch.column(k).slice(batch.num_rows - 1) for k in keys]
        starts = np.flatnonzero(new)
        values = [_numbers(batch.column(m), w) for m, w in zip(measures, wide)]
        upto = int(starts[0]) if len(starts) else batch.num_rows
        if upto:  # the key of the batch before goes on
            held.append((batch.slice(0, upto), [np.cumsum(v[:upto]) + s for v, s in zip(values, sums)]))
            sums = [s + v[:upto].sum() for v, s in zip(values, sums)]
        if not len(starts):
            continue
        if held:
            yield from flush(final=False)
            held, first_key = [], False
        # keys that begin and end inside this batch, all at once
        final_start = int(starts[-1])
        if final_start > starts[0]:
            lo, n = int(starts[0]), final_start - int(starts[0])
            begin = starts[:-1] - lo
            group = np.cumsum(new[lo:final_start]) - 1
            runs, tots = [], []
            for v in values:
                ran = np.cumsum(v[lo:final_start])
                base = (ran[begin] - v[lo:final_start][begin])[group]
                totals = np.add.reduceat(v[lo:final_start], begin)
                if v.dtype.kind == "f":  # sums of other keys would leave their rounding behind
                    ran, base = np.concatenate([np.cumsum(p) for p in np.split(v[lo:final_start], begin[1:])]), 0
                runs.append(ran - base)
                tots.append(totals[group])
            tail = np.zeros(n, bool)
            tail[np.append(begin[1:], n) - 1] = True
            edge = np.zeros(n, np.int32)
            if first_key:
                edge[: int(begin[1]) if len(begin) > 1 else n] = 1
            cols = [*batch.slice(lo, n).columns, *[pa.array(r, w) for r, w in zip(runs, wide)], *[pa.array(t, w) for t, w in zip(tots, wide)]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(edge), pa.array(tail)], schema=schema)
            first_key = False
        held = [(batch.slice(final_start), [np.cumsum(v[final_start:]) for v in values])]
        sums = [v[final_start:].sum() for v in values]
    if held:
        yield from flush(final=True)


def placed_sums(df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], *, descending: bool = False, width: int | None = None) -> DataFrame:
    """``df`` in ranges of (keys, order), each sorted, with sums inside the range: one exchange.

    Adds ``run_<m>`` and ``tot_<m>`` (of this range only), ``__range_edge``, ``__range_tail``
    and ``__range``, the range's number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, measures = list(keys), list(measures)
    by = [*[F.col(k).asc() for k in keys], F.col(order).desc() if descending else F.col(order).asc()]
    ranged = df.repartitionByRange(*by) if width is None else df.repartitionByRange(width, *by)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    real = [isinstance(kinds[m], (T.DoubleType, T.FloatType, T.DecimalType)) for m in measures]
    fields = list(df.schema.fields)
    for prefix in ("run", "tot"):
        fields += [T.StructField(f"{prefix}_{m}", T.DoubleType() if r else T.LongType()) for m, r in zip(measures, real)]
    schema = T.StructType([*fields, T.StructField("__range_edge", T.IntegerType()), T.StructField("__range_tail", T.BooleanType())])
    wide = [pa.float64() if r else pa.int64() for r in real]
    arrow = to_arrow_schema(schema)
    summed = ranged.sortWithinPartitions(*by).mapInArrow(lambda b: _prefix_sums(b, keys, measures, wide, arrow), schema)
    return summed.withColumn("__range", F.spark_partition_id())


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
    chunk: Column | None = None,
    width: int | None = None,
) -> DataFrame:
    """Running and total sums of ``measures`` in ``order`` within ``keys``.

    Input rows must be unique on ``keys + order`` (aggregate ties first), and
    rows without a key are a key of their own.  Adds ``run_<m>`` (inclusive) and
    ``tot_<m>``; a NULL measure counts as 0.

    Without ``chunk`` this is a distributed prefix sum: rows are placed by
    ranges of (keys, order) in one exchange, so a key with most of the rows lies
    in as many ranges as its rows need; AQE derives their number from the
    measured bytes (``width`` fixes it).  The sorted ranges with their inner sums
    are written once below the shared folder.  Then the keys at the ranges' edges,
    two a range at most, are summed up over the ranges and carried to their rows.
    """
    keys, measures = list(keys), list(measures)
    if chunk is not None:
        return _totals_by_chunk(df, keys, order, measures, descending, chunk)
    placed = materialize(placed_sums(df, keys, order, measures, descending=descending, width=width), "prefix-sums")
    edges = placed.filter("__range_tail AND __range_edge > 0").select(*keys, "__range", "__range_edge", *[f"tot_{m}" for m in measures])
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    carry = edges.select(
        F.col("__range").alias("__c_part"), F.col("__range_edge").alias("__c_edge"),
        *[F.coalesce(F.sum(f"tot_{m}").over(earlier), F.lit(0)).alias(f"__before_{m}") for m in measures],
        *[F.sum(f"tot_{m}").over(whole).alias(f"__all_{m}") for m in measures],
    )
    # written first: Spark then knows how small it is
    carry = materialize(carry, "prefix-carry")
    out = placed.join(carry, (F.col("__range") == F.col("__c_part")) & (F.col("__range_edge") == F.col("__c_edge")), "left")
    kinds = dict(placed.dtypes)
    return out.select(
        *df.columns,
        *[(F.col(f"run_{m}") + F.coalesce(f"__before_{m}", F.lit(0))).cast(kinds[f"run_{m}"]).alias(f"run_{m}") for m in measures],
        *[F.coalesce(f"__all_{m}", f"tot_{m}").alias(f"tot_{m}") for m in measures],
    )


def _totals_by_chunk(df: DataFrame, keys: list[str], order: str, measures: list[str], descending: bool, chunk: Column) -> DataFrame:
    """Running totals with the caller's chunks: one exchange by (keys, chunk) that running sums and chunk totals share."""
    placed = df.withColumn("__chunk", chunk).repartition(*[F.col(k) for k in (*keys, "__chunk")])
    inside = W.partitionBy(*keys, "__chunk").orderBy(F.desc(order) if descending else F.asc(order))
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select("*", *[F.sum(m).over(inside).alias(f"__in_{m}") for m in measures])

    sums = placed.groupBy(*keys, "__chunk").agg(*[F.sum(m).alias(f"__c_{m}") for m in measures])
    across = W.partitionBy(*keys).orderBy(F.desc("__chunk") if descending else F.asc("__chunk"))
    earlier, whole = across.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    carry = sums.select(
        *[F.col(k).alias(f"__k_{k}") for k in (*keys, "__chunk")],
        *[F.coalesce(F.sum(f"__c_{m}").over(earlier), F.lit(0)).alias(f"__before_{m}") for m in measures],
        *[F.sum(f"__c_{m}").over(whole).alias(f"tot_{m}") for m in measures],
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, "__chunk")]
    return local.join(carry, same).select(
        *df.columns,
        *[(F.col(f"__in_{m}") + F.col(f"__before_{m}")).alias(f"run_{m}") for m in measures],
        *[F.col(f"tot_{m}") for m in measures],
    )


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """0-based position of each row by ``order`` within ``keys``; ``order`` must be unique there."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    packed = df.withColumn("__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])).withColumn("__n", F.lit(1).cast("bigint"))
    ran = running_totals(packed, keys, "__o", ["__n"])
    return ran.withColumn(name, F.col("run___n") - 1).drop("__o", "__n", "run___n", "tot___n")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, *, descending: bool = True) -> DataFrame:
    """Rank within ``keys``; tied values share the mean of their positions.  NULL values get NULL."""
    keys = list(keys)
    ties = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ran = running_totals(ties, keys, value, ["__n"], descending=descending)
    ranks = ran.select(*keys, value, (F.col("run___n") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value], "left").select(*df.columns, name)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per entry of ``probs``.

    ``percentile`` keeps all distinct values of a group in one buffer; here the
    counts per value stay distributed and only the two order statistics around
    each position are picked out.  NULLs are skipped.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ran = running_totals(counts, keys, value, ["__n"])
    picks, outs = [], []
    for name, p in probs.items():
        h = (F.col("tot___n") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("run___n") > F.floor(h), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("run___n") > F.ceil(h), F.col(value))).alias(f"__hi_{name}"),
            F.max(h - F.floor(h)).alias(f"__f_{name}"),
        ]
        lo, hi, f = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__f_{name}")
        outs.append((lo + (hi - lo) * f).alias(name))
    return ran.groupBy(*keys).agg(*picks).select(*keys, *outs)


def consecutive_pairs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    carry: Sequence[str],
    *,
    chunk: Column,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Each row with the previous row of the same key: ``prev_<c>`` for every carried column.

    The first row of a key has NULLs.  ``chunk`` must grow with ``order``; rows
    inside a chunk see each other through a window, and the first row of a
    chunk gets the last row of the chunk before it.  Only first and last rows
    of chunks travel to the second step.
    """
    keys, carry = list(keys), list(carry)
    order_by = [F.col(order), *[F.col(t) for t in tiebreak]]
    inside = W.partitionBy("__g", *keys, "__chunk").orderBy(*order_by)
    placed = df.withColumn("__chunk", chunk).withColumn("__this", F.struct(*carry))
    placed = placed.withColumn("__g", F.xxhash64(*keys, "__chunk"))  # a number to sort by before any text
    local = placed.withColumn("__prev", F.lag("__this").over(inside))

    def unpack(frame: DataFrame) -> DataFrame:
        return frame.select(*df.columns, *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in carry])

    inner = local.filter(F.col("__prev").isNotNull())
    edges = local.withColumn("__next", F.lead("__this").over(inside)).filter(F.col("__prev").isNull() | F.col("__next").isNull())
    across = W.partitionBy(*keys).orderBy("__chunk", *order_by)
    first_rows = (
        edges.withColumn("__starts", F.col("__prev").isNull())
        .withColumn("__prev", F.lag("__this").over(across))
        .filter("__starts")
    )
    return unpack(inner).unionByName(unpack(first_rows))
