"""Precision-recall evaluation with ties, and gains with intervals from the cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import columns as C
from tidegauge.operators import bootstrap, ordering
from tidegauge.session import materialize

#: Scores of arrays that a task adds up at a time.
HELD = 1 << 22


def _counted_places(scores: pa.ListArray, code: np.ndarray, tp: pa.Array, fp: pa.Array) -> tuple | None:
    """(code, place, score, tp, fp) of arrays of equally many whole, small scores, added up by counting; None for others."""
    flat, rows = scores.flatten(), len(scores)
    width = len(flat) // max(rows, 1)
    if not width or (scores.value_lengths().to_numpy(zero_copy_only=False) != width).any() or any(x.null_count for x in (flat, tp, fp)):
        return None
    values = flat.to_numpy(zero_copy_only=False)
    if not (values.min() >= -1 << 15 and values.max() < 1 << 15):
        return None
    small = values.astype(np.int16)
    if (small != values).any():
        return None
    small, sums, out, low = small.reshape(rows, width), [x.to_numpy() for x in (tp, fp)], [], int(small.min())
    levels = int(small.max()) - low + 1
    if (int(code.max()) + 1) * levels > HELD:
        return None
    for place in range(width):
        at = code * levels + small[:, place] - low
        found = np.flatnonzero(np.bincount(at))
        out.append((found // levels, np.full(len(found), place, np.int32), (found % levels + low).astype(values.dtype), *(np.bincount(at, x)[found] for x in sums)))
    own, *columns = (np.concatenate(x) for x in zip(*out))
    return own, *map(pa.array, columns)


def _places_added(batches: Iterator[pa.RecordBatch], rest: list[str], score: str) -> Iterator[pa.RecordBatch]:
    """(rest, ``__place``, score, tp, fp): ``HELD`` scores at a time, those of equal keys, place and score added up."""

    def flush(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        scores = rows.column(score).combine_chunks()
        code = np.zeros(rows.num_rows, np.int64)
        for k in rest:
            own = rows.column(k).combine_chunks().dictionary_encode("encode")
            code = np.unique(code, return_inverse=True)[1] * len(own.dictionary) + own.indices.to_numpy()
        _, sample, code = np.unique(code, return_index=True, return_inverse=True)
        counted = _counted_places(scores, code, *(rows.column(c).combine_chunks() for c in ("tp", "fp")))
        if counted is not None:
            own, *columns = counted
            return pa.table([*[rows.column(k).take(pa.array(sample[own])) for k in rest], *columns], names=[*rest, "__place", score, "tp", "fp"])
        parent = pc.list_parent_indices(scores).to_numpy()
        at = np.arange(len(parent))
        place = at - np.maximum.accumulate(np.where(np.r_[True, parent[1:] != parent[:-1]][: len(at)], at, 0))
        cells = pa.table({"c": code[parent], "__place": place.astype(np.int32), score: scores.flatten(), **{c: rows.column(c).take(pa.array(parent)) for c in ("tp", "fp")}})
        cells = cells.group_by(["c", "__place", score], use_threads=False).aggregate([("tp", "sum"), ("fp", "sum")])
        own = pa.array(sample[cells.column("c").to_numpy()])
        columns = [*[rows.column(k).take(own) for k in rest], cells.column("__place"), cells.column(score), cells.column("tp_sum"), cells.column("fp_sum")]
        return pa.table(columns, names=[*rest, "__place", score, "tp", "fp"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(score).flatten())
        if size >= HELD:
            yield from flush(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 16)
            held, size = [], 0
    if size:
        yield from flush(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 16)


def score_cells(
    scored: DataFrame, *, keys: Sequence[str], y: str, score: str, weight: str | None = None, set_keys: Sequence[str] = (), sets: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """(keys, score, tp, fp): positives and negatives of every distinct score.

    With ``sets`` the rows hold an array of scores, one for each of them, and ``set_keys`` are
    among ``keys``: places are added up, names follow.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    label = F.col(y).cast("double")
    sums = [F.sum(w * label).alias("tp"), F.sum(w * (1 - label)).alias("fp")]
    if sets is None:
        return scored.groupBy(*keys, score).agg(*sums)
    rest = [k for k in keys if k not in set_keys]
    rows = scored.select(*rest, score, (w * label).alias("tp"), (w * (1 - label)).alias("fp"))
    fields = [*[rows.schema[k] for k in rest], T.StructField("__place", T.IntegerType()), T.StructField(score, rows.schema[score].dataType.elementType), rows.schema["tp"], rows.schema["fp"]]
    # rows of a task are added up before they are sent, an array at a time; no row per place is made
    cells = added_cells(rows.mapInArrow(lambda b: _places_added(b, rest, score), T.StructType(fields)), [*rest, "__place"], score)
    names = F.element_at(F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(set_keys, s)]) for s in sets]), F.col("__place") + 1)
    return cells.withColumn("__s", names).select(*[F.col(f"__s.{k}").alias(k) if k in set_keys else k for k in keys], score, "tp", "fp")


def added_cells(cells: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Cells over fewer keys."""
    return cells.groupBy(*keys, score).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


def threshold_points(scored: DataFrame, *, keys: Sequence[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    """One row per (keys, distinct score) with running true and false positives from the top score down.

    Equal scores are one threshold, so they are summed before anything is ordered.
    """
    cells = score_cells(scored, keys=keys, y=y, score=score, weight=weight)
    return ordering.running_totals(cells, keys, score, ["tp", "fp"], descending=True)


def average_precision(
    scored: DataFrame, *, keys: Sequence[str], y: str, score: str, weight: str | None = None, name: str = "average_precision"
) -> DataFrame:
    """Area under the precision-recall steps per key; NULL when a key has no positives."""
    return area_of_points(threshold_points(scored, keys=keys, y=y, score=score, weight=weight), keys, name)


def average_precision_of_cells(cells: DataFrame, *, keys: Sequence[str], score: str, name: str = "average_precision") -> DataFrame:
    """:func:`average_precision` from (keys, score, tp, fp), a row per distinct score."""
    return area_of_points(ordering.running_totals(cells, keys, score, ["tp", "fp"], descending=True), keys, name)


def area_of_points(points: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    step = C.ratio("tp", "tot_tp") * F.coalesce(C.ratio("run_tp", F.col("run_tp") + F.col("run_fp")), F.lit(1.0))
    return points.groupBy(*keys).agg(F.sum(step).alias(name))


def performance(scored: DataFrame, *, keys: Sequence[str], y: str, score: str, user: str) -> DataFrame:
    """Rows, positives, users, prevalence, PR-AUC and lift per key.

    Rows of a key and user meet in tasks of a counted number of (narrow) rows, which hold
    the users they have seen; a task of the scan would hold those of all its rows.
    """
    slim = scored.select(*keys, y, user)
    met = ordering.sized(slim, -(-scored.count() // 8), *keys, user)
    base = met.groupBy(*keys).agg(
        F.count("*").alias("jobs"), F.sum(F.col(y).cast("bigint")).alias("positives"), F.countDistinct(user).alias("users"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
    )
    ap = average_precision(scored, keys=keys, y=y, score=score, name="pr_auc")
    return base.join(ap, list(keys)).withColumn("lift", C.ratio("pr_auc", "prevalence"))


def pooled(predictions: DataFrame, *, split: str, parts: Sequence[str], name: str = "pooled") -> DataFrame:
    """Every row under its own split and rows of ``parts`` also under ``name``; one scan, no union."""
    also = F.when(F.col(split).isin(list(parts)), F.lit(name))
    sets = F.filter(F.array(F.col(split), also), lambda s: s.isNotNull())
    return predictions.withColumn("__sets", sets).drop(split).withColumn(split, F.explode("__sets")).drop("__sets")


def subset_tags(scored: DataFrame, *, split: str, main: str, queue: str, queues: Sequence[str]) -> DataFrame:
    """Rows of the ``main`` split also under ``queue <q>`` for each listed queue (PR-AUC is then taken on the subset)."""
    also = F.when((F.col(split) == main) & F.col(queue).isin(list(queues)), F.concat(F.lit("queue "), F.col(queue)))
    sets = F.filter(F.array(F.col(split), also), lambda s: s.isNotNull())
    return scored.withColumn("__sets", sets).drop(split).withColumn(split, F.explode("__sets")).drop("__sets")


def gain_over_baseline(values: DataFrame, *, keys: Sequence[str], set_col: str, baseline: str, value: str, name: str) -> DataFrame:
    """``value`` of every feature set minus the baseline's value under the same keys.

    ``values`` holds one row per (keys, set), so a key's window is as large as
    the list of sets; one pass, where a self join would compute ``values`` twice.
    Keys without a baseline drop out.
    """
    ref = F.max(F.when(F.col(set_col) == baseline, F.col(value))).over(W.partitionBy(*keys))
    met = F.max((F.col(set_col) == baseline).cast("int")).over(W.partitionBy(*keys))
    paired = values.withColumn("__ref", ref).withColumn("__met", met).filter((F.col("__met") == 1) & (F.col(set_col) != baseline))
    return paired.withColumn(name, F.col(value) - F.col("__ref")).drop("__ref", "__met")


# ------------------------------------------------------------------ paired gains


def paired_gains(
    scored: DataFrame,
    *,
    test_keys: Sequence[str],
    set_keys: Sequence[str],
    set_col: str,
    baseline: str,
    y: str,
    score: str,
    cluster: str,
    n_boot: int = 1000,
    seed: int = 42,
    sets: Sequence[Sequence[str]] | None = None,
    cells: DataFrame | None = None,
    ap: DataFrame | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Gain over the baseline with a percentile interval and one-sided p per (test_keys, set_keys).

    ``set_keys`` includes ``set_col``; the remaining ones (such as the model)
    pair a set with its own baseline.  Resamples without positives are left
    out.  The interval works on ``n_boot`` values per set, so the built-in exact
    percentile is bounded.  ``sets``: see :func:`bootstrap.average_precision`;
    ``cells``: (keys, score, tp, fp) of ``scored``, a written table, if known; ``ap``: (keys, ap), too; ``slots``: :func:`bootstrap.indexed_clusters`, too.
    """
    keys = [*test_keys, *set_keys]
    pair = [*test_keys, *[k for k in set_keys if k != set_col]]
    if cells is None:
        cells = materialize(score_cells(scored, keys=keys, y=y, score=score, set_keys=set_keys, sets=sets), "score-cells")
    if ap is None:
        ap = average_precision_of_cells(cells, keys=keys, score=score, name="ap")
    delta = gain_over_baseline(ap, keys=pair, set_col=set_col, baseline=baseline, value="ap", name="delta")
    boot = bootstrap.average_precision(
        scored, test_keys=test_keys, set_keys=set_keys, y=y, score=score, cluster=cluster, n_boot=n_boot, seed=seed, sets=sets, slots=slots,
        counted=cells.select(*keys, score, (F.col("tp") + F.col("fp")).cast("bigint").alias("__n")),
    )
    diffs = gain_over_baseline(boot, keys=[*pair, "b"], set_col=set_col, baseline=baseline, value="ap", name="d")
    d = F.round("d", 12)  # equal rankings differ by summation noise only
    spread = (
        diffs.filter(C.finite("d"))
        .groupBy(*keys)
        .agg(
            F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("__ci"),
            F.avg((d <= 0).cast("double")).alias("p"),
            F.count("*").alias("resamples"),
        )
    )
    pos = cells.groupBy(*keys).agg(F.sum("tp").cast("bigint").alias("pos"))
    return (
        delta.select(*keys, "delta")
        .join(spread, keys)
        .join(pos, keys)
        .select(*keys, "delta", F.col("__ci")[0].alias("ci_low"), F.col("__ci")[1].alias("ci_high"), "p", "resamples", "pos")
    )


def wide_by(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key, ``<measure>_<value>`` columns for the listed values, in one aggregation."""
    aggs = [F.max(F.when(F.col(column) == v, F.col(m))).alias(f"{m}_{v}".replace(" ", "")) for m in measures for v in values]
    return df.groupBy(*keys).agg(*aggs)


def score_matrix(predictions: DataFrame, *, keys: Sequence[str], set_col: str, sets: Sequence[str], score: str) -> DataFrame:
    """One row per key and one score column per feature set."""
    return predictions.groupBy(*keys).pivot(set_col, list(sets)).agg(F.first(score))


def metric_by_model(perf: DataFrame, *, keys: Sequence[str], models: Sequence[str], value: str, prevalence: str, lead: str) -> DataFrame:
    """Mean of ``value`` per model side by side, plus the lead model's lift over the prevalence."""
    wide = perf.groupBy(*keys, prevalence).pivot("model", list(models)).agg(F.avg(value))
    return wide.withColumn(f"lift_{lead}", C.ratio(lead, prevalence))


def noise_floor(gains: DataFrame, *, keys: Sequence[str], importance: str, gain: str, quantile: float = 0.95) -> DataFrame:
    """Placebo floor per key: a high quantile of importance and the mean gain (placebos per key are few)."""
    return (
        gains.filter("is_placebo")
        .groupBy(*keys)
        .agg(F.percentile(importance, F.lit(float(quantile))).alias("importance_p95"), F.avg(gain).alias("mean_gain"))
    )


def is_placebo(set_col: str) -> Column:
    return F.col(set_col).startswith("placebo")
