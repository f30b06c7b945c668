"""The paired cluster bootstrap of the PR-AUC: every resample, model and set, in bounded pieces.

A resample draws as many clusters (users) as there are, with replacement; a row
counts as often as its cluster was drawn, and all sets of a test set share the
draws, which is what pairs them.

1. Draws.  A task makes the draws of four resamples for ``BLOCK`` slots from md5,
   sorts them and sends them, two bytes each, to the chunk of ``CHUNK`` slots
   they fell on, which counts them.  A cluster's weights of all resamples are one
   string of bytes.
2. Ranges.  Rows become cells (set, score, cluster).  A distributed prefix sum of
   the cells per distinct score cuts every set into ranges of about ``CELLS``
   cells, so the number of ranges follows the data.  A single score with more
   cells than that is a range of its own, split by cluster.
3. Lanes.  Ranges of one test set are dealt to lanes of about ``LANE`` cells by a
   second prefix sum.  A lane gets the weights of its clusters once for all its
   ranges.
4. Totals.  Weighted true and false positives of every range whose set has more
   than one, then sums over higher ranges: one row per range and slice of resamples.
5. Area.  Inside a lane and range, ``SLICE`` resamples at a time: gather the
   weights in the order of scores, ``reduceat`` over ties, ``cumsum`` down the
   scores, add the carried totals.

Sets with many rows a score are summed up by blocks of clusters instead (:func:`block_areas`).

:func:`lane_bytes` is the most that a lane's task holds.  Sums over scores are exact;
areas differ from the definition by rounding only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import columns as C
from tidegauge.operators import ordering
from tidegauge.operators.ordering import spread
from tidegauge.operators.small import literal_table
from tidegauge.session import materialize

#: Slots counted together, slots whose draws are made together, digests made together.
CHUNK, BLOCK, PIECE = 1024, 1 << 20, 1 << 16
#: Cells of a range and of a lane, resamples handled at a time.
CELLS, LANE, SLICE = 1 << 14, 1 << 16, 100
#: Sums by blocks: slots of a block, rows of a task, sums of a task, scores of a set, blocks added at once, rows added in a core's cache.
WIDE, TASK_CELLS, TASK_SUMS, LEVELS, FAN, NEAR = 1 << 15, 1 << 22, 1 << 26, 1 << 14, 64, 2048
#: Clusters a slot of a block of draws up to which a quad is sent as counts, half a byte each.
DENSE = 4
#: Cells packed at a time, and rows of a slot among them from which they are added up first.
PACK, HOT = 1 << 20, 1 << 12
#: Blocks that a task adds up before it sends their sums, where there are enough of them.
FEW = 3
#: Rows a distinct score and block from which a set is summed up by blocks.
TIED = 4


def lane_bytes(cells: int, largest_range: int, n_boot: int, width: int = 1) -> int:
    """Most bytes of arrays for a lane: the weights of its clusters (at most one a cell), cells, and one slice of a range.

    ``width`` is the bytes of a weight (2 where a cluster was drawn over 255
    times in one resample); a slice has 8-byte copies of the weights of both
    labels, tie sums, running sums and quotients.
    """
    return cells * (n_boot * width + 64) + largest_range * min(SLICE, n_boot) * 8 * 7


# ------------------------------------------------------------------ draws


def indexed_clusters(rows: DataFrame, *, keys: Sequence[str], cluster: str) -> DataFrame:
    """(keys, cluster, slot, clusters): distinct clusters numbered 0.. in sorted order per key."""
    distinct = rows.select(*keys, cluster).distinct().withColumn("__n", F.lit(1).cast("bigint"))
    ran = ordering.running_totals(distinct, keys, cluster, ["__n"])
    return ran.select(*keys, cluster, (F.col("run___n") - 1).alias("slot"), F.col("tot___n").alias("clusters"))


_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]


def md5_words(prefix: bytes, first: int, count: int) -> np.ndarray:
    """The four 32-bit words of ``md5(prefix + str(i))`` for i from ``first`` on, a row each (as in the hex digest).

    One block of md5 over arrays: the message is at most 55 bytes, and all i of a call have equally many digits.
    """
    digits = len(str(first))
    size = len(prefix) + digits
    assert size <= 55 and len(str(first + max(count, 1) - 1)) == digits
    fixed = np.frombuffer((prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    message: list = list(fixed)
    i = np.arange(first, first + count, dtype=np.uint64)
    for at in range(size - 1, len(prefix) - 1, -1):
        i, digit = np.divmod(i, np.uint64(10))
        message[at // 4] = message[at // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (at % 4)))
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(count, v, np.uint32) for v in start)
    f = np.empty(count, np.uint32)  # nothing else is allocated below
    for step in range(64):
        turn = step // 16
        if turn == 0:
            g = step
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            g = (5 * step + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            g = (3 * step + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = (7 * step) % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        plus = _SINES[step]
        if message[g].ndim:
            a += message[g]
        else:
            plus = (plus + int(message[g])) & 0xFFFFFFFF
        a += np.uint32(plus)
        by = _SHIFTS[turn][step % 4]
        np.right_shift(a, np.uint32(32 - by), out=f)
        a <<= np.uint32(by)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([v + np.full(1, s, np.uint32) for v, s in zip((a, b, c, d), start)]).byteswap()


def _quad_words(seed: int, q: int, first: int, count: int) -> np.ndarray:
    """Words of quad ``q`` for the slots from ``first`` on, four rows: in pieces that stay in a core's cache."""
    out, at, prefix = np.empty((4, count), np.uint32), first, f"{seed}|{q}|".encode()
    while at < first + count:
        upto = min(first + count, at + PIECE, 10 ** len(str(at)))
        out[:, at - first : upto - first] = md5_words(prefix, at, upto - at)
        at = upto
    return out


def _drawn(batches: Iterator[pa.RecordBatch], keys: list[str], n_boot: int, seed: int, size: int) -> Iterator[pa.RecordBatch]:
    """(keys, chunk, clusters, q, draws): where the draws of a quad and block of slots fall, sorted, by chunk.

    A draw is its slot in the chunk times four and the resample's place in the quad.
    """
    for batch, i, n, _, words in _quads(batches, n_boot, seed):
        yield from _sorted_draws(batch, i, n, words, keys, size)


def _quads(batches: Iterator[pa.RecordBatch], n_boot: int, seed: int) -> Iterator[tuple[pa.RecordBatch, int, int, int, np.ndarray]]:
    """(batch, row, clusters, q, words) of every quad and block of slots; the words are the same for all keys."""
    last, words = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            n, q, block = (batch.column(c)[i].as_py() for c in ("clusters", "q", "block"))
            first, upto = block * BLOCK, min(n, (block + 1) * BLOCK)
            if last is None or last[:2] != (q, block) or last[2] < upto:
                last, words = (q, block, upto), _quad_words(seed, q, first, upto - first)
            yield batch, i, n, q, words[: min(4, n_boot - 4 * q), : upto - first]


def _sent(batch: pa.RecordBatch, i: int, keys: list[str], columns: dict, blobs: list[bytes]) -> pa.RecordBatch:
    """A row per string of bytes, with the keys, clusters and quad of row ``i``."""
    one = pa.array(np.full(len(blobs), i))
    taken = {c: batch.column(c).take(one) for c in (*keys, "clusters", "q")}
    made = {**{k: taken[k] for k in keys}, **columns, "clusters": taken["clusters"], "q": taken["q"], "draws": pa.array(blobs, pa.binary())}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _sorted_draws(batch: pa.RecordBatch, i: int, n: int, words: np.ndarray, keys: list[str], size: int, **more: bool) -> Iterator[pa.RecordBatch]:
    place = (words.astype(np.uint64) * np.uint64(n) >> np.uint64(32)) * np.uint64(4) + np.arange(len(words), dtype=np.uint64)[:, None]
    place = place.astype(np.uint32 if 4 * n < 1 << 32 else np.uint64).ravel()
    place.sort()
    cut = np.searchsorted(place, np.arange(0, -(-n // size) + 1, dtype=np.uint64) * np.uint64(4 * size))
    chunk = np.flatnonzero(cut[1:] > cut[:-1])
    packed = (place % (4 * size)).astype("<u2" if 4 * size <= 1 << 16 else "<u4")
    for at in range(0, len(chunk), 4096):
        part = chunk[at : at + 4096]
        columns = {"chunk": pa.array(part), **{k: pa.array([v] * len(part)) for k, v in more.items()}}
        yield _sent(batch, i, keys, columns, [packed[cut[c] : cut[c + 1]].tobytes() for c in part.tolist()])


def _dealt(batches: Iterator[pa.RecordBatch], keys: list[str], n_boot: int, seed: int, size: int) -> Iterator[pa.RecordBatch]:
    """(keys, chunk, dense, clusters, q, draws): the draws of a quad and block of slots by chunk, as counts where they are dense.

    Two resamples' counts of a slot are one byte; with more than ``DENSE`` slots a draw, or a count above 15, draws are sent as in :func:`_drawn`.
    """
    for batch, i, n, _, words in _quads(batches, n_boot, seed):
        counts = None
        if n <= DENSE * words.shape[1]:
            counts, slot = np.zeros((4, n), np.uint8), np.empty(words.shape[1], np.uint64)
            for row, own in zip(counts, words):
                np.multiply(own, np.uint64(n), out=slot, dtype=np.uint64)
                slot >>= np.uint64(32)
                times = np.bincount(slot.view(np.int64), minlength=n)
                if times.max() > 15:
                    counts = None
                    break
                row[:] = times
        if counts is None:
            yield from _sorted_draws(batch, i, n, words, keys, size, dense=False)
            continue
        pairs = counts[0::2] | counts[1::2] << 4
        blobs = [pairs[:, at : at + size].tobytes() for at in range(0, n, size)]
        for at in range(0, len(blobs), 64):
            some = blobs[at : at + 64]
            yield _sent(batch, i, keys, {"chunk": pa.array(np.arange(at, at + len(some))), "dense": pa.array([True] * len(some))}, some)


def _spread_counts(q: np.ndarray, blobs: pa.ChunkedArray, width: int, size: int) -> np.ndarray:
    """:func:`_block_weights` where every quad is one string of counts: the four counts of a slot are one word, looked up by their two bytes."""
    pairs = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(len(q), 2, -1)
    both = np.arange(1 << 16, dtype=np.uint32)
    words = both & 15 | (both & 0xF0) << 4 | (both & 0xF00) << 8 | (both & 0xF000) << 12
    weights = np.zeros((size + 1, width), np.uint8)
    out, order, step = weights.view("<u4"), np.argsort(q), max(1, NEAR // 8)
    first = int(q[order[0]])
    whole = int(q[order[-1]]) - first == len(q) - 1
    columns = slice(first, first + len(q)) if whole else q[order]
    for at in range(0, pairs.shape[2], step):  # in pieces that stay in a core's cache
        some = pairs[order, :, at : at + step]
        some = some[:, 0].astype(np.uint16) | some[:, 1].astype(np.uint16) << np.uint16(8)
        out[at : at + some.shape[1], columns] = words[some.T]
    return weights


def _block_weights(table: pa.Table, n_boot: int, size: int) -> np.ndarray:
    """Weights of the slots of one chunk, a row each, and a row of zeros; resamples filled up to a multiple of eight."""
    width = -(-n_boot // 8) * 8
    if not table.num_rows:
        return np.zeros((size + 1, width), np.uint8)
    q, dense, blobs = table.column("q").to_numpy(), table.column("dense").to_numpy(), table.column("draws")
    if dense.all() and len(np.unique(q)) == len(q):
        return _spread_counts(q, blobs, width, size)
    drawn = np.zeros((width, size), np.uint8)  # a row for each resample
    order = np.argsort(q, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(order)]):
        counts = np.zeros((4, size), np.uint8 if hi - lo == 1 and dense[order[lo]] else np.uint32)
        for at in order[lo:hi].tolist():
            blob = blobs[at].as_py()
            if dense[at]:
                pairs = np.frombuffer(blob, np.uint8).reshape(2, -1)
                counts[0::2, : pairs.shape[1]] += pairs & 15
                counts[1::2, : pairs.shape[1]] += pairs >> 4
            else:
                kind = "<u2" if 4 * size <= 1 << 16 else "<u4"
                counts += np.bincount(np.frombuffer(blob, kind), minlength=4 * size).reshape(size, 4).T.astype(np.uint32)
        if counts.max() > np.iinfo(drawn.dtype).max:
            drawn = drawn.astype(np.uint32)
        first = 4 * int(q[order[lo]])
        drawn[first : min(first + 4, n_boot)] = counts[: n_boot - first]
    weights = np.zeros((size + 1, width), drawn.dtype)
    for at in range(0, size, NEAR):  # turned round in pieces that stay in a core's cache
        weights[at : min(at + NEAR, size)] = drawn[:, at : at + NEAR].T
    return weights


def _fields(df: DataFrame, names: Sequence[str], *extra: T.StructField) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + list(extra))


def _units_of_draws(slots: DataFrame, keys: Sequence[str], n_boot: int) -> DataFrame:
    """(keys, clusters, q, block): quads of resamples and blocks of slots, dealt so that one task makes those of all keys."""
    sizes = slots.groupBy(*keys).agg(F.max("clusters").alias("clusters"))
    units = sizes.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit((n_boot + 3) // 4 - 1)))).withColumn("block", F.explode(F.expr(f"sequence(0L, (clusters - 1) div {BLOCK}L)")))
    return spread(units, "q", "block").sortWithinPartitions("q", "block", F.desc("clusters"))


def weight_vectors(slots: DataFrame, *, keys: Sequence[str], n_boot: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, slot, w): how often each cluster is drawn in each resample, as bytes (two a weight where one passes 255).

    Draw i of resample b is word ``b mod 4`` of ``md5(seed | b div 4 | i)``
    scaled to the number of clusters: it can be recomputed anywhere, so a task
    makes the draws of a quad and a block of slots for all keys.  A chunk of slots
    gets about ``chunk * n_boot`` draws of two bytes, whatever the number of clusters.
    """
    keys = list(keys)
    last = (n_boot + 3) // 4 - 1
    units = _units_of_draws(slots, keys, n_boot)
    fields = [T.StructField("chunk", T.LongType()), T.StructField("clusters", T.LongType()), T.StructField("q", T.IntegerType()), T.StructField("draws", T.BinaryType())]
    drawn = units.mapInArrow(lambda b: _drawn(b, keys, n_boot, seed, chunk), _fields(units, keys, *fields))

    def count(table: pa.Table) -> pa.Table:
        first, n = table.column("chunk")[0].as_py() * chunk, table.column("clusters")[0].as_py()
        size = min(chunk, n - first)
        counts = np.zeros((chunk, 4 * (last + 1)), np.uint32)
        kind = "<u2" if 4 * chunk <= 1 << 16 else "<u4"
        for q, blob in zip(table.column("q").to_pylist(), table.column("draws").to_pylist()):
            counts[:, 4 * q : 4 * q + 4] += np.bincount(np.frombuffer(blob, kind), minlength=4 * chunk).reshape(chunk, 4).astype(np.uint32)
        counts = counts[:size, :n_boot]
        wide = counts.max(axis=1) > 255
        blobs = [c.astype("<u2" if w else "u1").tobytes() for c, w in zip(counts, wide.tolist())]
        one = np.zeros(size, np.int64)
        return pa.table([*[table.column(k).take(one) for k in keys], pa.array(first + np.arange(size)), pa.array(blobs, pa.binary())], names=[*keys, "slot", "w"])

    return drawn.groupBy(*keys, "chunk").applyInArrow(count, _fields(drawn, keys, T.StructField("slot", T.LongType()), T.StructField("w", T.BinaryType())))


def unpack_weights(blobs: pa.ChunkedArray | pa.Array, n_boot: int) -> np.ndarray:
    """Weights as a matrix, a row for each string of bytes; one byte a weight if that is enough for all."""
    rows = blobs.to_pylist()
    wide = [len(r) != n_boot for r in rows]
    if not any(wide):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), n_boot)
    return np.stack([np.frombuffer(r, "<u2" if w else np.uint8).astype(np.uint16) for r, w in zip(rows, wide)])


def bootstrap_weights(rows: DataFrame, *, keys: Sequence[str], cluster: str, n_boot: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, cluster, b, weight): how often each cluster is drawn in each resample; absent means 0."""
    slots = materialize(indexed_clusters(rows, keys=keys, cluster=cluster), "bootstrap-clusters")
    vectors = weight_vectors(slots, keys=keys, n_boot=n_boot, seed=seed, chunk=chunk)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                w = unpack_weights(part.column("w"), n_boot)
                i, b = np.nonzero(w)
                where = pa.array(i)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(where) for k in (*keys, "slot")], pa.array(b.astype(np.int32)), pa.array(w[i, b].astype(np.int64))], [*keys, "slot", "b", "weight"])

    long = vectors.mapInArrow(unfold, _fields(vectors, [*keys, "slot"], T.StructField("b", T.IntegerType()), T.StructField("weight", T.LongType())))
    return _named(long, slots, keys, cluster).select(*keys, cluster, "b", "weight")


def _named(found: DataFrame, slots: DataFrame, keys: Sequence[str], cluster: str) -> DataFrame:
    """``found`` with the cluster of each slot; a NULL key is a key."""
    own = slots.select(*[F.col(k).alias(f"__k_{k}") for k in (*keys, "slot")], cluster)
    return found.join(own, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, "slot")])


def weight_sums(rows: DataFrame, *, keys: Sequence[str], cluster: str, n_boot: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, cluster, draws, resamples, most, checksum) of each cluster that is drawn: all its draws, the resamples
    it is in, its largest weight, and the sum of weight * weight * (b + 1).

    Adds up :func:`weight_vectors` where they are made: no row per cluster and resample.
    """
    slots = materialize(indexed_clusters(rows, keys=keys, cluster=cluster), "bootstrap-clusters")
    vectors = weight_vectors(slots, keys=keys, n_boot=n_boot, seed=seed, chunk=chunk)
    names = ["draws", "resamples", "most", "checksum"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                w = unpack_weights(part.column("w"), n_boot).astype(np.int64)
                sums = [w.sum(axis=1), (w > 0).sum(axis=1), w.max(axis=1), (w * w) @ np.arange(1, n_boot + 1)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in (*keys, "slot")], *[pa.array(x) for x in sums]], [*keys, "slot", *names])

    found = vectors.mapInArrow(add, _fields(vectors, [*keys, "slot"], *[T.StructField(n, T.LongType()) for n in names])).filter("resamples > 0")
    return _named(found, slots, keys, cluster).select(*keys, cluster, *names)


# ------------------------------------------------------------------ ranges and lanes


def placed_cells(cells: DataFrame, *, test_keys: Sequence[str], set_keys: Sequence[str], score: str, limit: int = CELLS, lane: int = LANE) -> DataFrame:
    """``cells`` with ``__part`` (range of scores, 0 the highest), ``__sub`` (piece of a score too large for a range),
    ``__parts`` (ranges of the set) and ``__lane``.

    ``cells`` is a written table with a row per (keys, score, slot).
    """
    keys = [*test_keys, *set_keys]
    scores = cells.groupBy(*keys, score).agg(F.count("*").alias("__n"))
    ran = ordering.running_totals(scores, keys, score, ["__n"], descending=True)
    hot = F.col("__n") > limit
    # the hot score of a stretch comes last in it
    part = 2 * F.floor((F.col("run___n") - F.col("__n")) / F.lit(limit)) + hot.cast("int")
    cuts = ran.select(*keys, score, part.alias("__part"), F.when(hot, F.ceil(F.col("__n") / F.lit(limit))).otherwise(1).cast("int").alias("__subs"))
    sub = F.pmod(F.xxhash64("slot"), F.col("__subs")).cast("int")
    # a score of many rows meets one row: AQE splits such a partition
    same = [cells[k].eqNullSafe(cuts[k]) for k in (*keys, score)]
    placed = materialize(cells.join(cuts, same).select(*[cells[c] for c in cells.columns], "__part", "__subs").withColumn("__sub", sub), "bootstrap-placed")
    units = placed.groupBy(*keys, "__part", "__sub").agg(F.count("*").alias("__n"))
    order = F.struct(*set_keys, "__part", "__sub")
    ran = ordering.running_totals(units.withColumn("__o", order), test_keys, "__o", ["__n"])
    lanes = ran.withColumn("__lane", F.floor((F.col("run___n") - F.col("__n")) / F.lit(lane)))
    counts = units.groupBy(*keys).agg(F.countDistinct("__part").alias("__parts"))
    lanes = lanes.join(counts, [lanes[k].eqNullSafe(counts[k]) for k in keys]).select(*[lanes[k] for k in keys], "__part", "__sub", "__lane", "__parts")
    lanes = materialize(lanes, "bootstrap-lanes")  # a row per range: Spark knows how few
    names = [*keys, "__part", "__sub"]
    return placed.join(lanes, [placed[k].eqNullSafe(lanes[k]) for k in names]).select(*[placed[c] for c in placed.columns], lanes["__lane"], lanes["__parts"])


def _units(left: pa.Table, names: list[str], score: str) -> Iterator[tuple[int, np.ndarray]]:
    """(a row of the unit, its rows by falling score) for every range of a lane."""
    if not left.num_rows:
        return
    frame = left.select(names).to_pandas()
    code = frame.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
    value = left.column(score).to_numpy()
    order = np.lexsort((-value, code))
    starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(order[a]), order[a:b]


def _label_sums(weights: np.ndarray, rows: np.ndarray, count: np.ndarray, level: np.ndarray, levels: int) -> np.ndarray:
    """Weights of all resamples of a slice times ``count``, added up for each level (distinct score)."""
    out = np.zeros((levels, weights.shape[1]))
    some = np.flatnonzero(count > 0)
    if len(some):
        values = weights[rows[some]].astype(np.int64)
        if (count[some] != 1).any():
            values *= count[some][:, None]
        at = level[some]
        starts = np.flatnonzero(np.r_[True, np.diff(at) != 0])
        out[at[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _lane(left: pa.Table, right: pa.Table, set_keys: list[str], score: str, n_boot: int, area: bool, names: list[str]) -> pa.Table:
    """Totals (``area`` False) or areas of the ranges of one lane, a row per range and slice."""
    slot = right.column("slot").to_numpy()
    weighed = np.flatnonzero(slot >= 0)
    weights = unpack_weights(right.column("w").take(pa.array(weighed)), n_boot) if len(weighed) else np.zeros((1, n_boot), np.uint8)
    order = np.argsort(slot[weighed])
    known = slot[weighed][order]
    p, q, own = (left.column(c).to_numpy() for c in ("__p", "__q", "slot"))
    near = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
    row = order[near] if len(known) else np.zeros(len(own), np.int64)
    missing = known[near] != own if len(known) else np.ones(len(own), bool)
    if missing.any():  # never drawn, like all of their chunk
        row, weights = np.where(missing, len(weights), row), np.concatenate([weights, np.zeros((1, n_boot), weights.dtype)])
    value = left.column(score).to_numpy()
    unit_names = [*set_keys, "__part", *([] if area else ["__sub"])]
    carried = {}
    if area:
        for i in np.flatnonzero(slot < 0).tolist():
            name = tuple(right.column(c)[i].as_py() for c in (*set_keys, "__part"))
            carried[(*name, right.column("b0")[i].as_py())] = np.frombuffer(right.column("w")[i].as_py(), np.float64).reshape(3, -1)
    picked, slices, first, second = [], [], [], []
    for sample, at in _units(left, unit_names, score):
        name = tuple(left.column(c)[sample].as_py() for c in (*set_keys, "__part")) if area else ()
        level = np.cumsum(np.r_[False, value[at][1:] != value[at][:-1]])
        for b0 in range(0, n_boot, SLICE):
            w = weights[:, b0 : b0 + SLICE]
            if not area:
                zero = np.zeros(len(at), np.int64)
                tp, fp = (_label_sums(w, row[at], c[at], zero, 1)[0] for c in (p, q))
                first.append(tp.tolist())
                second.append(fp.tolist())
            else:
                tp, fp = (_label_sums(w, row[at], c[at], level, int(level[-1]) + 1) for c in (p, q))
                tp0, fp0, pos = carried.get((*name, b0), (0.0, 0.0, tp.sum(axis=0)))
                run, both = np.cumsum(tp, axis=0) + tp0, np.cumsum(fp, axis=0) + fp0
                both += run
                run = np.divide(run, both, out=np.ones_like(both), where=both > 0)
                run *= tp
                first.append(np.divide(run.sum(axis=0), pos, out=np.full(len(pos), np.nan), where=pos > 0).tolist())
            picked.append(sample)
            slices.append(b0)
    columns = [left.column(c).take(pa.array(picked, pa.int64())) for c in names]
    more = [pa.array(first, pa.list_(pa.float64()))] + ([] if area else [pa.array(second, pa.list_(pa.float64()))])
    return pa.table([*columns, pa.array(slices, pa.int32()), *more], names=[*names, "b0", *(["area"] if area else ["tp", "fp"])])


def _carry(table: pa.Table, keys: list[str]) -> pa.Table:
    """For one set and slice: what higher ranges sum up to, and the area of ranges that are one score.

    Holds a row of three vectors per range.
    """
    frame = table.to_pandas()
    parts, code = np.unique(frame["__part"].to_numpy(), return_inverse=True)
    tp, fp = (np.zeros((len(parts), len(frame[c].iloc[0]))) for c in ("tp", "fp"))
    np.add.at(tp, code, np.stack(frame["tp"].to_numpy()))  # pieces of a score are one range again
    np.add.at(fp, code, np.stack(frame["fp"].to_numpy()))
    before_t, before_f, pos = np.cumsum(tp, axis=0) - tp, np.cumsum(fp, axis=0) - fp, tp.sum(axis=0)
    both = before_t + before_f + tp + fp
    share = tp * np.divide(before_t + tp, both, out=np.ones_like(both), where=both > 0)
    area = np.divide(share, pos, out=np.full(share.shape, np.nan), where=pos > 0)
    whole = [np.concatenate([t, f, pos]).tobytes() for t, f in zip(before_t, before_f)]
    one = pa.array(np.zeros(len(parts), np.int64))
    columns = [table.column(k).take(one) for k in (*keys, "b0")]
    return pa.table([*columns, pa.array(parts), pa.array(whole, pa.binary()), pa.array(area.tolist(), pa.list_(pa.float64()))], names=[*keys, "b0", "__part", "w", "area"])


# ------------------------------------------------------------------ sums by blocks of clusters


def planned_sets(scores: DataFrame, slots: DataFrame, *, test_keys: Sequence[str], set_keys: Sequence[str], n_boot: int, tied: float, wide: int, listed: DataFrame | None = None) -> DataFrame:
    """(keys, ``__set``, ``__tied``, ``__blocks``, ``__lot``) of every set, from counted rows and scores.

    Tied sets of a test are dealt to lots, so that a block of a lot has about ``TASK_CELLS`` rows and ``TASK_SUMS`` sums.
    With ``listed`` (set_keys, ``__place``) the sets of a test are numbered in that order, and ``__first`` is the number of the first.
    """
    keys = [*test_keys, *set_keys]
    sets = scores.groupBy(*keys).agg(F.sum("__n").alias("__cells"), F.count("*").alias("__levels"))
    sizes = slots.groupBy(*test_keys).agg(F.ceil(F.max("clusters") / F.lit(wide)).alias("__blocks")).withColumn("__test", F.monotonically_increasing_id())
    sizes = materialize(sizes, "bootstrap-tests")
    sets = sets.join(sizes, [sets[k].eqNullSafe(sizes[k]) for k in test_keys]).select(*[sets[c] for c in sets.columns], "__blocks", "__test")
    many = F.col("__cells") >= F.lit(float(tied)) * F.col("__levels") * F.col("__blocks")
    sets = sets.withColumn("__tied", many & (F.col("__levels") <= LEVELS))
    extra = []
    if listed is None:
        sets = sets.withColumn("__set", F.monotonically_increasing_id())
    else:
        sets = sets.join(listed, [sets[k].eqNullSafe(listed[k]) for k in set_keys]).select(*[sets[c] for c in sets.columns], "__place")
        first = F.col("__test") * listed.count()
        sets, extra = sets.withColumn("__first", first).withColumn("__set", first + F.col("__place")), ["__first", "__place"]
    sets = materialize(sets, "bootstrap-sets")
    test = W.partitionBy(*test_keys, "__tied")
    lots = F.ceil(F.greatest(F.sum("__cells").over(test) / (F.col("__blocks") * TASK_CELLS), F.sum("__levels").over(test) * n_boot / F.lit(TASK_SUMS)))
    dealt = sets.withColumn("__lots", lots).withColumn("__l", F.pmod(F.xxhash64("__set"), F.col("__lots")))
    lot = F.min("__set").over(W.partitionBy(*test_keys, "__tied", "__l"))  # a number of the lot
    return materialize(dealt.withColumn("__lot", lot).select(*keys, "__set", "__tied", "__blocks", "__lot", *extra), "bootstrap-lots")


def _falling(score: np.ndarray) -> np.ndarray:
    """64-bit numbers that rise as the scores fall; NaN above all, -0.0 the same as 0.0."""
    if score.dtype.kind == "f":
        score = score.astype(np.float64)
        bits = np.where(np.isnan(score), np.nan, score + 0.0).view(np.int64)
        return ~(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))
    return ~score.astype(np.int64)


_CELL = np.dtype([("key", "<i8"), ("slot", "<u4"), ("p", "<i4"), ("q", "<i4")])
_ROW = np.dtype([("slot", "<u4"), ("p", "<i4"), ("q", "<i4")])


def _merged(cells: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a set, score and slot added up to one."""
    order = np.lexsort((cells["slot"], cells["key"], number))
    cells, number = cells[order], number[order]
    new = (number[1:] != number[:-1]) | (cells["key"][1:] != cells["key"][:-1]) | (cells["slot"][1:] != cells["slot"][:-1])
    starts = np.flatnonzero(np.r_[True, new])
    out = cells[starts]
    for c in ("p", "q"):
        out[c] = np.add.reduceat(cells[c], starts)
    return out, number[starts]


def _packed_cells(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """(lot, block, set, cells): the cells of a set and block of slots as one string, from ``PACK`` cells at a time.

    A row has a score and a lot for every set from ``__first`` on (no lot: left out).  Cells of a slot with more than
    ``HOT`` rows are added up first, so a cluster with a third of all rows sends its distinct cells.
    """

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        scores, lots = (rows.column(c).combine_chunks() for c in ("__scores", "__lots"))
        lengths = scores.value_lengths().to_numpy()
        offsets = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        firsts, own = np.unique(rows.column("__first").to_numpy(), return_inverse=True)
        width = int(lengths.max(initial=1))
        code = (own * width - offsets)[row] + np.arange(len(row))  # a number for each set
        known = (firsts[:, None] + np.arange(width)).ravel()
        key, lot = _falling(scores.flatten().to_numpy(zero_copy_only=False)), lots.flatten()
        kept = lot.is_valid().to_numpy(zero_copy_only=False)
        lot = lot.fill_null(0).to_numpy()
        if not kept.all():
            row, code, key, lot = row[kept], code[kept], key[kept], lot[kept]
        if not len(row):
            return
        cells = np.empty(len(row), _CELL)
        cells["key"] = key
        slot = rows.column("slot").to_numpy()
        for c, values in (("slot", slot), ("p", rows.column("__p").to_numpy()), ("q", rows.column("__q").to_numpy())):
            cells[c] = values[row]
        own_lot = np.zeros(len(known), np.int64)
        own_lot[code] = lot
        _, at, times = np.unique(slot, return_inverse=True, return_counts=True)
        if times.max() > HOT:
            hot = (times[at] > HOT)[row]
            merged, merged_code = _merged(cells[hot], code[hot])
            cells, code = np.concatenate([cells[~hot], merged]), np.concatenate([code[~hot], merged_code])
            block = cells["slot"] // wide
        else:
            block = (slot // wide)[row]
        blocks = int(block.max()) + 1
        group = code * blocks + block
        if len(known) * blocks <= 1 << 16:  # sorted by counting
            group = group.astype(np.uint16)
        order = np.argsort(group, kind="stable")
        cells, group = cells[order], group[order]
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        own = code[order][cuts]
        blobs = [cells[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)])]
        columns = [own_lot[own], block[order][cuts].astype(np.int64), known[own]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], names=["__lot", "__block", "__set", "cells"])

    held, size = [], 0
    for batch in batches:
        width = max(1, batch.column("__scores").value_lengths().to_numpy().max(initial=1))
        step = max(1, PACK // int(width))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].num_rows * int(width)
            if size >= PACK:
                yield from flush(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield from flush(pa.Table.from_batches(held))


def _narrow(scores: np.ndarray) -> tuple[str, bytes]:
    """Scores as bytes and their kind: the letter of the numbers they stand for, and two bytes each (whole and small) or eight."""
    letter = "f" if scores.dtype.kind == "f" else "i"
    if scores.size and scores.min() >= -1 << 15 and scores.max() < 1 << 15:
        small = scores.astype("<i2")
        if (small == scores).all():
            return letter + "2", small.tobytes()
    return letter + "8", scores.astype(f"<{letter}8").tobytes()


_PACKED = "__lot long, __block long, __set long, cells binary, __sets binary, kind string, scores binary"


def _packed_rows(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """The rows of a test and block of slots as one string, with the scores of all sets of a lot, from ``PACK`` scores at a time.

    Rows as :func:`_packed_cells` reads them; those of a test have equally many scores and the same lots.  Rows of a
    slot with more than ``HOT`` of them go as cells that are added up, a set each.
    """
    names = ["__lot", "__block", "__set", "cells", "__sets", "kind", "scores"]

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        slot = rows.column("slot").to_numpy()
        _, at, times = np.unique(slot, return_inverse=True, return_counts=True)
        hot = (times > HOT)[at]
        if hot.any():
            for batch in _packed_cells(iter(rows.filter(pa.array(hot)).to_batches()), wide):
                none = [pa.nulls(batch.num_rows, t) for t in (pa.binary(), pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *none], names=names)
        scores, lots = (rows.column(c).combine_chunks() for c in ("__scores", "__lots"))
        lengths, flat = scores.value_lengths().to_numpy(), scores.flatten().to_numpy(zero_copy_only=False)
        offsets, first, block = np.cumsum(lengths) - lengths, rows.column("__first").to_numpy(), slot // wide
        order = np.lexsort((block, first))
        order = order[~hot[order]]
        if not len(order):
            return
        own = np.empty(len(order), _ROW)
        for c, values in (("slot", slot), ("p", rows.column("__p").to_numpy()), ("q", rows.column("__q").to_numpy())):
            own[c] = values[order]
        new = (first[order][1:] != first[order][:-1]) | (block[order][1:] != block[order][:-1])
        cuts, places, out = np.flatnonzero(np.r_[True, new]).tolist(), {}, []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            i, some = int(order[a]), order[a:b]
            number, width = int(first[i]), int(lengths[i])
            if (lengths[some] != width).any():
                raise ValueError("rows of a test have different numbers of scores")
            if number not in places:  # places of each lot
                each = lots[i].as_py()
                places[number] = {lot: np.array([j for j, x in enumerate(each) if x == lot]) for lot in dict.fromkeys(each) if lot is not None}
            matrix = flat[offsets[some][:, None] + np.arange(width)].T
            for lot, at in places[number].items():
                out.append((lot, int(block[i]), own[a:b].tobytes(), (number + at).astype("<i8").tobytes(), *_narrow(matrix[at])))
        if out:
            lot, block, cells, sets, kind, blobs = zip(*out)
            binary = [pa.array(x, pa.binary()) for x in (cells, sets, blobs)]
            yield pa.RecordBatch.from_arrays([pa.array(lot, pa.int64()), pa.array(block, pa.int64()), pa.nulls(len(out), pa.int64()), *binary[:2], pa.array(kind), binary[2]], names=names)

    held, size = [], 0
    for batch in batches:
        width = int(batch.column("__scores").value_lengths().to_numpy().max(initial=1))
        step = max(1, PACK // max(1, width))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].num_rows * width
            if size >= PACK:
                yield from flush(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield from flush(pa.Table.from_batches(held))


def _coded(scores: list[tuple[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, code): the distinct scores as rising keys and each score's place among them, from pieces as :func:`_narrow` makes them."""
    if all(kind[1] == "2" for kind, _ in scores):  # by counting
        values = np.concatenate([x for _, x in scores]).astype(np.int64)
        low = int(values.min())
        values -= low
        found = np.flatnonzero(np.bincount(values))[::-1]
        code = np.zeros(int(found[0]) + 1, np.int32)
        code[found] = np.arange(len(found), dtype=np.int32)
        return _falling((found + low).astype(f"{scores[0][0][0]}8")), code[values]
    keys, code = np.unique(np.concatenate([_falling(x.astype(f"{kind[0]}8")) for kind, x in scores]), return_inverse=True)
    return keys, code.astype(np.int32)


def _sets_of(left: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(set, rows, keys, code) of the sets of one block; sets that were sent together share their rows."""
    out, blobs = [], left.column("cells")
    together = left.column("__sets").to_pylist() if "__sets" in left.column_names else [None] * left.num_rows
    alone = np.array([x is None for x in together])
    number = left.column("__set").fill_null(0).to_numpy() if alone.any() else None
    for own in np.unique(number[alone]).tolist() if alone.any() else []:
        at = np.flatnonzero(alone & (number == own))
        cells = np.frombuffer(b"".join(blobs.take(pa.array(at)).to_pylist()), _CELL)
        rows = np.empty(len(cells), _ROW)
        for c in _ROW.names:
            rows[c] = cells[c]
        keys, code = np.unique(cells["key"], return_inverse=True)
        out.append((own, rows, keys, code.astype(np.int32)))
    groups: dict[bytes, list[int]] = {}
    for i, sets in enumerate(together):
        if sets is not None:
            groups.setdefault(sets, []).append(i)
    for sets, at in groups.items():
        some, numbers = left.take(pa.array(at)), np.frombuffer(sets, "<i8").tolist()
        rows = np.frombuffer(b"".join(some.column("cells").to_pylist()), _ROW)
        pieces = zip(some.column("kind").to_pylist(), some.column("scores").to_pylist())
        pieces = [(kind, np.frombuffer(x, "<i2" if kind[1] == "2" else f"<{kind}").reshape(len(numbers), -1)) for kind, x in pieces]
        for i, own in enumerate(numbers):
            out.append((own, rows, *_coded([(kind, x[i]) for kind, x in pieces])))
    return out


def _level_sums(weights: np.ndarray, rows: np.ndarray, count: np.ndarray, level: np.ndarray, levels: int) -> np.ndarray:
    """Rows of weights times ``count``, added up for each level; levels rise, the last row of weights is zero.

    Counts of one are added eight bytes at a time: a machine word holds that many weights, and so few rows are added
    that none runs over into the next.
    """
    most = max(int(weights.max()), 1)
    out = np.zeros((levels, weights.shape[1]), np.uint32 if float(most) * float(count.sum()) < 1 << 32 else np.int64)
    many = np.flatnonzero(count > 1)
    for at in range(0, len(many), NEAR // 8):
        some = many[at : at + NEAR // 8]
        starts = np.flatnonzero(np.r_[True, np.diff(level[some]) != 0])
        out[level[some[starts]]] += np.add.reduceat(count[some][:, None] * weights[rows[some]].astype(np.int64), starts, axis=0).astype(out.dtype)
    one = np.flatnonzero(count == 1)
    if not len(one):
        return out
    rows, level = rows[one], level[one]
    step = max(1, min(32, np.iinfo(weights.dtype).max // most))
    times = np.bincount(level, minlength=levels)
    groups = -(-times // step)
    filled = np.full(int(groups.sum()) * step, len(weights) - 1)
    filled[((np.cumsum(groups) - groups) * step - (np.cumsum(times) - times))[level] + np.arange(len(level))] = rows
    filled, own = filled.reshape(-1, step), np.repeat(np.arange(levels), groups)
    words = weights.view(np.uint64)
    near = max(1, NEAR // step)
    for at in range(0, len(filled), near):
        sums = np.add.reduce(words.take(filled[at : at + near], axis=0), axis=1).view(weights.dtype)
        some = own[at : at + near]
        starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], len(some)]):
            out[some[a]] += sums[a] if b == a + 1 else np.add.reduce(sums[a:b], axis=0, dtype=out.dtype)
    return out


def _joined_levels(sums: np.ndarray, to: np.ndarray, levels: int) -> np.ndarray:
    """Rows of sums added up by the level that each goes to."""
    by = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[by], np.arange(levels + 1)).tolist()
    out = np.empty((levels, sums.shape[1]), sums.dtype)
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows = by[a:b]
        np.add.reduce(sums[rows[0] : rows[-1] + 1] if rows[-1] - rows[0] == b - a - 1 else sums[rows], axis=0, out=out[i])
    return out


def _packed(sums: np.ndarray) -> list[bytes]:
    """Sums as bytes, a string for each slice of resamples, as narrow as the largest allows."""
    most = int(sums.max(initial=0))
    kind = "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"
    return [sums[:, b0 : b0 + SLICE].astype(kind).tobytes() for b0 in range(0, sums.shape[1], SLICE)]


def _sum_rows(number: int, tree: int, keys: np.ndarray, tp: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """The scores and sums of one set, a row for each slice."""
    b0 = np.arange(0, tp.shape[1], SLICE)
    n = len(b0)
    head = [np.full(n, number), np.full(n, tree), b0.astype(np.int32), np.minimum(SLICE, tp.shape[1] - b0).astype(np.int32)]
    blobs = [[keys.astype("<i8").tobytes()] * n, _packed(tp), _packed(fp)]
    return pa.RecordBatch.from_arrays([*map(pa.array, head), *[pa.array(x, pa.binary()) for x in blobs]], names=["__set", "__tree", "b0", "width", "keys", "tp", "fp"])


_SUMS = "__set long, __tree long, b0 int, width int, keys binary, tp binary, fp binary"


def _block_sums(left: pa.Table, right: pa.Table, n_boot: int, wide: int, fan: int) -> pa.Table:
    """Weighted positives and negatives of every set and score among the clusters of one block, all resamples.

    Where the scores of a set are a function of another's (a coarser ranking of the same rows), its sums are added up from that set's.
    """
    schema = pa.schema([("__set", pa.int64()), ("__tree", pa.int64()), ("b0", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("tp", pa.binary()), ("fp", pa.binary())])
    if not left.num_rows:
        return schema.empty_table()
    weights = _block_weights(right, n_boot, wide)
    block, sets = left.column("__block")[0].as_py(), _sets_of(left)
    sets.sort(key=lambda s: -len(s[2]))
    batches, finest = [], []
    for own, cells, keys, code in sets:
        tp = fp = None
        for rows, of, known in finest:  # sums of another set's scores, a row each
            if len(of) == len(code):
                one = np.zeros(len(known[0]), np.int32)
                one[of] = code
                if (one[of] == code).all() and (rows is cells or (rows == cells).all()):
                    tp, fp = (_joined_levels(x, one, len(keys)) for x in known)
                    break
        if tp is None:
            by = np.argsort(code.astype(np.uint16) if len(keys) <= 1 << 16 else code, kind="stable")  # few levels: sorted by counting
            row, level = cells["slot"][by].astype(np.int64) - block * wide, code[by]
            tp, fp = (_level_sums(weights, row, cells[c][by].astype(np.int64), level, len(keys))[:, :n_boot] for c in ("p", "q"))
            finest.append((cells, code, (tp, fp)))
        batches.append(_sum_rows(own, block // fan, keys, tp, fp))
    return pa.Table.from_batches(batches).cast(schema)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, tp, fp) of one set and slice, blocks added up."""
    width = table.column("width")[0].as_py()
    owns = [np.frombuffer(x, "<i8") for x in table.column("keys").to_pylist()]
    keys = np.unique(np.concatenate(owns))
    sums = []
    for c in ("tp", "fp"):
        out = np.zeros((len(keys), width), np.int64)
        for own, blob in zip(owns, table.column(c).to_pylist()):
            out[np.searchsorted(keys, own)] += np.frombuffer(blob, f"<u{len(blob) // (len(own) * width)}").reshape(len(own), width).astype(np.int64)
        sums.append(out)
    return keys, *sums


def _add_blocks(table: pa.Table, fan: int) -> pa.Table:
    keys, tp, fp = _added(table)
    head = [table.column(c).slice(0, 1) for c in ("__set", "__tree", "b0", "width")]
    head[1] = pa.array([head[1][0].as_py() // fan], pa.int64())
    more = [pa.array([x], pa.binary()) for x in (keys.astype("<i8").tobytes(), *_packed(tp), *_packed(fp))]
    return pa.table([*head, *more], names=table.column_names)


def _near_sums(left: pa.Table, right: pa.Table, n_boot: int, wide: int, fan: int) -> pa.Table:
    """:func:`_block_sums` of a few blocks, one after the other, those of a set and slice added up."""
    blocks = left.column("__block").unique().to_pylist()
    if len(blocks) < 2:
        return _block_sums(left, right, n_boot, wide, fan)
    out: dict[tuple, pa.Table] = {}
    for block in blocks:
        sums = _block_sums(*(t.filter(pc.equal(t.column("__block"), block)) for t in (left, right)), n_boot, wide, fan).combine_chunks()
        for i, at in enumerate(zip(*(sums.column(c).to_pylist() for c in ("__set", "__tree", "b0")))):
            row = sums.slice(i, 1)
            out[at] = _add_blocks(pa.concat_tables([out[at], row]), 1) if at in out else row
    return pa.concat_tables(out.values()).combine_chunks()


def _whole_area(table: pa.Table) -> pa.Table:
    """The areas of one set in a slice of resamples."""
    _, tp, fp = _added(table)
    pos, run = tp.sum(axis=0), np.cumsum(tp, axis=0)
    both = np.cumsum(fp, axis=0) + run
    share = tp * np.divide(run, both, out=np.ones(both.shape), where=both > 0)
    area = np.divide(share.sum(axis=0), pos, out=np.full(len(pos), np.nan), where=pos > 0)
    return pa.table([table.column("__set").slice(0, 1), table.column("b0").slice(0, 1), pa.array([area.tolist()], pa.list_(pa.float64()))], names=["__set", "b0", "area"])


def block_areas(rows: DataFrame, sets: DataFrame, slots: DataFrame, *, test_keys: Sequence[str], set_keys: Sequence[str], n_boot: int, seed: int, wide: int, fan: int) -> DataFrame:
    """(keys, b0, area) of the tied ``sets``; ``rows`` as :func:`_packed_rows` reads them.  A block's draws are sent to it and counted there."""
    keys = [*test_keys, *set_keys]
    tied = sets.filter("__tied")
    placed = rows.mapInArrow(lambda b: _packed_rows(b, wide), _PACKED)
    lots = tied.select(*test_keys, "__lot").distinct()
    units = _units_of_draws(_only(slots, lots, test_keys), test_keys, n_boot)
    extra = [T.StructField("chunk", T.LongType()), T.StructField("dense", T.BooleanType()), T.StructField("clusters", T.LongType()), T.StructField("q", T.IntegerType()), T.StructField("draws", T.BinaryType())]
    drawn = units.mapInArrow(lambda b: _dealt(b, list(test_keys), n_boot, seed, wide), _fields(units, test_keys, *extra))
    sent = drawn.join(lots, [drawn[k].eqNullSafe(lots[k]) for k in test_keys]).select("__lot", F.col("chunk").alias("__block"), "q", "dense", "draws")
    # a task for about every block of a lot, or a few of them
    most, groups, of = tied.groupBy("__lot").agg(F.max("__blocks").alias("b")).agg(F.max("b"), F.sum("b"), F.count("*")).first()
    spark = rows.sparkSession
    few = max(1, min(FEW, groups // (3 * spark.sparkContext.defaultParallelism)))
    parts = max(ordering.task_count(spark), -(-groups // few) + of)
    near = ["__lot", "__near"]
    placed, sent = (t.withColumn("__near", F.floor(F.col("__block") / few)).repartition(parts, *near) for t in (placed, sent))
    sums = placed.groupBy(*near).cogroup(sent.groupBy(*near)).applyInArrow(lambda left, right: _near_sums(left, right, n_boot, wide, fan), _SUMS)
    while most > fan:
        most = -(-most // fan)
        sums = sums.groupBy("__set", "__tree", "b0").applyInArrow(lambda table: _add_blocks(table, fan), _SUMS)
    areas = sums.groupBy("__set", "b0").applyInArrow(_whole_area, "__set long, b0 int, area array<double>")
    return areas.join(tied, "__set").select(*keys, "b0", "area")


def _only(slots: DataFrame, tests: DataFrame, test_keys: Sequence[str]) -> DataFrame:
    """Slots of the listed tests."""
    return slots.join(tests, [slots[k].eqNullSafe(tests[k]) for k in test_keys], "left_semi")


def unfolded(rows: DataFrame, *, set_keys: Sequence[str], score: str, sets: Sequence[Sequence]) -> DataFrame:
    """A row per set from rows with an array of scores, one for each of ``sets`` (values of ``set_keys``)."""
    names = F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(set_keys, s)]) for s in sets])
    rest = [c for c in rows.columns if c != score]
    long = rows.select(*rest, F.posexplode(score).alias("__place", score)).withColumn("__s", F.element_at(names, F.col("__place") + 1))
    return long.select(*rest, *[F.col(f"__s.{k}").alias(k) for k in set_keys], score)


def average_precision(
    scored: DataFrame,
    *,
    test_keys: Sequence[str],
    set_keys: Sequence[str],
    y: str,
    score: str,
    cluster: str,
    n_boot: int,
    seed: int,
    sets: Sequence[Sequence[str]] | None = None,
    counted: DataFrame | None = None,
    slots: DataFrame | None = None,
    cells: int = CELLS,
    lane: int = LANE,
    tied: float = TIED,
    wide: int = WIDE,
    fan: int = FAN,
) -> DataFrame:
    """(test_keys, set_keys, b, ap): weighted PR-AUC of every set in every cluster resample of its test set.

    NULL where a resample has no positives.  ``score`` is a number without
    NULLs; NULL keys and clusters are values of their own.  With ``sets`` a row
    holds an array of scores, one for each of them, and meets its cluster once for
    all.  ``counted`` is (keys, score, ``__n``): the rows of every score, if known; ``slots``: a written :func:`indexed_clusters`.
    ``cells``, ``lane``, ``tied``, ``wide`` and ``fan`` bound a task's work
    (:func:`lane_bytes`) and don't change the result.
    """
    test_keys, set_keys = list(test_keys), list(set_keys)
    keys = [*test_keys, *set_keys]
    spark, label = scored.sparkSession, F.col(y).cast("int")
    long = scored if sets is None else unfolded(scored, set_keys=set_keys, score=score, sets=sets)
    if slots is None:
        slots = materialize(indexed_clusters(scored, keys=test_keys, cluster=cluster), "bootstrap-clusters")
    if counted is None:
        counted = materialize(long.groupBy(*keys, score).agg(F.count("*").alias("__n")), "bootstrap-scores")
    listed = None
    if sets is not None:
        listed = literal_table(spark, [(i, *s) for i, s in enumerate(sets)], ", ".join(["__place long", *[f"{k} string" for k in set_keys]]))
    kind = long.schema[score].dataType
    plain = isinstance(kind, (T.DoubleType, T.FloatType, T.IntegralType))  # others keep their own order, by lanes
    plan = planned_sets(counted, slots, test_keys=test_keys, set_keys=set_keys, n_boot=n_boot, tied=tied if plain else float("inf"), wide=wide, listed=listed)
    some = {r["__tied"] for r in plan.select("__tied").distinct().collect()}
    areas = []
    if True in some:
        if sets is None:
            own = plan.filter("__tied")
            met = scored.join(own, [scored[k].eqNullSafe(own[k]) for k in keys])
            met = met.select(*[scored[k] for k in test_keys], cluster, label.alias("__y"), F.array(score).alias("__scores"), F.col("__set").alias("__first"), F.array("__lot").alias("__lots"))
        else:
            lot = F.struct("__place", F.when(F.col("__tied"), F.col("__lot")).alias("l"))
            own = plan.groupBy(*test_keys, "__first").agg(F.sort_array(F.collect_list(lot)).alias("__l")).select(*test_keys, "__first", F.col("__l.l").alias("__lots"))
            own = materialize(own, "bootstrap-places")  # a row per test
            met = scored.join(own, [scored[k].eqNullSafe(own[k]) for k in test_keys])
            met = met.select(*[scored[k] for k in test_keys], cluster, label.alias("__y"), F.col(score).alias("__scores"), "__first", "__lots")
        same = [met[k].eqNullSafe(slots[k]) for k in (*test_keys, cluster)]
        p = F.coalesce(F.col("__y"), F.lit(0)).alias("__p")
        rows = met.join(slots, same).select("slot", p, F.coalesce(1 - F.col("__y"), F.lit(0)).alias("__q"), "__first", "__lots", "__scores")
        areas.append(block_areas(rows, plan, slots, test_keys=test_keys, set_keys=set_keys, n_boot=n_boot, seed=seed, wide=wide, fan=fan))
    if False in some or not some:
        others = plan.filter("NOT __tied")
        rest = long.join(others, [long[k].eqNullSafe(others[k]) for k in keys], "left_semi") if True in some else long
        rest = rest.groupBy(*keys, score, cluster).agg(F.sum(label).cast("bigint").alias("__p"), F.sum(1 - label).cast("bigint").alias("__q"))
        same = [rest[k].eqNullSafe(slots[k]) for k in (*test_keys, cluster)]
        rest = materialize(rest.join(slots, same).select(*[rest[k] for k in (*keys, score, "__p", "__q")], "slot"), "bootstrap-cells")
        own = _only(slots, others.select(*test_keys).distinct(), test_keys)
        weights = materialize(weight_vectors(own, keys=test_keys, n_boot=n_boot, seed=seed), "bootstrap-vectors")
        areas.append(lane_areas(rest, weights, test_keys=test_keys, set_keys=set_keys, score=score, n_boot=n_boot, cells=cells, lane=lane))
    points = areas[0] if len(areas) == 1 else areas[0].unionByName(areas[1])
    points = points.select(*keys, "b0", F.posexplode("area").alias("i", "v"))
    return points.groupBy(*keys, (F.col("b0") + F.col("i")).alias("b")).agg(F.sum(C.nan_to_null("v")).alias("ap"))


def lane_areas(rows: DataFrame, weights: DataFrame, *, test_keys: Sequence[str], set_keys: Sequence[str], score: str, n_boot: int, cells: int, lane: int) -> DataFrame:
    """(keys, b0, area): areas of the ranges of every set, by lanes."""
    keys = [*test_keys, *set_keys]
    placed = materialize(placed_cells(rows, test_keys=test_keys, set_keys=set_keys, score=score, limit=cells, lane=lane), "bootstrap-ranges")

    # a lane's clusters with their weights, once each
    at = [*test_keys, "__lane"]
    needed = placed.select(*at, "slot").distinct()
    sent = needed.join(weights, [needed[k].eqNullSafe(weights[k]) for k in test_keys] + [needed["slot"] == weights["slot"]]).select(*[needed[c] for c in (*at, "slot")], "w")
    sent = materialize(sent, "bootstrap-weights")

    vector = lambda n: T.StructField(n, T.ArrayType(T.DoubleType()))
    b0 = T.StructField("b0", T.IntegerType())
    names = [*keys, "__part", "__sub"]
    several = placed.filter("__parts > 1 OR __part % 2 = 1")
    totals = several.groupBy(*at).cogroup(sent.groupBy(*at)).applyInArrow(
        lambda left, right: _lane(left, right, set_keys, score, n_boot, False, names), _fields(placed, names, b0, vector("tp"), vector("fp"))
    )
    carry = totals.groupBy(*keys, "b0").applyInArrow(
        lambda table: _carry(table, keys), _fields(totals, [*keys, "b0", "__part"], T.StructField("w", T.BinaryType()), vector("area"))
    )
    carry = materialize(carry, "bootstrap-carry")
    hot = carry.filter("__part % 2 = 1")
    plain = placed.filter("__part % 2 = 0")
    where = plain.select(*at, *set_keys, "__part").distinct()
    before = carry.join(where, [carry[k].eqNullSafe(where[k]) for k in (*keys, "__part")]).select(
        *[where[k] for k in at], F.lit(-1).cast("bigint").alias("slot"), carry["w"], *[where[k] for k in set_keys], where["__part"], carry["b0"]
    )
    both = sent.unionByName(before, allowMissingColumns=True)
    areas = plain.groupBy(*at).cogroup(both.groupBy(*at)).applyInArrow(
        lambda left, right: _lane(left, right, set_keys, score, n_boot, True, [*keys, "__part"]), _fields(placed, [*keys, "__part"], b0, vector("area"))
    )
    return areas.select(*keys, "b0", "area").unionByName(hot.select(*keys, "b0", "area"))
