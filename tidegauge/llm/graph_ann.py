"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by hash; equal vectors are one entry, with the few
smallest ids that any answer can need.  A shard's graph starts at random; in two
rounds every entry is searched greedily, its neighbours are chosen from what the
search found by relaxed distance pruning (a candidate falls if a chosen
neighbour is nearer to it, by the factor ``alpha``, than the entry is), and the
edges are also drawn backwards, pruned again where they are too many.  Searches
run for a batch of entries at a time, in NumPy.

A query's beam search asks every shard; its answers are scored again on the
original vectors in double precision and merged.  Queries come in blocks, so a
task holds one shard's graph and one block, whatever the number of either.
Shards are as many as keep their vectors at ``SHARD_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialize

SHARD_BYTES = 1 << 27
LEAST_SHARDS = 8
QUERY_BLOCK = 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 24, 40, 64, 1.2


def greedy(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest entries found for each query, nearest first (-1 pads), and their squared distances."""
    q, n = len(queries), len(x)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((queries - x[entry]) ** 2).sum(axis=1)
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    norms = (x * x).sum(axis=1)
    own = (queries * queries).sum(axis=1)
    live = np.arange(q)
    while len(live):
        best = np.where(done[live], np.inf, dist[live]).argmin(axis=1)
        done[live, best] = True
        near = graph[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, entry)] = True
        safe = np.where(fresh, near, 0)
        d = norms[safe] - 2 * np.einsum("qrd,qd->qr", x[safe], queries[live]) + own[live][:, None]
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)[row, order]
        done[live] = np.concatenate([done[live], ~fresh], axis=1)[row, order]
        dist[live] = all_d[row, order]
        live = live[(~done[live] & np.isfinite(dist[live])).any(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    row = np.arange(q)[:, None]
    dist = dist[row, order]
    return np.where(np.isfinite(dist), ids[row, order], -1), dist


def prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of entries ``of`` from their ``candidates`` (-1 pads)."""
    bad = (candidates < 0) | (candidates == of[:, None])
    c = np.where(bad, 0, candidates)
    norms = (x * x).sum(axis=1)
    d = norms[c] + norms[of][:, None] - 2 * np.einsum("qcd,qd->qc", x[c], x[of])
    d[bad] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    row = np.arange(len(of))
    c, d = c[row[:, None], order], d[row[:, None], order]
    again = np.zeros(c.shape, bool)
    by_id = np.argsort(c, axis=1, kind="stable")
    sorted_ids = c[row[:, None], by_id]
    again[row[:, None], by_id[:, 1:]] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    d[again & ~np.isinf(d)] = np.inf  # one of each
    vectors, sizes = x[c], norms[c]
    out = np.full((len(of), degree), -1, np.int64)
    for k in range(degree):
        first = d.argmin(axis=1)
        found = np.isfinite(d[row, first])
        if not found.any():
            break
        out[found, k] = c[row, first][found]
        between = sizes + sizes[row, first][:, None] - 2 * np.einsum("qcd,qd->qc", vectors, vectors[row, first])
        d[(alpha * alpha * between <= d) & found[:, None]] = np.inf
        d[row, first] = np.inf
    return out


def build(x: np.ndarray, *, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Neighbours of each entry (-1 pads) and the entry point, the one nearest to the mean."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    start = min(degree // 2, n - 1)
    if start > 0:
        graph[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    if n == 1:
        return graph, entry
    batch = int(np.clip((1 << 24) // n, 16, 512))
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            of = order[i : i + batch]
            found, _ = greedy(x, graph, x[of], entry, beam)
            graph[of] = prune(x, of, np.concatenate([found, graph[of]], axis=1), degree, a)
            _draw_back(x, graph, of, degree, a)
    return graph, entry


def _draw_back(x: np.ndarray, graph: np.ndarray, of: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges of ``of`` the other way round; where there is no room, prune."""
    to, source = graph[of].ravel(), np.repeat(of, degree)
    new = to >= 0
    new[new] = ~(graph[to[new]] == source[new][:, None]).any(axis=1)
    to, source = to[new], source[new]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    held = (graph[targets] >= 0).sum(axis=1)
    fits = held + counts <= degree
    room = np.repeat(fits, counts)
    nth = np.arange(len(to)) - np.repeat(first, counts)
    graph[to[room], (np.repeat(held, counts) + nth)[room]] = source[room]
    # entries that gain about as many edges are pruned together
    size = np.ceil(np.log2(np.maximum(counts, 4))).astype(int)
    for g in np.unique(size[~fits]):
        chosen = np.flatnonzero(~fits & (size == g))
        step = max(1, (1 << 21) // ((degree + (1 << g)) * x.shape[1]))
        for i in range(0, len(chosen), step):
            c = chosen[i : i + step]
            extra = np.full((len(c), 1 << g), -1, np.int64)
            row = np.repeat(np.arange(len(c)), counts[c])
            column = np.arange(len(row)) - np.repeat(np.cumsum(counts[c]) - counts[c], counts[c])
            extra[row, column] = source[np.repeat(first[c], counts[c]) + column]
            t = targets[c]
            graph[t] = prune(x, t, np.concatenate([graph[t], extra], axis=1), degree, alpha)


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _graph_of(group: pa.Table) -> pa.Table:
    dim = group.column("dim")[0].as_py()
    order = np.argsort([i[0] for i in group.column("ids").to_pylist()], kind="stable")  # the same graph in any order of arrival
    group = group.take(pa.array(order))
    x = _matrix(group.column("vector"), dim)
    graph, entry = build(_unit(x).astype(np.float32))
    return pa.table({"shard": group.column("shard")[:1], "dim": group.column("dim")[:1], "entry": pa.array([entry]), "ids": pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([x.tobytes()]), "graph": pa.array([graph.astype(np.int32).tobytes()])})


def _search(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Every row has a shard and a block of queries: the k best of the shard for each."""
    for batch in batches:
        for row in range(batch.num_rows):
            dim = batch.column("dim")[row].as_py()
            x = np.frombuffer(batch.column("vectors")[row].as_py(), np.float64).reshape(-1, dim)
            graph = np.frombuffer(batch.column("graph")[row].as_py(), np.int32).reshape(len(x), -1).astype(np.int64)
            ids = batch.column("ids")[row].as_py()
            asked = batch.column("queries")[row].values
            names = np.asarray(asked.field("id"), np.int64)
            own = _matrix(asked.field("vector"), dim)
            unit, mine = _unit(x).astype(np.float32), _unit(own).astype(np.float32)
            norms = np.sqrt((x * x).sum(axis=1))
            at, out = batch.column("entry")[row].as_py(), []
            step = int(np.clip((1 << 24) // len(x), 16, 512))
            for i in range(0, len(names), step):
                found, _ = greedy(unit, graph, mine[i : i + step], at, max(beam, k + 1))
                # one more than k, as the query's own entry may hold nothing else
                q = own[i : i + step]
                safe = np.where(found >= 0, found, 0)
                score = (x[safe] * q[:, None, :]).sum(axis=2) / (norms[safe] * np.sqrt((q * q).sum(axis=1))[:, None])
                for j in range(len(q)):
                    got = [(-float(s), v) for s, e in zip(score[j], found[j], strict=True) if e >= 0 for v in ids[e] if v != names[i + j]]
                    out += [(int(names[i + j]), v, -s) for s, v in sorted(set(got))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``queries`` is true its k nearest other rows by cosine.

    Edge cases: rows without key, and vectors that are null, zero or hold null or
    non-finite components, take no part; only vectors of one length are
    compared; ties go to the smaller key; equal vectors under several keys are
    all answers; a repeated row counts once; fewer than k candidates are all
    returned; an empty table gives an empty result; other columns are not read.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), v.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    # of equal vectors the k + 1 smallest keys are enough for any answer; each task keeps no more before the shuffle
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.select("id", "vector").withColumn("nth", F.rank().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("nth") <= k + 1)
    few = few.groupBy("vector", "id").agg(F.lit(1).alias("one")).withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    entries = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector").cast("long"))
    entries = materialize(entries, "ann-entries")
    n, dims = entries.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(LEAST_SHARDS, -(-n * dims * 8 // SHARD_BYTES))
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(int(shards))).cast("long"))
    graphs = dealt.groupBy("shard", "dim").applyInArrow(_graph_of, "shard long, dim long, entry long, ids array<array<long>>, vectors binary, graph binary")
    graphs = materialize(graphs, "ann-graphs")

    asked = rows.filter("asked").groupBy("id", "vector").agg(F.lit(1).alias("one")).select("id", "vector", F.size("vector").cast("long").alias("dim"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    pairs = graphs.join(packed, "dim").select("dim", "entry", "ids", "vectors", "graph", "queries").repartition(int(shards) * blocks)
    found = pairs.mapInArrow(lambda b: _search(b, k, beam), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
