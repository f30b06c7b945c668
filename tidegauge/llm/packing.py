"""Best-fit packing by a grouping genetic algorithm on islands.

A document longer than a sequence is cut, its remainder first, into full pieces.
What is packed are lengths: pieces of equal length are interchangeable, so a
packing is a list of fillings (how many pieces of which length share a sequence)
with the number of sequences filled that way.  There are at most ``capacity``
lengths, whatever the number of documents, so a packing of billions of pieces is
no larger than one of thousands.

* An individual is such a list.  Its groups are the filled sequences.
* Crossover takes whole well-filled sequences of one parent, adds those of the
  other of which no piece is used twice, and best-fits the displaced lengths into
  what room is left, then into new sequences, longest first.
* Mutation dissolves badly filled sequences, and a few others, the same way.
* Islands are rows of a table, each with a population of its own; after every
  epoch the best individuals go on to the next island.  A random draw depends on
  (seed, island, epoch) only, and every epoch is written, so a lost task is
  computed again with the same result.
* The best packing is dealt out: the r-th piece of a length takes the r-th slot of
  that length, by arithmetic.  Ranks come from a distributed prefix sum.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import byte_pairs
from tidegauge.llm import wordhash as wh
from tidegauge.operators import ordering
from tidegauge.session import materialize

#: A sequence's pieces as ((length, pieces), ...), longest first, and a packing as filling -> sequences.
Filling = tuple[tuple[int, int], ...]
Packing = dict[Filling, int]


@dataclass(frozen=True)
class Search:
    """The size of the search; none of it depends on the data."""

    islands: int = 6
    epochs: int = 3
    generations: int = 6
    population: int = 6
    elites: int = 2
    seed: int = 17


# ------------------------------------------------------------------ packings of lengths


def used(filling: Filling) -> int:
    return sum(length * n for length, n in filling)


def sequences(packing: Packing) -> int:
    return sum(packing.values())


def worth(packing: Packing, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer sequences, then fuller ones (mean square of their filling)."""
    n = sequences(packing)
    return -n, sum(m * (used(f) / capacity) ** 2 for f, m in packing.items()) / max(n, 1)


def demand_of(packing: Packing) -> Counter:
    out: Counter = Counter()
    for filling, times in packing.items():
        for length, n in filling:
            out[length] += n * times
    return out


class Lengths:
    """How many pieces of each length are still to be placed; finds the longest that fits in logarithmic time."""

    def __init__(self, left: Counter, capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in left.items():
            self.count[length] = n
        self.capacity = capacity
        #: the longest length at or below each that has pieces left
        self.below = np.maximum.accumulate(np.where(self.count > 0, np.arange(capacity + 1), 0))

    def longest(self, room: int) -> int:
        return int(self.below[room])

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            nxt = self.below[length + 1 :]
            shorter = self.below[length - 1]
            end = length + int(np.searchsorted(nxt, length, "right")) + 1
            self.below[length:end] = shorter


def _pair(count: np.ndarray, room: int, limit: int, rng: np.random.Generator | None) -> tuple[int, int] | None:
    """Two lengths up to ``limit`` that fill ``room`` to the last place, the most uneven pair or a drawn one."""
    low = np.arange(max(1, room - limit), room // 2 + 1)
    both = (count[low] > 0) & (count[room - low] > np.where(2 * low == room, 1, 0))
    low = low[both]
    if not len(low):
        return None
    x = int(low[0] if rng is None else low[rng.integers(len(low))])
    return room - x, x


def _fill(lengths: Lengths, room: int, rng: np.random.Generator | None, tries: int = 1) -> list[tuple[int, int]]:
    """Pieces for ``room``, without placing them: one or two that fill it, else the longest that fits, and again.

    With draws some lengths are passed over, and the fullest of ``tries`` is kept.
    """
    best, best_left = [], room + 1
    for t in range(tries):
        out: dict[int, int] = {}
        left, limit = room, room
        while left:
            length = lengths.longest(min(left, limit))
            if not length:
                break
            pair = _pair(lengths.count, left, limit, rng if t else None) if length < left else None
            if pair:
                for x in pair:
                    out[x] = out.get(x, 0) + 1
                left = 0
                break
            if rng is not None and t and rng.random() < 0.3:  # leave this length out
                limit = length - 1
                continue
            n = max(1, min(left // length, int(lengths.count[length])) - 1) if length < left else 1
            out[length] = out.get(length, 0) + n
            left -= n * length
            # a length that is not used up may come again
            limit = length - 1 if out[length] >= lengths.count[length] else length
            if limit == length:
                more = min(left // length, int(lengths.count[length]) - out[length])
                if more and not _pair(lengths.count, left, length - 1, None):
                    out[length] += more
                    left -= more * length
                limit = length - 1
        if left < best_left:
            best, best_left = sorted(out.items(), reverse=True), left
        if not left:
            break
    return best


def place(packing: Packing, left: Counter, capacity: int, rng: np.random.Generator | None = None, tries: int = 1) -> Packing:
    """Best-fit the lengths in ``left``: into the room of sequences that there are, then into new ones, longest first.

    A filling is used as often as the pieces allow, so every step ends a length
    or the sequences of a filling: the number of steps follows the number of
    lengths, not of pieces.
    """
    out: Packing = dict(packing)
    lengths = Lengths(left, capacity)
    if lengths.longest(capacity):
        for filling in sorted(packing, key=lambda f: (used(f), f), reverse=True):
            times = out[filling]
            room = capacity - used(filling)
            while times and lengths.longest(room):
                more = _fill(lengths, room, rng, tries)
                if not more:
                    break
                n = min(times, min(int(lengths.count[length]) // c for length, c in more))
                for length, c in more:
                    lengths.take(length, c * n)
                whole = Counter(dict(filling))
                for length, c in more:
                    whole[length] += c
                grown = tuple(sorted(whole.items(), reverse=True))
                out[grown] = out.get(grown, 0) + n
                times -= n
                out[filling] -= n
                if not out[filling]:
                    del out[filling]
    while length := lengths.longest(capacity):
        filling = [(length, 1)]
        lengths.count[length] -= 1
        gone = not lengths.count[length]
        lengths.count[length] += 1
        if gone:  # the rest is filled without this piece
            lengths.take(length, 1)
            rest = _fill(lengths, capacity - length, rng, tries)
            lengths.count[length] += 1
            lengths.below = np.maximum.accumulate(np.where(lengths.count > 0, np.arange(capacity + 1), 0))
        else:
            lengths.count[length] -= 1
            rest = _fill(lengths, capacity - length, rng, tries)
            lengths.count[length] += 1
        whole = Counter(dict(filling))
        for x, c in rest:
            whole[x] += c
        n = min(int(lengths.count[x]) // c for x, c in whole.items())
        for x, c in whole.items():
            lengths.take(x, c * n)
        key = tuple(sorted(whole.items(), reverse=True))
        out[key] = out.get(key, 0) + n
    return out


def crossover(a: Packing, b: Packing, demand: Counter, capacity: int, rng: np.random.Generator) -> Packing:
    """Well-filled sequences of ``b``, those of ``a`` that share no piece with them, and the displaced pieces best-fitted."""
    left, out = Counter(demand), {}
    well = [f for f in b if used(f) >= capacity - 1]
    for filling in well:
        if rng.random() < 0.5:
            out[filling] = b[filling]
            for length, c in filling:
                left[length] -= c * b[filling]
    for filling in sorted(a, key=lambda f: (used(f), f), reverse=True):
        n = min(a[filling], min(left[length] // c for length, c in filling))
        if n > 0 and used(filling) >= capacity - 1:
            out[filling] = out.get(filling, 0) + n
            for length, c in filling:
                left[length] -= c * n
    return place(out, left, capacity, rng, 4)


def mutate(a: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Dissolve all sequences that are not full and a tenth of the full ones, and place their pieces anew."""
    kept, left = {}, Counter()
    for filling, n in a.items():
        if used(filling) == capacity and rng.random() < 0.9:
            kept[filling] = n
        else:
            for length, c in filling:
                left[length] += c * n
    return place(kept, left, capacity, rng, 8)


def evolve(population: list[Packing], demand: Counter, capacity: int, rng: np.random.Generator, generations: int, size: int) -> list[Packing]:
    """The ``size`` best after some generations, best first."""
    bound = -(-sum(length * n for length, n in demand.items()) // capacity)
    key = lambda p: worth(p, capacity)
    population = sorted(population, key=key, reverse=True)[:size]
    for _ in range(generations):
        if -key(population[0])[0] <= bound:  # nothing can be better
            break
        children = []
        for _ in range(max(1, size // 2)):
            i, j = (int(min(rng.integers(len(population), size=2))) for _ in range(2))
            child = crossover(population[i], population[j], demand, capacity, rng)
            children.append(mutate(child, capacity, rng) if rng.random() < 0.5 else child)
        population = sorted(population + children, key=key, reverse=True)[:size]
    return population


# ------------------------------------------------------------------ islands


def _write(population: list[Packing]) -> list[list[dict]]:
    return [[{"times": n, "lengths": [x for x, _ in f], "counts": [c for _, c in f]} for f, n in p.items()] for p in population]


def _read(rows: list) -> list[Packing]:
    return [{tuple(zip(r["lengths"], r["counts"])): r["times"] for r in p} for p in rows]


_ISLAND = "island int, population array<array<struct<times:long,lengths:array<int>,counts:array<long>>>>"


def _epoch(batches: Iterator[pa.RecordBatch], demand: Counter, capacity: int, search: Search, epoch: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for island, rows in zip(batch.column("island").to_pylist(), batch.column("population").to_pylist()):
            rng = np.random.default_rng([search.seed, island, epoch])
            population = _read(rows)
            if not population:  # the plain best fit, then draws
                population = [place({}, demand, capacity)] + [place({}, demand, capacity, rng, 2) for _ in range(search.population - 1)]
            population = evolve(population, demand, capacity, rng, search.generations, search.population)
            yield pa.RecordBatch.from_arrays([pa.array([island], pa.int32()), pa.array([_write(population)], schema.field(1).type)], schema=schema)


def pack_lengths(spark: SparkSession, demand: dict[int, int], capacity: int, search: Search = Search()) -> Packing:
    """The best packing that the islands find of ``demand[length]`` pieces of each length up to ``capacity``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = Counter({int(x): int(n) for x, n in demand.items() if n})
    if not wanted:
        return {}
    if max(wanted) > capacity or min(wanted) < 1:
        raise ValueError("lengths are from 1 to the capacity")
    empty = F.array().cast("array<array<struct<times:long,lengths:array<int>,counts:array<long>>>>")
    islands = spark.range(search.islands, numPartitions=search.islands).select(F.col("id").cast("int").alias("island"), empty.alias("population"))
    schema = to_arrow_schema(spark.createDataFrame([], _ISLAND).schema)
    for epoch in range(search.epochs):
        grown = islands.mapInArrow(lambda b, epoch=epoch: _epoch(b, wanted, capacity, search, epoch, schema), _ISLAND)
        grown = materialize(grown, f"packing-epoch-{epoch}")
        # the best of each island go on to the next one, and all stay at home
        own = grown.select("island", "population")
        guests = grown.select(F.pmod(F.col("island") + 1, F.lit(search.islands)).alias("island"), F.slice("population", 1, search.elites).alias("population"))
        met = own.unionByName(guests).repartition(search.islands, "island").groupBy("island").agg(F.flatten(F.sort_array(F.collect_list("population"))).alias("population"))
        islands = met
    best = [p[0] for r in grown.select(F.slice("population", 1, 1).alias("best")).collect() if (p := _read([[{"times": f.times, "lengths": f.lengths, "counts": f.counts} for f in q] for q in r["best"]]))]
    return max(best, key=lambda p: (*worth(p, capacity), sorted(p.items())))


def slots(packing: Packing) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) of each length in each filling."""
    out, base, sequence = [], Counter(), 0
    for filling, times in sorted(packing.items(), reverse=True):
        offset = 0
        for length, c in filling:
            out.append((length, base[length], base[length] + c * times, c, sequence, offset))
            base[length] += c * times
            offset += c * length
        sequence += times
    return out


# ------------------------------------------------------------------ pieces of documents


_PIECES = "piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, keep: str) -> Iterator[pa.RecordBatch]:
    coder = byte_pairs.encoder(path)()
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text"), 1 << 22):
            ids, bounds = coder.block(data, offsets)
            rows, docs = [], []
            for i in range(end - first):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                rest = len(own) % capacity
                edges = [*([0] if rest else []), *range(rest, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    docs.append(i)
                    rows.append((k, a, b - a, zlib.crc32(own[a:b].tobytes())))
            where = pa.array(np.array(docs, np.int64) + first)
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(keep).take(where), *columns], [keep, "piece", "start", "length", "ids_crc32"])


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): every document's ids and its end, cut into full pieces behind the remainder."""
    wh.bound_batches(docs.sparkSession)
    path, kind = path or _default_path(), dict(docs.dtypes)[doc]
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _pieces(b, path, end_id, capacity, "doc"), f"doc {kind}, {_PIECES}")


def pack(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, capacity: int = 1024, search: Search = Search()) -> DataFrame:
    """One row per piece: doc, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is the tokenizer's file, on the driver and all executors.

    Edge cases: null and empty texts are documents of their end alone; repeated
    rows are packed each; a null id is kept; pieces of one length are told apart
    by their rank, in the order of (id, piece, start, checksum); an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, doc=doc, text=text, path=path, end_id=end_id, capacity=capacity), "packing-pieces")
    counted = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    packing = pack_lengths(spark, {r["length"]: r["count"] for r in counted}, capacity, search)
    # ranks within a length: equal rows are one, counted, so that the order is strict
    same = cut.groupBy("doc", "piece", "start", "length", "ids_crc32").agg(F.count("*").alias("__n"))
    ranked = ordering.running_totals(same.withColumn("__at", F.struct("doc", "piece", "start", "ids_crc32")), ["length"], "__at", ["__n"])
    ranked = ranked.withColumn("__rank", F.explode(F.sequence(F.col("run___n") - F.col("__n"), F.col("run___n") - 1))).drop("__n", "__at", "run___n", "tot___n")
    taken = slots(packing)
    by_length: dict[int, list] = {}
    for length, *rest in taken:
        by_length.setdefault(length, []).append(rest)
    lists = {x: np.array(sorted(r), np.int64) for x, r in by_length.items()}
    columns = "doc, piece, start, length, ids_crc32, __rank".split(", ")
    kind = dict(ranked.dtypes)["doc"]
    return ranked.select(*columns).mapInArrow(lambda b: _assign(b, lists), f"doc {kind}, {_PIECES}, sequence_id long, offset long")


def _assign(batches: Iterator[pa.RecordBatch], lists: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The slot of each piece's rank: ``lists`` has (first rank, end rank, pieces a sequence, first sequence, offset) by length."""
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        kinds, starts = np.unique(length[order], return_index=True)
        for x, a, b in zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            at, table = order[a:b], lists[x]
            row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
            nth = rank[at] - row[:, 0]
            sequence[at] = row[:, 3] + nth // row[:, 2]
            offset[at] = row[:, 4] + nth % row[:, 2] * x
        columns = [batch.column(c) for c in ("doc", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
