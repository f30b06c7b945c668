"""Jaccard join on word n-grams by vertical partitioning.

The n-grams have one global order (rarest first, then by hash), and the order is
cut into fragments.  A fragment sees its own segment of every document and
counts there; the counts of all fragments are summed per document, or per pair.

1. **Screen.**  The lowest part of the hashes goes through fragments that count,
   for each document, the n-grams that no other text has.  A document of n
   n-grams can lack at most ``n - ceil(t n)`` of them in a partner; whoever lacks
   more in this part alone has no partner.  That ends most documents with a
   third of the data shuffled.  A document without an n-gram in this part is not
   judged by it and goes on.
2. **Segments.**  The rest is read again (a fixed-size bit table tells who is
   left; what it lets through by chance only costs a little) and put through
   fragments in full: document frequencies, then per document its shared
   n-grams in the global order.  Documents that lack too many end here.
3. **Pairs.**  By the prefix filter two linked documents share an n-gram among
   their first ``n - ceil(t n) + 1``.  The most typical document that holds such
   an n-gram is its centre, and is paired with all in its list.  Pairs are
   counted fragment by fragment and summed; links make components.
4. **The rest of the pairs.**  Only members outside their centre's component can
   still link to something new; they are paired with the members of other
   components as far as sizes, lacking n-grams and a bitmap of the others (each
   n-gram turns one bit over; bits that differ are n-grams that differ) leave a
   link possible.

So no link between components goes untested, and a group of near copies costs
its size, not its square.  Documents with equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import wordhash as wh
from tidegauge.llm.components import components
from tidegauge.session import materialize

#: Share of the hash space that the screen reads.
SCREEN = 0.3
#: Bits of the table of documents that passed the screen: fixed, whatever the corpus.
BITS = 1 << 24
#: 64-bit words of a class's bitmap.
BITMAP = 8
#: Fragments of the order in which pairs are counted.
FRAGMENTS = 8
LOW = np.uint64((1 << 48) - 1)
RUN_GRAMS = 1 << 21


def ngram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; a text of fewer words is one sequence; none without words."""
    hashes, bounds = wh.words(data, offsets, wh.WHITE)
    all_grams = wh.grams(hashes, size)
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= size:
            yield np.unique(all_grams[a : b - size + 1])
        else:
            yield wh.grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_key(grams: np.ndarray) -> int:
    """A digest of a set, as a signed 64-bit number."""
    total = np.array([wh.mix(grams).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(grams))
    return int(wh.mix(total).view(np.int64)[0])


def most_missing(n, percent: int):
    """How many n-grams of a document of n a partner may lack."""
    return n - -(-n * percent // 100)


class _Segments:
    """Documents' sorted hashes, collected and then dealt to ``parts`` ranges of the hash."""

    def __init__(self, parts: int, share: float):
        self.parts, self.share = parts, share
        self.clear()

    def clear(self):
        self.keys, self.sets, self.total, self.sizes = [], [], 0, []

    def add(self, key: int, n: int, grams: np.ndarray):
        self.keys.append(key)
        self.sizes.append(n)
        self.sets.append(grams)
        self.total += len(grams)

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        if not self.total:
            return
        h = np.concatenate(self.sets)
        doc = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        part = part_of(h, self.parts, self.share)
        order = np.argsort(part, kind="stable")  # by range, then by document, then by hash
        h, doc, part = h[order], doc[order], part[order]
        keys, sizes = np.array(self.keys, np.int64).view(np.uint64), np.array(self.sizes, np.uint64)
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        for p in range(self.parts):
            a, b = cuts[p], cuts[p + 1]
            if b > a:
                who, counts = np.unique(doc[a:b], return_counts=True)
                low = h[a:b] & LOW
                yield p, wh.pack(keys[who], sizes[who], counts, low & np.uint64(0xFFFFFFFF), low >> np.uint64(32))


def part_of(h: np.ndarray, parts: int, share: float) -> np.ndarray:
    """The range, of ``parts`` that cut the lowest ``share`` of the hash space, that a hash lies in."""
    width = max(1, int(share * (1 << 32)) // parts)
    return np.minimum((h >> np.uint64(32)) // np.uint64(width), np.uint64(parts - 1)).astype(np.int64)


def _merge(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes (keys and sizes) of a fragment; its postings as (class, hash).  Equal sets are one class."""
    parsed = [wh.unpack(p) for p in payloads]
    keys = np.concatenate([p[0] for p in parsed]).astype(np.uint64)
    sizes = np.concatenate([p[1] for p in parsed]).astype(np.int64)
    counts = np.concatenate([p[2] for p in parsed]).astype(np.int64)
    low = np.concatenate([p[3] for p in parsed]).astype(np.uint64) | (np.concatenate([p[4] for p in parsed]).astype(np.uint64) << np.uint64(32))
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(keys)), counts)
    keep = first[place[owner]] == owner
    return distinct, sizes[first], place[owner[keep]], low[keep]


def _frequencies(low: np.ndarray) -> np.ndarray:
    """For each posting, how many classes have its hash."""
    order = np.argsort(low, kind="stable")
    s = low[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(s)))
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _by_key(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((wh.mix(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


PACKED = "part int, payload binary"


def _screen_map(batches: Iterator[pa.RecordBatch], size: int, parts: int, share: float) -> Iterator[pa.RecordBatch]:
    run, seen, limit = _Segments(parts, share), set(), np.uint64(int(share * (1 << 64)))
    for batch in batches:
        for _, _, data, offsets in wh.blocks(batch.column("text")):
            for g in ngram_sets(data, offsets, size):
                if len(g) and (key := set_key(g)) not in seen:
                    seen.add(key)
                    run.add(key, len(g), g[: np.searchsorted(g, limit)])
            if run.total > RUN_GRAMS:
                yield from _table(list(run.payloads())).to_batches()
                run.clear()
                seen.clear()
    yield from _table(list(run.payloads())).to_batches()


def _unshared(group: pa.Table, parts: int) -> pa.Table:
    """Of a fragment of the screen: by class, the n-grams that no other class has."""
    keys, sizes, owner, low = _merge([p.as_py() for p in group.column("payload")])
    alone = np.bincount(owner[_frequencies(low) == 1], minlength=len(keys))
    part = _by_key(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return _table([(p, wh.pack(keys[o], sizes[o], alone[o])) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])])


def _passed(group: pa.Table, percent: int) -> pa.Table:
    """The classes that may still have a partner, after all fragments of the screen."""
    parsed = [wh.unpack(p.as_py()) for p in group.column("payload")]
    keys, sizes, alone = (np.concatenate([p[i] for p in parsed]) for i in range(3))
    distinct, first, place = np.unique(keys.astype(np.uint64), return_index=True, return_inverse=True)
    lacking = np.bincount(place, weights=alone).astype(np.int64)
    left = distinct[lacking <= most_missing(sizes[first].astype(np.int64), percent)]
    return pa.table({"bit": pa.array(_bit(left))})


def _bit(keys: np.ndarray) -> np.ndarray:
    return (wh.mix(keys ^ np.uint64(0xA5A5A5A5)) & np.uint64(BITS - 1)).astype(np.int64)


def _segments_map(batches: Iterator[pa.RecordBatch], size: int, parts: int, sent, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each document (key and size of its set), and segments of those that the bit table lets through."""
    table, run, seen, limit = sent.value, _Segments(parts, 1.0), set(), np.uint64(int(SCREEN * (1 << 64)))
    names = ["doc", "key", "n", "part", "payload"]

    def passes(key: int) -> bool:
        bit = int(_bit(np.array([key], np.int64).view(np.uint64))[0])
        return bool(table[bit >> 3] >> (bit & 7) & 1)

    def packed():
        rows = list(run.payloads())
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            keys, sizes = [], []
            for g in ngram_sets(data, offsets, size):
                key = set_key(g) if len(g) else None
                keys.append(key)
                sizes.append(len(g))
                if key is not None and key not in seen:
                    seen.add(key)
                    # the screen saw nothing of a set whose least hash lies above its part
                    if g[0] >= limit or passes(key):
                        run.add(key, len(g), g)
            n = end - first
            yield pa.RecordBatch.from_arrays([batch.column("doc").slice(first, n), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            if run.total > RUN_GRAMS:
                yield packed()
                run.clear()
                seen.clear()
    yield packed()


def _shared(group: pa.Table, parts: int) -> pa.Table:
    """Of a fragment: postings of n-grams that several classes have, dealt by class."""
    keys, sizes, owner, low = _merge([p.as_py() for p in group.column("payload")])
    df = _frequencies(low)
    keep = df > 1
    owner, gram, df = owner[keep], low[keep] | (np.uint64(group.column("part")[0].as_py()) << np.uint64(48)), df[keep]
    part = _by_key(keys, parts)[owner]
    order = np.lexsort((owner, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for p in range(parts):
        o = order[cuts[p] : cuts[p + 1]]
        if len(o):
            who, counts = np.unique(owner[o], return_counts=True)
            rows.append((p, wh.pack(keys[who], sizes[who], counts, gram[o], df[o])))
    return _table(rows)


def _classes(group: pa.Table, percent: int) -> pa.Table:
    """By class that may have a partner, and fragment of the order: its shared n-grams, and those of its prefix."""
    parsed = [wh.unpack(p.as_py()) for p in group.column("payload")]
    keys, sizes, counts, gram, df = (np.concatenate([p[i] for p in parsed]) for i in range(5))
    gram, df = gram.astype(np.uint64), df.astype(np.int64)
    distinct, first, place = np.unique(keys.astype(np.uint64), return_index=True, return_inverse=True)
    sizes = sizes[first].astype(np.int64)
    owner = place[np.repeat(np.arange(len(keys)), counts)]
    lacking = sizes - np.bincount(owner, minlength=len(distinct))
    spare = most_missing(sizes, percent)
    keep = (lacking <= spare)[owner]
    owner, gram, df = owner[keep], gram[keep], df[keep]
    order = np.lexsort((gram, df, owner))
    owner, gram, df = owner[order], gram[order], df[order]
    # rare n-grams stand in the first half of the fragments, the others in the second; a half is cut by hash
    half = FRAGMENTS // 2
    fragment = (wh.mix(gram) >> np.uint64(40)).astype(np.int64) % half + half * (df > 2)
    cuts = np.searchsorted(owner, np.arange(len(distinct) + 1))
    bit = (wh.mix(gram ^ np.uint64(0x5A5A5A5A)) & np.uint64(64 * BITMAP - 1)).astype(np.int64)
    out = {"key": [], "n": [], "lacking": [], "fragment": [], "grams": [], "prefix": [], "bits": []}
    for i in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[i], cuts[i + 1]
        turned = np.bincount(bit[a:b], minlength=64 * BITMAP).astype(np.uint8) & 1
        bits = np.packbits(turned, bitorder="little").view(np.int64)
        # n-grams that nobody else has come first in the order
        first_ones = np.arange(b - a) < spare[i] + 1 - lacking[i]
        g, f = gram[a:b].view(np.int64), fragment[a:b]
        for k in range(FRAGMENTS):
            at = f == k
            if at.any():
                out["key"].append(int(distinct[i : i + 1].view(np.int64)[0]))
                out["n"].append(int(sizes[i]))
                out["lacking"].append(int(lacking[i]))
                out["fragment"].append(k)
                out["grams"].append(g[at])
                out["prefix"].append(g[at & first_ones])
                out["bits"].append(bits)
                bits = None  # once for a class
    kinds = {"key": pa.int64(), "n": pa.int64(), "lacking": pa.int64(), "fragment": pa.int32(), "grams": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64()), "bits": pa.list_(pa.int64())}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})


def classes(docs: DataFrame, *, doc: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc, key, n), and the classes that may link, by fragment (see :func:`_classes`)."""
    spark = docs.sparkSession
    wh.bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = max(4, parts // 4)
    base = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["doc"]
    arrow = base.select("doc").limit(0).toArrow().schema.field("doc").type

    screened = base.select("text").mapInArrow(lambda b: _screen_map(b, size, few, SCREEN), PACKED)
    alone = screened.groupBy("part").applyInArrow(lambda t: _unshared(t, few), PACKED)
    bits = alone.groupBy("part").applyInArrow(lambda t: _passed(t, percent), "bit long")
    # at most BITS / 64 rows
    blocks = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[blocks.column("word").to_numpy()] = blocks.column("mask").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(table.view(np.uint8))  # BITS / 8 bytes
    del blocks, table

    read = materialize(base.mapInArrow(lambda b: _segments_map(b, size, parts, sent, arrow), f"doc {kind}, key long, n long, {PACKED}"), "ngram-segments")
    sent.destroy()
    shared = read.filter("part is not null").select("part", "payload").groupBy("part").applyInArrow(lambda t: _shared(t, parts), PACKED)
    left = shared.groupBy("part").applyInArrow(lambda t: _classes(t, percent), "key long, n long, lacking long, fragment int, grams array<long>, prefix array<long>, bits array<long>")
    return read.filter("part is null").select("doc", "key", "n"), materialize(left, "ngram-classes")


def count_pairs(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of (a, b): the linked ones, from overlaps counted in every fragment and summed."""
    mine = segments.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    theirs = segments.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.select("a", "b").join(mine, "a").join(theirs, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("partial"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("both"))
    return total.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def possible(a: str, b: str, percent: int):
    """Whether sizes, and n-grams that only one has, leave a link between members ``a`` and ``b`` possible."""
    n_a, n_b, l_a, l_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.lacking"), F.col(f"{b}.lacking")
    need = percent * (n_a + n_b)  # linked documents share need / (100 + percent)
    return ((100 + percent) * (n_a - l_a) >= need) & ((100 + percent) * (n_b - l_b) >= need) & (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))


def alike(a: str, b: str, percent: int):
    """Whether the bitmaps leave a link possible: the n-grams in common are at most half of all less the bits that differ."""
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITMAP)), F.lit(0))
    n_a, n_b, l_a, l_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.lacking"), F.col(f"{b}.lacking")
    return (100 + percent) * (n_a - l_a + n_b - l_b - differ) >= 2 * percent * (n_a + n_b)


def join(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc, n_shingles and component_id, the smallest doc reachable by links.

    Texts link when their sets of word ``size``-grams have a Jaccard similarity
    of at least ``percent`` / 100.

    Edge cases: a null, empty or blank text has an empty set and links with
    nothing, so its component is its own doc; a text of fewer words is one
    n-gram; repeated rows have one component; a null doc counts for nothing in
    the minimum, and a component of nulls is null; an empty table gives an empty
    result; other columns are not read.
    """
    rows, segments = classes(docs, doc=doc, text=text, size=size, percent=percent)
    tokens = materialize(segments.filter(F.size("prefix") > 0).select("key", "n", "lacking", F.explode("prefix").alias("gram")), "ngram-prefixes")
    # the centre lacks least for its size, and so stands nearest to what its group has in common; it is sought among all that
    # hold the n-gram, not only in their prefix, so that the n-grams of one group agree on it
    holders = segments.select("key", "n", "lacking", F.explode("grams").alias("gram"))
    centre = holders.groupBy("gram").agg(F.min(F.struct((F.col("lacking") / F.col("n")).alias("rest"), "key", "n", "lacking")).alias("c"))
    centres = centre.select("gram", F.col("c.key").alias("key"), F.col("c.n").alias("n"), F.col("c.lacking").alias("lacking"))
    stars = tokens.alias("t").join(centres.alias("c"), "gram").filter((F.col("t.key") != F.col("c.key")) & possible("t", "c", percent))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = materialize(stars.select(*pair(F.col("t.key"), F.col("c.key"))).distinct(), "ngram-stars")
    links = materialize(count_pairs(stars, segments, percent), "ngram-links")
    root = components(links)

    own = lambda d: d.join(root, d["key"] == root["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    members = materialize(own(tokens), "ngram-members")
    centres = own(centres)
    outside = members.alias("m").join(centres.alias("c"), "gram").filter("m.root != c.root").select("m.*")
    bits = segments.filter("bits is not null").select("key", "bits")
    outside = materialize(outside.join(bits, "key"), "ngram-outside")
    around = members.join(outside.select("gram").distinct(), "gram", "left_semi").join(bits, "key")
    rest = outside.alias("x").join(around.alias("y"), "gram").filter((F.col("x.root") != F.col("y.root")) & possible("x", "y", percent) & alike("x", "y", percent))
    rest = rest.select(*pair(F.col("x.key"), F.col("y.key"))).distinct().join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(materialize(count_pairs(materialize(rest, "ngram-rest"), segments, percent), "ngram-links"))
    root = components(links)

    labelled = rows.join(root, rows["key"] == root["node"], "left").select("doc", "n", F.coalesce("root", "key").alias("root"))
    least = labelled.filter("root is not null").groupBy("root").agg(F.min("doc").alias("least"))
    out = labelled.join(least, "root", "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"))
