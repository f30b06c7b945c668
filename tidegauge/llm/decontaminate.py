"""Benchmark decontamination as a prefix-filtered set join.

An item is searched by its windows: ``window`` consecutive words, or all of a
shorter item.  A window is the set of its word shingles with their places.

1. Documents: places of every shingle that any window holds (one pass, Arrow).
2. Shingles are ordered by rarity in these documents.  Exact containment needs
   all shingles, so the necessary prefix of a window is its rarest shingle: only
   that one is joined.
3. Place of the shingle in the text less its place in the window is where the
   window would start: it must not begin before the text nor end behind it.
4. Candidates are verified over a span as long as the window: every shingle must
   stand at its place.  Shingles overlap, so together they are the words.

The shingles of all windows are sent to the tasks as one sorted array, after
they have been counted.  More than ``block`` of them are dealt into blocks, with
one pass over the documents for each, so memory stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import wordhash as wh
from tidegauge.session import materialize

#: Shingles per pass over the documents (8 bytes each).
BLOCK = 4_000_000


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _item_shingles(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Of each item: its windows' length, its shingles' width, and all its shingles in order."""
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            hashes, bounds = wh.words(data, offsets, wh.NOT_WORD)
            rows = []
            for i in range(end - first):
                h = hashes[bounds[i] : bounds[i + 1]]
                size = min(window, len(h))
                width = min(shingle, size)
                rows.append((size, width, wh.grams(h, width).astype(np.int64) if size else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(first, end - first), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), _lists(np.concatenate([r[2] for r in rows]), np.array([len(r[2]) for r in rows]))],
                ["item", "size", "width", "shingles"],
            )


def item_windows(items: DataFrame, *, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item, wid, size, width, need, shingles): a row per window; equal windows have one wid."""
    found = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    kind = dict(found.dtypes)["item"]
    rows = found.mapInArrow(lambda b: _item_shingles(b, window, shingle), f"item {kind}, size long, width long, shingles array<long>")
    need = F.col("size") - F.col("width") + 1
    at = F.explode(F.sequence(F.lit(1).cast("long"), F.size("shingles") - need + 1))
    cut = rows.filter("size > 0").select("item", "size", "width", need.alias("need"), "shingles", at.alias("at"))
    cut = cut.withColumn("shingles", F.slice("shingles", F.col("at").cast("int"), F.col("need").cast("int"))).drop("at")
    return cut.withColumn("wid", F.xxhash64("size", "width", "shingles"))


def _places(batches: Iterator[pa.RecordBatch], keys, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each document: its number of words, and place and hash of each shingle among ``keys`` (by width)."""
    tables = []
    for width, sorted_keys in keys.value.items():
        mark = np.zeros(1 << 20, bool)
        mark[sorted_keys >> np.uint64(44)] = True
        tables.append((width, sorted_keys, mark))
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            hashes, bounds = wh.words(data, offsets, wh.NOT_WORD)
            n_words = np.diff(bounds)
            docs, places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for width, sorted_keys, mark in tables:
                g = wh.grams(hashes, width)
                at = np.flatnonzero(mark[(g >> np.uint64(44)).astype(np.int64)])
                near = np.minimum(np.searchsorted(sorted_keys, g[at]), len(sorted_keys) - 1)
                at = at[sorted_keys[near] == g[at]]
                doc = np.searchsorted(bounds, at, "right") - 1
                whole = at + width <= bounds[doc + 1]  # shingles do not run on into the next text
                docs.append(doc[whole])
                places.append(at[whole] - bounds[doc[whole]])
                values.append(g[at[whole]])
            doc, place, value = np.concatenate(docs), np.concatenate(places), np.concatenate(values)
            order = np.lexsort((place, doc))
            counts = np.bincount(doc, minlength=end - first)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, end - first) for c in keep], pa.array(n_words.astype(np.int64)), _lists(place[order].astype(np.int64), counts), _lists(value[order].astype(np.int64), counts)],
                [*keep, "n_words", "place", "shingle"],
            )


def find(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents and contained windows.

    The first table has a row per row of ``docs``: doc, digest (of its text) and
    n_words.  The second has a row per (doc, digest, start, size, item): the
    item's window stands at word ``start``.

    Edge cases: null and empty texts have no words; an item without words has no
    window; repeated documents have the same windows, repeated items count once;
    empty tables on either side give no windows; other columns are not read.
    """
    spark = docs.sparkSession
    wh.bound_batches(spark)
    windows = materialize(item_windows(items, item=item, text=item_text, window=window, shingle=shingle), "benchmark-windows")
    shingles = windows.select("width", F.explode("shingles").alias("shingle")).distinct()
    n_blocks = max(1, -(-shingles.count() // block))
    base = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["doc"]
    tables = []
    for b in range(n_blocks):
        # at most about ``block`` hashes; they are uniform, so blocks are even
        rows = shingles.filter(F.pmod("shingle", F.lit(n_blocks)) == b).toArrow()
        width, value = rows.column("width").to_numpy(), rows.column("shingle").to_numpy().view(np.uint64)
        keys = {int(w): np.sort(value[width == w]) for w in np.unique(width)}
        sent = spark.sparkContext.broadcast(keys)
        places = base.mapInArrow(lambda it, sent=sent: _places(it, sent, ["doc", "digest"]), f"doc {kind}, digest long, n_words long, place array<long>, shingle array<long>")
        tables.append(materialize(places, "benchmark-places"))
        sent.destroy()
    hits = None
    for t in tables:
        rows = t.filter(F.size("place") > 0).select("doc", "digest", "n_words", F.inline(F.arrays_zip("place", "shingle")))
        hits = rows if hits is None else hits.unionByName(rows)
    hits = hits.distinct()  # repeated rows

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("seen"))
    distinct = windows.select("wid", "size", "need", "shingles").dropDuplicates(["wid"])
    parts = distinct.select("wid", "size", "need", F.posexplode("shingles").alias("at", "shingle"))
    ranked = parts.join(rarity, "shingle").groupBy("wid", "size", "need").agg(F.count("*").alias("n"), F.min(F.struct("seen", "at", "shingle")).alias("rarest"))
    prefix = ranked.filter("n = need").select("wid", "size", "need", F.col("rarest.at").alias("at"), F.col("rarest.shingle").alias("shingle"))
    start = F.col("place") - F.col("at")
    cand = hits.join(prefix, "shingle").filter((start >= 0) & (start + F.col("size") <= F.col("n_words"))).select("doc", "digest", "wid", "size", "need", start.alias("start"))
    # null document ids are ids too: they stand as a pair of a mark and a value
    same = lambda d: d.select(F.struct("doc").alias("doc"), *[c for c in d.columns if c != "doc"])
    wanted = same(cand).join(parts.select("wid", "at", "shingle"), "wid").withColumn("place", F.col("start") + F.col("at"))
    verified = (
        wanted.join(same(hits).drop("n_words"), ["doc", "digest", "place", "shingle"]).groupBy("doc", "digest", "wid", "start", "size", "need").agg(F.count("*").alias("n")).filter("n = need")
    )
    owners = windows.select("wid", "item").distinct()
    found = verified.join(owners, "wid").select("doc.doc", "digest", "start", "size", "item")
    return tables[0].select("doc", "digest", "n_words"), found


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row per document row: n_words, words inside any window (n_hit), the items' number and their sorted ids."""
    spans = found.select("doc", "digest", "start", (F.col("start") + F.col("size")).alias("end")).groupBy("doc", "digest", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc", "digest").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("doc", "digest").agg(F.sum("fresh").alias("n_hit"))
    items = found.groupBy("doc", "digest").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    r = hit.join(items, (hit["doc"].eqNullSafe(items["doc"])) & (hit["digest"] == items["digest"])).select(hit["doc"].alias("r_doc"), hit["digest"].alias("r_digest"), "n_hit", "items")
    out = rows.join(r, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("digest") == F.col("r_digest")), "left")
    return out.select("doc", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
