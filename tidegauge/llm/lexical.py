"""Ranked lexical search, reversed: the items are the index, the documents stream.

1. The items' distinct terms become an inverted index (term to items).  Items are
   dealt into blocks of about ``block`` postings, so what is sent to the tasks has
   a bound whatever the number of items; more items are more passes.
2. One pass over the documents counts them, their terms, and of the index's terms
   the documents that hold each; the sums are taken in Spark.
3. A second pass streams each document's term counts through the index.  A task
   keeps a bounded heap per item and hands over at most ``k`` rows an item.
4. The heaps are merged by a ranking per item that Spark limits on the map side.

Scores are integers: weight ``floor(1000 ln((2N+2)/(2df+1)))`` times
``1e9 tf div (1000 tf + 8 m)`` with ``m = 100-90 + (90 n N) div L``.  Terms are
compared by 64-bit hashes (:mod:`wordhash`): of u different words in documents
and v in a block of items, two fall together with a chance below u v / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import wordhash as wh
from tidegauge.session import materialize

#: Postings (pairs of an item and one of its terms) in the index of one pass: 12 bytes each, and 20 a term.
BLOCK = 2_000_000
#: Cells of a task's score table, and postings gone through at a time.
CELLS = 1 << 21
EXACT = 1 << 53


class Index:
    """Terms of a block of items, their items, and later their weights."""

    def __init__(self, hashes: list[np.ndarray]):
        """``hashes``: distinct terms of each item."""
        item = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.terms, first = np.unique(flat[order], return_index=True)
        self.items = item[order]
        self.starts = np.append(first, len(order)).astype(np.int64)
        self.n_items = len(hashes)
        self.most_terms = max([len(h) for h in hashes], default=0)
        self.weights = np.zeros(len(self.terms), np.int64)
        self.mark = np.zeros(1 << 16, bool)
        self.mark[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.weights = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)

    def found(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of each term of the index in each text of a block, by document and term."""
        at = np.flatnonzero(self.mark[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(self.terms) or not len(at):
            return (np.zeros(0, np.int64),) * 3
        h = hashes[at]
        near = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[near] == h
        doc = np.searchsorted(bounds, at[hit], "right") - 1
        pair, tf = np.unique(doc * len(self.terms) + near[hit], return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), tf


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            hashes, bounds = wh.words(data, offsets, wh.NOT_WORD)
            own = [np.unique(hashes[bounds[i] : bounds[i + 1]]).astype(np.int64) for i in range(end - first)]
            cuts = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(first, end - first), batch.column("digest").slice(first, end - first), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(own)))],
                ["item", "digest", "terms"],
            )


def _statistics(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """One row per task and term that it met: in how many documents; terms -1 and -2: documents with words, words."""
    index = sent.value
    df, n, words = np.zeros(len(index.terms), np.int64), 0, 0
    for batch in batches:
        for _, _, data, offsets in wh.blocks(batch.column("text")):
            hashes, bounds = wh.words(data, offsets, wh.NOT_WORD)
            n, words = n + int((np.diff(bounds) > 0).sum()), words + len(hashes)
            df += np.bincount(index.found(hashes, bounds)[1], minlength=len(df))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[n, words], df[at]]))], ["term", "seen"])


def lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of n terms; in Python's integers where 90 n N would pass 64 bits."""
    if int(n.max(initial=0)) * 90 * docs < 1 << 63:
        return 10 + 90 * n * docs // words
    return np.array([10 + 90 * int(x) * docs // words for x in n], np.int64)


def scores(index: Index, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, score above 0) for a block of documents, a bounded part of the score table at a time.

    ``doc`` is sorted; ``m`` belongs to the pairs.
    """
    part = index.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
    size = (index.starts[1:] - index.starts[:-1])[term]
    largest = int(part.max(initial=0)) * index.most_terms
    work = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(doc):
        # whole documents: at most CELLS cells and about CELLS postings, or one document
        to = min(int(np.searchsorted(doc, doc[at] + max(1, CELLS // index.n_items))), max(at + 1, int(np.searchsorted(work, work[at] + CELLS, "right")) - 1))
        if to < len(doc):
            begin = int(np.searchsorted(doc, doc[to]))
            to = begin if begin > at else int(np.searchsorted(doc, doc[at], "right"))
        first, docs = doc[at], int(doc[to - 1] - doc[at] + 1)
        count = size[at:to]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.starts[term[at:to]], count)
        cell = np.repeat((doc[at:to] - first) * index.n_items, count) + index.items[place]
        value = np.repeat(part[at:to], count)
        if largest < EXACT:
            total = np.bincount(cell, weights=value, minlength=docs * index.n_items).astype(np.int64)
        else:
            total = np.zeros(docs * index.n_items, np.int64)
            np.add.at(total, cell, value)
        hit = np.flatnonzero(total > 0)
        yield first + hit // index.n_items, hit % index.n_items, total[hit]
        at = to


class Heaps:
    """The k best (score, document) of every item so far: highest score, then smallest document."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(n_items, np.int64)  # score of the k-th, 0 while there are fewer

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        may = score >= np.maximum(self.least[item], 1)
        if not may.any():
            return
        item, score, doc = (np.concatenate([a, b[may]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        last = rank[keep] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def _search(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    index, docs, words = sent.value
    heaps = Heaps(index.n_items, k)
    for batch in batches:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        for start, _, data, offsets in wh.blocks(batch.column("text")):
            hashes, bounds = wh.words(data, offsets, wh.NOT_WORD)
            doc, term, tf = index.found(hashes, bounds)
            m = lengths(np.diff(bounds), docs, words)[doc] if len(doc) else doc
            for d, item, score in scores(index, doc, term, tf, m):
                heaps.add(item, score, ids[start + d])
    yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(heaps.doc), pa.array(heaps.score)], ["no", "doc", "score"])


#: Stands for a null document id inside the tasks: it comes before all others, as nulls do in Spark.
NULL_ID = -(1 << 63)


def search(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: item, rank (from 1), doc, score.

    ``doc`` is an integer column.  Rows with a score above 0 only, equal scores
    by ascending id.

    Edge cases: null and empty texts have no terms and are in no list; an item
    without terms, or of terms that no document holds, has no rows; a null id
    comes before the others; repeated documents are ranked one after the other;
    repeated items (same id and text) count once, items of one id with different
    texts have a list each; an empty table on either side gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    wh.bound_batches(spark)
    kind, item_kind = dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    rows = items.select(F.col(item).alias("item"), F.xxhash64(F.coalesce(F.col(item_text), F.lit(""))).alias("digest"), F.col(item_text).alias("text"))
    terms = rows.mapInArrow(_item_terms, f"item {item_kind}, digest long, terms array<long>").filter(F.size("terms") > 0).dropDuplicates(["item", "digest"])
    owners = materialize(terms.withColumn("deal", F.xxhash64("item", "digest")), "search-items")
    n_blocks = max(1, -(-int(owners.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block))
    base = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text).alias("text"))
    out = None
    for b in range(n_blocks):
        # about ``block`` postings: items are dealt by a hash
        dealt = owners.filter(F.pmod("deal", F.lit(n_blocks)) == b).sort("deal").toArrow()
        index = Index([np.array(t.values, np.int64).view(np.uint64) if len(t) else np.zeros(0, np.uint64) for t in dealt.column("terms")])
        sent = spark.sparkContext.broadcast(index)
        counted = base.select("text").mapInArrow(lambda it, sent=sent: _statistics(it, sent), "term long, seen long").groupBy("term").agg(F.sum("seen").alias("seen")).toArrow()
        term, seen = counted.column("term").to_numpy(), counted.column("seen").to_numpy()
        total = dict(zip(term[term < 0].tolist(), seen[term < 0].tolist()))
        df = np.zeros(len(index.terms), np.int64)
        df[term[term >= 0]] = seen[term >= 0]
        index.weigh(df, total.get(-1, 0))
        weighed = spark.sparkContext.broadcast((index, total.get(-1, 0), max(1, total.get(-2, 0))))
        heaps = base.mapInArrow(lambda it, sent=weighed: _search(it, sent, k), "no long, doc long, score long")
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc("doc"))
        best = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        numbers = spark.createDataFrame(pa.table({"no": pa.array(np.arange(dealt.num_rows)), "item": dealt.column("item")}))
        named = materialize(best.join(numbers, "no").select("item", "rank", F.when(F.col("doc") != NULL_ID, F.col("doc")).cast(kind).alias("doc"), "score"), "search-lists")
        sent.destroy()
        weighed.destroy()
        out = named if out is None else out.unionByName(named)
    return out
