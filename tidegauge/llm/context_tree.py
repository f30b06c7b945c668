"""Language-model scores: a context-tree weighting of bytes, beside a unigram base.

**Model.**  Each byte is eight binary decisions, taken along a tree of 255
nodes.  Every node has a context tree of depth ``DEPTH`` over the bytes before.
A context's counts give a Krichevsky-Trofimov estimate; its weighted probability
is half its own estimate and half the product of its children's, so all depths
are mixed by how well they told the training bytes.  With the counts frozen, the
mixture for a context is ``w * own + (1 - w) * deeper`` with
``w = own estimate / (2 * weighted probability)``.

What is gathered from the corpus are counts of byte strings of ``DEPTH`` + 1: over
all bytes, summed in each task before they are shuffled, and more of them the
more the corpus says.  A string is written with its context first, nearest byte
first, so in sorted order every context of every depth is one stretch.  Tasks
hold whole contexts of two bytes with all that lies below them, go through them
bottom-up for the weights and top-down for the scores; what lies above is 256
contexts of one byte and the empty one, which the driver mixes.  The scored
strings come to the texts as sorted slices of at most ``SLICE``, a pass over the
texts each.  ``DEPTH`` line feeds stand before every text, and a zero byte behind
it ends it.

**Base.**  Token counts need every distinct token of the corpus, which nothing
bounds.  Each task turns runs of texts into postings by range of the token's
hash; a range's task adds up its tokens' counts and returns partial sums by
text, which are added up per run.  Postings list each token once per run, so
frequent tokens are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import wordhash as wh
from tidegauge.session import materialize

#: Bytes of context, from 2 to 6.
DEPTH = 5
#: Scored strings that are sent to the tasks at once, 12 bytes each.
SLICE = 1 << 22
#: Distinct strings that a task holds before it hands them on, and that it takes in before it goes through whole contexts.
HELD, CHUNK = 1 << 20, 1 << 18
#: A run of texts is closed at this many bytes or texts.
RUN_BYTES, RUN_TEXTS = 1 << 24, 60_000
HALF = np.log(0.5)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] = np.arange(97, 123)
    return t


def strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context (nearest byte first) and byte, for every byte of every text and for its end; and where each text's begin."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    ends = offsets[1:] + np.arange(1, n + 1) * (DEPTH + 1) - 1
    b = np.full(len(data) + n * (DEPTH + 1), 10, np.uint8)
    said = np.zeros(len(b), bool)
    at = np.arange(len(data)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, size)
    b[at] = _lower()[data]
    b[ends] = 0
    said[at] = said[ends] = True
    code = b.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        code[k:] |= b[:-k].astype(np.uint64) << np.uint64(8 * (DEPTH - k + 1))
    return code[said], offsets + np.arange(n + 1)


def _sum_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(place, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


def _rows(code: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    part = {"code": code.astype(np.int64), **columns}
    for i in range(0, len(code), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + (1 << 16)]) for v in part.values()], list(part))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts, total = [], [], 0
    for batch in batches:
        held_out = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            code, bounds = strings(data, offsets)
            # strings of texts that are not learned from are listed without a count, since they are scored too
            held = np.repeat(held_out[first:end], np.diff(bounds)).astype(np.uint64)
            both, n = np.unique((code << np.uint64(1)) | held, return_counts=True)
            codes.append(both >> np.uint64(1))
            counts.append(np.where(both & np.uint64(1), 0, n))
            total += len(both)
            if total > HELD:
                code, n = _sum_up(codes, counts)
                codes, counts, total = [code], [n], len(code)
                if 2 * total > HELD:
                    yield from _rows(code, n=n)
                    codes, counts, total = [], [], 0
    if total:
        code, n = _sum_up(codes, counts)
        yield from _rows(code, n=n)


def string_counts(texts: DataFrame) -> DataFrame:
    """(code, n) over the columns ``text`` and ``held_out``: every string of every text, and how often it was learned."""
    return texts.select("text", "held_out").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, behind eight steps of the recurrence."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _block(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - np.log(np.pi)


class Subtrees:
    """The contexts of two bytes and more of a sorted stretch of strings that holds them whole."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        # by depth: strings, their counts; and the place of each string in the depth above
        self.code, self.n, self.up = {DEPTH: code}, {DEPTH: n.astype(np.float64)}, {}
        for d in range(DEPTH - 1, 1, -1):
            k = self.code[d + 1]
            self.code[d], self.up[d + 1] = np.unique(((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(255)), return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], weights=self.n[d + 1])

    def weigh(self, level: int) -> dict[int, tuple]:
        """At a bit of the byte, by depth: group of each string, first string, zeros, ones, log of the weighted probability, weight."""
        out = {}
        for d in range(DEPTH, 1, -1):
            k, n = self.code[d], self.n[d]
            stem = k >> np.uint64(8 - level)
            new = np.concatenate([[True], stem[1:] != stem[:-1]])
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            one = np.add.reduceat(n * ((k >> np.uint64(7 - level)) & np.uint64(1)), first)
            zero = np.add.reduceat(n, first) - one
            own = weighted = _block(zero, one)
            if d < DEPTH:
                deeper = out[d + 1]
                below = np.bincount(group[self.up[d + 1][deeper[1]]], weights=deeper[4], minlength=len(first))
                weighted = np.logaddexp(HALF + own, HALF + below)
            out[d] = group, first, zero, one, weighted, np.exp(HALF + own - weighted)
        return out

    def above(self, sums: np.ndarray) -> None:
        """Add zeros, ones and logs of weighted probabilities to ``sums``, by byte before and node."""
        for level in range(8):
            _, first, zero, one, weighted, _ = self.weigh(level)[2]
            k = self.code[2][first].astype(np.int64)
            slot = ((k >> 16) << 8) | (1 << level) | ((k & 255) >> (8 - level))
            for i, values in enumerate((zero, one, weighted)):
                sums[i] += np.bincount(slot, weights=values, minlength=1 << 16)

    def log10(self, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each string, log10 of its byte's probability after its context."""
        code, out = self.code[DEPTH].astype(np.int64), np.zeros(len(self.code[DEPTH]))
        for level in range(8):
            weighed, place = self.weigh(level), np.arange(len(out))
            for d in range(DEPTH, 1, -1):
                group, _, zero, one, _, w = weighed[d]
                estimate, at = (one + 0.5) / (zero + one + 1), group[place]
                p = estimate[at] if d == DEPTH else w[at] * estimate[at] + (1 - w[at]) * p
                place = self.up[d][place] if d > 2 else place
            slot = ((code >> (8 * DEPTH)) << 8) | (1 << level) | ((code & 255) >> (8 - level))
            p = top[0][slot] + top[1][slot] * p
            out += np.log10(np.where((code >> (7 - level)) & 1, p, 1 - p))
        return out


def mix_top(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths 0 and 1, by byte before and node: p = first + second * (p of the deeper contexts)."""
    zero, one, below = sums.reshape(3, 256, 256)
    own = _block(zero, one)
    weighted = np.logaddexp(HALF + own, HALF + below)
    root = _block(zero.sum(axis=0), one.sum(axis=0))
    w0 = np.exp(HALF + root - np.logaddexp(HALF + root, HALF + weighted.sum(axis=0)))
    w1 = np.exp(HALF + own - weighted)
    estimate = (one + 0.5) / (zero + one + 1)
    estimate0 = (one.sum(axis=0) + 0.5) / (zero.sum(axis=0) + one.sum(axis=0) + 1)
    return (w0 * estimate0 + (1 - w0) * w1 * estimate).ravel(), ((1 - w0) * (1 - w1)).ravel()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[Subtrees]:
    """Sorted strings, cut between contexts of two bytes."""
    codes, counts, total = [], [], 0
    for batch in batches:
        codes.append(batch.column("code").to_numpy().astype(np.uint64))
        counts.append(batch.column("n").to_numpy())
        total += len(codes[-1])
        if total >= CHUNK:
            code, n = np.concatenate(codes), np.concatenate(counts)
            last = code[-1] >> np.uint64(8 * (DEPTH - 1)) << np.uint64(8 * (DEPTH - 1))
            cut = int(np.searchsorted(code, last))
            if cut:
                yield Subtrees(code[:cut], n[:cut])
            codes, counts, total = [code[cut:]], [n[cut:]], len(code) - cut
    if total:
        yield Subtrees(np.concatenate(codes), np.concatenate(counts))


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((3, 1 << 16))
    for tree in _whole(batches):
        tree.above(sums)
    slot = np.flatnonzero(sums.any(axis=0))
    yield from _rows(slot, zero=sums[0][slot], one=sums[1][slot], below=sums[2][slot])


def _log10(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for tree in _whole(batches):
        yield from _rows(tree.code[DEPTH], log10=tree.log10(sent.value).astype(np.float32))


def fit(texts: DataFrame) -> DataFrame:
    """(code, log10) of every string of ``texts`` (columns ``text``, ``held_out``), learned from those not held out."""
    counts = materialize(string_counts(texts), "byte-strings")
    dealt = counts.repartition(F.shiftright("code", 8 * (DEPTH - 1))).sortWithinPartitions("code")
    sums = np.zeros((3, 1 << 16))
    # at most 256 bytes x 255 nodes
    top = dealt.mapInArrow(_above, "code long, zero double, one double, below double").groupBy("code").agg(F.sum("zero"), F.sum("one"), F.sum("below")).toArrow()
    for i in range(3):
        sums[i][top.column(0).to_numpy()] = top.column(i + 1).to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(mix_top(sums))
    out = materialize(dealt.mapInArrow(lambda b: _log10(b, sent), "code long, log10 float"), "byte-string-scores")
    sent.destroy()
    return out


def slices(scored: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The scored strings as sorted arrays of some ``SLICE`` strings at most."""
    passes = max(1, -(-scored.count() * 8 // (SLICE * 7)))
    for i in range(passes):
        part = scored if passes == 1 else scored.filter(F.pmod(F.xxhash64("code"), F.lit(passes)) == i)
        got = part.toArrow()
        code, log10 = got.column("code").to_numpy(), got.column("log10").to_numpy()
        order = np.argsort(code)
        yield code[order].astype(np.uint64), log10[order]


def look_up(known: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
    """log10 of the strings of a slice, 0 for those of other slices."""
    if not len(known[0]):
        return np.zeros(len(code))
    at = np.minimum(np.searchsorted(known[0], code), len(known[0]) - 1)
    return np.where(known[0][at] == code, known[1][at], 0.0)


def _text_sums(known: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    code, bounds = strings(data, offsets)
    return np.diff(np.concatenate([[0.0], np.cumsum(look_up(known, code), dtype=np.float64)])[bounds])


def _more(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("digest").slice(first, end - first), pa.array(_text_sums(sent.value, data, offsets))], ["digest", "more"])


class _Run:
    """Texts gathered for one set of postings."""

    def __init__(self):
        self.hashes, self.counts, self.train, self.bytes = [], [], [], 0

    def postings(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """By range of the hash: tokens, their training counts, their numbers of texts; then texts and counts."""
        h = np.concatenate(self.hashes)
        doc = np.repeat(np.arange(len(self.train)), np.concatenate(self.counts))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        if not len(h):
            return
        new_token = np.concatenate([[True], h[1:] != h[:-1]])
        pair = np.flatnonzero(new_token | np.concatenate([[True], doc[1:] != doc[:-1]]))
        times = np.diff(np.append(pair, len(h)))
        doc_of, first = doc[pair], np.flatnonzero(new_token[pair])
        tokens = h[pair[first]]
        held = np.add.reduceat(times * np.asarray(self.train)[doc_of], first)
        spread = np.diff(np.append(first, len(pair)))
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        pair_cuts = np.append(first, len(pair))[cuts]
        for p in range(parts):
            a, b, x, y = cuts[p], cuts[p + 1], pair_cuts[p], pair_cuts[p + 1]
            if b > a:
                yield p, wh.pack(tokens[a:b], held[a:b], spread[a:b], doc_of[x:y], times[x:y])


def _score(batches: Iterator[pa.RecordBatch], sent, parts: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each text (part -1: its place in the run, score, tokens) and for each run and range of hashes."""
    task, number, run = TaskContext.get().partitionId(), 0, _Run()

    def emit(run_id, part, doc, place, held_out, n_tokens, score, texts, payload, digest):
        kinds = (pa.int64(), pa.int32(), kind, pa.int32(), pa.bool_(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.int64())
        names = ["run", "part", "doc", "place", "held_out", "n_tokens", "score", "texts", "payload", "digest"]
        values = (run_id, part, doc, place, held_out, n_tokens, score, texts, payload, digest)
        return pa.RecordBatch.from_arrays([v.cast(k) if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    def close():
        for p, data in run.postings(parts):
            yield emit([run_id()], [p], [None], [None], [None], [None], [None], [len(run.train)], [data], [None])

    def run_id():
        return (task << 32) | number

    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            n = end - first
            if run.train and (run.bytes + len(data) > RUN_BYTES or len(run.train) + n > RUN_TEXTS):
                yield from close()
                run, number = _Run(), number + 1
            sums = _text_sums(sent.value, data, offsets)
            hashes, words = wh.words(data, offsets, wh.WHITE)
            count = np.diff(words)
            held = batch.column("held_out").slice(first, n)
            begin = len(run.train)
            run.hashes.append(hashes)
            run.counts.append(count)
            run.train.extend((~np.asarray(held.to_numpy(zero_copy_only=False), bool)).tolist())
            run.bytes += len(data)
            yield emit(np.full(n, run_id()), np.full(n, -1), batch.column("doc").slice(first, n), np.arange(begin, begin + n), held, count + 1, sums, [None] * n, [None] * n, batch.column("digest").slice(first, n))
    if run.train:
        yield from close()


def _add_up(group: pa.Table) -> pa.Table:
    """Of a range of hashes: for every run, sums by text of count * log10(c + 1) and of known tokens."""
    runs, texts = group.column("run").to_pylist(), group.column("texts").to_pylist()
    parsed = []
    for data in group.column("payload"):
        parsed.append(wh.unpack(data.as_py()))
    tokens = np.concatenate([p[0] for p in parsed])
    distinct, place = np.unique(tokens, return_inverse=True)
    c = np.bincount(place, weights=np.concatenate([p[1] for p in parsed]).astype(np.float64))[place]
    out, at = [], 0
    for run, n, (t, _, spread, doc, times) in zip(runs, texts, parsed, strict=True):
        own = np.repeat(c[at : at + len(t)], spread)
        at += len(t)
        logs = np.bincount(doc, weights=times * np.log10(own + 1), minlength=n)
        known = np.bincount(doc, weights=times * (own > 0), minlength=n).astype(np.int64)
        out.append((run, logs.astype("<f8").tobytes(), wh.pack(known), 0))
    types = int(len(np.unique(place[c > 0])))
    out.append((-1, b"", b"", types))
    return pa.table({"run": pa.array([o[0] for o in out], pa.int64()), "logs": pa.array([o[1] for o in out], pa.binary()), "known": pa.array([o[2] for o in out], pa.binary()), "types": pa.array([o[3] for o in out], pa.int64())})


def _per_text(group: pa.Table) -> pa.Table:
    """Of a run: the sums of all ranges of hashes, by place."""
    logs = known = 0
    for a, b in zip(group.column("logs"), group.column("known"), strict=True):
        logs = logs + np.frombuffer(a.as_py(), "<f8")
        known = known + wh.unpack(b.as_py())[0].astype(np.int64)
    n = len(logs)
    return pa.table({"run": pa.array(np.full(n, group.column("run")[0].as_py())), "place": pa.array(np.arange(n, dtype=np.int32)), "logs": pa.array(logs), "known": pa.array(known)})


def score(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", held_out: Column) -> DataFrame:
    """One row per row of ``docs``: doc, held_out, n_tokens, n_known, train_tokens, train_types, base_score, score, bits_per_byte.

    Rows for which ``held_out`` is not true are learned from; all are scored,
    whole, in lower case (A-Z).  Tokens are words between white space, and one
    end.  ``score`` counts the text's bytes and its end.

    Edge cases: a null text is an empty one; a null ``held_out`` is false;
    repeated rows count and are scored as often as they come; without any row to
    learn from, c, N and V are 0 and every bit has probability a half; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    wh.bound_batches(spark)
    base = docs.select(F.col(doc).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))
    known = slices(fit(base))
    sent = spark.sparkContext.broadcast(next(known))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(base.dtypes)["doc"]
    arrow = pa.schema([("doc", base.select("doc").limit(0).toArrow().schema.field("doc").type)]).field("doc").type
    table = base.mapInArrow(
        lambda b: _score(b, sent, parts, arrow), f"run long, part int, doc {kind}, place int, held_out boolean, n_tokens long, score double, texts int, payload binary, digest long"
    )
    table = materialize(table, "token-postings")
    sent.destroy()
    sums = table.filter("part >= 0").select("run", "part", "texts", "payload").groupBy("part").applyInArrow(_add_up, "run long, logs binary, known binary, types long")
    sums = materialize(sums, "token-sums")
    rows = table.filter("part = -1").select("run", "place", "doc", "held_out", "n_tokens", "score", "digest")
    for part in known:
        # strings of other slices: a score depends on the text alone, so it comes back by the text's digest
        sent = spark.sparkContext.broadcast(part)
        more = base.select("digest", "text").mapInArrow(lambda b, sent=sent: _more(b, sent), "digest long, more double")
        more = materialize(more.groupBy("digest").agg(F.max("more").alias("more")), "more-strings")
        sent.destroy()
        rows = rows.join(more, "digest").withColumn("score", F.col("score") + F.col("more")).drop("more")
    ends, words = rows.filter(~F.col("held_out")).agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    types = sums.filter("run = -1").agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0] + (ends > 0)
    per_text = sums.filter("run >= 0").select("run", "logs", "known").groupBy("run").applyInArrow(_per_text, "run long, place int, logs double, known long")
    out = rows.join(per_text, ["run", "place"], "left")
    return out.select(
        "doc",
        "held_out",
        "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(words)).cast("long").alias("train_tokens"),
        F.lit(int(types)).cast("long").alias("train_types"),
        (F.coalesce("logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(words + types + 1)))).alias("base_score"),
        "score",
    )
