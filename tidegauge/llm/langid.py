"""Language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (byte n-grams of words with
their ends, hashed into ``buckets``), put through a linear softmax.  The model
is trained by stochastic gradient descent in NumPy on a bounded sample of
labelled rows: ``per_label`` rows of each label are expected, drawn by a hash of
their key, each as a whole and as some short fragments.  A fifth of the sample
is held back to calibrate: a temperature for the probabilities and the
probability below which a text is rejected.

Subwords are counted on the executors; the driver gets sparse counts of the
sample and the label counts, never texts.  Since mean and softmax are linear
until the end, the model that is sent out is one number per bucket and label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import wordhash as wh
from tidegauge.session import materialize

UNDETERMINED = "und"
LENGTHS = (2, 3, 4)
BUCKETS = 1 << 15
#: Bytes of an Arrow batch: long texts do not meet in one.
BATCH_BYTES = 1 << 22


@dataclass(frozen=True)
class Settings:
    per_label: int = 600
    dimensions: int = 16
    epochs: int = 12
    rate: float = 0.8
    fragments: int = 3
    held_back: float = 0.2
    #: Share of held-back whole texts that may be rejected, and the probability that is never rejected.
    rejected_share: float = 0.001
    never_rejected: float = 0.5


@dataclass(frozen=True)
class Model:
    """Scores by label and bucket; ``labels`` may be empty."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    reject_below: float


def _normal_bytes() -> np.ndarray:
    """Lower case; everything in ASCII that is no letter is a space."""
    t = np.arange(256, dtype=np.uint32)
    t[:128] = 32
    t[65:91] = t[97:123] = np.arange(97, 123)
    return t


def buckets_of(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte."""
    b = _normal_bytes()[data]
    size = max(0, len(b) - n + 1)
    key = np.full(size, n, np.uint32)
    for i in range(n):
        key = key * np.uint32(0x01000193) + b[i : i + size]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _padded(text: Column) -> Column:
    """Every text begins and ends with a word's end."""
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))


def _counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = np.concatenate([buckets_of(data, n) for n in LENGTHS])
    at, n = np.unique(got, return_counts=True)
    return at.astype(np.int32), (n / n.sum()).astype(np.float32)


def _sample_features(batches: Iterator[pa.RecordBatch], fragments: int) -> Iterator[pa.RecordBatch]:
    """Sparse counts of each text and of fragments of one to twelve words."""
    for batch in batches:
        names, draws, whole, at, share = [], [], [], [], []
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            for i in range(end - first):
                body = data[offsets[i] : offsets[i + 1]]
                draw = batch.column("draw")[first + i].as_py()
                rng = np.random.default_rng(draw)
                starts, ends = wh.word_bounds(body, np.array([0, len(body)]), wh.WHITE)
                parts = [(True, body)]
                for _ in range(fragments if len(starts) else 0):
                    a = int(rng.integers(len(starts)))
                    z = min(len(starts), a + int(rng.integers(1, 13))) - 1
                    parts.append((False, np.concatenate([[32], body[starts[a] : ends[z]], [32]]).astype(np.uint8)))
                for is_whole, part in parts:
                    k, v = _counts(part)
                    names.append(batch.column("lang")[first + i].as_py())
                    draws.append(draw)
                    whole.append(is_whole)
                    at.append(k)
                    share.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(draws, pa.int64()), pa.array(whole, pa.bool_()), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["lang", "draw", "whole", "at", "share"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(rows: pa.Table, labels: list[str], s: Settings) -> Model:
    """Plain SGD, one text at a time, then temperature and threshold on the held-back fifth."""
    rng = np.random.default_rng(7)
    number = {x: i for i, x in enumerate(labels)}
    lists = rows.column("at").combine_chunks()
    at, share = np.asarray(lists.flatten()), np.asarray(rows.column("share").combine_chunks().flatten())
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
    heads = list(zip(rows.column("draw").to_pylist(), rows.column("lang").to_pylist(), rows.column("whole").to_pylist(), strict=True))
    # rows arrive in any order; equal ones are interchangeable
    order = sorted(range(len(heads)), key=lambda i: (*heads[i][:2], not heads[i][2], ends[i + 1] - ends[i], zlib.crc32(at[ends[i] : ends[i + 1]]), zlib.adler32(at[ends[i] : ends[i + 1]])))
    data = [(at[ends[i] : ends[i + 1]], share[ends[i] : ends[i + 1]], number[heads[i][1]], heads[i][2], (heads[i][0] >> 8) % 1000 < 1000 * s.held_back) for i in order]
    train, back = [d for d in data if not d[4]], [d for d in data if d[4]]
    train, back = train or back, back or train
    embed = rng.normal(0, 0.1, (BUCKETS, s.dimensions)).astype(np.float32)
    weights = np.zeros((s.dimensions, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(train)):
            at, share, y, _, _ = train[i]
            hidden = share @ embed[at]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # shares are small: a text's step is spread over its subwords, so it is scaled to their number
            embed[at] -= (rate * 20) * share[:, None] * step
    scores = embed @ weights
    z = np.array([share @ scores[at] + bias for at, share, *_ in back])
    y = np.array([d[2] for d in back])
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    whole = np.array([d[3] for d in back])
    best = _softmax(z / heat).max(axis=1)[whole] if whole.any() else np.ones(1)
    below = min(s.never_rejected, float(np.quantile(best, s.rejected_share)))
    return Model(labels, (scores / heat).T.astype(np.float32).copy(), (bias / heat).astype(np.float64), below)


def train(rows: DataFrame, *, key: str, text: str, lang: str, settings: Settings = Settings()) -> Model:
    """Fit on ``rows``; those without text or label are left out."""
    wh.bound_batches(rows.sparkSession, BATCH_BYTES)
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0), 0.0)
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), 1)
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, settings.per_label / counts[k])))])
    sample = labelled.select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text")).filter(F.pmod("draw", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    sample = sample.select("lang", "draw", _padded(F.col("text")).alias("text"))
    features = sample.mapInArrow(lambda b, k=settings.fragments: _sample_features(b, k), "lang string, draw long, whole boolean, at array<int>, share array<float>")
    features = materialize(features, "language-sample")
    # the sample is bounded, so one task fits it; only the model comes to the driver
    fitted = features.coalesce(1).mapInArrow(lambda b: _fit_rows(b, labels, settings), "scores binary, bias array<double>, below double").first()
    scores = np.frombuffer(fitted["scores"], np.float32).reshape(len(labels), BUCKETS)
    return Model(labels, scores, np.array(fitted["bias"]), fitted["below"])


def _fit_rows(batches: Iterator[pa.RecordBatch], labels: list[str], settings: Settings) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        model = _fit(pa.Table.from_batches(got), labels, settings)
    else:  # texts, but the draws left all of them out
        model = Model(labels, np.zeros((len(labels), BUCKETS), np.float32), np.zeros(len(labels)), 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias.tolist()], pa.list_(pa.float64())), pa.array([model.reject_below])], ["scores", "bias", "below"])


def _predict(batches: Iterator[pa.RecordBatch], sent, keep: list[str], text: str) -> Iterator[pa.RecordBatch]:
    model: Model = sent.value
    for batch in batches:
        # like _padded; here, so that a text that is kept goes to the task once
        padded = pc.binary_join_element_wise(" ", pc.fill_null(batch.column(text), ""), " ", "")
        for first, end, data, offsets in wh.blocks(padded):
            z = np.zeros((end - first, len(model.labels)))
            size = np.zeros(end - first)
            for n in LENGTHS:
                at = buckets_of(data, n)
                # n-grams of a text end with it; a running sum gives each text's share
                a, b = offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
                a, b = np.minimum(a, len(at)), np.minimum(b, len(at))
                size += b - a
                for k in range(len(model.labels)):
                    sums = np.concatenate([[0.0], np.cumsum(model.scores[k][at], dtype=np.float64)])
                    z[:, k] += sums[b] - sums[a]
            letters = np.asarray(batch.column("letters").slice(first, end - first).to_numpy(zero_copy_only=False), bool)
            names = np.full(end - first, UNDETERMINED, object)
            score = np.zeros(end - first)
            if model.labels:
                p = _softmax(z / np.maximum(size, 1)[:, None] + model.bias)
                best = p.argmax(axis=1)
                names[letters] = np.array(model.labels, object)[best[letters]]
                score[letters] = p[np.arange(len(p)), best][letters]
            rejected = ~letters | (score < model.reject_below) | (not model.labels)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, end - first) for c in keep], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])


def _predicted(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """Like :func:`predict`, with ``keep_`` before the names that are kept."""
    wh.bound_batches(docs.sparkSession, BATCH_BYTES)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    kept = f"keep_{text}" if text in keep else "text"
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], letters, *([] if text in keep else [F.col(text).alias("text")]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels
    names, kinds = [f"keep_{c}" for c in keep], dict(docs.dtypes)
    return rows.mapInArrow(lambda b: _predict(b, sent, names, kept), ", ".join([f"`keep_{c}` {kinds[c]}" for c in keep] + ["lang_pred string, score double, rejected boolean"]))


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep``, lang_pred, score (calibrated probability) and rejected for each row; only the text is looked at.

    Edge cases: a null text and one without any letter are ``und`` with score 0
    and rejected; so is everything under a model without labels; of equal
    probabilities the first label wins; repeated rows are predicted alike; an
    empty table gives an empty result; other columns are not read.
    """
    out = _predicted(docs, model, text, keep)
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""
    out = _predicted(docs, model, text, docs.columns).filter(~F.col("rejected"))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])
