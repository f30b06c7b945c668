"""SentencePiece encoding by sampling, and lossless decoding.

The segmentations of a word into pieces are the paths of a lattice; a path has
the product of its pieces' probabilities (to the power ``sharpness``).  Forward
filtering adds up the probability of all paths to each byte, once for every
distinct word of a block.  Backward sampling then walks each occurrence from its
end, choosing the piece that ends there by its share.  Random numbers are hashes
of the row's key, the word's place and the step, so a row has one segmentation
whatever task, order or retry encodes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import pieces as pc
from tidegauge.llm import wordhash as wh

#: Bytes of texts that share the forward pass over their distinct words.
BLOCK_BYTES = 1 << 21


def forward(pieces: pc.Pieces, rows: np.ndarray, n: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cumulative shares and ids of the pieces that end behind each byte, [word, end, choice], and their lengths, [end, choice]."""
    found = pc.matches(pieces, rows, n)
    words, width = rows.shape
    choices = [[k for k in sorted(found) if k <= end and (found[k][:, end - k] >= 0).any()] for end in range(width + 1)]
    most = max(map(len, choices))
    logp = np.append(sharpness * pieces.logp, -np.inf)  # -1, for no piece, is the last
    total = np.full((width + 1, words), -np.inf)
    total[0] = 0
    share = np.full((words, width + 1, most), 2, np.float32)  # above any draw, where no piece ends
    ids = np.full((words, width + 1, most), -1, np.int32)
    length = np.zeros((width + 1, most), np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        for end, lengths in enumerate(choices):
            if not lengths:
                continue
            length[end, : len(lengths)] = lengths
            score = np.empty((len(lengths), words))
            for j, k in enumerate(lengths):
                i = found[k][:, end - k]
                ids[:, end, j] = i
                score[j] = logp[i] + total[end - k]
            best = score.max(axis=0)
            weight = np.exp(score - np.where(best > -np.inf, best, 0))
            mass = np.cumsum(weight, axis=0)
            total[end] = best + np.log(mass[-1])
            share[:, end, : len(lengths)] = (mass / np.maximum(mass[-1], 1e-300)).T
    return share, ids, length


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    return (wh.mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sample_block(pieces: pc.Pieces, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, and how many each text has."""
    starts, first_word = pieces.cut(data, offsets)
    if len(starts) < 2:
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    chosen, number = pc.distinct_words(data, starts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first_word))
    nth = np.arange(len(text)) - first_word[:-1][text]
    seed = wh.mix(seeds[text] + wh.mix(nth.astype(np.uint64) + np.uint64(1)))
    by_word = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[by_word], np.arange(len(chosen) + 1))
    place_of, id_of = [], []
    for part, rows, n in pc.by_length(data, starts, chosen):
        share, ids, length = forward(pieces, rows, n, sharpness)
        count = cuts[part + 1] - cuts[part]
        local = np.repeat(np.arange(len(part)), count)
        spot = np.repeat(cuts[part], count) + np.arange(len(local)) - np.repeat(np.cumsum(count) - count, count)
        occurrence = by_word[spot]
        for i in range(0, len(local), 1 << 17):
            row, occ = local[i : i + (1 << 17)], occurrence[i : i + (1 << 17)]
            at, step = n[row].copy(), 0
            while len(row):
                u = _uniform(seed[occ], step)
                s = share[row, at]
                pick = np.minimum((u[:, None] >= s).sum(axis=1), share.shape[2] - 1)
                got = ids[row, at, pick]
                # rounding may point past the last piece that is there
                while (bad := got < 0).any():
                    pick[bad] -= 1
                    got[bad] = ids[row[bad], at[bad], pick[bad]]
                place_of.append((occ << 24) + ((1 << 24) - 1 - step))  # by word, the last step first
                id_of.append(got)
                at = at - length[at, pick]
                on = at > 0
                row, occ, at, step = row[on], occ[on], at[on], step + 1
    place, ids = np.concatenate(place_of), np.concatenate(id_of)
    return ids[np.argsort(place)], np.bincount(text[place >> 24], minlength=len(offsets) - 1)


def _same(pieces: pc.Pieces, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text of a block whether its ids spell its bytes."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    back, bounds = spelled(pieces, ids, ends)
    if len(back) == len(data) and (back == data).all() and (bounds == offsets).all():
        return np.ones(len(counts), bool)
    return np.array([np.array_equal(back[bounds[i] : bounds[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(counts))])


def _encode(batches: Iterator[pa.RecordBatch], sent, sharpness: float, keep: list[str]) -> Iterator[pa.RecordBatch]:
    pieces = sent.value
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text"), BLOCK_BYTES):
            seeds = batch.column("seed").slice(first, end - first).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, counts = sample_block(pieces, data, offsets, seeds, sharpness)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))
            null = batch.column("null").slice(first, end - first)
            lists = pa.compute.if_else(null, pa.nulls(end - first, lists.type), lists)
            same = pa.array(_same(pieces, ids, counts, data, offsets))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, end - first) for c in keep], lists, same], [*keep, "ids", "lossless"])


def encode(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: list[str], pieces: pc.Pieces | None = None, sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """``keep``, ``ids`` (array<int>) and ``lossless`` of each row: the ids are decoded at once and held against the text.

    Edge cases: a null text has null ids, an empty one none; a null key is a key
    of its own; repeated rows have equal ids; an empty table gives an empty
    result; other columns are not read.
    """
    wh.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces or pc.load())
    t = F.col(text)
    rows = docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep],
        F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("seed"),
        t.isNull().alias("null"),
        F.when(F.length(t) > 0, F.concat(F.lit(" "), t)).otherwise("").alias("text"),
    )
    names = [f"keep_{c}" for c in keep]
    kinds = dict(docs.dtypes)
    out = rows.mapInArrow(lambda b: _encode(b, sent, sharpness, names), ", ".join([f"`keep_{c}` {kinds[c]}" for c in keep] + ["ids array<int>, lossless boolean"]))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "ids", "lossless")


def spelled(pieces: pc.Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces, and where each text begins."""
    size = pieces.starts[ids + 1] - pieces.starts[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = pieces.flat[np.repeat(pieces.starts[ids] - ends[:-1], size) + np.arange(ends[-1])] if len(ids) else np.zeros(0, np.uint8)
    return data, ends[offsets]


def decode_block(pieces: pc.Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins; the space put before a text is taken off again."""
    data, bounds = spelled(pieces, ids, offsets)
    keep = np.ones(len(data), bool)
    some = bounds[1:] > bounds[:-1]
    keep[bounds[:-1][some]] = False
    return data[keep], bounds - np.concatenate([[0], np.cumsum(some)])


def _decode(batches: Iterator[pa.RecordBatch], sent, keep: list[str]) -> Iterator[pa.RecordBatch]:
    pieces = sent.value
    for batch in batches:
        # about a million ids at a time
        column = batch.column("ids")
        column = pa.compute.cast(column, pa.list_(pa.int32()))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            part = column.slice(at, to - at)
            ids = np.asarray(part.flatten(), np.int64)
            data, bounds = decode_block(pieces, ids, np.concatenate([[0], np.cumsum(sizes[at:to])]))
            texts = pa.StringArray.from_buffers(to - at, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes()))
            texts = pa.compute.if_else(part.is_null(), pa.nulls(to - at, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, to - at) for c in keep], texts], [*keep, "decoded"])
            at = to


def decode(rows: DataFrame, *, ids: str = "ids", keep: list[str], pieces: pc.Pieces | None = None) -> DataFrame:
    """``keep`` and ``decoded``: the text that ``ids`` spell, null for null."""
    wh.bound_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(pieces or pc.load())
    kinds, names = dict(rows.dtypes), [f"keep_{c}" for c in keep]
    out = rows.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col(ids).alias("ids")).mapInArrow(
        lambda b: _decode(b, sent, names), ", ".join([f"`keep_{c}` {kinds[c]}" for c in keep] + ["decoded string"])
    )
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "decoded")
