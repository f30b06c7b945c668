"""Token counts by dynamic programming over a trie of words.

The number of tokens of a text is the sum over its words, and words repeat.  The
distinct words of a block are sorted and put in a trie, level by level; the best
segmentation of a prefix (the greatest sum of unigram log probabilities, fewer
tokens among equals) is computed once for all words that share it, from those of
its ancestors one piece shorter.  A word's node holds its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import pieces as pc
from tidegauge.llm import wordhash as wh


def trie_counts(pieces: pc.Pieces, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Tokens of the best segmentation of each word; words are rows of bytes, padded with zeros behind ``n``."""
    words, width = rows.shape
    order = np.lexsort((n, *rows.T[::-1]))
    rows, n = rows[order], n[order]
    # up to which depth a word is its predecessor again
    same = np.concatenate([[0], np.where((d := rows[1:] != rows[:-1]).any(axis=1), d.argmax(axis=1), width)])
    same = np.minimum(same, np.concatenate([[0], np.minimum(n[1:], n[:-1])]))
    found = pc.matches(pieces, rows, n)
    node = np.zeros((width + 1, words), np.int64)
    best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    out = np.zeros(words, np.int64)
    for depth in range(1, width + 1):
        alive = n >= depth
        new = alive & (same < depth)
        heads = np.flatnonzero(new)  # the first word of each node of this level
        if not len(heads):
            break
        node[depth] = np.cumsum(new) - 1
        score, count = np.full(len(heads), -np.inf), np.zeros(len(heads), np.int64)
        for length, ids in found.items():
            if length > depth:
                continue
            i = ids[heads, depth - length]
            up = node[depth - length, heads]
            s = np.where(i >= 0, pieces.logp[i] + best[depth - length][up], -np.inf)
            c = tokens[depth - length][up] + 1
            better = (s > score) | ((s == score) & (c < count) & np.isfinite(s))
            score, count = np.where(better, s, score), np.where(better, c, count)
        best.append(score)
        tokens.append(count)
        ends = n == depth
        out[ends] = count[node[depth, ends]]
    back = np.empty(words, np.int64)
    back[order] = out
    return back


def count_block(pieces: pc.Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text of a block."""
    starts, first_word = pieces.cut(data, offsets)
    if len(starts) < 2:
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    chosen, number = pc.distinct_words(data, starts)
    counts = np.zeros(len(chosen), np.int64)
    for part, rows, n in pc.by_length(data, starts, chosen):
        counts[part] = trie_counts(pieces, rows, n)
    sums = np.concatenate([[0], np.cumsum(counts[number])])
    return np.diff(first_word), np.diff(sums[first_word])


def _count(batches: Iterator[pa.RecordBatch], sent, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text"), 1 << 22):
            words, tokens = count_block(sent.value, data, offsets)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, end - first) for c in keep], pa.array(words), pa.array(tokens)], [*keep, "n_words", "n_tokens"])


def count(docs: DataFrame, *, text: str = "text", keep: list[str], pieces: pc.Pieces | None = None) -> DataFrame:
    """``keep``, n_words (pieces' words: runs of spaces with what follows, and line feeds) and n_tokens of each row.

    Edge cases: null and empty texts have none; characters without a piece count
    a token for each of their bytes; repeated rows have equal counts; an empty
    table gives an empty result; other columns are not read.
    """
    wh.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces or pc.load())
    names, kinds, t = [f"keep_{c}" for c in keep], dict(docs.dtypes), F.col(text)
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.when(F.length(t) > 0, F.concat(F.lit(" "), t)).otherwise("").alias("text"))
    out = rows.mapInArrow(lambda b: _count(b, sent, names), ", ".join([f"`keep_{c}` {kinds[c]}" for c in keep] + ["n_words long", "n_tokens long"]))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "n_words", "n_tokens")
