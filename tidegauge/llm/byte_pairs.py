"""Ids of a byte-level BPE tokenizer for blocks of texts.

A pre-token never runs from a visible character into white space, nor from a
letter or digit into punctuation, so texts are cut there.  The ids of a cut
depend on its bytes alone: each distinct cut of a task is encoded once, by the
tokenizer, and kept while there are fewer than ``KNOWN`` of them.  Cuts are told
apart by 64-bit hashes with and without case (:func:`pieces.exact_hashes`).
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from tidegauge.llm.pieces import exact_hashes

#: Cuts and ids remembered by a task.
KNOWN, KNOWN_IDS = 1 << 20, 1 << 23


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all cuts (a last entry ends the last) and the first cut of each text (one entry more).

    Punctuation is cut off ASCII letters and digits and the letters from U+00C0 to
    U+00FF only.  A character from U+0080 to U+00BF or U+1000 to U+3FFF may be white space
    itself: nothing is cut behind one.
    """
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    if len(data) > 1:
        white = np.isin(data, [0x20, 0x0A])
        visible = (data > 0x20) & (data < 0x7F)
        for back in (1, 2, 3):  # ends of characters of 2, 3 and 4 bytes whose first byte is none of C2, E1, E2, E3
            low, high = ((0xC3, 0xDF), (0xE4, 0xEF), (0xF0, 0xF4))[back - 1]
            lead = np.zeros(len(data), bool)
            lead[back:] = (data[:-back] >= low) & (data[:-back] <= high)
            for i in range(back):
                lead[i:] &= data[: len(data) - i] >= 0x80
            visible |= lead
        begin[1:-1] |= white[1:] & visible[:-1]
        solid = np.zeros(256, bool)
        solid[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        mark = np.zeros(256, bool)
        mark[0x21:0x7F] = ~solid[0x21:0x7F]
        mark[0x7C] = False  # stands inside the tokenizer's own marks
        last = solid[data]
        last[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begin[1:-1] |= mark[data[1:]] & last[:-1]
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """Encodes blocks with a memory of the cuts met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.ids = np.zeros(0, np.uint32)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text's begin (one entry more)."""
        starts, first = cuts(data, offsets)
        if len(starts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, sample, number = np.unique(exact_hashes(data, starts[:-1], starts[1:]), return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN or len(self.ids) > KNOWN_IDS:
            self.forget()
        new = np.flatnonzero(~self._known(distinct))
        if len(new):
            raw = data.tobytes()
            texts = [raw[starts[i] : starts[i + 1]].decode("utf-8", "replace") for i in sample[new].tolist()]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.array([len(f) for f in found], np.int64)
            flat = np.fromiter((i for f in found for i in f), np.uint32, int(n.sum()))
            keys, at = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            order = np.argsort(keys)
            self.keys, self.at, self.n, self.ids = keys[order], at[order], np.concatenate([self.n, n])[order], np.concatenate([self.ids, flat])
        slot = np.searchsorted(self.keys, distinct)[number]
        n = self.n[slot]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(ends[-1]) - np.repeat(ends[:-1] - self.at[slot], n)]
        return ids, ends[first]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[near] == keys


def encoder(path: str) -> Callable[[], Encoder]:
    """A function that makes the task's encoder, once for each Python worker and file."""

    def get() -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    return get


_ENCODERS: dict[str, Encoder] = {}
