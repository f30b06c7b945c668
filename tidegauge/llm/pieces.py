"""The pieces of a SentencePiece vocabulary as arrays, and their matches in words.

Words are cut so that no piece crosses a cut: before every run of spaces and
around line feeds (as long as no piece holds one).  Matches are looked up for
all words of a block at once, one piece length after the other, by a rolling
hash over their bytes.  Spaces stand for the vocabulary's word mark, so a word
mark in a text is no space: like every character without a piece it is spelled
in byte pieces, and decoding is lossless.
"""

from __future__ import annotations

import numpy as np

from tidegauge.llm import wordhash as wh

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, FEED = 0x20, 0x0A
_STEP = np.uint64(0x9FB21C651E98DF25)


class Pieces:
    """Bytes, log probabilities and lookup table of a vocabulary.

    The files at hand hold merge ranks in place of probabilities, so a piece's
    probability falls with its place in the file, as 1 / (place + 1).
    """

    def __init__(self, strings: list[str], byte_ids: dict[int, int]):
        """``strings``: None for ids that are no ordinary piece; ``byte_ids``: id of each byte."""
        self.bytes = [b"" if s is None else s.replace(MARK, " ").encode() for s in strings]
        for value, i in byte_ids.items():
            self.bytes[i] = bytes([value])
        ordinary = [i for i, s in enumerate(strings) if s]
        weight = 1.0 / (np.arange(len(ordinary)) + 1.0)
        self.logp = np.full(len(strings), -np.inf)
        self.logp[ordinary] = np.log(weight / weight.sum())
        self.byte_id = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.logp[self.byte_id] = self.logp[ordinary].min()
        own = {}
        for i in ordinary:
            own.setdefault(self.bytes[i], i)
        size = np.array([len(b) for b in own])
        key = np.array([self._hash(b) for b in own], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array(list(own.values()), np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self.keys >> np.uint64(42)] = True
        self.lengths = sorted(set(size.tolist()))
        self.longest = max(self.lengths)
        self.cut_feeds = not any(FEED in b for b in own)
        self.cut_spaces = not any(b" " in b.lstrip(b" ") for b in own)
        # bytes back from ids
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @staticmethod
    def _hash(data: bytes) -> int:
        return int(Pieces.rolled(np.frombuffer(data, np.uint8)[None, :], len(data))[0, 0])

    @staticmethod
    def rolled(rows: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all substrings of ``length`` bytes of each row."""
        return wh.mix(Pieces.polynomial(rows, length) + np.uint64(length))

    @staticmethod
    def polynomial(rows: np.ndarray, length: int) -> np.ndarray:
        n = rows.shape[1] - length + 1
        out = np.zeros((rows.shape[0], n), np.uint64)
        for i in range(length):
            out = out * _STEP + rows[:, i : i + n].astype(np.uint64) + np.uint64(1)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        at = np.nonzero(self.marks[(hashes >> np.uint64(42)).astype(np.int64)])
        h = hashes[at]
        near = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out[at] = np.where(self.keys[near] == h, self.ids[near], -1)
        return out

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all words (a last entry ends the last), and the first word of each text (one entry more)."""
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        if self.cut_spaces and len(data):
            space = data == SPACE
            begin[1:-1] |= space[1:] & ~space[:-1]
        if self.cut_feeds and len(data):
            feed = data == FEED
            begin[1:-1] |= feed[1:] != feed[:-1]
        starts = np.flatnonzero(begin)
        return starts, np.searchsorted(starts, offsets)


def load(path: str = MODEL) -> Pieces:
    """Read a SentencePiece model file that has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        s = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(s[1:-1], 16)] = i
        strings.append(None if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else s)
    if len(byte_ids) != 256:
        raise ValueError("a vocabulary with byte pieces is needed")
    return Pieces(strings, byte_ids)


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words between ``starts``: one index for each distinct word, and each word's number among them."""
    s, e = starts[:-1], starts[1:]
    hashes = exact_hashes(data, s, e)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return first, number


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Like :func:`wordhash.hash_words`, but upper case is told from lower: its letters are put elsewhere first."""
    return wh.hash_words(data, starts, ends) ^ wh.mix(wh.hash_words((((data >= 65) & (data <= 90)).astype(np.uint8) * 7), starts, ends))


def by_length(data: np.ndarray, starts: np.ndarray, chosen: np.ndarray):
    """(indices into ``chosen``, rows of bytes padded with zero, lengths) for words of similar length."""
    size = starts[chosen + 1] - starts[chosen]
    group = np.maximum(3, np.ceil(np.log2(np.maximum(size, 1))).astype(int))
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        # a slice holds about a million bytes
        step = max(1, (1 << 18) >> g)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            n = size[part]
            column = np.arange(int(n.max()))
            place = starts[chosen[part]][:, None] + column
            inside = column < n[:, None]
            yield part, np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8), n


def matches(pieces: Pieces, rows: np.ndarray, n: np.ndarray) -> dict[int, np.ndarray]:
    """For each length of a piece: ids of the pieces that begin at each byte, or -1.

    A byte piece stands at every byte of a character that is no piece itself.
    """
    out, width = {}, rows.shape[1]
    sums = np.zeros((len(rows), width), np.uint64)
    for length in range(1, min(pieces.longest, width) + 1):
        m = width - length + 1
        sums = sums[:, :m] * _STEP + rows[:, length - 1 :].astype(np.uint64) + np.uint64(1)
        if length in pieces.lengths:
            ids = pieces.find(wh.mix(sums + np.uint64(length)))
            ids[np.arange(m) + length > n[:, None]] = -1
            out[length] = ids
    lead = np.where(rows < 0x80, 1, np.where(rows < 0xC0, 0, np.where(rows < 0xE0, 2, np.where(rows < 0xF0, 3, 4))))
    known = np.zeros(rows.shape, bool)
    for length in range(1, 5):
        if length in out:
            whole = np.zeros(rows.shape, bool)
            whole[:, : width - length + 1] = (lead[:, : width - length + 1] == length) & (out[length] >= 0)
            for i in range(length):
                known[:, i:] |= whole[:, : width - i]
    single = out.setdefault(1, np.full(rows.shape, -1, np.int32))
    spelled = ~known & (np.arange(width) < n[:, None])
    single[spelled] = pieces.byte_id[rows[spelled]]
    return out
