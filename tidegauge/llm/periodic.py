"""Runs of words that repeat with a period, found by block convolution.

A run of period q is at least 3 q and ``least`` words long.  So, with B = q
rounded down to a power of two (8 at least), it covers a whole block of B words
that begins at a multiple of B, and the same words again q further on.  For each
scale B = 8, 16, 32, ... the blocks are held against the windows behind them:

* the sum of squared differences of word numbers between a block and the window
  at every distance is one convolution, taken as an exact integer NTT (modulo
  one prime, or two or three where the sums could exceed one).  Distances in
  [B, 2B) with sum zero are the block's occurrences; the base scale takes 1 to 16.
* Only blocks all of whose words occur again at such a distance are transformed:
  others cannot match.
* Distances inside a run that is known already, and a multiple of its period, are
  explained.  The rest are seeds: chains of neighbouring blocks with one distance
  are extended word by word to both sides, and are runs if they are long enough.
  Of equal stretches the smallest distance is the period.

Blocks are at most ``BLOCK`` words: at larger scales each block is its first
``BLOCK`` words, and the distances are taken in parts, so that a transform has a
bounded size however long a text is.  Word numbers are exact, from a dictionary
of the text's words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import wordhash as wh

BASE = 8
BLOCK = 1 << 12
#: Numbers in the arrays of one batch of transforms.
CELLS = 1 << 19
#: Primes of the form a 2^b + 1 below 2^31, each with a generator (b is 24 at least).
PRIMES = [(2013265921, 31), (469762049, 3), (1811939329, 13)]


# ------------------------------------------------------------------ number-theoretic transform


@lru_cache(maxsize=64)
def _twiddles(size: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for every level of a transform of ``size``."""
    out, half = [], size // 2
    while half:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        if inverse:
            root = pow(root, -1, prime)
        powers = np.ones(half, np.uint64)
        at, step = 1, root
        while at < half:  # doubling: the second half is the first times one factor
            powers[at : 2 * at] = powers[:at] * np.uint64(step) % np.uint64(prime)
            at, step = 2 * at, step * step % prime
        out.append(powers)
        half //= 2
    return out


def ntt(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform of each row, in bit-reversed order."""
    p, (n, size) = np.uint64(prime), rows.shape
    for powers in _twiddles(size, prime, generator, False):
        half = len(powers)
        x = rows.reshape(n, -1, 2, half)
        a, b = x[:, :, 0, :], x[:, :, 1, :]
        rows = np.stack([(a + b) % p, (a + p - b) * powers % p], axis=2).reshape(n, size)
    return rows


def inverse_ntt(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Back from :func:`ntt`."""
    p, (n, size) = np.uint64(prime), rows.shape
    for powers in reversed(_twiddles(size, prime, generator, True)):
        half = len(powers)
        x = rows.reshape(n, -1, 2, half)
        a, b = x[:, :, 0, :], x[:, :, 1, :] * powers % p
        rows = np.stack([(a + b) % p, (a + p - b) % p], axis=2).reshape(n, size)
    return rows * np.uint64(pow(size, -1, prime)) % p


def primes_for(block: int, numbers: int) -> list[tuple[int, int]]:
    """As many primes as a sum of ``block`` squared differences of ``numbers`` word numbers needs."""
    bound, have, out = block * numbers * numbers, 1, []
    for prime, generator in PRIMES:
        out.append((prime, generator))
        have *= prime
        if have > bound:
            return out
    raise ValueError("more different words than exact sums have room for")


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray, numbers: int) -> np.ndarray:
    """Where each block (length b) stands in its window (length 2 b): a row of b answers, one for each offset below b.

    Sum (x - y)^2 = sum x^2 + sum y^2 - 2 sum x y; the last by the transform of
    size 2 b, of which the offsets below b are free of wrapping.  The true sum is
    below the product of the primes, so it is zero if it is zero modulo each.
    """
    b = blocks.shape[1]
    out = np.ones((len(blocks), b), bool)
    for prime, generator in primes_for(b, numbers):
        p = np.uint64(prime)
        x, y = blocks % p, windows % p
        squares = np.concatenate([np.zeros((len(y), 1), np.uint64), np.cumsum(y * y % p, axis=1)], axis=1)
        own = (x * x % p).sum(axis=1, keepdims=True) + squares[:, b : 2 * b] - squares[:, :b]
        padded = np.zeros(y.shape, np.uint64)
        padded[:, :b] = x[:, ::-1]
        cross = inverse_ntt(ntt(padded, prime, generator) * ntt(y, prime, generator) % p, prime, generator)[:, b - 1 : 2 * b - 1]
        out &= own % p == 2 * cross % p
    return out


# ------------------------------------------------------------------ runs of a block of texts


def _recurring(code: np.ndarray, order: np.ndarray, keys: np.ndarray, place: np.ndarray, low: int, high: int) -> np.ndarray:
    """Of words at ``place``: whether the same word stands at a distance of low to high."""
    n = np.int64(len(code) + 1)
    near = np.searchsorted(keys, code[place] * n + place + low)
    at = np.minimum(near, len(keys) - 1)
    return (near < len(keys)) & (code[order[at]] == code[place]) & (order[at] - place <= high)


def _extend(code: np.ndarray, left: np.ndarray, right: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grow stretches [left, right) of words equal to those q on, to both sides within their texts.

    Chunks double from 16 words, and several stretches are compared at once.
    """
    left, right = left.copy(), right.copy()
    for side in (0, 1):
        active, chunk = np.arange(len(left)), 16
        while len(active):
            rest = []
            step = max(1, CELLS // chunk)
            for at in range(0, len(active), step):
                a = active[at : at + step]
                i = np.arange(chunk)
                place = left[a][:, None] - 1 - i if side == 0 else right[a][:, None] + i
                inside = place >= begin[a][:, None] if side == 0 else place + q[a][:, None] < end[a][:, None]
                same = inside & (code[np.where(inside, place, 0)] == code[np.where(inside, place + q[a][:, None], 0)])
                count = np.where(same.all(axis=1), chunk, same.argmin(axis=1))
                if side == 0:
                    left[a] -= count
                else:
                    right[a] += count
                rest.append(a[count == chunk])
            active, chunk = np.concatenate(rest), min(2 * chunk, CELLS)
    return left, right


def find_runs(code: np.ndarray, bounds: np.ndarray, numbers: int, least: int = 24, repeats: int = 3, block: int = BLOCK) -> np.ndarray:
    """Runs of a sequence of texts: rows (start, end, period), ``start`` and ``end`` in the whole sequence.

    ``code``: each word's number, equal only for equal words of one text (so
    nothing matches across texts); ``numbers``: how many there are in one text at
    most, from ``bounds[i]`` on for text i.
    """
    if least < 3 * BASE or repeats < 3:
        raise ValueError("blocks of 8 words need runs of 24 words and 3 periods at least")
    n = len(code)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    size = np.diff(bounds)
    order = np.argsort(code, kind="stable")
    keys = code[order] * np.int64(n + 1) + order
    runs, scale = none, BASE
    while scale * 3 <= size.max() or scale == BASE:
        b = min(scale, block)
        per_text = np.where(size >= max(least, 3 * scale), size // scale, 0)
        text = np.repeat(np.arange(len(size)), per_text)
        starts = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * scale
        ends = bounds[1:][text]
        # distances of this scale, in parts as wide as a block
        for low in [1, 1 + b] if scale == BASE else range(scale, 2 * scale, b):
            alive = starts + low + b <= ends
            for i in range(b):
                at = np.flatnonzero(alive)
                if not len(at):
                    break
                alive[at] = _recurring(code, order, keys, starts[at] + i, low, low + b - 1)
            seeds = _seeds(code, starts[alive], ends[alive], low, b, numbers)
            seeds = seeds[~_explained(seeds, runs, b)]
            runs = _merge(runs, _grow(code, bounds, seeds, scale, b, least, repeats))
        scale *= 2
    return runs


def _seeds(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, b: int, numbers: int) -> np.ndarray:
    """(block start, distance) of all zero-mismatch occurrences at distances low to low + b - 1 that lie inside the text."""
    out = [np.zeros((0, 2), np.int64)]
    step = max(1, CELLS // (2 * b))
    for at in range(0, len(starts), step):
        s, e = starts[at : at + step], ends[at : at + step]
        place = s[:, None] + low + np.arange(2 * b)
        base = code[s][:, None]  # differences stay the same, and numbers of one text are small
        window = code[np.minimum(place, len(code) - 1)] - base
        own = code[s[:, None] + np.arange(b)] - base
        # words of other texts and behind the end get a number that no word of the text has
        lowest = own.min(axis=1, keepdims=True)
        outside = place >= e[:, None]
        lowest = np.minimum(lowest, np.where(outside, 0, window).min(axis=1, keepdims=True))
        own, window = own - lowest + 1, np.where(outside, 0, window - lowest + 1)
        hit, offset = np.nonzero(zero_mismatches(own.astype(np.uint64), window.astype(np.uint64), numbers + 2))
        q = low + offset
        whole = s[hit] + q + b <= e[hit]
        out.append(np.stack([s[hit[whole]], q[whole]], axis=1))
    return np.concatenate(out)


def _explained(seeds: np.ndarray, runs: np.ndarray, b: int) -> np.ndarray:
    """Seeds whose block and its occurrence lie in one known run, a multiple of its period apart.

    A block covered by several runs is held against the one of smallest period.
    """
    if not len(seeds) or not len(runs):
        return np.zeros(len(seeds), bool)
    order = np.argsort(seeds[:, 0], kind="stable")
    start = seeds[order, 0]
    period, end = np.zeros(len(seeds), np.int64), np.zeros(len(seeds), np.int64)
    for left, right, q in runs[np.argsort(-runs[:, 2], kind="stable")]:
        lo, hi = np.searchsorted(start, [left, right - b + 1])
        period[lo:hi], end[lo:hi] = q, right
    known = (period > 0) & (seeds[order, 1] % np.maximum(period, 1) == 0) & (start + seeds[order, 1] + b <= end)
    out = np.zeros(len(seeds), bool)
    out[order] = known
    return out


def _grow(code: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, scale: int, b: int, least: int, repeats: int) -> np.ndarray:
    """The long enough stretches around seeds."""
    if not len(seeds):
        return np.zeros((0, 3), np.int64)
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    s, q = seeds[:, 0], seeds[:, 1]
    text = np.searchsorted(bounds, s, "right") - 1
    new = np.ones(len(s), bool)
    if b == scale:  # blocks that touch continue one stretch
        new[1:] = (np.diff(q) != 0) | (np.diff(s) != scale) | (np.diff(text) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    t, q = text[first], q[first]
    left, right = _extend(code, s[first], s[last] + b, q, bounds[t], bounds[t + 1])
    out = np.stack([left, right + q, q], axis=1)
    return out[(out[:, 1] - out[:, 0]) >= np.maximum(least, repeats * q)]


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both, each stretch once and with its smallest period, by start and period."""
    both = np.concatenate([a, b])
    both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
    keep = np.ones(len(both), bool)
    keep[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
    both = both[keep]
    return both[np.lexsort((both[:, 2], both[:, 0]))]


# ------------------------------------------------------------------ texts


def planted(words: list[bytes], key: str) -> list[bytes]:
    """The words of a row as the contract of the query has them: a tenth of the keys repeat from some word on."""
    h = zlib.crc32(key.encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, the strongest run, the digests of all runs and of the words that are kept."""
    kept, best = words, (None,) * 4
    if len(runs):
        strong = min(runs.tolist(), key=lambda r: (-_exact(r), r[0], r[2]))
        length = strong[1] - strong[0]
        best = (strong[0], length, strong[2], 1000 * length // strong[2])
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 1], -1)
        gone = np.cumsum(drop) > 0
        kept = [w for w, g in zip(words, gone.tolist()) if not g]
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), kept)


def _exact(run: list[int]):
    from fractions import Fraction

    return Fraction(run[1] - run[0], run[2])


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FULL = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _scan(batches: Iterator[pa.RecordBatch], keep: list[str], rewrite: bool, full: bool, least: int, repeats: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in wh.blocks(batch.column("text")):
            raw, cuts = data.tobytes(), offsets.tolist()
            texts, codes, bounds, numbers = [], [], [0], 0
            keys = batch.column("key").slice(first, end - first).to_pylist() if rewrite else None
            base = 0
            for i in range(end - first):
                words = raw[cuts[i] : cuts[i + 1]].split()  # of bytes: at space, \t, \n, \v, \f, \r
                if rewrite:
                    words = planted(words, keys[i])
                texts.append(words)
                seen: dict[bytes, int] = {}
                codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
                base += len(seen)
                numbers = max(numbers, len(seen))
                bounds.append(bounds[-1] + len(words))
            code, bounds = np.concatenate(codes), np.array(bounds, np.int64)
            runs = find_runs(code, bounds, numbers, least, repeats)
            of = np.searchsorted(runs[:, 0], bounds)
            rows = []
            for i, words in enumerate(texts):
                own = runs[of[i] : of[i + 1]].copy()
                own[:, :2] -= bounds[i]
                rows.append((summary(words, own), own))
            columns = [pa.array([r[0][c] for r in rows], schema.field(len(keep) + c).type) for c in range(7)]
            if full:
                columns.append(pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in r[1].tolist()] for r in rows], schema.field(len(keep) + 7).type))
                columns.append(pa.array([b" ".join(r[0][7]).decode("utf-8", "replace") for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, end - first) for c in keep], *columns], schema=schema)


def detect(docs: DataFrame, *, text: str = "text", keep: list[str], key: str | None = None, full: bool = False, least: int = 24, repeats: int = 3) -> DataFrame:
    """``keep`` and, for each row: n_runs, the run with the greatest length / period, digests of all runs and of the
    words that stay when every run is cut to its first period.

    ``full`` adds the runs themselves and the collapsed text.  ``key`` names a
    column by which a tenth of the rows are rewritten first (:func:`planted`).

    Edge cases: null and empty texts, and texts without words, have no runs
    (four nulls) and an empty collapsed text; of equally strong runs the first,
    then the one of smaller period is named; repeated rows have equal results;
    an empty table gives an empty result; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wh.bound_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    names = [f"keep_{c}" for c in keep]
    rows = docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("text"),
        *([F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")] if key else []),
    )
    made = ", ".join([f"`keep_{c}` {kinds[c]}" for c in keep] + [DIGEST] + ([FULL] if full else []))
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], made).schema)
    out = rows.mapInArrow(lambda b: _scan(b, names, key is not None, full, least, repeats, schema), made)
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], *[F.col(c) for c in out.columns if c not in names])
