"""Keyed permutations of 0 .. n-1 by arithmetic, for moving rows without sorting them once per permutation.

A number is written as (left, right) with left below ``a`` and right below ``b``,
where a times b is n or a little more.  Four rounds add a mix of one half to the
other (a Feistel network over two moduli), each of them one-to-one.  The few
results from n on walk on through the network until they fall below n; where
each of them ends is worked out beforehand, so a row needs one pass.

Every step is integer arithmetic below 2^63 (n up to 2^60), the same in any SQL
engine: :func:`scramble_sql` says it for the twins.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: Widths tried for the left half; the numbers beyond n are then far fewer than sqrt(n).
TRIED = 1024
_M1, _M2, _WORD = 747796405, 668265263, 1 << 32


@lru_cache(maxsize=256)
def domain(n: int) -> tuple[int, int]:
    """(a, b) with a b >= n and the least excess, of ``TRIED`` widths from sqrt(n) on."""
    root = math.isqrt(max(n - 1, 0)) + 1
    return min(((a, -(-n // a)) for a in range(root, root + TRIED)), key=lambda p: (p[0] * p[1] - n, p[0]))


def round_keys(seed: int, number: int) -> list[int]:
    """A 32-bit key for each round of permutation ``number``."""
    digest = hashlib.md5(f"{seed}|{number}".encode()).hexdigest()
    return [int(digest[8 * r : 8 * r + 8], 16) for r in range(ROUNDS)]


def _mix(v: int, key: int) -> int:
    t = (v * _M1 + key) % _WORD
    t ^= t >> 16
    t = t * _M2 % _WORD
    return t ^ (t >> 15)


def scramble_int(i: int, n: int, seed: int, number: int) -> int:
    """Where permutation ``number`` puts i: the definition."""
    (a, b), keys = domain(n), round_keys(seed, number)
    while True:
        left, right = i % a, i // a
        for r, key in enumerate(keys):
            if r % 2 == 0:
                left = (left + _mix(right, key)) % a
            else:
                right = (right + _mix(left, key)) % b
        i = left + right * a
        if i < n:
            return i


def beyond(n: int, seed: int, number: int) -> list[int]:
    """Where the numbers from n to a b - 1 end."""
    a, b = domain(n)
    return [scramble_int(i, n, seed, number) for i in range(n, a * b)]


def scramble(name: str, n: int, seed: int, number: int) -> Column:
    """:func:`scramble_int` of a BIGINT column with values from 0 to n - 1; each step is named, so nothing is computed twice."""
    a, b = domain(n)
    low = f"{_WORD - 1}L"
    rounds = ", ".join(f"struct({key}L AS k, {str(r % 2 == 0).lower()} AS even)" for r, key in enumerate(round_keys(seed, number)))
    first = f"(if(p.even, s.r, s.l) * {_M1}L + p.k) & {low}"
    second = f"transform(array({first}), t -> ((t ^ shiftright(t, 16)) * {_M2}L) & {low})[0]"
    add = "(u ^ shiftright(u, 15))"
    step = f"transform(array({second}), u -> struct(if(p.even, (s.l + {add}) % {a}L, s.l) AS l, if(p.even, s.r, (s.r + {add}) % {b}L) AS r))[0]"
    start = f"struct(`{name}` % {a}L AS l, `{name}` div {a}L AS r)"
    out = F.expr(f"aggregate(array({rounds}), {start}, (s, p) -> {step}, s -> s.l + s.r * {a}L)")
    ends = beyond(n, seed, number)
    if not ends:
        return out
    place = F.array(*[F.lit(e).cast("bigint") for e in ends])
    return F.transform(F.array(out), lambda x: F.when(x < n, x).otherwise(F.get(place, (x - n).cast("int"))))[0]


def scramble_sql(source: str, seed: int, numbers: int, walks: int = 2) -> str:
    """A chain of DuckDB subqueries: (number, i, x) for the first ``numbers`` permutations of ``source``'s column i (0 .. n - 1).

    Numbers beyond n walk on ``walks`` times at most.
    """
    low = _WORD - 1
    keys = ", ".join(f"({k}, {', '.join(map(str, round_keys(seed, k)))})" for k in range(numbers))
    out = f"""SELECT number, i, i AS x, n, a, (n + a - 1) // a AS b, k0, k1, k2, k3, 0 AS l, 0 AS r, 0 AS t FROM {source},
 (SELECT n, arg_min(a, ROW(((n + a - 1) // a) * a - n, a)) AS a FROM (SELECT n, unnest(range(root, root + {TRIED})) AS a FROM
   (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS root FROM {source})) GROUP BY n), (VALUES {keys}) AS keys(number, k0, k1, k2, k3)"""
    for walk in range(walks):
        on = "true" if walk == 0 else "x >= n"
        out = f"SELECT * REPLACE (x % a AS l, x // a AS r) FROM ({out})"
        for r in range(ROUNDS):
            side = "r" if r % 2 == 0 else "l"
            out = f"SELECT * REPLACE (({side} * {_M1} + k{r}) & {low} AS t) FROM ({out})"
            out = f"SELECT * REPLACE ((xor(t, t >> 16) * {_M2}) & {low} AS t) FROM ({out})"
            new = "(l + xor(t, t >> 15)) % a AS l" if r % 2 == 0 else "(r + xor(t, t >> 15)) % b AS r"
            out = f"SELECT * REPLACE ({new}) FROM ({out})"
        out = f"SELECT * REPLACE (CASE WHEN {on} THEN l + r * a ELSE x END AS x) FROM ({out})"
    return f"SELECT number, i, x FROM ({out})"
