"""Best-fit packing, ranked lexical search and periodic runs."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pyarrow as pa
import pytest
from awkward import PASSAGE, TEXTS, ascii_words, documents, empty
from pyspark.sql import functions as F

from tidegauge.llm import byte_pairs, lexical, packing, periodic
from tidegauge.llm import wordhash as wh
from tidegauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ op11


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.Encoder(packing._default_path())


def test_ids_of_blocks_are_the_tokenizers(coder):
    rng = random.Random(0)
    letters = list("ab'sSt .,;|1 9\n\t\r  　 é日本\u0085​ñ😀-_×÷") + ["<|endoftext|>", "  ", "\n\n", " the", "'ll", "don't", "\x1c", "\x0b", " ", "́"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [t for t in TEXTS if t is not None]
    for first, end, data, offsets in wh.blocks(pa.array(texts), 1 << 14):
        ids, bounds = coder.block(data, offsets)
        for i in range(first, end):
            assert ids[bounds[i - first] : bounds[i - first + 1]].tolist() == coder.tokenizer.encode(texts[i], add_special_tokens=False).ids, texts[i]


def check_packing(rows, texts, coder, capacity=1024):
    """Every document's ids in order, no sequence too long, no gap; returns the number of sequences."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for key, several in texts.items():
        want = Counter()
        for text in several:
            ids = np.array([*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            rest = len(ids) % capacity
            edges = [*([0] if rest else []), *range(rest, len(ids) + 1, capacity)]
            assert len(edges) - 1 == -(-len(ids) // capacity)
            want.update((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs[key]) == want
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(bins)


def test_packed_pieces_of_the_whole_table(spark, coder):
    got = QUERIES["op11_best_fit_packing"](spark, SF).collect()
    texts = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"])
    n = check_packing(got, texts, coder)
    total = sum(r["length"] for r in got)
    assert n <= math.ceil(total / 1024) * 1.01 + 1


def test_packing_of_awkward_rows(spark, coder):
    docs = documents(spark)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packing(packing.pack(docs).withColumnRenamed("doc", "doc_id").collect(), texts, coder)
    small = packing.Search(islands=2, epochs=2, generations=2)
    check_packing(packing.pack(docs, capacity=64, search=small).withColumnRenamed("doc", "doc_id").collect(), texts, coder, 64)
    assert packing.pack(empty(spark)).count() == 0


def lengths(seed, n, low, high):
    x, c = np.unique(np.random.default_rng(seed).integers(low, high, n), return_counts=True)
    return Counter(dict(zip(x.tolist(), c.tolist())))


@pytest.mark.parametrize("low, high", [(1, 12), (5, 60), (200, 700), (260, 520), (1000, 1024)])
def test_operators_of_the_search_keep_every_piece(low, high):
    rng = np.random.default_rng(0)
    demand = lengths(low, 800, low, high)
    whole = lambda p: packing.demand_of(p) == demand and all(0 < packing.used(f) <= 1024 and n > 0 for f, n in p.items())
    a, b = packing.place({}, demand, 1024), packing.place({}, demand, 1024, rng, 3)
    for _ in range(5):
        c = packing.crossover(a, b, demand, 1024, rng)
        m = packing.mutate(c, 1024, rng)
        assert whole(a) and whole(b) and whole(c) and whole(m)
        a, b = c, m
    best = packing.evolve([a, b], demand, 1024, rng, 3, 4)
    assert whole(best[0]) and packing.sequences(best[0]) <= min(map(packing.sequences, (a, b)))


def test_crossover_injects_whole_well_filled_sequences():
    demand = Counter({600: 2, 424: 2, 512: 2})
    a = {((600, 1),): 2, ((512, 1), (424, 1)): 2}
    b = {((600, 1), (424, 1)): 2, ((512, 2),): 1}
    seen = {packing.sequences(packing.crossover(a, b, demand, 1024, np.random.default_rng(s))) for s in range(20)}
    assert min(seen) == 3


def test_islands_reach_known_optima_and_repeat(spark):
    """Pieces cut from full sequences: the optimum is the number of sequences."""
    rng = np.random.default_rng(5)
    demand = Counter()
    for _ in range(300):
        cut = np.sort(rng.integers(1, 1024, 3))
        demand.update(int(x) for x in np.diff([0, *cut, 1024]) if x)
    got = packing.pack_lengths(spark, demand, 1024)
    assert packing.demand_of(got) == demand and packing.sequences(got) <= 303
    assert packing.pack_lengths(spark, demand, 1024) == got
    many = packing.pack_lengths(spark, {k: v * 10**7 for k, v in demand.items()}, 1024)
    assert packing.sequences(many) <= 303 * 10**7 and len(many) < 3000
    assert packing.pack_lengths(spark, {}, 1024) == {}
    with pytest.raises(ValueError):
        packing.pack_lengths(spark, {2000: 1}, 1024)


# ------------------------------------------------------------------ op12


def brute_search(docs, items, k=10):
    words = [(d, ascii_words(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for d, w in words:
            tf = Counter(w)
            score = 0
            for t in set(ascii_words(text)):
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (10**9 * tf[t] // (1000 * tf[t] + 8 * (10 + 90 * len(w) * n_docs // total)))
            if score > 0:
                found.append((-score, d is not None, d, score))
        found.sort(key=lambda r: r[:3] if r[1] else (r[0], False))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(found[:k])]
    return sorted(out, key=repr)


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("digest", F.lit("x")).withColumn("terms", F.lit(1))


@pytest.mark.parametrize("block", [3, lexical.BLOCK])
def test_search_of_awkward_rows(spark, block):
    docs = documents(spark)
    items = [(0, PASSAGE), (1, None), (2, ""), (3, "never said by anybodyy"), (4, "word"), (5, "MIT license é 日本語 free"), (None, "one two three fox"), (6, "fox fox fox FOX"), (7, "zzzz")]
    got = lexical.search(docs, item_table(spark, [*items, items[0]]), block=block)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted([(r["item"], r["rank"], r["doc"], r["score"]) for r in got.collect()], key=repr) == brute_search(rows, items)
    assert dict(got.dtypes) == {"item": "bigint", "rank": "int", "doc": "bigint", "score": "bigint"}


def test_search_of_empty_tables_and_small_k(spark):
    docs, items = documents(spark), item_table(spark, [(0, PASSAGE)])
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert [r["rank"] for r in lexical.search(docs, items, k=2).sort("rank").collect()] == [1, 2]


def test_tables_are_filled_a_part_at_a_time(monkeypatch):
    """Small score tables and sums beyond a double's integers give the same scores."""
    rng = np.random.default_rng(1)
    hashes = [np.unique(rng.integers(0, 40, 12).astype(np.uint64) << np.uint64(50)) for _ in range(30)]
    index = lexical.Index(hashes)
    index.weigh(rng.integers(1, 50, len(index.terms)), 50)
    words = rng.integers(0, 60, 900).astype(np.uint64) << np.uint64(50)
    bounds = np.sort(np.concatenate([[0, 900], rng.integers(0, 900, 20)]))
    doc, term, tf = index.found(words, bounds)
    m = lexical.lengths(np.diff(bounds), 20, 900)[doc]
    want = sorted(zip(*[np.concatenate(x).tolist() for x in zip(*lexical.scores(index, doc, term, tf, m))]))
    for name, value in (("CELLS", 16), ("EXACT", 0)):
        monkeypatch.setattr(lexical, name, value)
        assert sorted(zip(*[np.concatenate(x).tolist() for x in zip(*lexical.scores(index, doc, term, tf, m))])) == want
    assert lexical.lengths(np.array([10**9]), 10**11, 10**12).tolist() == [10 + 90 * 10**9 * 10**11 // 10**12]


# ------------------------------------------------------------------ op13


def brute_runs(w, least=24):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, n, w = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 5, 23, 24, 30, 60, 150, 400, 700]), []
    while len(w) < n:
        r = rng.random()
        if r < 0.4:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        elif r < 0.8:
            u = [rng.randrange(k) for _ in range(rng.randrange(1, rng.choice([3, 10, 60])))]
            w += u * rng.randrange(1, 8) + u[: rng.randrange(len(u) + 1)]
        elif w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(1, 80)]
    return w[:n]


@pytest.mark.parametrize("block", [8, 16, periodic.BLOCK])
def test_runs_equal_brute_force(block):
    rng = random.Random(block)
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        code, bounds, base, most = [], [0], 0, 0
        for w in texts:
            seen = {}
            code += [seen.setdefault(x, len(seen)) + base for x in w]
            base, most = base + len(seen), max(most, len(seen))
            bounds.append(len(code))
        got = periodic.find_runs(np.array(code, np.int64), np.array(bounds, np.int64), most, block=block)
        assert [tuple(r) for r in got.tolist()] == [(s + b, e + b, q) for w, b in zip(texts, bounds) for s, e, q in brute_runs(w)]


def test_runs_of_long_texts():
    one = periodic.find_runs(np.zeros(60_000, np.int64), np.array([0, 60_000]), 1)
    assert one.tolist() == [[0, 60_000, 1]]
    part = np.random.default_rng(0).integers(0, 30_000, 9_000)
    code = np.concatenate([part, part, part, part[:5]])
    assert periodic.find_runs(code, np.array([0, len(code)]), 30_000).tolist() == [[0, len(code), 9_000]]


@pytest.mark.parametrize("numbers, primes", [(50, 1), (10**6, 2), (10**12, 3)])
def test_sums_of_squared_differences_are_exact(numbers, primes):
    assert len(periodic.primes_for(16, numbers)) == primes
    for prime, generator in periodic.PRIMES:
        assert pow(generator, (prime - 1) // 2, prime) == prime - 1
        assert all(pow(generator, (prime - 1) // (1 << b), prime) != 1 for b in range(1, 24))
    rng = np.random.default_rng(primes)
    windows = rng.integers(0, 2, (40, 32)) * np.int64(numbers - 1)
    blocks = windows[:, 5:21].copy()
    blocks[20:] = rng.integers(0, 2, (20, 16)) * np.int64(numbers - 1)
    got = periodic.zero_mismatches(blocks.astype(np.uint64), windows.astype(np.uint64), numbers)
    want = np.array([[(blocks[i] == windows[i, d : d + 16]).all() for d in range(16)] for i in range(40)])
    assert (got == want).all() and got[:20, 5].all()


def brute_row(key, text):
    """The contract, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if key is None else str(key)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (key, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_rows_equal_brute_force(spark):
    got = QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    short = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 1500]
    assert len(short) > 150
    for r in short:
        assert rows[r["doc_id"]] == brute_row(r["doc_id"], r["text"])
    assert any(r[1] for r in rows.values())


def test_periodic_runs_of_awkward_rows(spark):
    line = "a b c d e f g h "
    more = [line * 3, line * 2 + "a b c d e f g x", "x y " * 12, "x y " * 11 + "x", "A a " * 12, "é ß " * 30, "\t\n" + "q\x0b" * 24, (line + "z ") * 400]
    docs = documents(spark, [t for t in TEXTS if len(t or "") < 2_000] + more)
    got = periodic.detect(docs, keep=["doc_id"], key="doc_id").collect()
    want = [brute_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = periodic.detect(docs.filter(F.col("text") == line * 3), keep=["doc_id"], full=True).first()
    assert [tuple(r) for r in full["runs"]] == [(0, 24, 8)] and full["collapsed"] == line.strip()
    long = documents(spark, ["word " * 30_000, "l" * 50_000])
    assert {r["n_runs"] for r in periodic.detect(long.filter("doc_id is not null"), keep=["doc_id"]).collect()} == {0, 1}
    assert periodic.detect(empty(spark), keep=["doc_id"]).count() == 0
