"""Benchmark decontamination, n-gram join, components and nearest neighbours."""

import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pytest
from awkward import PASSAGE, ascii_words, documents, empty, white_words
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, graph_ann, ngram_join
from tidegauge.llm.components import components


def items(spark):
    rows = [(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (5, "x"), (6, " ".join(PASSAGE.split()[5:20])), (6, " ".join(PASSAGE.split()[5:20])), (None, "word word word word word word word word word word word")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS size", "2 AS wid")


@pytest.mark.parametrize("block", [4_000_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    docs = documents(spark)
    windows = {}
    for r in items(spark).collect():
        w = ascii_words(r["text"])
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(r["item_id"])
    sizes = {len(k) for k in windows}
    rows, found = decontaminate.find(docs, items(spark), block=block)
    got = {(r["doc"], r["digest"]): r for r in decontaminate.summary(rows, found).collect()}
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d"), "text").collect()
    assert decontaminate.summary(rows, found).count() == len(texts)
    for t in texts:
        w, hit, ids = ascii_words(t["text"]), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[k]
        r = got[(t["doc_id"], t["d"])]
        want = sorted(str(i) for i in ids if i is not None)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), want), t["text"]
        assert hashlib.sha256(",".join(want).encode()).hexdigest()


def test_decontamination_of_empty_tables(spark):
    for d, i in ((empty(spark), items(spark)), (documents(spark), items(spark).limit(0))):
        rows, found = decontaminate.find(d, i)
        assert found.count() == 0 and decontaminate.summary(rows, found).filter("n_hit > 0").count() == 0


def brute_components(texts, size, percent):
    def shingles(t):
        w = white_words(t)
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def chained(rng):
    """Groups of near copies with few and many edits, chains, hub groups and a passage that half of all texts share."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(30)]
    texts = []
    for g in range(6):
        base = [word() for _ in range(rng.randint(40, 90))]
        now = list(base)
        for c in range(9):
            copy = list(base if g % 2 else now)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            now = copy
            texts.append(" ".join(copy + (shared if c % 2 else [])))
    return texts + [" ".join(shared), " ".join(shared), None, "", "a b", "a b", "A  B"]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80), (3, 3, 60)])
def test_ngram_join_matches_brute_force(spark, seed, size, percent):
    texts = chained(random.Random(seed))
    sets, want = brute_components(texts, size, percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n", "'k' AS key", "2 AS root", "3 AS gram").repartition(5)
    got = {r["doc"]: r for r in ngram_join.join(docs, size=size, percent=percent).collect()}
    assert len(set(want)) < len(want)
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(s), want[i])


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_links_short_texts(spark, size, percent):
    texts = []
    for seed in range(30):
        rng = random.Random(seed)
        for n in range(8, 21):
            words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n + 1)]
            texts += [" ".join(words[:n]), " ".join(words)]
    _, want = brute_components(texts, size, percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc"]: r["component_id"] for r in ngram_join.join(docs, size=size, percent=percent).collect()}
    assert sum(w != i for i, w in enumerate(want)) >= 300
    assert [got[i] for i in range(len(texts))] == want


def test_ngram_join_of_awkward_and_empty_tables(spark):
    docs = documents(spark)
    got = ngram_join.join(docs).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc"], set()).add(r["component_id"])
    assert by_id[6] == by_id[7] == {6} and by_id[0] == {0} and by_id[1] == {1} and by_id[None] == {6}
    assert ngram_join.join(empty(spark)).count() == 0


def test_every_ngram_lies_in_one_range():
    h = np.array([0, 1, 1 << 40, (1 << 64) - 1, 1 << 63], np.uint64)
    for parts in (1, 3, 7, 211):
        got = ngram_join.part_of(h, parts, 1.0)
        assert got.min() >= 0 and got.max() == parts - 1 and got[0] == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (20, 21), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and got[21] == 20 and got[140] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        score = sorted((-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = score[:k]
    return out


def test_nearest_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(12)] + [(200, [2.0, 4.0, 6.0, 8.0]), (300, [1.0, 0.0]), (301, [0.0, 1.0]), (302, [1.0, 1.0])]
    bad = [(400, None), (401, [0.0, 0.0, 0.0, 0.0]), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan"), 1.0, 1.0, 1.0]), (404, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad + good[:3], "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'v' AS vector", "2 AS shard", "3 AS rank").repartition(4)
    asked = {0, 7, 100, 105, 200, 300, 401}
    got = {}
    for r in graph_ann.nearest(df, F.col("vec_id").isin(asked), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest([(i, np.array(v)) for i, v in good], [(i, np.array(v)) for i, v in good if i in asked], 5)
    assert set(got) == set(want)
    for q, w in want.items():
        assert [g[0] for g in sorted(got[q])] == list(range(1, len(w) + 1))
        assert np.allclose([g[2] for g in sorted(got[q])], [-s for s, _ in w], atol=1e-12)
    assert [g[1] for g in sorted(got[105])] == [100, 101, 102, 103, 104] and len(got[300]) == 2
    assert graph_ann.nearest(df.limit(0), F.col("vec_id") == 1).count() == 0


def test_nearest_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 10 == 0], 5)
    got = {}
    for r in graph_ann.nearest(table, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(got[q] & {i for _, i in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-1, 0]], np.float32)
    kept = graph_ann.prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 0]]), 4, 1.2)[0]
    assert set(kept[kept >= 0]) == {1, 3, 4}
