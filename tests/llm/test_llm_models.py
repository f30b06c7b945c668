"""Language identification, language-model scores, sampled pieces and token counts."""

import itertools
import math
import os
import sys
import zlib
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pyarrow as pa
import pytest
from awkward import TEXTS, documents, empty, white_words
from pyspark.sql import functions as F

from tidegauge.llm import context_tree, langid, pieces, sentencepiece_codec, token_counts
from tidegauge.llm import wordhash as wh
from tidegauge.llm.queries import QUERIES, remainder

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_rule_of_the_split(spark):
    got = QUERIES["op6_language_id"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    model = langid.train(docs, key="doc_id", text="text", lang="lang")
    assert model.labels == ["en", "fr"]
    got = langid.predict(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["score"] == 0 and r["rejected"]))
    # the same rows in other partitions get the same answer
    again = {(r["doc_id"], r["text"]): r["score"] for r in langid.predict(docs.repartition(7), model, keep=["doc_id", "text"]).collect()}
    assert all(again[(r["doc_id"], r["text"])] == r["score"] for r in got)
    assert langid.predict(empty(spark), model, keep=["doc_id"]).count() == 0
    nothing = langid.train(empty(spark), key="doc_id", text="text", lang="lang")
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, keep=["doc_id"]).collect()} == {"und"}


def brute_tree(texts, text):
    """The definition, without any sharing: log10 probability of ``text`` and its end after training on ``texts``."""
    depth = context_tree.DEPTH

    def steps(t):
        b = b"\n" * depth + t.lower().encode() + b"\0"
        for i in range(depth, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                yield node, [b[i - d : i] for d in range(depth + 1)], bit
                node = 2 * node + bit

    counts, children = {}, {}
    for t in texts:
        for node, contexts, bit in steps(t):
            for d, c in enumerate(contexts):
                counts.setdefault((node, c), [0, 0])[bit] += 1
                if d:
                    children.setdefault((node, contexts[d - 1]), set()).add((node, c))

    def own(key):
        a, b = counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key, d):
        if d == depth:
            return own(key)
        x, y = own(key), sum(weighted(k, d + 1) for k in children.get(key, ()))
        return math.log(0.5) + max(x, y) + math.log1p(math.exp(-abs(x - y)))

    total = 0.0
    for node, contexts, bit in steps(text):
        p = None
        for d in range(depth, -1, -1):
            a, b = counts.get((node, contexts[d]), (0, 0))
            kt = ((b if bit else a) + 0.5) / (a + b + 1)
            w = 1.0 if d == depth else 0.5 * math.exp(own((node, contexts[d])) - weighted((node, contexts[d]), d))
            p = kt if d == depth else w * kt + (1 - w) * p
        total += math.log10(p)
    return total


def test_scores_match_the_definition(spark):
    texts = ["abracadabra", "abba", "", "cab é", "Abracadabra"]
    unseen = ["abrac", "zzz", "éé", "", "bca"]
    rows = [(i, t, i >= len(texts)) for i, t in enumerate(texts + unseen)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").selectExpr("*", "1 AS run", "2 AS place", "3 AS part")
    got = {r["doc"]: r for r in context_tree.score(df, held_out=F.col("h")).collect()}
    for i, t, _ in rows:
        assert got[i]["score"] == pytest.approx(brute_tree(texts, t), rel=1e-5), t


def test_scores_in_several_slices_are_the_same(spark, monkeypatch):
    assert context_tree.DEPTH >= 4
    docs = documents(spark)
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    one = {(r["doc"], r["n_tokens"]): r["score"] for r in context_tree.score(docs, held_out=held).collect()}
    monkeypatch.setattr(context_tree, "SLICE", 500)
    several = context_tree.score(docs, held_out=held).collect()
    assert len(several) == docs.count() and all(one[r["doc"], r["n_tokens"]] == pytest.approx(r["score"], rel=1e-6) for r in several)


def test_subtrees_do_not_depend_on_the_cuts(monkeypatch):
    data = np.frombuffer(b"the cat sat on the mat and the rat sat on the hat" * 3, np.uint8)
    code, n = context_tree._sum_up([c := context_tree.strings(data, np.array([0, 20, 20, len(data)]))[0]], [np.ones(len(c))])
    batch = pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])
    found = []
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(context_tree, "CHUNK", chunk)
        trees = list(context_tree._whole(batch.slice(i, 5) for i in range(0, len(code), 5)))
        sums = np.zeros((3, 1 << 16))
        for tree in trees:
            tree.above(sums)
        top = context_tree.mix_top(sums)
        found.append(np.concatenate([tree.log10(top) for tree in trees]))
        assert sum(len(tree.code[context_tree.DEPTH]) for tree in trees) == len(code)
    assert np.allclose(found[0], found[2]) and np.allclose(found[1], found[2])


def test_probabilities_of_all_bytes_sum_to_one():
    context = np.frombuffer(b"nabab", np.uint8)
    ends = np.array([int.from_bytes(bytes(context[:: -1][: context_tree.DEPTH]) + bytes([b]), "big") for b in range(256)], np.uint64)
    tree = context_tree.Subtrees(ends, np.where(np.arange(256) % 50 == 7, 5, 0))
    sums = np.zeros((3, 1 << 16))
    tree.above(sums)
    assert (10 ** tree.log10(context_tree.mix_top(sums))).sum() == pytest.approx(1)


def test_base_scores_match_brute_force(spark):
    docs = documents(spark)
    held = remainder("doc_id", 7) == 2
    out = context_tree.score(docs.withColumn("text_", F.col("text")), held_out=held)
    got = out.collect()
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("h")).collect()
    tokens = [[*white_words(r["text"]), None] for r in rows]
    c = Counter(w for r, t in zip(rows, tokens, strict=True) if not r["h"] for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(r["doc_id"]), r["h"], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for r, t in zip(rows, tokens, strict=True))
    assert sorted((repr(r["doc"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want


def test_scores_without_training_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc"]: r for r in context_tree.score(docs, held_out=F.lit(True)).collect()}
    assert got[1]["base_score"] == 0 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert got[1]["score"] == pytest.approx(4 * 8 * math.log10(0.5), rel=1e-5)
    assert context_tree.score(empty(spark), held_out=F.lit(False)).count() == 0


def small_pieces():
    strings = [None, "a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "é", "bab"]
    return pieces.Pieces(strings + [None] * 256, {b: len(strings) + b for b in range(256)})


def segmentations(p, word):
    """All paths of a word's lattice as (ids, log probability)."""
    own = {b: i for i, b in enumerate(p.bytes) if b and i < 11}
    spelled = [False] * len(word)
    at = 0
    for ch in word.decode():
        size = len(ch.encode())
        if word[at : at + size] not in own:
            spelled[at : at + size] = [True] * size
        at += size
    paths = {0: [((), 0.0)]}
    for end in range(1, len(word) + 1):
        paths[end] = []
        for start in range(end):
            i = own.get(word[start:end])
            if i is None and end - start == 1 and spelled[start]:
                i = int(p.byte_id[word[start]])
            if i is not None:
                paths[end] += [((*ids, i), lp + p.logp[i]) for ids, lp in paths[start]]
    return paths[len(word)]


WORDS = [b"a", b"abab", b" abab", b"babab", "aéb".encode(), "b▁a".encode(), b"   ab", b"zz", b"abababab"]


def test_trie_counts_match_all_segmentations():
    p = small_pieces()
    for words in (WORDS, [w for n in (1, 2, 3, 4, 5) for w in map(bytes, itertools.product(b"ab", repeat=n))]):
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        for part, rows, n in pieces.by_length(data, starts, np.arange(len(words))):
            for i, got in zip(part, token_counts.trie_counts(p, rows, n), strict=True):
                best = max(segmentations(p, words[i]), key=lambda s: (round(s[1], 9), -len(s[0])))
                assert got == len(best[0]), words[i]


def test_samples_follow_the_lattice():
    p, n = small_pieces(), 20_000
    for word in (b" abab", "aéb▁".encode(), b"abababab"):
        ways = segmentations(p, word)
        weight = np.exp(np.array([lp for _, lp in ways]))
        want = dict(zip([ids for ids, _ in ways], weight / weight.sum(), strict=True))
        data = np.frombuffer(word * n, np.uint8)
        offsets = np.arange(n + 1) * len(word)
        ids, counts = sentencepiece_codec.sample_block(p, data, offsets, wh.mix(np.arange(n).astype(np.uint64)), 1.0)
        ends = np.concatenate([[0], np.cumsum(counts)])
        seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(ends))
        assert set(seen) <= set(want)
        for ids_, share in want.items():
            assert abs(seen[ids_] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3


def test_round_trip_and_reproducible_samples(spark):
    docs = documents(spark)
    vocabulary = pieces.load()
    rows = sentencepiece_codec.encode(docs, keep=["doc_id", "text"], pieces=vocabulary)
    assert rows.filter("NOT lossless").count() == 0
    back = sentencepiece_codec.decode(rows, keep=["doc_id", "text", "ids"], pieces=vocabulary).collect()
    assert len(back) == docs.count()
    for r in back:
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    again = {(r["doc_id"], r["text"]): r["ids"] for r in sentencepiece_codec.encode(docs.repartition(8), keep=["doc_id", "text"], pieces=vocabulary).collect()}
    assert all(again[(r["doc_id"], r["text"])] == r["ids"] for r in back)
    other = {(r["doc_id"], r["text"]): r["ids"] for r in sentencepiece_codec.encode(docs, keep=["doc_id", "text"], pieces=vocabulary, seed=1).collect()}
    assert any(other[k] != again[k] for k in again)
    assert sentencepiece_codec.encode(empty(spark), keep=["doc_id"]).count() == 0


def test_token_counts_of_awkward_rows(spark):
    docs = documents(spark)
    got = token_counts.count(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count() and token_counts.count(empty(spark), keep=["doc_id"]).count() == 0
    by_text = {r["text"]: r["n_tokens"] for r in got}
    assert by_text[None] == by_text[""] == 0 and by_text["x"] == 1 and by_text["l" * 50_000] > 3_000
    # no text of pieces can have fewer tokens than the longest piece allows, nor more than bytes
    assert all(r["n_tokens"] <= len(r["text"].encode()) + 1 for r in got if r["text"])
    assert len(TEXTS) == 22
