"""The corpus pipeline, stage by stage, against a brute-force version; SQL twins; the guard of the entry."""

import os
import subprocess
import sys
import textwrap

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import pytest
from awkward import ascii_words, documents, empty, white_words
from compare import compare, connect

import corpus_pipeline
from tidegauge.llm import queries

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    ok, message, _, _ = compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, message


def groups_of(texts):
    def shingles(t):
        w = white_words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j]) if min(len(sets[i]), len(sets[j])) * 5 >= 4 * max(len(sets[i]), len(sets[j])) else 0
            if sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(texts)
    near = corpus_pipeline.near_copies(spark, docs, SF)
    root = groups_of(texts)
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == {i for i in root if root[i] == i}
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ascii_words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = {i for i, t in texts.items() if windows & {tuple((w := ascii_words(t))[k : k + 10]) for k in range(len(ascii_words(t)) - 9)}}
    assert hit and {r["doc_id"] for r in clean.select("doc_id").collect()} == set(texts) - hit
    safe = corpus_pipeline.secret_scans(spark, docs, SF)
    assert safe.columns == docs.columns and dict(safe.dtypes) == dict(docs.dtypes)
    changed = {r["doc_id"]: r for r in safe.collect() if r["text"] != texts[r["doc_id"]]}
    assert set(texts) == {r["doc_id"] for r in safe.select("doc_id").collect()}
    assert all("<secret>" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed.values())
    last = corpus_pipeline.sentencepiece(spark, docs, SF)
    assert last.count() == len(texts) and all(r["n_pieces"] == len(r["ids"]) for r in last.collect())


def test_run_strings_the_stages_together(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(out) < len(texts) and len({r["doc_id"] for r in out}) == len(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "benchmark_decontamination", "secret_scans", "sentencepiece"]


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (documents(spark, extra=False).selectExpr("*", "cast(length(text) AS bigint) AS n_chars", "'x' AS score", "'y' AS digest"), empty(spark).selectExpr("*", "cast(1 AS bigint) AS n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert name == "sentencepiece" or out.columns == docs.columns
            assert len(rows) <= docs.count()
            if name == "near_copies" and rows:
                assert sum(r["doc_id"] == 6 for r in rows) == 1  # a repeated row stays once


def test_the_rest_stands_without_the_folder(tmp_path):
    """The entry module imports where the llm folder and the pipeline are gone."""
    import shutil

    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-B", "-c", textwrap.dedent(code)], cwd=tmp_path / "repo", check=True, timeout=120)
