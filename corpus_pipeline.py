"""The corpus pipeline: language, near copies, benchmark passages, secrets, pieces.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``docs``.  Sets of documents
that a stage takes out are written first, so that Spark joins them by their
measured size: broadcast while they are small, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, langid, ngram_join, secrets, sentencepiece_codec
from tidegauge.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, and those of which the calibrated model is unsure, go."""
    model = langid.train(docs, key="doc_id", text="text", lang="lang")
    return langid.accepted(docs, model, text="text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays.

    Documents without words, and those without an id, link with nothing here and
    stay; a repeated row stays once.
    """
    groups = materialize(ngram_join.join(docs, size=5, percent=80), "near-groups")
    gone = groups.filter("doc <> component_id").select(F.col("doc").alias("doc_id")).distinct()
    out = docs.join(materialize(gone, "near-copies"), "doc_id", "left_anti").select(docs.columns)
    repeated = materialize(groups.groupBy(F.col("doc").alias("doc_id")).count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.limit(1).count():
        one = out.join(repeated, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")))
        out = out.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one.filter("__nth = 1").select(docs.columns))
    return out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    _, found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = materialize(found.select(F.col("doc").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["hit_digest"])
    return docs.join(hit, same, "left_anti").select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look alive and belong to few owners are replaced; every document stays."""
    out = secrets.redact(docs, text="text", owner="source", repo="doc_id")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, beside what else is known of it; they take the place of columns of their names."""
    out = sentencepiece_codec.encode(docs, text="text", key="doc_id", keep=[c for c in docs.columns if c not in ("text", "ids", "lossless", "n_pieces")])
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]
#: A trained model, links and random draws: SQL cannot say it; tests/llm holds it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
