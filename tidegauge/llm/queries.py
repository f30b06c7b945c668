"""The queries opN_<name> over the driver tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import context_tree, decontaminate, graph_ann, langid, lexical, licenses, ngram_join, packing, periodic, secrets, sentencepiece_codec, token_counts, twins, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_license_scans": twins.LICENSES,
    "op4_url_filters": twins.URLS,
    "op5_benchmark_decontamination": twins.DECONTAMINATION,
    "op8_ngram_jaccard_join": twins.NGRAM_JOIN,
    "op12_ranked_lexical_search": twins.LEXICAL_SEARCH,
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents"), text="text", owner="source", repo="doc_id", keep=["doc_id"])
    return secrets.digest(found, keep=["doc_id"])


@query
def op2_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf, "documents"), keep=["doc_id"]), keep=["doc_id"])


@query
def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), keep=["page_id"])


@query
def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows, found = decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.summary(rows, found).select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remainder(key: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


@query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs.filter(remainder("doc_id", 3) != 1), key="doc_id", text="text", lang="lang")
    out = langid.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    out = context_tree.score(table(spark, sf, "documents"), held_out=remainder("doc_id", 7) == 2)
    return out.withColumnRenamed("doc", "doc_id").drop("train_types")


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents"), size=4, percent=85).withColumnRenamed("doc", "doc_id")


@query
def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled pieces of every document, their digest, and whether decoding gives the text back."""
    rows = sentencepiece_codec.encode(table(spark, sf, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "lossless",
    )


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count(table(spark, sf, "documents"), keep=["doc_id"])


@query
def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op11_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents")).withColumnRenamed("doc", "doc_id")


@query
def op12_ranked_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.detect(table(spark, sf, "documents"), keep=["doc_id"], key="doc_id")
