"""The registered queries of this folder, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnmap.llm import ann, codebooks, jaccard, language, licenses, mixing, onepermutation, packing, perplexity, repetition, resampling, toxicity, urls
from cairnmap.session import ship_package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fold(doc_id, folds: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


@_query("op1_license_scan", licenses.oracle())
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query("op2_language")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = _fold(F.col("doc_id"), 5) == 0
    model = language.train(docs.filter(~held))
    return language.identify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])


@_query("op3_quality_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.classify_quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"), ["doc_id"])


@_query("op4_quality_rules", repetition.ORACLE)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.measure_repetition(_table(spark, sf, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op5_jaccard_join", jaccard.ORACLE)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf, "documents"))


@_query("op6_mixing", mixing.ORACLE)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf, "documents"))


@_query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(_table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


@_query("op8_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_near_copies(_table(spark, sf, "documents"))


@_query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "labels")
    held = _fold(F.col("doc_id"), 3) == 1
    known = labels.filter(~held & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the bounded training sample is drawn from the labels, so only its texts are moved
    drawn = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxicity.TRAINING_ROWS) for y in (0, 1)]
    model = toxicity.train(docs.filter(~held).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id"), "toxic")
    return toxicity.score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", "predicted")


@_query("op10_url_filter", urls.oracle())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@_query("op11_resampling", resampling.ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@_query("op12_vector_codes", codebooks.oracle())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return codebooks.code_report(_table(spark, sf, "embeddings"))


@_query("op13_fingerprints")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return onepermutation.fingerprint_documents(_table(spark, sf, "documents"))
