"""The corpus pipeline: classify, filter, de-duplicate, mix and pack the documents of a data set.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnmap.llm import jaccard, mixing, packing, perplexity, repetition
from cairnmap.session import scratch_folder, ship_package


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under plain numbered names, which no operator uses, and the new name of each."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose perplexity is too high for their language go; so do texts without a word.

    A null language is a language of its own. Repeated rows and rows that repeat an id are judged by their own text, equal rows alike; a text whose
    perplexity equals the threshold stays. An empty table stays empty. Other columns pass through, whatever their names.
    """
    ship_package(spark)
    slim = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash"))
    judged = perplexity.classify_quality(slim, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "text_hash"])
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are too short or repeat themselves too much go; the verdict is reached where the row is read.

    Null and empty texts go. Rows are judged one by one, whole texts of any length, repeated rows alike. An empty table stays
    empty. Other columns pass through, whatever their names.
    """
    ship_package(spark)
    plain, names = _numbered(docs)
    whole = plain.withColumn("text", F.col(names["text"]))
    kept = repetition.measure_repetition(whole, list(names.values())).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates stays: that of the smallest doc_id.

    Texts without words are near nothing and stay, as do rows without an id whose text no row with an id has. Of rows that repeat the
    id that stays, all stay. An empty table stays empty. Other columns pass through, whatever their names.
    """
    ship_package(spark)
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, in training order; a text that is taken several times is several rows.

    A null source is a source, ranked last; rows that no copy is taken of go. Ties in the training time go by id. Repeated rows are rows like any
    other. With no word in any text nothing is taken. An empty table stays empty. Other columns pass through, whatever their names.
    """
    ship_package(spark)
    plain, names = _numbered(docs)
    mixed = mixing.mix_sources(plain, names["text"], names["source"], names["doc_id"])
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items()])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a text: its bin and its place there.

    A null or empty text is one piece of no words without a bin; a text longer than a bin is cut into pieces. Equal texts never
    share a bin, so repeated rows lie in bins of their own. An empty table gives an empty table; other columns are ignored.
    """
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

# Kneser-Ney smoothing and best-fit packing have no SQL form; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
