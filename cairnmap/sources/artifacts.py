"""Attached files: content addresses, links to items, text of files."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairnmap.functions import text as X

FILE = "file_path"


def read_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Content of all files under the folders, with the path relative to its folder."""
    found = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        absolute = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/+", "/")
        prefix = root.rstrip("/") + "/"
        part = files.select(
            absolute.alias("path"),
            F.when(absolute.startswith(prefix), F.substring(absolute, len(prefix) + 1, 1 << 30)).alias("relative"),
            "content",
        )
        found = part if found is None else found.unionByName(part)
    return found


def _plain(path: Column) -> Column:
    """Path without ``./`` parts and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"(^|/)(\./)+", "$1"), r"/{2,}", "/")


def fingerprints(files: DataFrame) -> DataFrame:
    """Replace the bytes by their address and size while scanning, so they never reach a shuffle."""
    return files.select(
        "path", "relative", F.sha2("content", 256).alias("artifact_id"), F.length("content").cast("long").alias("bytes")
    )


def attach(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that name a file, with the address of its content; a name that matches nothing fails the job.

    Names are absolute or relative to the folder of the files.
    """
    known = fingerprints(files)
    named = rows.filter(F.coalesce(FILE, F.lit("")) != "").withColumn("_path", _plain(F.col(FILE)))
    names = F.array_distinct(F.array_compact(F.array(_plain(F.col("path")), _plain(F.col("relative")))))
    keys = known.select(F.explode(names).alias("_key"), "path", "artifact_id", "bytes")
    missing = F.concat(
        F.lit("row "), F.col("source_row_number").cast("string"), F.lit(": file '"), F.col(FILE), F.lit("' not found")
    )
    joined = named.join(keys, named["_path"] == keys["_key"], "left")
    return joined.select(
        F.col("row_id").alias("item_id"), "source_row_number",
        F.when(F.col("path").isNull(), F.raise_error(missing)).otherwise(F.col("path")).alias("original_path"),
        "artifact_id", mime_type(F.col("path")).alias("mime_type"), "bytes",
    )


def extension(path: Column) -> Column:
    """Last suffix of the file name with its dot, or empty; a leading dot is no suffix."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?s).(\.[^.]+)$", 1)


def mime_type(path: Column) -> Column:
    """Type by extension from Python's table; a compression suffix is looked through."""
    table = F.create_map(*[F.lit(x) for pair in sorted(mimetypes.types_map.items()) for x in pair])
    coded = "|".join(ext[1:] for ext in sorted(mimetypes.encodings_map))
    inner = F.regexp_replace(path, rf"(?i)\.({coded})$", "")
    suffix = F.lower(extension(inner))
    return F.when(suffix != "", F.element_at(table, suffix))


def addressed(files: DataFrame) -> DataFrame:
    """Links of items to contents when the bytes lie in the item's own row."""
    return files.select(
        "item_id", "source_row_number", "original_path",
        F.sha2("content", 256).alias("artifact_id"),
        mime_type(F.col("original_path")).alias("mime_type"),
        F.length("content").cast("long").alias("bytes"),
    )


def artifacts(links: DataFrame) -> DataFrame:
    """One row per distinct content; path, extension and type come from the first row that has it."""
    first = F.min_by(F.struct("original_path", "mime_type", "bytes"), F.col("source_row_number"))
    return links.groupBy("artifact_id").agg(first.alias("_first")).select(
        "artifact_id", "_first.original_path",
        F.concat(
            F.substring("artifact_id", 1, 2), F.lit("/"), F.col("artifact_id"), extension(F.col("_first.original_path"))
        ).alias("stored_path"),
        "_first.mime_type", "_first.bytes",
    )


def item_artifacts(links: DataFrame) -> DataFrame:
    """Unique item to artifact links."""
    return links.select("item_id", "artifact_id").distinct().withColumn("role", F.lit("source"))


def is_image(mime: Column) -> Column:
    return F.coalesce(mime.startswith("image/"), F.lit(False))


def file_text(content: Column) -> Column:
    """UTF-8 text of a file; missing or undecodable bytes give the empty text."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))


def item_texts(parts: DataFrame) -> DataFrame:
    """Texts of an item's artifacts, stripped, blanks dropped, in artifact order.

    ``parts(item_id, artifact_id, text)``; the text of one item is one value by
    definition, so its parts meet in one row.
    """
    kept = F.filter(
        F.transform(
            F.array_sort(F.collect_list(F.struct("artifact_id", X.strip(F.col("text")).alias("text")))),
            lambda p: p["text"],
        ),
        lambda t: t != "",
    )
    return parts.groupBy("item_id").agg(F.array_join(kept, X.PART_SEPARATOR).alias("extracted_text"))


def first_images(item_links: DataFrame, artifact_rows: DataFrame) -> DataFrame:
    """The first image artifact of each item, by artifact id."""
    images = artifact_rows.filter(is_image(F.col("mime_type"))).select("artifact_id")
    return item_links.join(images, "artifact_id").groupBy("item_id").agg(
        F.min("artifact_id").alias("image_artifact_id")
    )
