"""Writers: Parquet tables, and JSON as the client reads it."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.text import block_id, script_json
from stemma.sources import storage


def working_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, from the session; only on one machine a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/stemma-{spark.sparkContext.applicationId}"


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below working_folder(), deleted with clear_scratch() or when the driver ends."""
    _SCRATCH.append((spark, f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"))
    return _SCRATCH[-1][1]


def clear_scratch() -> None:
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(clear_scratch)


def write_table(df: DataFrame, path: str, *partitions: str, rows_per_file: int = 0) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partitions)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def json_array(*values: Column) -> Column:
    """A JSON array of strings and numbers, as text; null for what is null."""
    said = lambda v: F.coalesce(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"^\{\"v\":(?s:(.+))\}$", 1), F.lit(""))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array(*map(said, values)), lambda x: F.when(x == "", "null").otherwise(x)), ","), F.lit("]"))


def page_maps(chunks: DataFrame) -> DataFrame:
    """chunks(slug, ord, original_page, pdf_page) -> file, ord, key, value: the entries of each work's page map.

    key is a block id, value JSON: [location, page, order].
    """
    value = json_array(F.col("original_page"), F.col("pdf_page"), F.col("ord") - 1)
    return chunks.select(F.concat("slug", F.lit(".json")).alias("file"), "ord", block_id(F.col("ord")).alias("key"), value.alias("value"))


def write_page_maps(chunks: DataFrame, path: str) -> None:
    """One JSON file a work, an entry a line, in the order of its chunks; see storage.write_files()."""
    storage.write_files(page_maps(chunks), storage.JsonFiles, path, "ord")


def write_corpus(chunks: DataFrame, path: str) -> None:
    """One JSON file a work: block id -> [location, page, text], in order."""
    value = json_array(F.col("original_page"), F.col("pdf_page"), F.col("text"))
    rows = chunks.select(F.concat("slug", F.lit(".json")).alias("file"), "ord", block_id(F.col("ord")).alias("key"), value.alias("value"))
    storage.write_files(rows, storage.JsonFiles, path, "ord")


def write_document_map(parts: DataFrame, path: str, name: str = "documents.json") -> None:
    """One JSON file: fragment -> [slug, class, part]."""
    rows = document_map(parts).select(F.lit(name).alias("file"), F.col("part_id").alias("key"), F.col("mapping").alias("value"))
    storage.write_files(rows, storage.JsonFiles, path, "key")


def document_map(parts: DataFrame, *more: Column) -> DataFrame:
    """parts(part_id, slug, record_class, part_index) -> one row a fragment: JSON [slug, class, part], and what more is asked of it."""
    names = F.to_json(F.array("slug", "record_class"))
    return parts.select("part_id", F.concat(F.left(names, F.length(names) - 1), F.lit(","), F.col("part_index").cast("string"), F.lit("]")).alias("mapping"), *more)


def structured_data(publications: DataFrame) -> DataFrame:
    """JSON-LD of publications, safe inside a script element."""
    thing = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.when(F.col("record_class") == "major-work", "Book").otherwise("ScholarlyArticle").alias("@type"),
        F.col("title").alias("name"),
        F.struct(F.lit("Person").alias("@type"), F.col("author").alias("name")).alias("author"),
        F.col("updated").cast("string").alias("dateModified"),
    )
    return publications.select("slug", script_json(F.to_json(thing)).alias("json_ld"))


def sitemap(publications: DataFrame, origin: str) -> DataFrame:
    """Address and last change of each publication, by class."""
    folder = F.when(F.col("record_class") == "major-work", "books").otherwise("papers")
    return publications.select(F.concat(F.lit(origin), folder, F.lit("/"), F.col("slug"), F.lit("/")).alias("loc"), F.col("updated").cast("string").alias("lastmod"))


def asset_manifest(files: DataFrame, root: str, origin: str) -> DataFrame:
    """files(path, size, sha256) under `root` -> path, url, size, sha256, with addresses encoded part by part."""
    path = F.regexp_replace("path", "^(?:file:/*)?/?" + root.strip("/") + "/", "")
    part = lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
    url = F.concat(F.lit(origin), F.array_join(F.transform(F.split("path", "/"), part), "/"))
    return files.withColumn("path", path).select("path", url.alias("url"), "size", "sha256")
