"""python -m stemma COMMAND: the steps from source files to search results, over tables in Parquet.

    extract SOURCES CHUNKS [--pages PAGES]   Markdown files -> chunks, aligned with pages(slug, page_no, text) if given
    index CHUNKS INDEX [--segment N]         chunks -> parts, page map and positions; later segments replace works of earlier ones
    merge INDEX INTO                         an index of several segments -> one of one
    search CHUNKS QUERY [--index INDEX] [--limit N]
    maps CHUNKS FOLDER                       chunks -> page maps, one JSON file a work
    manifest FOLDER OUT --origin URL         files of a folder -> path, url, size, sha256, as JSON lines
    contents EPUBS                           tables of contents of EPUBs as they would be rebuilt, an entry a line
    epubs EPUBS                              faults of EPUBs, one a line; exit status 1 if there are any
    verify CHUNKS [--index INDEX]            violations, one a line; exit status 1 if there are any
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import align, annotate, index, integrity, outline, packages, postings, search
from stemma.sources import formats, sinks, storage


def extract(spark: SparkSession, sources: str, chunks: str, pages: str | None = None) -> None:
    files = spark.read.text(sources, wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("slug"), F.col("value").alias("text"))
    out = annotate.chunks(annotate.annotated(formats.markdown_paragraphs(files)))
    if pages:
        out = align.relabelled(align.align(out, spark.read.parquet(pages)), spark.read.parquet(pages))
    search.with_search_text(out).write.mode("overwrite").parquet(chunks)


def build_index(spark: SparkSession, chunks: str, out: str, segment: int = 0) -> None:
    rows = _paged(spark.read.parquet(chunks))
    index.parts(rows).write.mode("overwrite").parquet(f"{out}/parts")
    index.page_map(rows).write.mode("overwrite").parquet(f"{out}/page_map")
    postings.write_segment(rows, f"{out}/search", segment)


def find(spark: SparkSession, chunks: str, query: str, built: str | None = None, limit: int = search.FIRST_WORKS) -> DataFrame:
    hits = postings.search(postings.read_index(spark, f"{built}/search"), query) if built else search.literal_chunks(_paged(spark.read.parquet(chunks)), query)
    return search.works(hits.withColumns({"record_class": F.lit(search.MAJOR), "work_ord": F.lit(0)}), limit)


def verify(spark: SparkSession, chunks: str, built: str | None = None) -> DataFrame:
    """Violations of chunks, and of an index against them: entries of the page map, labels, parts that hold all, postings of all texts."""
    rows = _paged(spark.read.parquet(chunks))
    found = [integrity.required(rows, "id", ["slug", "id", "text"]), integrity.shape(rows, "id", "id", integrity.BLOCK), integrity.contiguous(rows, "slug", "ord", 1)]
    if built:
        key = lambda df: df.select(F.concat_ws("/", "slug", "id").alias("key"))
        placed, parts = spark.read.parquet(f"{built}/page_map"), spark.read.parquet(f"{built}/parts")
        indexed = postings.read_index(spark, f"{built}/search").chunks.select("slug", "id")
        found += [integrity.set_difference(key(rows), key(placed), "key", "map-missing", "map-unknown"), integrity.set_difference(key(rows), key(indexed), "key", "index-missing", "index-unknown")]
        found.append(integrity.shape(placed.withColumn("key", F.concat_ws("/", "slug", "id")), "key", "original_page", integrity.LOCATION_PREFIX))
        held = parts.groupBy("slug").agg(F.sum("chunks").alias("held")).join(rows.groupBy("slug").agg(F.count("*").alias("n")), "slug", "full")
        found += [integrity.violations(held, "part-chunks", "slug", ~F.col("held").eqNullSafe(F.col("n")), F.col("held")), integrity.contiguous(parts, "slug", "part", 0)]
    return integrity.all_of(*found)


def manifest(spark: SparkSession, folder: str, out: str, origin: str) -> None:
    """Each file's size and checksum, read by itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    sinks.asset_manifest(files, folder, origin).write.mode("overwrite").json(out)


def epub_contents(spark: SparkSession, folder: str) -> DataFrame:
    return outline.contents(packages.headings(storage.read_archives(spark, folder, "*.epub")))


def _paged(chunks: DataFrame) -> DataFrame:
    return chunks if "pdf_page" in chunks.columns else chunks.withColumn("pdf_page", F.lit(None).cast("int"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stemma", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    places = {"extract": ("sources", "chunks"), "index": ("chunks", "index"), "merge": ("index", "into"), "search": ("chunks", "query"), "maps": ("chunks", "folder"), "manifest": ("folder", "out"), "contents": ("epubs",), "epubs": ("epubs",), "verify": ("chunks",)}
    options = {"extract": ("--pages",), "search": ("--index",), "verify": ("--index",)}
    for name, names in places.items():
        command = commands.add_parser(name)
        for p in (*names, *options.get(name, ())):
            command.add_argument(p)
        if name == "index":
            command.add_argument("--segment", type=int, default=0)
        if name == "search":
            command.add_argument("--limit", type=int, default=search.FIRST_WORKS)
        if name == "manifest":
            command.add_argument("--origin", required=True)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("stemma").getOrCreate()
    if a.command == "extract":
        extract(spark, a.sources, a.chunks, a.pages)
    elif a.command == "index":
        build_index(spark, a.chunks, a.index, a.segment)
    elif a.command == "merge":
        postings.merge(spark, f"{a.index}/search", f"{a.into}/search")
    elif a.command == "maps":
        sinks.write_page_maps(_paged(spark.read.parquet(a.chunks)), a.folder)
    elif a.command == "manifest":
        manifest(spark, a.folder, a.out, a.origin)
    elif a.command == "contents":
        for r in epub_contents(spark, a.epubs).orderBy("slug", "ord").toLocalIterator():
            print(r.slug, "  " * r.depth + r.label, r.target)
    elif a.command == "search":
        for r in find(spark, a.chunks, a.query, a.index, a.limit).orderBy("rank").collect():  # at most `limit` rows
            print(r["rank"], r.slug, r.score)
    else:
        found = verify(spark, a.chunks, a.index) if a.command == "verify" else packages.check(storage.read_archives(spark, a.epubs, "*.epub"))
        bad = 0
        for r in found.toLocalIterator():
            print(r.check, r.key, r.detail)
            bad = 1
        return bad
    return 0


if __name__ == "__main__":
    sys.exit(main())
