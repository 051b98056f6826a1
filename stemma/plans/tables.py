"""The test tables in the roles of the corpus: works, pages, chunks, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: a source is a work, a document a page, a language a location."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("slug"), "doc_id", F.col("lang").alias("original_page"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    number = F.regexp_extract("slug", "([0-9]+)$", 1).cast("int")
    return lines.select(
        "slug",
        (F.col("doc_id") * 100_000 + F.col("line")).alias("ord"),
        "original_page",
        F.col("doc_id").alias("pdf_page"),
        "text",
        number.alias("work_ord"),
        F.when(number % 2 == 0, "major-work").otherwise("short-work").alias("record_class"),
    ).where("text <> ''")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("slug"), F.col("doc_id").cast("int").alias("page_no"), "text")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue of many records."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read(spark, sf_dir, "part").join(nation, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    k = F.col("p_partkey")
    year = F.when(k % 7 == 0, F.concat((16 + k % 4).cast("string"), F.lit("世紀"))).when(k % 11 == 0, "刊年不詳").otherwise((1566 + (k * 13) % 400).cast("string"))
    return part.select(
        F.concat(F.lit("p-"), k.cast("string")).alias("slug"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("author_key"),
        year.alias("year"),
        F.split("p_name", " ").alias("types"),
        F.array("n_name").alias("regions"),
        F.array(F.concat(F.lit("L"), (k % 4).cast("string"))).alias("languages"),
        F.array("p_type").alias("tags"),
        F.when(F.col("p_size") <= 25, "major-work").otherwise("short-work").alias("record_class"),
        F.col("p_size").alias("page_count"),
        (F.col("p_retailprice") * 1000).cast("long").alias("size"),
        k.alias("ord"),
    )


#: The same in SQL, to put before a query.
PUBLICATIONS = """WITH pub AS (
  SELECT 'p-' || p_partkey AS slug, p_name AS title, p_brand AS author, lower(replace(p_brand, '#', '-')) AS author_key,
    CASE WHEN p_partkey % 7 = 0 THEN (16 + p_partkey % 4)::VARCHAR || '世紀' WHEN p_partkey % 11 = 0 THEN '刊年不詳' ELSE (1566 + (p_partkey * 13) % 400)::VARCHAR END AS year,
    string_split(p_name, ' ') AS types, [n_name] AS regions, ['L' || (p_partkey % 4)] AS languages, [p_type] AS tags,
    CASE WHEN p_size <= 25 THEN 'major-work' ELSE 'short-work' END AS record_class, p_size AS page_count, (p_retailprice * 1000)::BIGINT AS size, p_partkey AS ord,
    CASE WHEN p_partkey % 7 = 0 THEN (16 + p_partkey % 4) * 100 - 1 WHEN p_partkey % 11 = 0 THEN NULL ELSE 1566 + (p_partkey * 13) % 400 END AS y,
    CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN '' WHEN 1566 + (p_partkey * 13) % 400 < 1700 THEN '17世紀' WHEN 1566 + (p_partkey * 13) % 400 < 1800 THEN '18世紀'
      WHEN 1566 + (p_partkey * 13) % 400 < 1850 THEN '19世紀前半' WHEN 1566 + (p_partkey * 13) % 400 < 1900 THEN '19世紀後半' ELSE '20世紀初頭' END AS era
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey)
"""
CHUNKS = """WITH line AS (
  SELECT source AS slug, doc_id, lang AS original_page, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
chunk AS (
  SELECT slug, doc_id * 100000 + line AS ord, original_page, doc_id AS pdf_page, text, regexp_extract(slug, '([0-9]+)$', 1)::INT AS work_ord,
    CASE WHEN regexp_extract(slug, '([0-9]+)$', 1)::INT % 2 = 0 THEN 'major-work' ELSE 'short-work' END AS record_class
  FROM line WHERE text <> '')
"""
PAGES = """WITH page AS (SELECT source AS slug, doc_id::INT AS page_no, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS txt FROM documents),
starts AS (SELECT slug, page_no, txt, coalesce(sum(length(txt)) OVER (PARTITION BY slug ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM page),
work AS (SELECT slug, string_agg(txt, '' ORDER BY page_no) AS hay FROM page GROUP BY slug),
item AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS needle FROM benchmark)
"""
