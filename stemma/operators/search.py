"""Full-text search: literal matches, grouped by work, one snippet a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.ranking import numbered

FIRST_WORKS, MORE_WORKS, FIRST_SNIPPETS, MORE_SNIPPETS = 6, 20, 10, 20
MAJOR = "major-work"


def with_search_text(chunks: DataFrame, form: bool = True) -> DataFrame:
    """Add `cmp`, what literal search compares. Worth storing: it is the same for all queries."""
    return chunks.withColumn("cmp", T.comparable(F.col("text"), form))


def literal_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold the query, case and white space aside. An empty query finds nothing."""
    needle = T.comparable_value(query)
    rows = chunks if "cmp" in chunks.columns else with_search_text(chunks)
    return rows.where(F.contains("cmp", F.lit(needle)) if needle else F.lit(False))


def conjunctive_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold every word of the query somewhere."""
    words = query.lower().split()
    lower = F.lower("text")
    out = chunks
    for w in words:
        out = out.where(F.contains(lower, F.lit(w)))
    return out if words else chunks.where(F.lit(False))


def by_work(matches: DataFrame) -> DataFrame:
    """slug, record_class, score, first: the number of matching chunks a work; best first, see works()."""
    return matches.groupBy("slug").agg(F.first("record_class").alias("record_class"), F.count("*").alias("score"), F.min("work_ord").alias("first"))


def works(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """by_work() with `rank`, by score and then by the works' order; with a limit, the first of them."""
    out = by_work(matches)
    if limit:
        order = [F.desc("score"), F.col("first")]
        out = out.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    else:
        out = numbered(out, F.col("score"), "first", True)
    return out.drop("first")


def counts(found: DataFrame) -> DataFrame:
    """One row: books, and papers, which is what the rest counts as."""
    books = F.count_if(F.col("record_class") == MAJOR)
    return found.agg(books.alias("books"), (F.count("*") - books).alias("papers"))


def snippets(matches: DataFrame) -> DataFrame:
    """matches(slug, ord, original_page, pdf_page, text) -> a row a page: labels in order, first block and its text."""
    first = F.min_by(F.struct("ord", "text"), "ord")
    labels = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "original_page"))), lambda x: x.original_page)), "／")
    out = matches.groupBy("slug", "pdf_page").agg(first.alias("f"), labels.alias("original_page"), F.min("ord").alias("ord"))
    return out.select("slug", "pdf_page", T.block_id(F.col("f.ord")).alias("block_id"), "original_page", "ord", F.col("f.text").alias("excerpt"))


def top_snippets(rows: DataFrame, limit: int = FIRST_SNIPPETS, offset: int = 0) -> DataFrame:
    """The next snippets of each work, by page."""
    order = W.partitionBy("slug").orderBy("pdf_page", "ord")
    return rows.withColumn("n", F.row_number().over(order)).where((F.col("n") > offset) & (F.col("n") <= offset + limit))


def merged_references(references: DataFrame) -> DataFrame:
    """references(part_id, score, variant) -> part_id, score (the best; none counts as 0), variants."""
    return references.where("part_id is not null").groupBy("part_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("variants"), F.min("variant").alias("first_variant"))


def first_results(results: DataFrame) -> DataFrame:
    """results(part_id, variant, position, anchor, url, excerpt): one a block, the first in variant order."""
    key = F.coalesce(T.block_of(F.col("anchor"), F.col("url")), F.nullif(F.col("url"), F.lit("")), F.col("excerpt"), F.lit(""))
    order = W.partitionBy("part_id", "key").orderBy("variant", "position")
    return results.withColumn("key", key).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def grouped_references(exact: DataFrame, broad: DataFrame, documents: DataFrame) -> DataFrame:
    """Works of exact references(part_id, score, pos), scored by the broad ones where those have a score.

    documents(part_id, slug, record_class, part_index) must have every part; one that is missing raises.
    """
    rows = exact.join(broad.select("part_id", F.col("score").alias("broad")), "part_id", "left").join(documents, "part_id", "left")
    slug = F.when(F.col("slug").isNotNull(), F.col("slug")).otherwise(F.raise_error(F.concat(F.lit("unmapped search document: "), "part_id")))
    score = F.coalesce(F.nullif(F.col("broad"), F.lit(0.0)), F.col("score"), F.lit(0.0))
    out = rows.withColumn("slug", slug).groupBy("slug").agg(F.first("record_class").alias("record_class"), F.sum(score).alias("score"), F.min("pos").alias("first"), F.array_sort(F.collect_list("part_index")).alias("parts"))
    return numbered(out, F.col("score"), "first", True).drop("first")


def located(results: DataFrame, page_map: DataFrame) -> DataFrame:
    """results(slug, anchor, url, ...) with the location, page and order of their block; others are dropped."""
    keyed = results.withColumn("id", T.block_of(F.col("anchor"), F.col("url")))
    return keyed.join(page_map.select("slug", "id", "original_page", "pdf_page", "order"), ["slug", "id"])


def result_label(books: Column, papers: Column) -> Column:
    """What a reader is told of the works that were found."""
    return F.concat(F.lit("書籍 "), books.cast("string"), F.lit("冊・論文 "), papers.cast("string"), F.lit("篇が該当"))


#: Fixed value: the parameter of an address that holds the query.
PARAMETER = "fulltext"


def with_query(url: Column, query: Column) -> Column:
    """The address with this query instead of another; without the parameter if it is empty."""
    bare = F.regexp_replace(url, rf"([?&]){PARAMETER}=[^&#]*(&?)", "$1$2")
    bare = F.regexp_replace(F.regexp_replace(bare, "([?&])&+", "$1"), "[?&]+(#|$)", "$1")
    page, fragment = F.regexp_extract(bare, "^([^#]*)", 1), F.regexp_extract(bare, "(#.*)$", 1)
    joint = F.when(F.contains(page, F.lit("?")), "&").otherwise("?")
    asked = F.coalesce(query, F.lit(""))
    return F.concat(page, F.when(asked == "", "").otherwise(F.concat(joint, F.lit(f"{PARAMETER}="), F.url_encode(asked))), fragment)


def query_of(url: Column) -> Column:
    """The query in an address; empty if there is none."""
    return F.coalesce(F.url_decode(F.regexp_extract(url, rf"[?&]{PARAMETER}=([^&#]*)", 1)), F.lit(""))
