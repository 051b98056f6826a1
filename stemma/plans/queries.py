"""The queries of the catalogue, text and search operators, and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import catalogue as C
from stemma.functions import text as T
from stemma.operators import align, annotate, catalogue, index, integrity, outline, postings, search
from stemma.plans import documents, structure, tables
from stemma.plans import sources as files
from stemma.plans.registry import ORACLES, QUERIES, query
from stemma.plans.tables import CHUNKS, PAGES, PUBLICATIONS, read
from stemma.sources import formats, sinks

__all__ = ["ORACLES", "QUERIES", "documents", "files", "structure"]

QUERY = "the that"
_INDEXES: dict[tuple[str, str], str] = {}


# ---------------------------------------------------------------- catalogue


@query(
    PUBLICATIONS
    + "SELECT slug, record_class FROM pub WHERE contains(lower(concat_ws(' ', title, author, array_to_string(types, ' '), array_to_string(regions, ' '), array_to_string(languages, ' '), array_to_string(tags, ' '))), 'ring') AND list_contains(languages, 'L2') AND era = '18世紀'"
)
def catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    """Substring, facets and era, with the class."""
    pubs = tables.publications(spark, d)
    return catalogue.matching(pubs, catalogue.State(q=" RING ", language="L2", era="18世紀")).select("slug", "record_class")


@query(PUBLICATIONS + "SELECT slug, y AS sort_year, row_number() OVER (ORDER BY y ASC NULLS LAST, ord) AS rank, row_number() OVER (ORDER BY y DESC NULLS LAST, ord) AS rank_desc FROM pub")
def catalogue_year_sort(spark: SparkSession, d: str) -> DataFrame:
    """Both directions, unknown years last, ties in catalogue order."""
    pubs = tables.publications(spark, d)
    out = catalogue.ranked_by_year(catalogue.ranked_by_year(pubs).withColumnRenamed("rank", "up"), True)
    return out.select("slug", C.sort_year(F.col("year")).cast("long").alias("sort_year"), F.col("up").alias("rank"), F.col("rank").alias("rank_desc"))


@query(PUBLICATIONS + "SELECT slug, rank FROM (SELECT slug, row_number() OVER (ORDER BY title COLLATE NOCASE, ord) AS rank FROM pub WHERE record_class = 'major-work') WHERE rank BETWEEN 49 AND 72")
def catalogue_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 24 by title. A page is what this operator is for."""
    pubs = tables.publications(spark, d).where("record_class = 'major-work'")
    return catalogue.page(pubs, catalogue.State(sort="title", per_page=24, page=3)).select("slug", F.col("rank").cast("long").alias("rank"))


@query(PUBLICATIONS + "SELECT era, record_class, count(*) AS publications FROM pub GROUP BY era, record_class")
def era_counts(spark: SparkSession, d: str) -> DataFrame:
    """F4, A3."""
    return tables.publications(spark, d).groupBy(C.era(F.col("year")).alias("era"), "record_class").agg(F.count("*").alias("publications"))


@query(
    PUBLICATIONS
    + "SELECT facet, value, count(*) AS publications FROM (SELECT 'types' AS facet, unnest(list_distinct(types)) AS value FROM pub UNION ALL SELECT 'regions', unnest(regions) FROM pub UNION ALL SELECT 'languages', unnest(languages) FROM pub UNION ALL SELECT 'tags', unnest(tags) FROM pub) GROUP BY facet, value"
)
def facet_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return catalogue.facets(tables.publications(spark, d))


@query(PUBLICATIONS + "SELECT author_key, arg_min(author, ord) AS name, count(*) AS n_works, sha256(string_agg(slug, ',' ORDER BY y ASC NULLS LAST, title, ord)) AS works_sha256 FROM pub WHERE record_class = 'short-work' GROUP BY author_key")
def author_groups(spark: SparkSession, d: str) -> DataFrame:
    """Short works by author, in order of year, title and catalogue."""
    out = catalogue.author_groups(tables.publications(spark, d).where("record_class = 'short-work'"))
    return out.select("author_key", "name", "n_works", F.sha2(F.array_join("works", ","), 256).alias("works_sha256"))


@query(
    PUBLICATIONS
    + """, pair AS (SELECT a.slug, b.slug AS related, b.y, b.ord,
      4 * len(list_filter(a.regions, lambda x: list_contains(b.regions, x))) + 3 * len(list_filter(a.types, lambda x: list_contains(b.types, x)))
      + 2 * len(list_filter(a.tags, lambda x: list_contains(b.tags, x))) + len(list_filter(a.languages, lambda x: list_contains(b.languages, x))) AS score
      FROM pub a JOIN pub b ON a.slug <> b.slug)
    SELECT slug, rank, related, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, y ASC NULLS LAST, ord) AS rank FROM pair) WHERE rank <= 3"""
)
def related_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three closest records of each, in the whole catalogue, one record a part. A top-k is what this operator is for."""
    return catalogue.related(tables.publications(spark, d)).select("slug", F.col("rank").cast("long").alias("rank"), "related", "score")


@query("SELECT p_partkey, len(list_filter(string_split(p_name || ' ' || p_name, ' '), lambda x: list_contains(string_split(p_type || ' ring red', ' '), x))) AS overlap, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '))), ' ') AS tags FROM part")
def multiset_tags(spark: SparkSession, d: str) -> DataFrame:
    """Overlap that counts repeated elements on the left; distinct tags."""
    words = F.split(F.concat_ws(" ", "p_name", "p_name"), " ")
    other = F.split(F.concat(F.col("p_type"), F.lit(" ring red")), " ")
    return read(spark, d, "part").select("p_partkey", C.multiset_overlap(words, other).cast("long").alias("overlap"), F.array_join(F.array_sort(C.tags(F.split("p_name", " "), F.array("p_type"), F.split("p_name", " "))), " ").alias("tags"))


@query(PUBLICATIONS + "SELECT count(*) AS works, count(*) FILTER (record_class = 'major-work') AS books, count(*) FILTER (record_class <> 'major-work') AS papers, sum(page_count)::BIGINT AS pages, count(DISTINCT author_key) AS authors FROM pub")
def catalogue_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1, A3, A13."""
    books = F.count_if(F.col("record_class") == "major-work")
    return tables.publications(spark, d).agg(F.count("*").alias("works"), books.alias("books"), (F.count("*") - books).alias("papers"), F.sum("page_count").alias("pages"), F.count_distinct("author_key").alias("authors"))


_ASSETS = "asset AS (SELECT 'pdf/' || slug AS path, size FROM pub UNION ALL SELECT 'epub/' || slug, size // 7 FROM pub)"


def _assets(pubs: DataFrame) -> DataFrame:
    files = F.array(F.struct(F.concat(F.lit("pdf/"), "slug").alias("path"), F.col("size")), F.struct(F.concat(F.lit("epub/"), "slug").alias("path"), F.floor(F.col("size") / 7).alias("size")))
    return pubs.select(F.explode(files).alias("f")).select("f.*")


_SIZE = "CASE WHEN {0} >= 1048576 THEN printf('%.1f MB', floor({0} / 1048576 * 10 + 0.5) / 10) ELSE printf('%.1f KB', floor({0} / 1024 * 10 + 0.5) / 10) END"


@query(PUBLICATIONS.rstrip() + ", " + _ASSETS + f" SELECT slug, p.size AS pdf_bytes, e.size AS epub_bytes, {_SIZE.format('p.size')} AS pdf_size, {_SIZE.format('e.size')} AS epub_size FROM pub JOIN asset p ON p.path = 'pdf/' || slug JOIN asset e ON e.path = 'epub/' || slug")
def asset_join(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of both files of each publication, plain and for readers."""
    pubs = tables.publications(spark, d)
    named = pubs.select("slug", F.concat(F.lit("pdf/"), "slug").alias("pdf"), F.concat(F.lit("epub/"), "slug").alias("epub"))
    out = catalogue.with_assets(named, _assets(pubs))
    return out.select("slug", "pdf_bytes", "epub_bytes", T.file_size(F.col("pdf_bytes")).alias("pdf_size"), T.file_size(F.col("epub_bytes")).alias("epub_size"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN 'current' WHEN o_orderkey % 2 = 0 THEN 'previous' ELSE 'missing' END AS origin FROM orders")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The current row, else the one before."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    before = orders.where("key % 2 = 0").withColumn("price", F.col("price") + 1)
    return catalogue.upsert_keep(orders, orders.where("key % 3 <> 0"), before, "key", ["price"])


@query(
    """SELECT 'missing' AS "check", doc_id::VARCHAR AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'overlap', doc_id::VARCHAR FROM labels WHERE quality = 1 AND toxic = 1
    UNION ALL SELECT 'fallback', doc_id::VARCHAR FROM labels WHERE toxic = 1 AND quality = 0"""
)
def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Works against archived and fallback records."""
    labels = read(spark, d, "labels")
    slug = F.col("doc_id").cast("string").alias("slug")
    archived = labels.where("quality = 1").select(slug, F.concat(F.lit("works/"), "doc_id").alias("path"))
    fallbacks = labels.where("toxic = 1").select(slug, F.when(F.col("quality") == 1, F.concat(F.lit("works/"), "doc_id")).alias("canonical_path"))
    return integrity.ledger(read(spark, d, "documents").select(slug), archived, fallbacks).select("check", "key")


# ---------------------------------------------------------------- text


@query("SELECT doc_id, count(*) AS paragraphs, max(length(text)) AS longest, sha256(string_agg(text, chr(10) ORDER BY line)) AS sha256 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents) WHERE text <> '' GROUP BY doc_id")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    """S3-like: lines as ordered paragraphs, put together again."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    docs = read(spark, d, "documents").select("doc_id", lines.alias("p")).where(F.size("p") > 0)
    return docs.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"), F.sha2(F.array_join("p", "\n"), 256).alias("sha256"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The tolerant parser; tests compare it with fixtures, as SQL has none."""
    return formats.html_blocks(read(spark, d, "pages"))


@query()
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """C3; tests compare it line by line, as SQL's expressions have no look-around."""
    clean = T.clean_inline(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(clean).alias("n"), F.sha2(clean, 256).alias("sha256"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role <> 'assistant' THEN role || ' ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS location FROM conversations")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last marker at or before each row."""
    rows = read(spark, d, "conversations")
    mark = F.when(F.col("role") != "assistant", F.concat_ws(" ", "role", F.col("turn").cast("string")))
    return annotate.carried(rows, mark, "conv_id", ["turn"], "none").select("conv_id", "turn", "location")


@query("SELECT doc_id, len(s) AS sentences, sha256(array_to_string(s, '|')) AS sha256 FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, '.', '!'), '([。！？!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """C6, with full stops as marks."""
    s = T.sentences(F.replace("text", F.lit("."), F.lit("!")))
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sha256"))


@query(
    """WITH RECURSIVE sentence AS (SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(replace(text, '.', '!'), '([。！？!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
    cut AS (SELECT doc_id, lang, list_filter(list_transform(flatten(list_transform(s, lambda x: regexp_extract_all(x, '(?s)(.{1,190}\\z|.{135,190}[、；;：:，,]|.{190})\\s*', 1))), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM sentence),
    piece AS (SELECT doc_id, lang, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM cut),
    fold AS (SELECT doc_id, i, 0 AS g, length(t) AS held FROM piece WHERE i = 1
      UNION ALL SELECT p.doc_id, p.i, f.g + (f.held + length(p.t) > 170)::INT, CASE WHEN f.held + length(p.t) > 170 THEN length(p.t) ELSE f.held + length(p.t) END FROM fold f JOIN piece p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
    chunk AS (SELECT doc_id, lang, g, trim(regexp_replace(string_agg(t, '' ORDER BY i), '\\s+', ' ', 'g')) AS text FROM fold JOIN piece USING (doc_id, i) GROUP BY doc_id, lang, g),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS ord FROM chunk WHERE length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 2)
    SELECT doc_id::VARCHAR AS slug, ord, 'b' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') AS id, lang AS original_page, text FROM numbered"""
)
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, a greedy fold."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.lit(1).alias("seq"), F.col("lang").alias("original_page"), F.replace("text", F.lit("."), F.lit("!")).alias("text"))
    return annotate.chunks(docs)


@query("SELECT doc_id, length(n) AS n, sha256(n) AS sha256 FROM (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS n FROM documents)")
def normalize_match(spark: SparkSession, d: str) -> DataFrame:
    """C1."""
    n = T.matchable(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("n"), F.sha2(n, 256).alias("sha256"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\x{C0}-\\x{24F}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]', '', 'g')) AS japanese FROM documents")
def char_class_count(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a class."""
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.regexp_count(text, F.lit(r"[\x{C0}-\x{24F}]")).cast("long").alias("letters"), T.japanese_count(text).cast("long").alias("japanese"))


@query("SELECT 'checksum' AS \"check\", doc_id::VARCHAR AS key FROM documents WHERE doc_id % 50 < 3")
def text_digest(spark: SparkSession, d: str) -> DataFrame:
    """G4, m5: checksums and sizes of all documents against a copy that lacks files or has other texts."""
    digests = lambda df: df.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    docs = read(spark, d, "documents")
    k = F.col("doc_id") % 50
    copy = docs.where(k != 0).withColumn("text", F.when(k == 1, F.concat("text", F.lit("x"))).when(k == 2, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return integrity.checksums(digests(docs), digests(copy), "doc_id").select("check", "key")


@query("SELECT item_id, len(g) AS grams, sha256(array_to_string(list_sort(g), '|')) AS sha256 FROM (SELECT item_id, list_distinct(list_transform(range(1, length(n) - 4), lambda i: substring(n, i, 6))) AS g FROM (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS n FROM benchmark))")
def gram_sets(spark: SparkSession, d: str) -> DataFrame:
    """C8."""
    g = T.grams(F.col("n"))
    return read(spark, d, "benchmark").select("item_id", T.matchable(F.col("text")).alias("n")).select("item_id", F.size(g).cast("long").alias("grams"), F.sha2(F.array_join(F.array_sort(g), "|"), 256).alias("sha256"))


@query(
    "SELECT doc_id, length(html)::BIGINT AS chars, sha256(html) AS sha256 FROM (SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS html FROM documents)"
)
def escaped_html(spark: SparkSession, d: str) -> DataFrame:
    """C13, on whole texts: length and digest."""
    html = read(spark, d, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"))
    return html.select("doc_id", F.length("html").cast("long").alias("chars"), F.sha2("html", 256).alias("sha256"))


# ---------------------------------------------------------------- alignment


def _needles(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items, to be found in every source."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("ord"), T.matchable(F.col("text")).alias("norm"))


@query(
    PAGES
    + """, hit AS (SELECT slug, item_id, needle, hay, instr(hay, needle) AS p FROM item, work WHERE contains(hay, needle))
    SELECT slug, item_id, CASE WHEN instr(substring(hay, p + 1), needle) > 0 THEN 2 ELSE 1 END::BIGINT AS hits, (SELECT max(page_no) FROM starts s WHERE s.slug = hit.slug AND s.start <= p - 1 AND s.txt <> '')::INT AS page_no FROM hit"""
)
def align_exact_unique(spark: SparkSession, d: str) -> DataFrame:
    """Once, or several times, and on which page first."""
    out = align.exact(_needles(spark, d), align.blocks(align.page_starts(tables.pages(spark, d))))
    return out.select("slug", F.col("ord").alias("item_id"), F.least("hits", F.lit(2)).alias("hits"), "page_no")


@query(
    PAGES
    + """, probe AS (SELECT item_id, length(needle) AS n, needle, least(48, greatest(20, length(needle) // 2)) AS w FROM item),
    piece AS (SELECT DISTINCT item_id, o, substring(needle, o::BIGINT + 1, w) AS piece FROM (SELECT *, unnest([0, n // 4, n // 2, greatest(0, n - w)]) AS o FROM probe)),
    found AS (SELECT slug, item_id, min(greatest(0, instr(hay, piece) - 1 - o)) AS a FROM piece, work WHERE length(piece) >= 16 AND contains(hay, piece) GROUP BY slug, item_id)
    SELECT slug, item_id, a::BIGINT AS "at", (SELECT max(page_no) FROM starts s WHERE s.slug = found.slug AND s.start <= a AND s.txt <> '')::INT AS page_no FROM found"""
)
def align_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Where a needle's parts say it begins."""
    out = align.fingerprints(_needles(spark, d), align.blocks(align.page_starts(tables.pages(spark, d))))
    return out.select("slug", F.col("ord").alias("item_id"), F.col("at").cast("long").alias("at"), "page_no")


@query(
    PAGES
    + """, mine AS (SELECT item_id, total, unnest(g) AS gram FROM (SELECT item_id, g, len(g) AS total FROM (SELECT item_id, list_distinct(list_transform(range(1, length(needle) - 4), lambda i: substring(needle, i, 6))) AS g FROM item))),
    there AS (SELECT DISTINCT slug, page_no, substring(txt, i, 6) AS gram FROM (SELECT slug, page_no, txt, unnest(range(1, length(txt) - 4)) AS i FROM page) SEMI JOIN mine ON substring(txt, i, 6) = mine.gram),
    score AS (SELECT slug, item_id, page_no, count(*) / first(total) AS score FROM mine JOIN there USING (gram) GROUP BY slug, item_id, page_no)
    SELECT slug, item_id, page_no, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY slug, item_id ORDER BY score DESC, abs(page_no - 100), page_no) AS r FROM score) WHERE r = 1 AND score >= 0.24"""
)
def align_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The page of each work with most of an item's 6-grams, all pages in range."""
    rows = _needles(spark, d).select("ord", "norm", F.lit(100.0).alias("target"), F.lit(0).alias("from_page"), F.lit(2**31 - 1).alias("to_page"))
    out = align.fuzzy(rows, align.page_starts(tables.pages(spark, d)))
    return out.select("slug", F.col("ord").alias("item_id"), "page_no", F.round("score", 6).alias("score"))


@query(PAGES + "SELECT slug, page_no, length(txt) AS n, start FROM starts")
def page_starts(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return align.page_starts(tables.pages(spark, d)).select("slug", "page_no", F.length("txt").cast("long").alias("n"), "start")


_ANCHORS = """WITH row AS (SELECT source AS slug, doc_id AS ord, CASE WHEN quality = 1 THEN doc_id // 10 END::INT AS page FROM documents LEFT JOIN labels USING (doc_id)),
near AS (SELECT *, last_value(CASE WHEN page IS NOT NULL THEN {'o': ord, 'p': page} END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN page IS NOT NULL THEN {'o': ord, 'p': page} END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM row)
SELECT slug, ord, a.p AS prev_page, b.p AS next_page, round(coalesce(a.p + (b.p - a.p) * (ord - a.o) / (b.o - a.o), a.p, b.p, 1), 6)::DOUBLE AS target,
  greatest(1, least(coalesce(a.p, 1), coalesce(b.p, 1000000)) - 2)::INT AS from_page, least(1000000, greatest(coalesce(a.p, 1), coalesce(b.p, 1000000)) + 2)::INT AS to_page FROM near"""


@query(_ANCHORS)
def neighbour_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Anchors on both sides, the page between them, and the range to search."""
    labels = read(spark, d, "labels").select("doc_id", "quality")
    docs = read(spark, d, "documents").join(labels, "doc_id", "left")
    page = F.when(F.col("quality") == 1, F.floor(F.col("doc_id") / 10)).cast("int")
    rows = docs.select(F.col("source").alias("slug"), F.col("doc_id").alias("ord"), page.alias("page_no"), F.lit("").alias("original_page"))
    out = align.neighbours(rows, F.col("page_no").isNotNull(), F.lit(1_000_000))
    return out.select("slug", "ord", F.col("prev.page").alias("prev_page"), F.col("next.page").alias("next_page"), F.round("target", 6).alias("target"), "from_page", "to_page")


@query(
    """WITH page AS (SELECT source AS slug, doc_id AS page_no, lang || (n_chars % 50) AS label FROM documents),
    ask AS (SELECT source AS slug, doc_id AS ord, unnest([lang || ((n_chars + 1) % 50), lang || ((n_chars + 7) % 50)]) AS label FROM documents)
    SELECT slug, ord, min(page_no) AS page_no FROM ask JOIN page USING (slug, label) GROUP BY slug, ord HAVING count(DISTINCT page_no) = 1"""
)
def unique_label(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose labels together name one page."""
    docs = read(spark, d, "documents")
    label = lambda k: F.concat("lang", ((F.col("n_chars") + k) % 50).cast("string"))
    pages = docs.select(F.col("source").alias("slug"), F.col("doc_id").alias("page_no"), F.array(label(0)).alias("labels"))
    rows = docs.select(F.col("source").alias("slug"), F.col("doc_id").alias("ord"), F.concat_ws("／", label(1), label(7)).alias("original_page"))
    return align.unique_labels(rows, pages)


@query(
    """WITH row AS (SELECT source AS slug, ['exact', 'fingerprint', 'fuzzy', 'sourcePage', 'inherited', 'unmapped'][doc_id % 7 % 6 + 1] AS m, length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) >= 12 AS solid FROM documents)
    SELECT slug, count(*) FILTER (m = 'exact') AS exact, count(*) FILTER (m = 'fingerprint') AS fingerprint, count(*) FILTER (m = 'fuzzy') AS fuzzy, count(*) FILTER (m = 'sourcePage') AS "sourcePage", count(*) FILTER (m = 'inherited') AS inherited, count(*) FILTER (m = 'unmapped') AS unmapped,
      round(count(*) FILTER (solid AND m NOT IN ('inherited', 'unmapped')) / count(*) FILTER (solid), 6) AS verified_rate, count(*) FILTER (solid AND m NOT IN ('inherited', 'unmapped')) / count(*) FILTER (solid) >= 0.7 AS accepted FROM row GROUP BY slug"""
)
def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5, with a gate at 0.7."""
    method = F.element_at(F.array(*map(F.lit, align.METHODS)), (F.col("doc_id") % 7 % 6 + 1).cast("int"))
    rows = read(spark, d, "documents").select(F.col("source").alias("slug"), "text", method.alias("alignment"))
    return align.summary(rows, 0.7)


# ---------------------------------------------------------------- index and search


@query(
    CHUNKS.replace("WITH line", "WITH RECURSIVE line")
    + """, run AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY "first") AS run FROM (SELECT slug, min(ord) AS "first", count(*) AS n, sum(length(text))::BIGINT AS size, arg_min(length(text), ord) AS head FROM chunk GROUP BY slug, pdf_page)),
    fold AS (SELECT slug, run, "first", n, size, 0 AS part, n AS held, size AS chars FROM run WHERE run = 1
      UNION ALL SELECT r.slug, r.run, r."first", r.n, r.size, f.part + (f.chars + r.head > 20000 OR f.held >= 200)::INT, CASE WHEN f.chars + r.head > 20000 OR f.held >= 200 THEN r.n ELSE f.held + r.n END,
        CASE WHEN f.chars + r.head > 20000 OR f.held >= 200 THEN r.size ELSE f.chars + r.size END FROM fold f JOIN run r ON r.slug = f.slug AND r.run = f.run + 1)
    SELECT slug, part, min("first") AS "first", sum(n)::BIGINT AS chunks, sum(size)::BIGINT AS chars FROM fold GROUP BY slug, part"""
)
def part_pack(spark: SparkSession, d: str) -> DataFrame:
    """A greedy fold."""
    return index.parts(tables.chunks(spark, d), 20_000, 200)


@query(CHUNKS + "SELECT slug, 'b' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') AS id, original_page, pdf_page, ord - 1 AS \"order\" FROM chunk")
def page_map(spark: SparkSession, d: str) -> DataFrame:
    """K2, W2."""
    return index.page_map(tables.chunks(spark, d))


_LITERAL = CHUNKS.rstrip() + ", hit AS (SELECT * FROM chunk WHERE contains(regexp_replace(lower(text), '[\\s\\x{3000}]', '', 'g'), 'thethat')) "


@query(_LITERAL + "SELECT slug, record_class, score, row_number() OVER (ORDER BY score DESC, work_ord) AS rank FROM (SELECT slug, first(record_class) AS record_class, count(*) AS score, min(work_ord) AS work_ord FROM hit GROUP BY slug)")
def literal_search(spark: SparkSession, d: str) -> DataFrame:
    """The works in which a phrase stands, by the number of chunks."""
    return search.works(search.literal_chunks(tables.chunks(spark, d), QUERY)).withColumn("rank", F.col("rank").cast("long"))


@query(_LITERAL + "SELECT count(*) FILTER (c = 'major-work') AS books, count(*) FILTER (c <> 'major-work') AS papers FROM (SELECT slug, first(record_class) AS c FROM hit GROUP BY slug)")
def literal_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return search.counts(search.by_work(search.literal_chunks(tables.chunks(spark, d), QUERY)))


@query(_LITERAL + "SELECT slug, pdf_page, 'b' || lpad(min(ord)::VARCHAR, greatest(5, length(min(ord)::VARCHAR))::INT, '0') AS block_id, first(original_page) AS original_page, min(ord) AS ord, arg_min(text, ord) AS excerpt FROM hit GROUP BY slug, pdf_page")
def page_snippets(spark: SparkSession, d: str) -> DataFrame:
    """One snippet a page."""
    return search.snippets(search.literal_chunks(tables.chunks(spark, d), QUERY))


@query(CHUNKS + "SELECT slug, ord FROM chunk WHERE contains(lower(text), 'idiot') AND contains(lower(text), 'the')")
def fallback_and_search(spark: SparkSession, d: str) -> DataFrame:
    """F11."""
    return search.conjunctive_chunks(tables.chunks(spark, d), "Idiot  the").select("slug", "ord")


@query(
    _LITERAL
    + "SELECT slug, ord, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;'), '(t\\s*h\\s*e\\s*t\\s*h\\s*a\\s*t)', '<mark>\\1</mark>', 'gi') AS html FROM hit"
)
def highlight(spark: SparkSession, d: str) -> DataFrame:
    """C11, C13, C14."""
    return search.literal_chunks(tables.chunks(spark, d), QUERY).select("slug", "ord", T.highlight(F.col("text"), QUERY).alias("html"))


@query(
    CHUNKS
    + """, hit AS (SELECT slug, ord, text, least(instr(lower(text), 'idiot'), instr(lower(text), 'the')) AS pos FROM chunk WHERE contains(lower(text), 'idiot') AND contains(lower(text), 'the')),
    cut AS (SELECT *, greatest(1, pos - 54) AS a, least(length(text), pos - 1 + 116) AS z FROM hit)
    SELECT slug, ord, CASE WHEN a > 1 THEN '…' ELSE '' END || regexp_replace(replace(replace(replace(replace(replace(substring(text, a, z - a + 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;'), '(idiot|the)', '<mark>\\1</mark>', 'gi')
      || CASE WHEN z < length(text) THEN '…' ELSE '' END AS html FROM cut"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """C12."""
    return search.conjunctive_chunks(tables.chunks(spark, d), "idiot the").select("slug", "ord", T.excerpt(F.col("text"), ["idiot", "the"]).alias("html"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal results."""
    docs = read(spark, d, "documents")
    results = docs.select(F.lit("all").alias("part_id"), F.lit(0).alias("variant"), F.col("doc_id").alias("position"), F.lit(None).cast("string").alias("anchor"), F.lit("").alias("url"), F.md5("text").alias("excerpt"), "source")
    return search.first_results(results).select("key", F.col("position").alias("doc_id"), "source")


@query(
    "SELECT part_id, max(score)::DOUBLE AS score, count(*) AS variants FROM (SELECT o_orderkey AS part_id, 0 AS variant, o_totalprice AS score FROM orders UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0 END FROM lineitem) GROUP BY part_id"
)
def merge_references(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each part over its variants; none counts as 0."""
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("part_id"), F.lit(0).alias("variant"), F.col("o_totalprice").alias("score"))
    b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("part_id"), F.col("l_linenumber").alias("variant"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("score"))
    return search.merged_references(a.unionByName(b)).select("part_id", "score", "variants")


@query(
    """WITH exact AS (SELECT o_orderkey AS part_id, (o_orderkey % 9)::DOUBLE AS score, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 = 0), broad AS (SELECT o_orderkey AS part_id, (o_orderkey % 5)::DOUBLE AS broad FROM orders WHERE o_orderkey % 2 = 0)
    SELECT slug, record_class, score, row_number() OVER (ORDER BY score DESC, pos) AS rank, parts FROM (SELECT 'c' || o_custkey AS slug, CASE WHEN o_custkey % 2 = 0 THEN 'major-work' ELSE 'short-work' END AS record_class, sum(coalesce(nullif(broad, 0), score, 0)) AS score, min(pos) AS pos, count(*) AS parts
      FROM exact LEFT JOIN broad USING (part_id) JOIN orders ON o_orderkey = part_id GROUP BY o_custkey)"""
)
def group_references(spark: SparkSession, d: str) -> DataFrame:
    """J8, J9, A8, O8."""
    orders = read(spark, d, "orders")
    part = F.col("o_orderkey").alias("part_id")
    exact = orders.where("o_orderkey % 3 = 0").select(part, (F.col("o_orderkey") % 9).cast("double").alias("score"), F.col("o_orderkey").alias("pos"))
    broad = orders.where("o_orderkey % 2 = 0").select(part, (F.col("o_orderkey") % 5).cast("double").alias("score"))
    documents = orders.select(part, F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("slug"), F.when(F.col("o_custkey") % 2 == 0, "major-work").otherwise("short-work").alias("record_class"), F.col("o_orderkey").alias("part_index"))
    out = search.grouped_references(exact, broad, documents)
    return out.select("slug", "record_class", "score", F.col("rank").cast("long").alias("rank"), F.size("parts").cast("long").alias("parts"))


# ---------------------------------------------------------------- integrity and publishing


@query(
    """SELECT 'sequence' AS "check", conv_id::VARCHAR AS key FROM (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1) GROUP BY conv_id) WHERE NOT (n = d AND lo = 0 AND hi = n - 1)"""
)
def seq_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Turns with gaps (every fifth conversation loses its second turn here)."""
    rows = read(spark, d, "conversations").where("not (conv_id % 5 = 0 and turn = 1)")
    return integrity.contiguous(rows, "conv_id", "turn").select("check", "key")


@query(
    """SELECT 'unique' AS "check", text AS key, count(*)::VARCHAR AS detail FROM (SELECT md5(text) AS text FROM documents) GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'shape:lang', doc_id::VARCHAR, lang FROM documents WHERE NOT regexp_matches(lang, '^(en|de)$')
    UNION ALL SELECT 'size', doc_id::VARCHAR, n_chars::VARCHAR FROM documents WHERE n_chars > 10000"""
)
def record_checks(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are not unique, values of the wrong shape, sizes over a budget."""
    docs = read(spark, d, "documents")
    return integrity.all_of(
        integrity.unique(docs.select(F.md5("text").alias("text")), "text"),
        integrity.shape(docs, "doc_id", "lang", "^(en|de)$"),
        integrity.violations(docs, "size", "doc_id", F.col("n_chars") > 10_000, F.col("n_chars")),
    )


@query("SELECT max(o_orderdate)::DATE::VARCHAR AS latest, year(max(o_orderdate)) || '年' || month(max(o_orderdate)) || '月' || day(max(o_orderdate)) || '日' AS shown, count(*) AS dated FROM orders")
def latest_update(spark: SparkSession, d: str) -> DataFrame:
    """A6, and the date as readers see it."""
    day = F.max(F.to_date("o_orderdate"))
    out = read(spark, d, "orders").agg(day.alias("day"), F.count("o_orderdate").alias("dated"))
    return out.select(F.col("day").cast("string").alias("latest"), T.japanese_date(F.col("day")).alias("shown"), "dated")


@query("SELECT 'https://example.org/' || CASE WHEN o_custkey % 2 = 0 THEN 'books' ELSE 'papers' END || '/o-' || o_orderkey || '/' AS loc, o_orderdate::DATE::VARCHAR AS lastmod FROM orders")
def sitemap_rows(spark: SparkSession, d: str) -> DataFrame:
    """H2."""
    rows = read(spark, d, "orders").select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("slug"), F.when(F.col("o_custkey") % 2 == 0, "major-work").otherwise("short-work").alias("record_class"), F.to_date("o_orderdate").alias("updated"))
    return sinks.sitemap(rows, "https://example.org/")


@query("SELECT l_orderkey AS slug, l_linenumber AS ord, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS base, row_number() OVER (PARTITION BY l_orderkey, l_returnflag || l_linestatus ORDER BY l_linenumber) AS n FROM lineitem)")
def heading_ids(spark: SparkSession, d: str) -> DataFrame:
    """Repeated names get numbers."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("base"))
    return outline.heading_ids(rows)


@query(
    "SELECT l.l_orderkey AS slug, l.l_linenumber AS ord, l.l_linenumber * 5 % 4 + 1 AS level, (SELECT max(b.l_linenumber) FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber < l.l_linenumber AND b.l_linenumber * 5 % 4 < l.l_linenumber * 5 % 4) AS parent FROM lineitem l"
)
def outline_parents(spark: SparkSession, d: str) -> DataFrame:
    """The last heading before of a higher level."""
    n = F.col("l_linenumber")
    return outline.nested(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"), n.alias("ord"), (n * 5 % 4 + 1).alias("level")))


@query(
    "SELECT 'toc' AS \"check\", user_id || '/' || event_id AS key FROM (SELECT user_id, event_id, (value * 100)::BIGINT % 50 AS spine, lag((value * 100)::BIGINT % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE spine < before"
)
def toc_monotone(spark: SparkSession, d: str) -> DataFrame:
    """Entries that go back."""
    spine = F.round(F.col("value") * 100).cast("long") % 50
    rows = read(spark, d, "events").select(F.col("user_id").alias("slug"), F.col("event_id").alias("n"), spine.alias("spine"))
    return integrity.toc_order(rows).select("check", "key")


def _index(spark: SparkSession, d: str) -> str:
    """The index of all chunks, built once for a session and its tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = sinks.scratch(spark, "index")
        postings.write_segment(tables.chunks(spark, d), path)
        _INDEXES[key] = path
    return _INDEXES[key]


@query(CHUNKS + "SELECT slug, count(*) FILTER (n >= 3) AS chunks, sum(greatest(n - 2, 0))::BIGINT AS places FROM (SELECT slug, length(regexp_replace(lower(text), '[\\s\\x{3000}]', '', 'g')) AS n FROM chunk) GROUP BY slug")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """K4: building the index of all chunks, and what it has of each work."""
    rows = postings.read_index(spark, _index(spark, d)).postings
    return rows.groupBy("slug").agg(F.count_if(F.col("at") == 0).alias("chunks"), F.count("*").alias("places"))


@query(_LITERAL + "SELECT slug, ord, text FROM hit")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks by the places of the phrase's grams; only texts that hold it are read."""
    return postings.search(postings.read_index(spark, _index(spark, d)), QUERY).select("slug", "ord", "text")


@query(_LITERAL + "SELECT slug, pdf_page, rank FROM (SELECT slug, pdf_page, row_number() OVER (PARTITION BY slug ORDER BY pdf_page) AS rank FROM (SELECT DISTINCT slug, pdf_page FROM hit)) WHERE rank BETWEEN 4 AND 8")
def snippet_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next five snippets of each work. A batch is what this operator is for."""
    rows = search.top_snippets(search.snippets(search.literal_chunks(tables.chunks(spark, d), QUERY)), 5, 3)
    return rows.select("slug", "pdf_page", F.col("n").cast("long").alias("rank"))


@query(CHUNKS + "SELECT slug, ord, 'b' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') AS id, original_page, pdf_page FROM chunk")
def located_results(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk meets the page map, by ids of five digits and more."""
    chunks = tables.chunks(spark, d)
    results = chunks.select("slug", "ord", F.lit(None).cast("string").alias("anchor"), F.concat(F.lit("/x/#"), T.block_id(F.col("ord"))).alias("url"))
    return search.located(results, index.page_map(chunks)).select("slug", "ord", "id", "original_page", "pdf_page")


@query(
    """WITH block AS (SELECT l_orderkey AS slug, l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS priority, l_returnflag || l_linenumber AS text FROM lineitem)
    SELECT i.slug, i.ord, arg_min(b.text, b.priority * 1000 + abs(b.ord - i.ord) * 100 + b.ord) AS caption FROM block i JOIN block b ON b.slug = i.slug AND abs(b.ord - i.ord) BETWEEN 1 AND 3 WHERE i.priority IS NULL AND b.priority IS NOT NULL GROUP BY i.slug, i.ord"""
)
def nearest_caption(spark: SparkSession, d: str) -> DataFrame:
    """The caption near an image with the least priority * 10 + distance."""
    flag = F.col("l_returnflag")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("ord"), F.when(flag == "A", 1).when(flag == "R", 2).alias("priority"), F.concat(flag, F.col("l_linenumber").cast("string")).alias("text"))
    return outline.captions(rows, rows.where("priority is null"))


#: All passes over all works, one after the other: what is there once, by parts, by grams near the anchors, nearby, inherited.
_ALIGNED = """, row AS (SELECT slug, item_id + 1 AS ord, needle, length(needle) AS n, (SELECT max(page_no) FROM page p WHERE p.slug = work.slug) AS last_page FROM item, work),
hit AS (SELECT slug, ord, CASE WHEN instr(substring(hay, p + 1), needle) > 0 THEN 2 ELSE 1 END AS hits, p - 1 AS pos FROM (SELECT slug, ord, needle, hay, instr(hay, needle) AS p FROM row JOIN work USING (slug) WHERE n >= 12) WHERE p > 0),
piece AS (SELECT DISTINCT slug, ord, o, substring(needle, o::BIGINT + 1, w) AS piece FROM (SELECT *, unnest([0, n // 4, n // 2, greatest(0, n - w)]) AS o FROM (SELECT *, least(48, greatest(20, n // 2)) AS w FROM row ANTI JOIN hit USING (slug, ord) WHERE n >= 18))),
print AS (SELECT slug, ord, min(greatest(0, instr(hay, piece) - 1 - o)) AS pos FROM piece JOIN work USING (slug) WHERE length(piece) >= 16 AND contains(hay, piece) GROUP BY slug, ord),
place AS (SELECT slug, ord, 'exact' AS m, pos FROM hit WHERE hits = 1 UNION ALL SELECT slug, ord, 'fingerprint', pos FROM print),
one AS (SELECT row.*, coalesce(m, 'unmapped') AS m, (SELECT max(page_no) FROM starts s WHERE s.slug = row.slug AND s.start <= pos AND s.txt <> '') AS page FROM row LEFT JOIN place USING (slug, ord)),
near1 AS (SELECT *, last_value(CASE WHEN m <> 'unmapped' THEN {'o': ord, 'p': page} END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(CASE WHEN m <> 'unmapped' THEN {'o': ord, 'p': page} END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM one),
open1 AS (SELECT slug, ord, needle, coalesce(a.p + (b.p - a.p) * (ord - a.o) / (b.o - a.o), a.p, b.p, 1)::DOUBLE AS target, greatest(1, least(coalesce(a.p, 1), coalesce(b.p, last_page)) - 2) AS lo, least(last_page, greatest(coalesce(a.p, 1), coalesce(b.p, last_page)) + 2) AS hi FROM near1 WHERE m = 'unmapped' AND n >= 12),
mine AS (SELECT slug, ord, target, lo, hi, len(g) AS total, unnest(g) AS gram FROM (SELECT *, list_distinct(list_transform(range(1, length(needle) - 4), lambda i: substring(needle, i, 6))) AS g FROM open1)),
there AS (SELECT DISTINCT slug, page_no, gram FROM (SELECT slug, page_no, substring(txt, i, 6) AS gram FROM (SELECT slug, page_no, txt, unnest(range(1, length(txt) - 4)) AS i FROM page)) SEMI JOIN mine USING (gram)),
score AS (SELECT slug, ord, page_no, count(*) / first(total) AS score, first(target) AS target FROM mine JOIN there USING (slug, gram) WHERE page_no BETWEEN lo AND hi GROUP BY slug, ord, page_no),
fuzzy AS (SELECT slug, ord, page_no FROM score QUALIFY row_number() OVER (PARTITION BY slug, ord ORDER BY score DESC, abs(page_no - target), page_no) = 1 AND score >= 0.24),
two AS (SELECT one.slug, one.ord, needle, n, last_page, CASE WHEN f.page_no IS NOT NULL THEN 'fuzzy' ELSE m END AS m, coalesce(f.page_no, page) AS page FROM one LEFT JOIN fuzzy f USING (slug, ord)),
near2 AS (SELECT *, last_value(CASE WHEN m <> 'unmapped' THEN {'o': ord, 'p': page} END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(CASE WHEN m <> 'unmapped' THEN {'o': ord, 'p': page} END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM two),
open2 AS (SELECT slug, ord, needle, n, coalesce(a.p + (b.p - a.p) * (ord - a.o) / (b.o - a.o), a.p, b.p, 1)::DOUBLE AS target, greatest(1, least(coalesce(a.p, 1), coalesce(b.p, last_page)) - 2) AS lo, least(last_page, greatest(coalesce(a.p, 1), coalesce(b.p, last_page)) + 2) AS hi, coalesce(b.p, a.p) AS heir FROM near2 WHERE m = 'unmapped'),
inside AS (SELECT slug, ord, arg_min(page_no, {'d': abs(page_no - target), 'p': page_no}) AS page_no FROM open2 JOIN page USING (slug) WHERE n > 0 AND page_no BETWEEN lo AND hi AND contains(txt, needle) GROUP BY slug, ord)
SELECT slug, ord, CASE WHEN m <> 'unmapped' THEN page ELSE coalesce(i.page_no, heir) END::INT AS pdf_page, CASE WHEN m <> 'unmapped' THEN m WHEN i.page_no IS NOT NULL AND two.n >= 12 THEN 'exact' WHEN coalesce(i.page_no, heir) IS NOT NULL THEN 'inherited' ELSE 'unmapped' END AS alignment
FROM two LEFT JOIN open2 USING (slug, ord) LEFT JOIN inside i USING (slug, ord)"""


@query(PAGES.rstrip() + _ALIGNED)
def align_items(spark: SparkSession, d: str) -> DataFrame:
    """All alignment passes, with every item as a chunk of each of the twenty works."""
    works = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("src"), k.cast("string")))
    items = read(spark, d, "benchmark").select(F.explode(works).alias("slug"), (F.col("item_id") + 1).alias("ord"), F.lit("").alias("original_page"), "text")
    return align.align(items, tables.pages(spark, d)).select("slug", "ord", "pdf_page", "alignment")
