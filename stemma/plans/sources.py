"""Queries of file formats and addresses, on files and rows that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import catalogue as C
from stemma.functions import text as T
from stemma.plans.registry import query
from stemma.plans.tables import read
from stemma.sources import formats, sinks, storage

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(spark: SparkSession, d: str) -> str:
    """A folder of DOCX files of ten documents each: a marker paragraph a document, in a style of its own for every other one, and its lines."""
    plain = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}., ]+", " "))
    p = lambda text, style="": F.concat(F.lit(f"<w:p>{style}<w:r><w:t>"), text, F.lit("</w:t></w:r></w:p>"))
    marker = F.concat(F.lit("〔出所 "), F.col("doc_id").cast("string"), F.lit("〕"))
    styled = p(marker, '<w:pPr><w:pStyle w:val="s1"/></w:pPr>')
    said = F.concat(F.when(F.col("doc_id") % 2 == 0, styled).otherwise(p(marker)), F.array_join(F.transform(plain, lambda x: p(x)), ""))
    docs = read(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).cast("string").alias("k"), said.alias("said"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "said"))), lambda s: s.said), "")  # ten documents
    files = docs.groupBy("k").agg(body.alias("body"))
    styles = F.lit(f'<w:styles xmlns:w="{_W}"><w:style w:styleId="s1"><w:name w:val="Source Page"/></w:style></w:styles>')
    notes = F.concat(F.lit(f'<w:footnotes xmlns:w="{_W}">'), p(F.concat(F.lit("note "), "k")), F.lit("</w:footnotes>"))
    member = lambda n, name, content: F.struct(F.lit(n).alias("n"), F.lit(name).alias("member"), F.encode(content, "UTF-8").alias("content"))
    document = F.concat(F.lit(f'<w:document xmlns:w="{_W}"><w:body>'), "body", F.lit("</w:body></w:document>"))
    rows = files.select("k", F.explode(F.array(member(1, "word/document.xml", document), member(2, "word/styles.xml", styles), member(3, "word/footnotes.xml", notes))).alias("m"))
    folder = sinks.scratch(spark, "docx")
    storage.write_files(rows.select(F.concat(F.lit("k"), "k", F.lit(".docx")).alias("file"), "m.*", F.lit(False).alias("stored")), storage.Archives, folder, "n")
    return folder


@query(
    r"""WITH line AS (SELECT 'k' || doc_id // 10 AS slug, doc_id * 2 AS a, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS text FROM documents),
    said AS (SELECT slug, a, i, trim(regexp_replace(text, '[^\p{L}\p{N}., ]+', ' ', 'g')) AS text FROM line UNION ALL SELECT 'k' || doc_id // 10, doc_id * 2 - 1, 0, CASE WHEN doc_id % 2 = 0 THEN '〔出所 ' || doc_id || '〕' ELSE '〔' || chr(57344) || '出所 ' || doc_id || '〕' END FROM documents
      UNION ALL SELECT 'k' || k, 1000000000000, n, CASE n WHEN 0 THEN '原注' ELSE 'note ' || k END FROM (SELECT DISTINCT doc_id // 10 AS k FROM documents), range(2) t(n))
    SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY a, i) AS para_no, length(text) AS n, sha256(text) AS sha256 FROM said WHERE text <> ''"""
)
def docx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of DOCX files, with styles that make markers count, and notes at the end."""
    files = formats.read_files(spark, _docx(spark, d)).select(F.regexp_extract("path", "([^/]*)[.]docx$", 1).alias("slug"), "content")
    out = formats.docx_paragraphs(files)
    return out.select("slug", F.col("para_no").cast("long").alias("para_no"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha256"))


@query(
    """WITH part AS (SELECT doc_id AS slug, string_split(replace(text, chr(10), chr(12)) || CASE WHEN doc_id % 2 = 0 THEN chr(12) || '  ' ELSE '' END, chr(12)) AS p FROM documents),
    page AS (SELECT slug, unnest(range(1, len(p) + 1)) AS page_no, unnest(p) AS text, len(p) AS n, p[-1] AS last FROM part)
    SELECT slug, page_no, sha256(text) AS sha256 FROM page WHERE NOT (page_no = n AND trim(last) = '')"""
)
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a work's text, which form feeds end; a blank last one goes."""
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\f")), F.when(F.col("doc_id") % 2 == 0, "\f  ").otherwise(""))
    rows = formats.page_rows(read(spark, d, "documents").select(F.col("doc_id").alias("slug"), text.alias("page_text")))
    return rows.select("slug", F.col("page_no").cast("long").alias("page_no"), F.sha2("text", 256).alias("sha256"))


@query(
    r"""WITH line AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no, unnest(string_split(text, chr(10))) AS text FROM documents),
    page AS (SELECT doc_id, page_no, CASE WHEN doc_id % 4 = 0 THEN ' -- ' ELSE text END AS text, 'scan ' || text AS scan FROM line),
    has AS (SELECT doc_id, max(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) > 0 AS own FROM page GROUP BY doc_id)
    SELECT doc_id AS slug, page_no, sha256(CASE WHEN own THEN text ELSE scan END) AS sha256, CASE WHEN own THEN 'text' ELSE 'scanned' END AS mode FROM page JOIN has USING (doc_id)"""
)
def scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """The text of pages, or of their scans where a work has no text at all."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    slug, number = F.col("doc_id").alias("slug"), (F.col("i") + 1).cast("long").alias("page_no")
    pages = lines.select(slug, number, F.when(F.col("doc_id") % 4 == 0, " -- ").otherwise(F.col("line")).alias("text"))
    out = formats.text_or_scanned(pages, lines.select(slug, number, F.concat(F.lit("scan "), "line").alias("text")))
    return out.select("slug", "page_no", F.sha2("text", 256).alias("sha256"), "mode")


@query(
    r"""WITH pair AS (SELECT doc_id, unnest(range(1, len(l))) AS n, unnest(l[:len(l) - 1]) AS a, unnest(l[2:]) AS b FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 0 THEN x || '-  ' ELSE x || ' ' END) AS l FROM documents)),
    joint AS (SELECT *, CASE WHEN regexp_matches(a, '[-‐]\s*$') THEN '' WHEN regexp_matches(a, '[A-Za-z0-9][,.;:]?\s*$') AND regexp_matches(b, '^\s*[A-Za-z0-9]') AND length(regexp_extract(a, '(\S+)\s*$', 1)) > 1 THEN ' ' ELSE '' END AS j FROM pair)
    SELECT doc_id, n, sha256(regexp_replace(a, '\s+$', '') || j || regexp_replace(b, '^\s+', '')) AS sha256 FROM joint"""
)
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the next, by the rules for hyphens and scripts."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(x, F.when((i + 1) % 4 == 0, "-  ").otherwise(" ")))
    docs = read(spark, d, "documents").select("doc_id", lines.alias("l"))
    pairs = docs.select("doc_id", F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l")).alias("b"))).alias("i", "p"))
    return pairs.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), F.sha2(T.join_lines(F.col("p.a"), F.col("p.b")), 256).alias("sha256"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Events as blocks of the EPUB documents of their users."""
    v = F.round(F.col("value") * 100).cast("long")
    head = v % 4 == 0
    text = F.when(head, F.when(v % 8 == 0, "底本").otherwise("章")).when(v % 5 < 2, "原資料頁 5").when(v % 5 == 2, "〔原刊 p. 3〕 x").otherwise(F.concat(F.lit("t"), F.col("event_id").cast("string")))
    return read(spark, d, "events").select(F.col("user_id").alias("slug"), F.floor(F.col("event_id") / 300).alias("document"), F.col("event_id").alias("para_no"), F.when(head, "h2").otherwise("p").alias("tag"), text.alias("text"))


@query(
    """WITH event AS (SELECT *, round(value * 100)::BIGINT AS v FROM events),
    block AS (SELECT user_id AS slug, event_id // 300 AS document, event_id AS i, v % 4 = 0 AS head, CASE WHEN v % 8 = 0 THEN '底本' WHEN v % 4 = 0 THEN '章' WHEN v % 5 < 2 THEN '原資料頁 5' WHEN v % 5 = 2 THEN '〔原刊 p. 3〕 x' ELSE 't' || event_id END AS text FROM event),
    seen AS (SELECT *, bool_and(text = '原資料頁 5') OVER (PARTITION BY slug, document) AS picture, coalesce(last_value(CASE WHEN head THEN CASE WHEN text = '底本' THEN 'skip' ELSE 'go' END WHEN text LIKE '〔%' THEN 'go' END IGNORE NULLS) OVER (PARTITION BY slug, document ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'go') AS state FROM block)
    SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY i) AS para_no, text FROM seen WHERE NOT picture AND state = 'go'"""
)
def epub_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are but facsimiles, and sections about the edition, are left out."""
    out = formats.paragraphs_of(_blocks(spark, d))
    return out.select("slug", F.col("para_no").cast("long").alias("para_no"), "text")


def _state() -> dict[str, Column]:
    k, size = F.col("p_partkey"), F.col("p_size")
    empty = F.lit("")
    return {
        "q": F.when(k % 3 == 0, empty).otherwise(F.col("p_name")), "type": F.when(k % 4 == 0, F.col("p_type")).otherwise(empty), "region": F.when(k % 5 == 0, "メキシコ").otherwise(empty),
        "language": F.when(k % 6 == 0, "L2").otherwise(empty), "era": F.when(k % 7 == 0, "19世紀前半").otherwise(empty), "sort": F.when(k % 2 == 0, "year-asc").otherwise("title"),
        "perPage": F.when(size % 3 == 0, "12").when(size % 3 == 1, "24").otherwise("all"), "page": size % 4,
    }


_CODE = "replace(url_encode({0}), '%20', '+')"


@query(
    f"""WITH state AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'a b' END AS f, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS q, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '' END AS t, CASE WHEN p_partkey % 5 = 0 THEN 'メキシコ' ELSE '' END AS r, CASE WHEN p_partkey % 6 = 0 THEN 'L2' ELSE '' END AS l, CASE WHEN p_partkey % 7 = 0 THEN '19世紀前半' ELSE '' END AS e, CASE WHEN p_partkey % 2 = 0 THEN 'year-asc' ELSE 'title' END AS s, CASE p_size % 3 WHEN 0 THEN '12' WHEN 1 THEN '24' ELSE 'all' END AS n, p_size % 4 AS page FROM part),
    query AS (SELECT *, array_to_string(list_filter([CASE WHEN f IS NOT NULL THEN 'fulltext=' || {_CODE.format('f')} END, CASE WHEN q <> '' THEN 'q=' || {_CODE.format('q')} END, CASE WHEN t <> '' THEN 'type=' || {_CODE.format('t')} END, CASE WHEN r <> '' THEN 'region=' || {_CODE.format('r')} END, CASE WHEN l <> '' THEN 'language=' || l END, CASE WHEN e <> '' THEN 'era=' || {_CODE.format('e')} END, CASE WHEN s <> 'year-asc' THEN 'sort=' || s END, CASE WHEN n <> '12' THEN 'perPage=' || n END, CASE WHEN page > 1 THEN 'page=' || page END], lambda x: x IS NOT NULL), '&') AS x FROM state)
    SELECT k, '/archive/' || CASE WHEN x <> '' THEN '?' || x ELSE '' END || CASE WHEN k % 10 = 0 THEN '#list' ELSE '' END AS url, q || '|' || t || '|' || r || '|' || l || '|' || e || '|' || s || '|' || n || '|' || greatest(page, 1) AS state FROM query"""
)
def catalogue_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The address of what a reader has asked for, and that read back from it."""
    k = F.col("p_partkey")
    before = F.concat(F.lit("/archive/"), F.when(k % 9 == 0, "?fulltext=a+b&page=7").otherwise("?q=old"), F.when(k % 10 == 0, "#list").otherwise(""))
    rows = read(spark, d, "part").select(k.alias("k"), C.address(before, _state()).alias("url"))
    return rows.select("k", "url", F.concat_ws("|", *[C.asked(F.col("url"), n) for n in C.PARAMETERS]).alias("state"))
