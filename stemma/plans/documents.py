"""Queries of annotation, sources, sinks and integrity checks, over documents that are made from the test tables.

The same documents are made in DuckDB; what is expected of them is said in SQL by how they were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import markers as M
from stemma.functions import text as T
from stemma.operators import align, annotate, catalogue, index, integrity, search
from stemma.plans import tables
from stemma.plans.registry import query
from stemma.plans.tables import CHUNKS, PUBLICATIONS, read
from stemma.sources import formats, sinks


def _k() -> Column:
    return F.col("o_orderkey")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders")


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---------------------------------------------------------------- markers and paragraphs


def _marked(k: Column) -> Column:
    """A paragraph with a marker of one of seven kinds, by k."""
    kinds = [
        _said("a 〔原刊 p. ", k % 90, "〕 b"),
        _said("a 〔原刊 p. X〕 b"),
        _said("a 〔出所 文書館〕 b"),
        _said("a {{SOURCE: 館 p. ", k % 80, "}} b"),
        _said("a 〔PMM 12, f. ", k % 70, "r。注記〕 b"),
        _said("a 〔別の注〕 b 〔原写本 p. ", k % 60, "〕 c"),
        _said("a b"),
    ]
    out = kinds[0]
    for i in range(1, len(kinds)):
        out = F.when(k % 7 == i, kinds[i]).otherwise(out)
    return out


_PLACE = "CASE o_orderkey % 7 WHEN 0 THEN '原刊 p. ' || o_orderkey % 90 WHEN 3 THEN '出所 館 p. ' || o_orderkey % 80 WHEN 4 THEN 'PMM 12, f. ' || o_orderkey % 70 || 'r' WHEN 5 THEN '原写本 p. ' || o_orderkey % 60 END"


@query(
    f"SELECT o_orderkey AS id, {_PLACE} AS place, CASE WHEN o_orderkey % 7 = 6 THEN 0 ELSE 1 END::BIGINT AS markers, o_orderkey % 7 = 1 AS placeholder, CASE WHEN o_orderkey % 7 = 4 THEN '注記' END AS note FROM orders"
)
def markers_found(spark: SparkSession, d: str) -> DataFrame:
    """Markers in running text, the first that names a place, placeholders and notes."""
    text = _marked(_k())
    found, first = M.markers(text), M.first_concrete(text)
    placeholder = F.exists(found, lambda m: M.is_placeholder(m) & M.is_location(m))
    note = F.try_element_at(F.filter(F.transform(found, M.note), lambda n: n.isNotNull()), F.lit(1))
    return _orders(spark, d).select(_k().alias("id"), M.label(first).alias("place"), F.size(found).cast("long").alias("markers"), placeholder.alias("placeholder"), note.alias("note"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as paragraphs of the works of their customers."""
    return _orders(spark, d).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("slug"), _k().alias("para_no"), _marked(_k()).alias("text"))


@query(
    f"""WITH marked AS (SELECT 'c' || o_custkey AS slug, o_orderkey, {_PLACE} AS place FROM orders),
    piece AS (SELECT slug, o_orderkey, 0 AS part, 0 AS step, NULL AS place, CASE WHEN o_orderkey % 7 = 5 THEN 'a 〔別の注〕 b' WHEN place IS NOT NULL THEN 'a' WHEN o_orderkey % 7 = 2 THEN 'a 〔出所 文書館〕 b' WHEN o_orderkey % 7 = 1 THEN 'a b' ELSE 'a b' END AS text FROM marked
      UNION ALL SELECT slug, o_orderkey, 0, 1, place, CASE WHEN o_orderkey % 7 = 4 THEN '訳注　注記' END FROM marked WHERE place IS NOT NULL
      UNION ALL SELECT slug, o_orderkey, 1, 0, NULL, CASE WHEN o_orderkey % 7 = 5 THEN 'c' ELSE 'b' END FROM marked WHERE place IS NOT NULL),
    placed AS (SELECT *, coalesce(last_value(place IGNORE NULLS) OVER (PARTITION BY slug ORDER BY o_orderkey, part, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '底本位置なし（前付）') AS original_page FROM piece)
    SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY o_orderkey, part, step) AS seq, original_page, text FROM placed WHERE text IS NOT NULL"""
)
def annotated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs fall apart at markers, and each row has the place of the last one."""
    return annotate.annotated(_paragraphs(spark, d))


@query(
    """WITH para AS (SELECT 'c' || o_custkey AS slug, o_orderkey AS para_no, CASE WHEN o_custkey % 4 = 1 AND o_orderkey % 5 = 2 THEN '## 日本語全訳' WHEN o_custkey % 4 = 2 AND o_orderkey % 5 = 3 THEN '# 原刊表紙' WHEN o_custkey % 3 <> 0 AND o_orderkey % 5 = 4 THEN 'x 〔原刊 p. 3〕' ELSE 'plain' END AS text FROM orders),
    pos AS (SELECT *, min(CASE WHEN text LIKE '##%' THEN para_no END) OVER w AS h, min(CASE WHEN text LIKE '# %' THEN para_no END) OVER w AS f, min(CASE WHEN text LIKE 'x%' THEN para_no END) OVER w AS m FROM para WINDOW w AS (PARTITION BY slug))
    SELECT slug, para_no, text FROM pos WHERE para_no >= CASE WHEN h IS NOT NULL AND (m IS NULL OR h <= m) THEN h + 1 WHEN f IS NOT NULL AND (m IS NULL OR f <= m) THEN f ELSE coalesce(m, 0) END"""
)
def trimmed_rows(spark: SparkSession, d: str) -> DataFrame:
    """works from their heading, their front matter or their first marker on."""
    c = F.col("o_custkey")
    text = F.when((c % 4 == 1) & (_k() % 5 == 2), "## 日本語全訳").when((c % 4 == 2) & (_k() % 5 == 3), "# 原刊表紙").when((c % 3 != 0) & (_k() % 5 == 4), "x 〔原刊 p. 3〕").otherwise("plain")
    return annotate.trimmed(_orders(spark, d).select(_said("c", c).alias("slug"), _k().alias("para_no"), text.alias("text")))


@query(
    """SELECT 'o' || o_orderkey AS slug, unnest([1, 2, 3, 4, 5, 6])::INT AS para_no, unnest(['## h' || o_orderkey, 'plain a plain b' || o_orderkey % 10, 'c　d' || o_orderkey % 7, 'code 1 code 2', '〔原刊 p. ' || o_orderkey || '〕 x', 'last']) AS text FROM orders"""
)
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    """S3: headings, lines of one paragraph, table rows, rules, fences and marker lines of a Markdown file a row."""
    text = _said("## h", _k(), "\n\nplain a\n  plain b", _k() % 10, "  \n\n| c | d", _k() % 7, " |\n|---|---|\n```\ncode 1\ncode 2\n```\n\n〔原刊 p. ", _k(), "〕 x\r\nlast\n")
    # A marker is where a work begins if it has no heading, so the work gets one.
    return formats.markdown_paragraphs(_orders(spark, d).select(_said("o", _k()).alias("slug"), F.concat(F.lit("before\n## 日本語全訳\n"), text).alias("text")))


@query("SELECT o_custkey AS slug, o_orderkey AS page_no, CASE o_orderkey % 3 WHEN 0 THEN '原刊 p. ' || o_orderkey % 50 || '|原刊 p. 7' WHEN 1 THEN '原資料頁 ' || o_orderkey % 40 ELSE '' END AS labels FROM orders WHERE o_orderkey % 50 <> 7 OR o_orderkey % 3 <> 0")
def page_label_rows(spark: SparkSession, d: str) -> DataFrame:
    """A10: the labels of each page, markers and page lines, in order."""
    text = F.when(_k() % 3 == 0, _said("〔原刊 p. ", _k() % 50, "〕 a 〔出所 館〕 〔原刊 p. 7〕")).when(_k() % 3 == 1, _said("x\n原資料頁 ", _k() % 40, "\ny")).otherwise("no label")
    pages = _orders(spark, d).where((_k() % 50 != 7) | (_k() % 3 != 0)).select(F.col("o_custkey").alias("slug"), _k().alias("page_no"), text.alias("text"))
    return align.page_labels(pages).select("slug", "page_no", F.array_join("labels", "|").alias("labels"))


@query(
    "SELECT o_custkey AS slug, o_orderkey AS ord, o_orderkey AS pdf_page, CASE WHEN o_orderkey % 3 = 0 THEN '原刊 p. ' || o_orderkey % 50 WHEN o_orderkey % 3 = 1 THEN '原資料頁 ' || o_orderkey % 40 ELSE 'own' END AS original_page FROM orders"
)
def relabelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The labels of a chunk's page replace its own."""
    text = F.when(_k() % 3 == 0, _said("〔原刊 p. ", _k() % 50, "〕 a")).when(_k() % 3 == 1, _said("x\n原資料頁 ", _k() % 40, "\ny")).otherwise("no label")
    orders = _orders(spark, d)
    pages = orders.select(F.col("o_custkey").alias("slug"), _k().alias("page_no"), text.alias("text"))
    chunks = orders.select(F.col("o_custkey").alias("slug"), _k().alias("ord"), _k().alias("pdf_page"), F.lit("own").alias("original_page"))
    return align.relabelled(chunks, pages).select("slug", "ord", "pdf_page", "original_page")


@query("SELECT c_custkey AS id, 'x' || c_custkey || ' bold link ' || c_mktsegment || ' a_b & c' AS text FROM customer")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes, emphasis, links, images, tags and references of a line of Markdown."""
    key, name = F.col("c_custkey"), F.col("c_mktsegment")
    prefix = F.element_at(F.array(*map(F.lit, ("", "## ", "- ", "3. ", "> "))), (key % 5 + 1).cast("int"))
    line = F.concat(prefix, _said("x", key, " **bold**  [link](http://h/x) <b>"), name, F.lit("</b> a_b &amp; *c*"))
    return read(spark, d, "customer").select(key.alias("id"), T.clean_inline(line).alias("text"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '190,61' WHEN 1 THEN '151,100' WHEN 2 THEN (o_orderkey % 190 + 1)::VARCHAR ELSE '190,190,190,31' END AS lengths FROM orders"""
)
def long_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences beyond the limit are cut after a clause mark near it, or at it."""
    run = lambda c, n: F.repeat(F.lit(c), n if isinstance(n, Column) else F.lit(n))
    mark = F.lit("、")
    text = F.when(_k() % 4 == 0, F.concat(run("x", 200), mark, run("y", 50))).when(_k() % 4 == 1, F.concat(run("x", 150), mark, run("y", 100)))
    text = text.when(_k() % 4 == 2, run("x", (_k() % 190 + 1).cast("int"))).otherwise(F.concat(run("x", 100), mark, run("y", 500)))
    return _orders(spark, d).select(_k().alias("id"), F.array_join(F.transform(T.pieces(text), lambda p: F.length(p).cast("string")), ",").alias("lengths"))


@query(
    """SELECT conv_id AS slug, turn AS ord, CASE WHEN turn % 2 = 1 THEN '〔p. ' || (turn - 1) || '〕' ELSE '' END || 'n' AS text FROM conversations"""
)
def footnote_rows(spark: SparkSession, d: str) -> DataFrame:
    """Notes get the place of the anchor that their link leads to."""
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("slug"), F.col("turn").alias("ord"))
    t = F.col("ord")
    notes = turns.select("slug", "ord", F.lit("O/n.xhtml").alias("member"), F.when(t % 2 == 1, _said("../O/a.xhtml#r", t - 1)).otherwise(F.lit("a.xhtml#none")).alias("href"), F.lit("n").alias("text"))
    anchors = turns.where("ord % 2 = 0").select("slug", F.lit("O/a.xhtml").alias("member"), _said("r", t).alias("fragment"), _said("p. ", t).alias("original_page"))
    return annotate.footnote_places(notes, anchors).select("slug", "ord", "text")


@query("SELECT o_orderkey AS id, 'é-•□'.replace('é', 'é') || o_orderkey AS text FROM orders")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text as page descriptions have it, composed, with wrongly coded glyphs repaired."""
    raw = _said("é­~~  \u0000□", _k())
    return _orders(spark, d).select(_k().alias("id"), T.page_text(T.repaired(raw, {"~": "?", "~~": "-", "  \u0000": "•"})).alias("text"))


@query("SELECT page_id, (page_id % 5 + 2)::BIGINT AS images, 2::BIGINT AS without_text FROM pages")
def image_texts(spark: SparkSession, d: str) -> DataFrame:
    """Images of a page, and those without words."""
    k = F.col("page_id")
    added = F.concat(F.repeat(F.lit("<p><img src='a.png' alt='a map'></p>"), (k % 5).cast("int")), F.lit('<IMG src="b.png"><img alt=" " src="c.png"/>'))
    html = F.concat(F.regexp_replace("html", "(?i)<img", "<i-m-g"), added)
    return read(spark, d, "pages").select("page_id", T.images(html).cast("long").alias("images"), T.images_without_text(html).cast("long").alias("without_text"))


# ---------------------------------------------------------------- index and sinks


@query(CHUNKS + "SELECT count(DISTINCT slug) AS works, count(DISTINCT slug) FILTER (record_class = 'major-work') AS books, count(DISTINCT slug) FILTER (record_class <> 'major-work') AS papers, count(DISTINCT (slug, pdf_page)) AS parts, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunk")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of an index with a part a page."""
    chunks = tables.chunks(spark, d)
    return index.totals(chunks, chunks.select("slug", "pdf_page").distinct(), chunks.select("slug", "record_class").distinct())


@query(CHUNKS + "SELECT DISTINCT 'ja_' || pdf_page AS part_id, '[\"' || slug || '\",\"' || record_class || '\",' || pdf_page || ']' AS mapping, '/__fulltext/' || slug || '/part-' || lpad(pdf_page::VARCHAR, greatest(4, length(pdf_page::VARCHAR))::INT, '0') || '/' AS url FROM chunk")
def document_map(spark: SparkSession, d: str) -> DataFrame:
    """Fragments and what they stand for, and their addresses."""
    parts = tables.chunks(spark, d).select(F.concat(F.lit("ja_"), F.col("pdf_page").cast("string")).alias("part_id"), "slug", "record_class", F.col("pdf_page").alias("part_index")).distinct()
    return sinks.document_map(parts, index.document_url("slug", "part_index").alias("url")).distinct()


@query(
    PUBLICATIONS
    + """SELECT slug, '{"@context":"https://schema.org","@type":"' || CASE WHEN record_class = 'major-work' THEN 'Book' ELSE 'ScholarlyArticle' END || '","name":"' || title || ' \\u003cb\\u003e","author":{"@type":"Person","name":"' || author || '"},"dateModified":"2020-01-02"}' AS json_ld FROM pub"""
)
def structured_data(spark: SparkSession, d: str) -> DataFrame:
    """H1, m4: JSON-LD that can stand in a script element."""
    pubs = tables.publications(spark, d)
    return sinks.structured_data(pubs.withColumn("title", F.concat("title", F.lit(" <b>"))).withColumn("updated", F.to_date(F.lit("2020-01-02"))))


@query(PUBLICATIONS + "SELECT 'pdf/' || slug || '/a b.pdf' AS path, 'https://h/pdf/' || slug || '/a%20b.pdf' AS url, size, sha256(slug) AS sha256 FROM pub")
def asset_manifest(spark: SparkSession, d: str) -> DataFrame:
    """K5: files with their encoded addresses."""
    files = tables.publications(spark, d).select(F.concat(F.lit("file:/data/in/pdf/"), "slug", F.lit("/a b.pdf")).alias("path"), "size", F.sha2("slug", 256).alias("sha256"))
    return sinks.asset_manifest(files, "/data/in", "https://h/")


@query(PUBLICATIONS + "SELECT path, row_number() OVER (ORDER BY path) AS n FROM (SELECT DISTINCT unnest(['Cover/' || author_key, 'pdf/' || slug, 'epub/' || slug]) AS path FROM pub)")
def asset_order(spark: SparkSession, d: str) -> DataFrame:
    """The paths that a manifest must list, each once, in the order of their code units."""
    pubs = tables.publications(spark, d)
    rows = pubs.select(F.concat(F.lit("Cover/"), "author_key").alias("cover"), F.concat(F.lit("pdf/"), "slug").alias("pdf"), F.concat(F.lit("epub/"), "slug").alias("epub"))
    return catalogue.required_paths(rows).select("path", F.col("n").cast("long").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN s >= 1048576 THEN printf('%.1f MB', floor(s / 1048576 * 10 + 0.5) / 10) ELSE floor(s / 1024 + 0.5)::BIGINT || ' KB' END AS size, '書籍 ' || o_orderkey % 9 || '冊・論文 ' || o_orderkey % 4 || '篇が該当' AS label FROM (SELECT o_orderkey, (o_orderkey * 1024 * 7 // 2 + 512)::BIGINT AS s FROM orders)")
def result_labels(spark: SparkSession, d: str) -> DataFrame:
    """P3, m1: what a reader is told of results and of downloads."""
    size = F.floor(_k() * 1024 * 7 / 2).cast("long") + 512
    return _orders(spark, d).select(_k().alias("id"), T.download_size(size).alias("size"), search.result_label(_k() % 9, _k() % 4).alias("label"))


@query("SELECT 'https://h/?lang=ja' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '&fulltext=a+' || o_orderkey || '%26b' END || '#top' AS url, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a ' || o_orderkey || '&b' END AS query FROM orders")
def search_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The query in a page's address, put in, taken out and read back."""
    asked = F.when(_k() % 3 == 0, "").otherwise(_said("a ", _k(), "&b"))
    url = search.with_query(F.lit("https://h/?lang=ja&fulltext=old+one#top"), asked)
    return _orders(spark, d).select(url.alias("url"), search.query_of(url).alias("query"))


# ---------------------------------------------------------------- integrity


@query(
    """SELECT 'asset-missing' AS "check", 'pdf/' || p_partkey AS key FROM part WHERE p_partkey % 40 = 3 UNION ALL SELECT 'asset-unknown', 'old/' || p_partkey FROM part WHERE p_partkey % 40 = 4"""
)
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """A manifest that lacks some files and lists others that nobody needs. The total is right, as many lack as are too many in a table of whole forties."""
    k = F.col("p_partkey")
    part = read(spark, d, "part")
    pubs = part.select(_said("cover/", k).alias("cover"), _said("pdf/", k).alias("pdf"), _said("epub/", k).alias("epub"))
    assets = part.select(F.explode(F.array(_said("cover/", k), F.when(k % 40 != 3, _said("pdf/", k)), _said("epub/", k), F.when(k % 40 == 4, _said("old/", k)))).alias("path")).where("path is not null")
    return integrity.manifest(pubs, assets).where(F.col("check") != "asset-count").select("check", "key")


@query(
    """SELECT * FROM (SELECT unnest(['fragment-missing', 'shape:part_id', 'size']) AS "check", unnest([CASE WHEN o_orderkey % 50 = 1 THEN 'o' || o_orderkey || '/1' END, CASE WHEN o_orderkey % 50 = 2 THEN 'JA_' || o_orderkey END, CASE WHEN o_orderkey % 50 = 3 THEN 'ja_' || o_orderkey || '0' END]) AS key FROM orders WHERE o_orderkey % 50 IN (1, 2, 3)
    UNION ALL SELECT 'fragment-unknown', 'o' || o_orderkey || '/5' FROM orders WHERE o_orderkey % 50 = 4 UNION ALL SELECT 'sequence', 'o' || o_orderkey FROM orders WHERE o_orderkey % 50 = 4) WHERE key IS NOT NULL"""
)
def fragment_check(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that are missing, unknown, badly named or too large, and gaps in their order."""
    orders = _orders(spark, d)
    numbers = lambda *more: F.explode(F.array(F.lit(0), *more))
    expected = orders.select(_said("o", _k()).alias("slug"), numbers(F.lit(1)).alias("part_index"))
    found = orders.select(_k(), _said("o", _k()).alias("slug"), numbers(F.when(_k() % 50 != 1, 1), F.when(_k() % 50 == 4, 5)).alias("part_index")).where("part_index is not null")
    name = F.concat(F.when((_k() % 50 == 2) & (F.col("part_index") == 0), _said("JA_", _k())).otherwise(_said("ja_", _k(), F.col("part_index"))))
    size = F.when((_k() % 50 == 3) & (F.col("part_index") == 0), 750_001).otherwise(750_000)
    return integrity.fragments(found.select(name.alias("part_id"), "slug", "part_index", size.alias("bytes")), expected).where("key is not null").select("check", "key")


@query(
    """SELECT * FROM (SELECT unnest(['block', 'label', 'page']) AS "check", unnest([CASE WHEN o_orderkey % 60 = 1 THEN 'o' || o_orderkey || '/x1' END, CASE WHEN o_orderkey % 60 = 2 THEN 'o' || o_orderkey || '/b00001' END, CASE WHEN o_orderkey % 60 = 3 THEN 'o' || o_orderkey || '/b00001' END]) AS key FROM orders
    UNION ALL SELECT 'sequence', 'o' || o_orderkey FROM orders WHERE o_orderkey % 60 = 4) WHERE key IS NOT NULL"""
)
def page_map_check(spark: SparkSession, d: str) -> DataFrame:
    """Block ids, labels, pages within the work, and an unbroken order."""
    orders = _orders(spark, d)
    k = _k() % 60
    ids = F.when(k == 1, "x1").otherwise("b00001")
    chunks = orders.select(_said("o", _k()).alias("slug"), ids.alias("id"), F.when(k == 2, "p. 3").otherwise("原刊 p. 3").alias("original_page"), F.when(k == 3, 9).otherwise(2).alias("pdf_page"), F.when(k == 4, 2).otherwise(1).alias("ord"))
    works = orders.select(_said("o", _k()).alias("slug"), F.lit(5).alias("page_count"))
    return integrity.page_map(chunks, works).select("check", "key")


@query(
    """SELECT * FROM (SELECT unnest(['map-url', 'map-pdf', 'map-sha', 'map-master', 'map-mode', 'map-source', 'map-text']) AS "check", unnest([CASE WHEN p_partkey % 70 = 1 THEN p END, CASE WHEN p_partkey % 70 = 2 THEN p END, CASE WHEN p_partkey % 70 = 3 THEN p END, CASE WHEN p_partkey % 70 = 4 THEN p END, CASE WHEN p_partkey % 70 = 5 THEN p END, CASE WHEN p_partkey % 70 IN (6, 7) THEN p END, CASE WHEN p_partkey % 70 = 8 THEN p END]) AS key
    FROM (SELECT p_partkey, 'p-' || p_partkey AS p FROM part)) WHERE key IS NOT NULL"""
)
def page_map_files(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, checksums, masters and modes of page maps."""
    k, slug = F.col("p_partkey") % 70, _said("p-", F.col("p_partkey"))
    part = read(spark, d, "part")
    sha, other = F.sha2(slug, 256), F.sha2(F.lit("x"), 256)
    works = part.select(slug.alias("slug"), _said("/pdf/", slug).alias("pdf_url"), sha.alias("pdf_sha256"), other.alias("epub_sha256"), _said("works/", slug).alias("master_path"))
    maps = part.select(
        slug.alias("slug"),
        F.when(k == 1, "/p/").otherwise(_said("/publications/", slug, "/")).alias("canonical_url"),
        F.when(k == 2, "/old").otherwise(_said("/pdf/", slug)).alias("pdf_url"),
        F.when(k == 3, other).otherwise(sha).alias("pdf_sha256"),
        F.when(k != 4, _said("works/", slug)).alias("master_path"),
        F.when(k == 5, "draft").when(k == 6, "approved-epub-mirror").otherwise("canonical-master").alias("source_mode"),
        F.when(k == 7, "short").otherwise(sha).alias("source_sha256"),
        F.when(k == 8, "none").otherwise("embedded").alias("pdf_text_mode"),
    )
    return integrity.page_map_files(maps, works).select("check", "key")


@query(
    """SELECT * FROM (SELECT unnest(['rate', 'unmapped', 'methods']) AS "check", unnest([CASE WHEN o_orderkey % 30 = 1 THEN k END, CASE WHEN o_orderkey % 30 = 2 THEN k END, CASE WHEN o_orderkey % 30 = 3 THEN k END]) AS key FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k FROM orders)) WHERE key IS NOT NULL"""
)
def alignment_check(spark: SparkSession, d: str) -> DataFrame:
    """Rates that are too low, unmapped chunks, and methods that do not add up."""
    k = _k() % 30
    orders = _orders(spark, d)
    counts = {m: F.lit(0) for m in align.METHODS} | {"exact": F.when(k == 2, 1).otherwise(2), "unmapped": F.when(k == 2, 1).otherwise(0)}
    summary = orders.select(_k().alias("slug"), *[c.alias(m) for m, c in counts.items()], F.lit(0.9).alias("verified_rate"), (k != 1).alias("accepted"))
    blocks = orders.select(_k().alias("slug"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 3).otherwise(2))).alias("ord"))
    return integrity.alignment(summary, blocks).select("check", "key")


@query("SELECT unnest(['version', 'commit', 'manifest', 'counts']) AS \"check\", 'index' AS key FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def freshness_check(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of an index that is out of date, against all works."""
    works = _orders(spark, d).select(_k().alias("slug"), F.when(_k() % 2 == 0, "major-work").otherwise("short-work").alias("record_class"))
    meta = spark.createDataFrame([(2, "abc", "def", 1, 1, 1 << 40)], "schema_version int, archive_commit string, manifest_sha256 string, books long, papers long, chunks long")
    return integrity.freshness(meta, works).select("check", "key")


@query("SELECT 'golden' AS \"check\", o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 20 IN (1, 2)")
def golden_check(spark: SparkSession, d: str) -> DataFrame:
    """Counts of queries that are not what they should be; what is not expected is not checked."""
    orders = _orders(spark, d)
    found = orders.where(_k() % 20 != 1).select(_k().alias("query"), F.when(_k() % 20 == 2, 5).otherwise(4).alias("books"), F.lit(7).alias("papers"), F.lit(9).alias("pages"))
    expected = orders.select(_k().alias("query"), F.lit(4).alias("books"), F.lit(7).alias("papers"), F.when(_k() % 2 == 0, 9).alias("pages"))
    return integrity.golden(found, expected).select("check", "key")


@query(
    """SELECT 'link' AS "check", conv_id || '/O/' || turn || '.xhtml' AS key FROM conversations WHERE conv_id % 7 = turn"""
)
def link_check(spark: SparkSession, d: str) -> DataFrame:
    """H5: links to members that are not in the archive."""
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("slug"), F.col("turn").alias("t"))
    member = _said("O/", F.col("t"), ".xhtml")
    return integrity.unresolved_links(turns.select("slug", member.alias("target")), turns.where("slug % 7 <> t").select("slug", member.alias("member"))).select("check", "key")


@query(
    """SELECT p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'works/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'release/' || p_partkey END AS path FROM part"""
)
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's path of each work, else that of its fallback."""
    k = F.col("p_partkey")
    part = read(spark, d, "part").select(k.alias("slug"))
    s = F.col("slug")
    return integrity.canonical_paths(part, part.where("slug % 3 = 0").select("slug", _said("works/", s).alias("path")), part.where("slug % 3 < 2").select("slug", _said("release/", s).alias("canonical_path")))


@query(
    """SELECT * FROM (SELECT unnest(['fallback-status', 'fallback-commit', 'fallback-sha', 'fallback-size', 'fallback-file', 'fallback-tag']) AS "check", unnest([CASE WHEN p_partkey % 80 = 1 THEN k END, CASE WHEN p_partkey % 80 IN (2, 3) THEN k END, CASE WHEN p_partkey % 80 = 4 THEN k END, CASE WHEN p_partkey % 80 = 5 THEN k END, CASE WHEN p_partkey % 80 = 6 THEN k END, CASE WHEN p_partkey % 80 = 7 THEN k END]) AS key FROM (SELECT p_partkey, p_partkey::VARCHAR AS k FROM part) UNION ALL SELECT 'ledger-fallbacks', 'ledger') WHERE key IS NOT NULL"""
)
def ledger_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of a ledger and of its fallbacks."""
    k = F.col("p_partkey") % 80
    commit = "0123456789abcdef0123456789abcdef01234567"
    rows = read(spark, d, "part").select(
        F.col("p_partkey").alias("slug"),
        F.when(k == 1, "done").otherwise("pending_lfs").alias("status"),
        F.when(k == 2, "0123").when(k == 3, commit[::-1]).otherwise(commit).alias("ledger_commit"),
        F.when(k == 4, "ABC").otherwise(F.sha2(F.lit("x"), 256)).alias("master_sha256"),
        F.when(k == 5, 0).otherwise(10).alias("master_size"),
        F.when(k == 6, "a/b.docx").otherwise("a.docx").alias("master_filename"),
        F.when(k == 7, "v 1").otherwise("v1").alias("release_tag"),
    )
    ledger = spark.createDataFrame([(1, commit)], "schema_version int, archive_commit string")
    return integrity.ledger_shapes(ledger, rows).select("check", "key")
