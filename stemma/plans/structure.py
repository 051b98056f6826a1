"""Queries of words, tables of contents, archives and pages' structure, and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import outline, packages, pages, segment
from stemma.plans import tables
from stemma.plans.registry import query
from stemma.plans.tables import CHUNKS, read
from stemma.sources import sinks, storage

# ---------------------------------------------------------------- words

#: Words of items without white space, by the words of all documents: costs, edges, the best way to each place, and back.
_SEGMENTS = r"""WITH RECURSIVE vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents) GROUP BY word),
total AS (SELECT sum(n)::BIGINT AS total FROM vocab),
cost AS (SELECT word, round(1000 * ln(total / n))::BIGINT AS cost FROM vocab, total WHERE length(word) <= 24),
bare AS (SELECT item_id, regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '[\p{L}\p{N}]+') AS r FROM benchmark),
run AS (SELECT item_id, unnest(range(1, len(r) + 1)) AS run, unnest(r) AS said FROM bare),
place AS (SELECT item_id, run, i, l, lower(substring(said, i, l)) AS word FROM (SELECT *, unnest(range(1, length(said) + 1)) AS i FROM run), range(1, 25) t(l) WHERE i + l - 1 <= length(said)),
edge AS (SELECT item_id, run, i - 1 AS a, i - 1 + l AS z, coalesce(cost, round(1000 * ln(total / 0.5)))::BIGINT AS c FROM total, place LEFT JOIN cost USING (word) WHERE cost IS NOT NULL OR l = 1),
best AS (SELECT item_id, run, 0::BIGINT AS j, [{'c': 0::BIGINT, 'n': 0::BIGINT, 'a': 0::BIGINT}] AS b FROM run
  UNION ALL SELECT item_id, run, j + 1, list_append(any_value(b), min({'c': b[a + 1].c + c, 'n': b[a + 1].n + 1, 'a': a})) FROM best JOIN edge USING (item_id, run) WHERE z = j + 1 GROUP BY item_id, run, j),
way AS (SELECT item_id, run, said, b, length(said) AS z FROM best JOIN run USING (item_id, run) WHERE j = length(said) UNION ALL SELECT item_id, run, said, b, b[z + 1].a FROM way WHERE z > 0),
word AS (SELECT item_id, run, z, substring(said, b[z + 1].a + 1, z - b[z + 1].a) AS w FROM way WHERE z > 0)
"""


def _bare(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace("text", r"\s+", "").alias("text"))


@query(_SEGMENTS + "SELECT item_id, string_agg(w, ' ' ORDER BY run, z) AS words, count(*) AS n FROM word GROUP BY item_id")
def segment_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of items that have lost their spaces, by the words of all documents."""
    words = segment.vocabulary(read(spark, d, "documents").select("text"))
    found = segment.segmented(_bare(spark, d), words)
    return found.select(F.col("id").alias("item_id"), F.array_join("words", " ").alias("words"), F.size("words").cast("long").alias("n"))


@query(
    _SEGMENTS
    + """, token AS (SELECT item_id, 0 AS t, list(w ORDER BY run, z) AS w FROM word GROUP BY item_id UNION ALL SELECT item_id, 1, r FROM bare),
    variant AS (SELECT item_id, t, 0 AS i, 0::DOUBLE AS far, 0 AS k, array_to_string(w, ' ') AS q FROM token
      UNION ALL SELECT item_id, t, i, abs(k - length(w[i]) / 2), k, array_to_string(w[:i - 1] || [substring(w[i], 1, k), substring(w[i], k + 1)] || w[i + 1:], ' ') FROM (SELECT *, unnest(range(1, length(w[i]))) AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM token))),
    once AS (SELECT item_id, q, min(o) AS o FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY t, i, far, k) AS o FROM variant) GROUP BY item_id, q)
    SELECT item_id, count(*) AS candidates, sha256(string_agg(q, chr(10) ORDER BY o)) AS sha256 FROM once GROUP BY item_id"""
)
def candidate_queries(spark: SparkSession, d: str) -> DataFrame:
    """All candidates in order, of both tokenizations, with each word cut in two at each place."""
    words = segment.vocabulary(read(spark, d, "documents").select("text"))
    found = segment.candidates(_bare(spark, d), words)
    return found.select(F.col("id").alias("item_id"), F.size("queries").cast("long").alias("candidates"), F.sha2(F.array_join("queries", "\n"), 256).alias("sha256"))


# ---------------------------------------------------------------- tables of contents

#: Lines of documents as headings of their source, and where each stands in the tree.
_HEADINGS = r"""WITH line AS (SELECT source AS slug, doc_id, unnest(string_split(text, chr(10))) AS label, unnest(range(len(string_split(text, chr(10))))) AS line, lang FROM documents),
heading AS (SELECT slug, doc_id * 100000 + line AS seq, 'text/' || doc_id || '.xhtml' AS path, length(label) % 5 + 1 AS level, trim(regexp_replace(label, '\s+', ' ', 'g')) AS label, CASE line % 3 WHEN 0 THEN lang WHEN 1 THEN 'h' || line END AS anchor FROM line WHERE doc_id % 7 <> 0),
listed AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq) AS ord FROM heading WHERE level <= 4 AND label <> ''),
entry AS (SELECT *, CASE WHEN anchor IS NULL OR row_number() OVER (PARTITION BY slug, path, anchor ORDER BY seq) > 1 THEN path || '#reading-order-heading-' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') ELSE path || '#' || anchor END AS target FROM listed),
last AS (SELECT *, coalesce(max(ord) FILTER (level = 1) OVER up, 0) AS l1, coalesce(max(ord) FILTER (level = 2) OVER up, 0) AS l2, coalesce(max(ord) FILTER (level = 3) OVER up, 0) AS l3,
  min(ord) FILTER (level <= 1) OVER down AS n1, min(ord) FILTER (level <= 2) OVER down AS n2, min(ord) FILTER (level <= 3) OVER down AS n3, min(ord) FILTER (level <= 4) OVER down AS n4, max(ord) OVER (PARTITION BY slug) AS total
  FROM entry WINDOW up AS (PARTITION BY slug ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY slug ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
tree AS (SELECT slug, ord, level, label, target, ((level > 1 AND l1 > 0)::INT + (level > 2 AND l2 > l1)::INT + (level > 3 AND l3 > greatest(l1, l2))::INT) AS depth, coalesce([n1, n2, n3, n4][level] - 1, total) AS last FROM last)
"""


def _headings(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("source").alias("slug"), "doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line", "label"))
    anchor = F.when(F.col("line") % 3 == 0, F.col("lang")).when(F.col("line") % 3 == 1, F.concat(F.lit("h"), F.col("line").cast("string")))
    path = F.concat(F.lit("text/"), F.col("doc_id").cast("string"), F.lit(".xhtml"))
    return docs.select("slug", (F.col("doc_id") * 100_000 + F.col("line")).alias("seq"), path.alias("path"), (F.length("label") % 5 + 1).alias("level"), "label", anchor.alias("anchor"), (F.col("doc_id") % 7 == 0).alias("unlisted"))


@query(_HEADINGS + 'SELECT slug, ord, label, target, depth, last, 2 * ord - 1 - depth AS "left", 2 * ord - 1 - depth + 2 * (last - ord) + 1 AS "right" FROM tree')
def contents_entries(spark: SparkSession, d: str) -> DataFrame:
    """H3: the table of contents of each work, its lines as headings, with each entry's place in the tree."""
    return outline.contents(_headings(spark, d)).select("slug", "ord", "label", "target", "depth", "last", "left", "right")


@query(
    _HEADINGS
    + """, followed AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY slug ORDER BY ord), 0) AS next FROM tree)
    SELECT slug, count(*) AS entries, sha256(string_agg('<li><a href="' || target || '">' || replace(replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') || '</a>'
      || CASE WHEN next > depth THEN '<ol class="toc">' ELSE '</li>' || repeat('</ol></li>', depth - next) END, chr(10) ORDER BY ord)) AS sha256 FROM followed GROUP BY slug"""
)
def contents_lists(spark: SparkSession, d: str) -> DataFrame:
    """H3: the same as nested lists; here a work's lines meet for a digest."""
    lines = outline.contents_markup(outline.contents(_headings(spark, d)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "markup"))), lambda x: x.markup)
    return lines.groupBy("slug").agg(F.count("*").alias("entries"), F.sha2(F.array_join(ordered, "\n"), 256).alias("sha256"))


# ---------------------------------------------------------------- archives

#: Kinds of books; all but the first have a fault.
_KINDS = 23


def _book_members(spark: SparkSession, d: str) -> DataFrame:
    """file, n, member, content, stored, of EPUBs of three pages each, most with a fault by the book's number."""
    words = T.collapse(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[^\p{L}\p{N}., ]+", " "))
    pages = read(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 3).alias("book"), words.alias("words"))
    head = F.row_number().over(W.partitionBy("book").orderBy("page_id")) == 1
    pages = pages.withColumns({"kind": F.col("book") % _KINDS, "head": head, "name": F.concat(F.lit("p"), F.col("page_id").cast("string"))})
    on = lambda k, what: F.when(F.col("kind") == k, F.lit(what)).otherwise("")
    first = lambda k, what: F.when((F.col("kind") == k) & F.col("head"), F.lit(what)).otherwise("")
    body = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body><h1 id="h">'), "name", F.lit("</h1><p>"), "words", F.lit("</p>"), first(15, '<p id="h">x</p>'), first(16, '<p><a href="gone.xhtml">x</a></p>'), first(17, "<p>"), first(18, '<p><img src="p.xhtml"/></p>'), F.lit("</body></html>"))
    texts = pages.select("book", "kind", F.lit(10).alias("n"), F.concat(F.lit("OEBPS/text/"), "name", F.lit(".xhtml")).alias("member"), F.replace(body, F.lit('<img src="p.xhtml"/>'), F.lit('<img src="../nav.xhtml" alt=" "/>')).alias("content"))
    each = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", c.alias("x")))), lambda s: s.x), "")
    entry = F.concat(F.lit('<item id="'), "name", F.lit('" href="text/'), "name", F.lit('.xhtml"/>'))
    link = F.concat(F.lit('<li><a href="text/'), "name", F.lit('.xhtml#h">'), "name", F.lit("</a></li>"))
    again = F.concat(F.lit('<li><a href="text/'), F.min_by("name", "page_id"), F.lit('.xhtml#h">x</a></li>'))
    lost = F.concat(F.lit('<li><a href="text/'), F.max_by("name", "page_id"), F.lit('.xhtml#none">x</a></li>'))
    second = F.concat(F.lit('<item id="n2" properties="nav" href="text/'), F.min_by("name", "page_id"), F.lit('.xhtml"/>'))
    books = pages.groupBy("book", "kind").agg(each(entry).alias("items"), each(F.concat(F.lit('<itemref idref="'), "name", F.lit('"/>'))).alias("refs"), each(link).alias("links"), again.alias("again"), lost.alias("lost"), second.alias("second"))
    kind = F.col("kind")
    nav = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>'), F.when(kind == 19, "").otherwise(F.col("links")), on(20, '<li><a href="nav.xhtml">x</a></li>'), F.when(kind == 21, F.col("again")).otherwise(""), F.when(kind == 22, F.col("lost")).otherwise(""), F.lit("</ol></nav></body></html>"))
    package = F.concat(
        F.when(kind == 7, '<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><manifest>').otherwise('<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest>'),
        F.when(kind == 11, '<item id="nav" href="nav.xhtml"/>').otherwise('<item id="nav" properties="scripted nav" href="nav.xhtml"/>'), "items",
        on(8, '<item id="" href="nav.xhtml"/>'), on(9, '<item id="x" href="gone.css"/>'), on(10, '<item id="x" href="empty%20one.css"/>'), F.when(kind == 12, F.col("second")).otherwise(""),
        F.lit("</manifest><spine>"), F.when(kind == 13, "").otherwise(F.col("refs")), on(14, '<itemref idref="who"/>'), F.lit("</spine></package>"),
    )
    root = lambda path: f'<rootfile full-path="{path}"/>'
    container = F.concat(F.lit('<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'), F.when(kind == 6, root("OEBPS/gone.opf")).otherwise(root("OEBPS/book.opf")), on(5, root("OEBPS/book.opf")), F.lit("</rootfiles></container>"))
    member = lambda n, name, content: F.struct(F.lit(n).alias("n"), F.lit(name).alias("member"), content.alias("content"))
    kind_said = F.when(kind == 3, "application/zip").otherwise("application/epub+zip")
    fixed = F.array(member(1, "mimetype", kind_said), member(2, "META-INF/container.xml", container), member(3, "OEBPS/book.opf", package), member(4, "OEBPS/nav.xhtml", nav), member(5, "OEBPS/empty one.css", F.lit("")))
    made = books.select("book", "kind", F.explode(fixed).alias("m")).select("book", "kind", "m.*").unionByName(texts)
    made = made.where("not (kind = 4 and n = 2) and not (kind <> 10 and n = 5)").withColumn("n", F.when((F.col("kind") == 1) & (F.col("n") == 1), 2).when((F.col("kind") == 1) & (F.col("n") == 2), 1).otherwise(F.col("n")))
    return made.select(F.concat(F.lit("book-"), F.col("book").cast("string"), F.lit(".epub")).alias("file"), "n", "member", F.encode("content", "UTF-8").alias("content"), ((F.col("member") == "mimetype") & (F.col("kind") != 2)).alias("stored"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Those books, written as archives and read again by their members."""
    folder = sinks.scratch(spark, "books")
    storage.write_files(_book_members(spark, d), storage.Archives, folder, "n", "member")
    return storage.read_archives(spark, folder, "*.epub")


_BOOKS = """WITH page AS (SELECT page_id, page_id // 3 AS book, page_id // 3 % 23 AS kind FROM pages),
book AS (SELECT book, kind, 'book-' || book || '.epub' AS a, count(*) AS n, 'p' || min(page_id) AS f, 'p' || max(page_id) AS l FROM page GROUP BY book, kind)
"""


@query(
    _BOOKS
    + """SELECT "check", a || path AS key, detail FROM (
      SELECT a, 'type-first' AS "check", '' AS path, 'META-INF/container.xml' AS detail FROM book WHERE kind = 1
      UNION ALL SELECT a, 'type-stored', '', '8' FROM book WHERE kind = 2
      UNION ALL SELECT a, 'type-said', '', '' FROM book WHERE kind = 3
      UNION ALL SELECT a, 'container', '', '' FROM book WHERE kind = 4
      UNION ALL SELECT a, unnest(['navigation', 'spine']), '', '' FROM book WHERE kind IN (4, 5, 6)
      UNION ALL SELECT a, 'root', '', '2' FROM book WHERE kind = 5
      UNION ALL SELECT a, 'package', '', 'OEBPS/gone.opf' FROM book WHERE kind = 6
      UNION ALL SELECT a, 'version', '', '2.0' FROM book WHERE kind = 7
      UNION ALL SELECT a, 'item', '/OEBPS/book.opf', '' FROM book WHERE kind = 8
      UNION ALL SELECT a, 'item-missing', '/OEBPS/book.opf', 'OEBPS/gone.css' FROM book WHERE kind = 9
      UNION ALL SELECT a, 'link', '/OEBPS/text/' || f || '.xhtml', 'gone.xhtml' FROM book WHERE kind = 16
      UNION ALL SELECT a, 'item-empty', '/OEBPS/empty one.css', '' FROM book WHERE kind = 10
      UNION ALL SELECT a, 'navigation', '', '' FROM book WHERE kind = 11
      UNION ALL SELECT a, 'navigation-twice', '', '2' FROM book WHERE kind = 12
      UNION ALL SELECT a, 'spine', '', '' FROM book WHERE kind = 13
      UNION ALL SELECT a, 'contents-outside', '', 'text/p' || page_id || '.xhtml#h' FROM book JOIN page USING (book) WHERE book.kind = 13
      UNION ALL SELECT a, 'spine-id', '', 'who' FROM book WHERE kind = 14
      UNION ALL SELECT a, 'id-twice', '/OEBPS/text/' || f || '.xhtml', 'h' FROM book WHERE kind = 15
      UNION ALL SELECT a, 'malformed', '/OEBPS/text/' || f || '.xhtml', '' FROM book WHERE kind = 17
      UNION ALL SELECT a, 'contents-fragment', '', 'text/' || f || '.xhtml#h' FROM book WHERE kind = 17
      UNION ALL SELECT a, 'image-words', '/OEBPS/text/' || f || '.xhtml', '../nav.xhtml' FROM book WHERE kind = 18
      UNION ALL SELECT a, 'contents', '', '' FROM book WHERE kind = 19
      UNION ALL SELECT a, 'contents-outside', '', 'nav.xhtml' FROM book WHERE kind = 20
      UNION ALL SELECT a, 'contents-order', '', 'text/' || f || '.xhtml#h' FROM book WHERE kind = 21 AND n > 1
      UNION ALL SELECT a, 'contents-fragment', '', 'text/' || l || '.xhtml#none' FROM book WHERE kind = 22)"""
)
def epub_faults(spark: SparkSession, d: str) -> DataFrame:
    """Archives of the pages, read by their directories; each fault that was put in is found, and nothing else."""
    members = _books(spark, d).withColumn("archive", F.regexp_extract("archive", "([^/]*)$", 1))
    return packages.check(members)


@query(
    _BOOKS
    + r""", said AS (SELECT page_id, page.book, page.kind, f, n, row_number() OVER (PARTITION BY page.book ORDER BY page_id) - 1 AS document, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\p{L}\p{N}., ]+', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM page JOIN pages USING (page_id) JOIN book ON book.book = page.book),
    block AS (SELECT book, document, 1 AS i, 'h1' AS tag, 'p' || page_id AS text FROM said WHERE kind NOT IN (4, 5, 6, 13)
      UNION ALL SELECT book, document, 2, 'p', words FROM said WHERE kind NOT IN (4, 5, 6, 13) AND words <> '' UNION ALL SELECT book, document, 3, 'p', 'x' FROM said WHERE kind IN (15, 16) AND document = 0)
    SELECT 'book-' || book AS slug, document::INT AS document, row_number() OVER (PARTITION BY book ORDER BY document, i) AS para_no, tag, length(text) AS n, sha256(text) AS sha256 FROM block"""
)
def epub_texts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of those archives in reading order, malformed documents in their places, navigation left out."""
    out = packages.blocks(_books(spark, d))
    return out.select("slug", "document", "para_no", "tag", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- files of the client


@query(CHUNKS + """SELECT slug, 'b' || lpad(ord::VARCHAR, greatest(5, length(ord::VARCHAR))::INT, '0') AS key, '["' || original_page || '",' || pdf_page || ',' || (ord - 1) || ']' AS value FROM chunk""")
def page_map_json(spark: SparkSession, d: str) -> DataFrame:
    """K2: page maps as JSON files, one a work, written in order without holding one, and read again line by line."""
    folder = sinks.scratch(spark, "page-maps")
    sinks.write_page_maps(tables.chunks(spark, d), folder)
    lines = spark.read.text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), "(.*)[.]json$", 1).alias("slug"), "value").where("length(value) > 1")
    return lines.select("slug", F.regexp_extract("value", '^"([^"]*)":', 1).alias("key"), F.regexp_extract("value", r'^"[^"]*":(.*?),?$', 1).alias("value"))


# ---------------------------------------------------------------- printed pages


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Pages set in two columns below a title, with a running line and a number: boxes of words, in no order."""
    plain = F.regexp_extract_all(F.regexp_replace("html", "<[^>]*>", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = read(spark, d, "pages").select(F.concat(F.lit("w"), (F.col("page_id") % 20).cast("string")).alias("work"), F.col("page_id").alias("page"), plain.alias("w"))
    number = F.ceil((F.size("w") - 3) / 4)  # lines
    half = F.floor((number + 1) / 2)
    # Every word is a row before it is placed; the last two are the running line and the number.
    two = F.array(F.concat(F.lit("Bericht "), F.col("page").cast("string")), F.col("page").cast("string"))
    rows = rows.select("work", "page", F.size("w").alias("n"), half.alias("half"), F.posexplode(F.concat("w", two)).alias("i", "text"))
    i, n, foot = F.col("i"), F.col("n"), 210 + F.col("half") * 12
    rows = rows.withColumn("j", F.floor((i - 3) / 4)).withColumn("column", F.when(F.col("j") >= F.col("half"), 1).otherwise(0))
    rows = rows.withColumn("row", F.col("j") - F.col("column") * F.col("half")).withColumn("head", F.col("row") % 10 == 0)
    x, y = 50 + F.col("column") * 320 + (i - 3) % 4 * 60, 150 + F.col("row") * 12
    of = lambda running, number, title, body: F.when(i == n, running).when(i == n + 1, number).when(i < 3, title).otherwise(body)
    boxes = {
        "x0": of(50, 300, 50 + i * 181, x),
        "y0": of(30, foot, 60, y),
        "x1": of(592, 340, 230 + i * 181, x + 50),
        "y1": of(38, foot + 8, 84, y + 10),
        "size": of(8, 8, 24, F.when(F.col("head"), 12).otherwise(10)),
    }
    return rows.select("work", "page", *[v.cast("double").alias(k) for k, v in boxes.items()], of(False, False, True, F.col("head")).alias("bold"), "text")


@query(
    r"""WITH page AS (SELECT page_id AS page, regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\p{L}\p{N}]+') AS w FROM pages),
    line AS (SELECT page, w, unnest(range(0, ceil((len(w) - 3) / 4)::BIGINT)) AS j, floor((ceil((len(w) - 3) / 4) + 1) / 2)::BIGINT AS half FROM page)
    SELECT page, 2 AS n, 'h1' AS kind, array_to_string(w[:3], ' ') AS text FROM page UNION ALL SELECT page, j + 3, CASE WHEN (j - CASE WHEN j >= half THEN half ELSE 0 END) % 10 = 0 THEN 'h3' ELSE 'p' END, array_to_string(w[4 * j + 4:4 * j + 7], ' ') FROM line"""
)
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    """Columns, lines and headings of pages from the boxes of their words; running lines and numbers are gone."""
    rows = pages.structured(pages.without_running(pages.lines(pages.columns(_words(spark, d)))))
    return rows.select("page", F.col("n").cast("long").alias("n"), "kind", "text")
