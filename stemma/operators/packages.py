"""EPUB packages as rows: what their documents say, whether it holds together, and their text in reading order."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.integrity import all_of, violations
from stemma.operators.ranking import kept
from stemma.sources.formats import CONTAINER, OPF, xhtml_blocks

#: Names of a package's parts, and members that are XML.
MIMETYPE, TYPE, CONTAINER_FILE = "mimetype", "application/epub+zip", "META-INF/container.xml"
XHTML, EPUB = "{http://www.w3.org/1999/xhtml}", "{http://www.idpf.org/2007/ops}"
XML = r"\.(?:xml|opf|ncx|xhtml|svg)$"
#: Addresses that lead out of a package or stay in a document.
OUTSIDE = re.compile(r"#|[a-z][a-z0-9+.-]*:", re.I)
#: Front matter that a short work's reading order leaves out, and where it begins then.
FRONT_FILES, FIRST_FILE = ("cover.xhtml", "title_page.xhtml", "nav.xhtml"), "ch001.xhtml"

FACTS = "archive string, member string, kind string, k int, a string, b string, c string"


def _package(root: ElementTree.Element) -> Iterator[tuple]:
    yield "version", 0, root.get("version", ""), None, None
    for k, i in enumerate(root.findall(f".//{OPF}manifest/{OPF}item")):
        yield "item", k, i.get("id", ""), unquote(i.get("href", "")), i.get("properties", "")
    for k, i in enumerate(root.findall(f".//{OPF}spine/{OPF}itemref")):
        yield "spine", k, i.get("idref", ""), None, None


def _document(root: ElementTree.Element) -> Iterator[tuple]:
    k = 0
    for e in root.iter():
        k += 1
        if e.get("id"):
            yield "id", k, e.get("id"), None, None
        for name in ("href", "src"):
            if e.get(name) and not OUTSIDE.match(e.get(name)):
                yield "link", k, unquote(e.get(name)), None, None
        if e.tag == f"{XHTML}img" and not e.get("alt", "").strip():
            yield "no-alt", k, e.get("src", ""), None, None
    for nav in root.iter(f"{XHTML}nav"):
        if "toc" in nav.get(f"{EPUB}type", "").split():
            yield "toc", 0, None, None, None
            for k, a in enumerate(nav.iter(f"{XHTML}a")):
                path, _, fragment = a.get("href", "").partition("#")
                yield "toc-link", k, unquote(path), unquote(fragment) or None, a.get("href", "")
            break


def said(member: str, content: bytes) -> Iterator[tuple]:
    """(kind, k, a, b, c) of what one member says, or that it is malformed."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as error:
        yield "malformed", 0, str(error), None, None
        return
    yield "parsed", 0, None, None, None
    if member == CONTAINER_FILE:
        for k, r in enumerate(root.iter(f"{CONTAINER}rootfile")):
            yield "root", k, r.get("full-path", ""), None, None
    elif member.endswith(".opf"):
        yield from _package(root)
    elif member.endswith((".xhtml", ".svg")):
        yield from _document(root)


def facts(members: DataFrame) -> DataFrame:
    """members(archive, member, content) -> archive, member, kind, k, a, b, c: a row for each thing that an XML member says.

    Each member is parsed by itself; what belongs together, in a package or between them, meets in joins.
    """
    T.short_batches()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for archive, member, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows = [(archive.as_py(), member.as_py(), *f) for f in said(member.as_py(), content.as_py() or b"")]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in FACTS.split(", ")])

    return members.where(F.col("member").rlike(XML)).select("archive", "member", "content").mapInArrow(read, FACTS)


def _of(rows: DataFrame, kind: str, **names: str) -> DataFrame:
    """The facts of a kind, with their columns by name."""
    return rows.where(F.col("kind") == kind).select("archive", "member", "k", *[F.col(c).alias(n) for n, c in names.items()])


def package_items(rows: DataFrame) -> DataFrame:
    """facts() -> archive, package, k, id, path, properties: what packages list, by the archive's one root."""
    root = _of(rows, "root", package="a").groupBy("archive").agg(F.min("package").alias("member"), F.count("*").alias("n")).where("n = 1")
    items = _of(rows, "item", id="a", href="b", properties="c").join(root.select("archive", "member"), ["archive", "member"])
    return items.select("archive", F.col("member").alias("package"), "k", "id", T.archive_path(F.col("member"), F.col("href")).alias("path"), F.split("properties", r"\s+").alias("properties"))


def reading_order(rows: DataFrame, items: DataFrame) -> DataFrame:
    """archive, k (from 0), path, properties: the documents of a package as they are read; unknown ids are left out."""
    spine = _of(rows, "spine", id="a").select("archive", F.col("member").alias("package"), "k", "id")
    once = items.groupBy("archive", "package", "id").agg(F.max_by("path", "k").alias("path"), F.max_by("properties", "k").alias("properties"))
    return spine.join(once, ["archive", "package", "id"]).select("archive", "k", "path", "properties")


def short_order(order: DataFrame) -> DataFrame:
    """reading_order() of short works: without front matter, numbered anew. See short_starts() for what it must begin with."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = order.where(~name.isin(*FRONT_FILES))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("archive").orderBy("k")) - 1)  # rows are documents of a short work


def short_starts(order: DataFrame) -> DataFrame:
    """Violations: short works whose reading order, as short_order() has it, does not begin with their first chapter."""
    first = order.where("k = 0").withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return violations(first, "short-start", "archive", F.col("name") != FIRST_FILE, F.col("path"))


def check(members: DataFrame, version: str = "3") -> DataFrame:
    """members(archive, n, member, method, size, content) of EPUBs -> violations (check, key, detail); key: archive or archive/member.

    The first member is the type, stored as it is; XML is well formed; one root leads to one package; what it lists is
    there and not empty, its ids are whole, its reading order knows them; one navigation document, whose links
    go to documents in reading order, to fragments that exist; ids are unique in a document; links resolve; images have
    words. An archive that lacks something is judged by what it has.
    """
    rows = kept(facts(members))
    names = kept(members.select("archive", "n", "member", "method", "size", F.when(F.col("member") == MIMETYPE, F.col("content")).alias("content")))
    archives = names.groupBy("archive").agg(F.min_by("member", "n").alias("first"))
    key = lambda member="member": F.concat_ws("/", "archive", F.col(member))
    none = lambda name, there: violations(archives.join(there.select("archive").distinct(), "archive", "left_anti"), name, "archive", F.lit(True))
    there = names.select("archive", F.col("member").alias("path")).distinct()
    lost = lambda name, links, detail: violations(links.join(there, ["archive", "path"], "left_anti"), name, key(), F.lit(True), F.col(detail))

    types = names.where(F.col("member") == MIMETYPE)
    roots = _of(rows, "root", path="a")
    parsed = _of(rows, "parsed").select("archive", F.col("member").alias("path"))
    listed = _of(rows, "item", id="a", href="b")
    items = kept(package_items(rows))
    order = kept(reading_order(rows, items))
    packages = items.select("archive", F.col("package").alias("member")).distinct()
    spine = _of(rows, "spine", id="a").join(packages, ["archive", "member"])
    known = items.select("archive", F.col("package").alias("member"), "id").distinct()
    navs = items.where(F.array_contains("properties", "nav")).select("archive", F.col("path").alias("member"))
    versions = _of(rows, "version", version="a").join(packages, ["archive", "member"])
    links = _of(rows, "link", href="a").select("archive", "member", "href", T.archive_path(F.col("member"), F.col("href")).alias("path"))
    toc = _of(rows, "toc-link", to="a", fragment="b", href="c").join(navs, ["archive", "member"])
    # A link without a path stays in its document.
    target = F.when(F.col("to") == "", F.col("member")).otherwise(T.archive_path(F.col("member"), F.col("to")))
    toc = kept(toc.withColumn("path", target))
    placed = toc.join(order.groupBy("archive", "path").agg(F.max("k").alias("place")), ["archive", "path"], "left")
    before = F.max("place").over(W.partitionBy("archive").orderBy("k").rowsBetween(W.unboundedPreceding, -1))  # links of one package
    ids = _of(rows, "id", id="a")
    found = ids.select("archive", F.col("member").alias("path"), F.col("id").alias("fragment")).distinct()
    held = items.join(names.select("archive", F.col("member").alias("path"), "size"), ["archive", "path"])
    return all_of(
        violations(archives, "type-first", "archive", F.col("first") != MIMETYPE, F.col("first")),
        none("type", types),
        violations(types, "type-stored", "archive", F.col("method") != 0, F.col("method")),
        violations(types, "type-said", "archive", F.col("content") != F.encode(F.lit(TYPE), "utf-8")),
        none("container", names.where(F.col("member") == CONTAINER_FILE)),
        violations(_of(rows, "malformed", error="a"), "malformed", key(), F.lit(True)),
        violations(roots.groupBy("archive").agg(F.count("*").alias("n")), "root", "archive", F.col("n") != 1, F.col("n")),
        violations(roots.join(parsed, ["archive", "path"], "left_anti"), "package", "archive", F.lit(True), F.col("path")),
        violations(versions, "version", "archive", ~F.startswith("version", F.lit(version)), F.col("version")),
        violations(listed, "item", key(), (F.col("id") == "") | (F.col("href") == ""), F.col("id")),
        lost("item-missing", items.where("id <> ''").withColumn("member", F.col("package")), "path"),
        violations(held, "item-empty", key("path"), F.col("size") == 0),
        violations(navs.groupBy("archive").agg(F.count("*").alias("n")), "navigation-twice", "archive", F.col("n") != 1, F.col("n")),
        none("navigation", navs),
        none("spine", spine),
        violations(spine.join(known, ["archive", "member", "id"], "left_anti"), "spine-id", "archive", F.lit(True), F.col("id")),
        violations(ids.groupBy("archive", "member", "id").agg(F.count("*").alias("n")), "id-twice", key(), F.col("n") > 1, F.col("id")),
        lost("link", links, "href"),
        violations(_of(rows, "no-alt", src="a"), "image-words", key(), F.lit(True), F.col("src")),
        violations(navs.join(toc.select("archive").distinct(), "archive", "left_anti"), "contents", "archive", F.lit(True)),
        violations(placed, "contents-outside", "archive", F.col("place").isNull(), F.col("href")),
        violations(placed.withColumn("before", before), "contents-order", "archive", F.coalesce(F.col("place") < F.col("before"), F.lit(False)), F.col("href")),
        violations(toc.where("fragment is not null").join(there, ["archive", "path"], "left_semi").join(found, ["archive", "path", "fragment"], "left_anti"), "contents-fragment", "archive", F.lit(True), F.col("href")),
    )


def blocks(members: DataFrame, slug: Column | None = None) -> DataFrame:
    """members(archive, member, content) of EPUBs -> slug, document, para_no, tag, text: blocks in reading order.

    As formats.epub_blocks(), member by member; slug is the archive's name unless given.
    """
    rows = kept(facts(members))
    order = reading_order(rows, package_items(rows)).where(~F.array_contains("properties", "nav")).groupBy("archive", "path").agg(F.min("k").alias("document"))
    wanted = members.select("archive", F.col("member").alias("path"), "content").join(order, ["archive", "path"])
    schema = "archive string, document int, i int, tag string, text string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, document, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = xhtml_blocks((content or b"").decode("utf-8", "replace"))
                n = len(found)
                columns = [[archive] * n, [document] * n, range(n), [t for t, _ in found], [x for _, x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], [x.split()[0] for x in schema.split(", ")])

    said = kept(wanted.select("archive", "document", "content").mapInArrow(read, schema))
    before = F.coalesce(F.sum("n").over(W.partitionBy("archive").orderBy("document").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = said.groupBy("archive", "document").agg(F.count("*").alias("n")).select("archive", "document", before.alias("before"))  # a row a document
    name = slug if slug is not None else F.regexp_extract("archive", r"([^/]*?)(?:\.epub)?$", 1)
    return said.join(starts, ["archive", "document"]).select(name.alias("slug"), "document", (F.col("before") + F.col("i") + 1).alias("para_no"), "tag", "text")


def headings(members: DataFrame) -> DataFrame:
    """members(archive, member, content) of EPUBs -> slug, seq, path, level, label, anchor, unlisted: for outline.contents().

    Headings of the documents in reading order, navigation and front matter aside; an anchor is that of the heading or else of
    the nearest element around it that has one, and paths are seen from the navigation document.
    """
    rows = kept(facts(members))
    items = package_items(rows)
    nav = items.where(F.array_contains("properties", "nav")).groupBy("archive").agg(F.min("path").alias("nav"))
    order = reading_order(rows, items).where(~F.array_contains("properties", "nav") & F.col("path").rlike(r"\.x?html$") & ~F.regexp_extract("path", "([^/]*)$", 1).isin("cover.xhtml", "title_page.xhtml"))
    order = order.groupBy("archive", "path").agg(F.min("k").alias("document")).join(nav, "archive")
    wanted = members.select("archive", F.col("member").alias("path"), "content").join(order, ["archive", "path"])
    schema = "archive string, path string, document int, place int, level int, label string, anchor string, unlisted boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            for archive, path, base, document, content in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                found = [(archive, relative(path, base), document, *h) for h in _headings(content or b"")]
                columns = zip(*found, strict=True) if found else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    said = wanted.select("archive", "path", "nav", "document", "content").mapInArrow(read, schema)
    seq = F.col("document").cast("long") * (1 << 32) + F.col("place")
    return said.select(F.regexp_extract("archive", r"([^/]*?)(?:\.epub)?$", 1).alias("slug"), seq.alias("seq"), "path", "level", "label", "anchor", "unlisted")


def relative(path: str, base: str) -> str:
    """The address of a member as seen from another."""
    return posixpath.relpath(path, posixpath.dirname(base) or ".")


def _headings(content: bytes) -> Iterator[tuple[int, int, str, str | None, bool]]:
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return
    todo = [(root, None, False)]  # elements with the nearest anchor and whether they are left out
    place = 0
    while todo:
        e, anchor, unlisted = todo.pop()
        anchor, unlisted, place = e.get("id") or anchor, unlisted or "unlisted" in e.get("class", "").split(), place + 1
        level = re.fullmatch("h([1-4])", e.tag.removeprefix(XHTML)) if isinstance(e.tag, str) and e.tag.startswith(XHTML) else None
        if level:
            yield place, int(level[1]), "".join(e.itertext()), anchor, unlisted
        todo += [(child, anchor, unlisted) for child in reversed(e)]
