"""Document formats as ordered paragraphs. Parsing works on one file at a time, inside Arrow UDFs."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import markers as M
from stemma.functions.text import let, matchable, strip
from stemma.operators.ranking import ranked

#: Elements that make a block of text.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote figcaption caption th td pre".split())
SKIPPED = frozenset(("script", "style"))
#: Names of the formats' parts.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF = "{http://www.idpf.org/2007/opf}"
LOCATION_STYLES = frozenset(("Source Page", "Source Folio"))
SENTINEL = ""
NOTES = "原注"
LFS_HEADER, LFS_LARGEST = b"version https://git-lfs.github.com/spec/v1", 512


# ---------------------------------------------------------------- plain files


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, content, size and SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def is_usable(content: Column) -> Column:
    """Whether content is a real file and not a pointer to one in large-file storage."""
    head = F.substring(content, F.lit(1), F.lit(len(LFS_HEADER)))
    return (F.octet_length(content) > LFS_LARGEST) | (head != F.lit(LFS_HEADER))


def read_manifest(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """A JSON manifest, one row a work; another schema version raises when rows are read."""
    top = spark.read.json(path, multiLine=True)
    right = F.when(F.col("schemaVersion") == version, F.col("works")).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.coalesce(F.col("schemaVersion").cast("string"), F.lit("none")))).cast(top.schema["works"].dataType))
    return top.select(F.explode(right).alias("work")).select("work.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Publications from JSON lines, a JSON array, or Parquet; `ord` (from 0) is their place in the files, by their names.

    JSON whose first sign is a bracket is an array, whatever its lines are. Blank lines are no records.
    """
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()  # one line
        rows = spark.read.json(path, multiLine=bool(first) and first[0].value.lstrip("\ufeff \t").startswith("["))
    if "ord" in rows.columns:
        return rows
    place = ["_file", "_start", "_row"]
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_row", F.monotonically_increasing_id())
    return ranked(rows, *[F.col(c).asc() for c in place], name="ord").withColumn("ord", F.col("ord") - 1).drop(*place)


# ---------------------------------------------------------------- Markdown

#: Lines that end a paragraph.
FENCE = r"^\s*```"
RULE = r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"


def trim_source(text: Column) -> Column:
    """Markdown from where the work begins: after its heading, from its front matter, or from its first marker.

    Each of the three is looked for once: a split at the first match says what is before it and what after.
    """
    at = lambda pattern: F.split(text, "(?m)" + pattern, 2)
    marker = F.coalesce(M.first_concrete(text), F.lit("\u0000"))
    places = F.struct(at(M.HEADING).alias("head"), at(M.FRONT).alias("front"), F.nullif(F.instr(text, marker), F.lit(0)).alias("first"))

    def begun(p: Column) -> Column:
        first = F.coalesce(p.first, F.length(text) + 1)
        before = lambda parts: (F.size(parts) == 2) & (F.length(parts[0]) < first)
        front = F.substring(text, F.length(p.front[0]) + 1, F.length(text))
        return F.when(before(p.head), p.head[1]).when(before(p.front), front).when(p.first.isNotNull(), F.substring(text, p.first, F.length(text))).otherwise(text)

    return let(places, begun)


def markdown_paragraphs(files: DataFrame) -> DataFrame:
    """files(slug, text) -> slug, para_no, text: paragraphs in order.

    Each line gets a class; headings, marker lines, page lines and table rows stand alone, fences keep their
    lines together, blank lines and rules end a paragraph. Lines of one paragraph share a running number.
    """
    lines = files.select("slug", F.posexplode(F.split(trim_source(F.col("text")), r"\r\n|\r|\n", -1)).alias("line_no", "line"))
    by = W.partitionBy("slug").orderBy("line_no")
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    line = F.regexp_replace(F.col("line"), r"(?U)\s+$", "")
    lines = lines.withColumn("line", line).withColumn("fence", F.col("line").rlike(FENCE))
    lines = lines.withColumn("inside", (F.sum(F.col("fence").cast("int")).over(so_far) % 2 == 1) & ~F.col("fence"))
    kind = (
        F.when(F.col("fence"), "break")
        .when(F.col("inside"), "text")
        .when(strip(F.col("line")) == "", "break")
        .when(F.col("line").rlike(RULE), "break")
        .when(F.col("line").rlike(r"^\s*#"), "own")
        .when(F.col("line").rlike(M.MARKER), "own")
        .when(M.is_standalone(F.col("line")), "page")
        .when(F.col("line").rlike(r"^\s*\|"), "row")
        .otherwise("text")
    )
    lines = lines.withColumn("kind", kind)
    starts = (F.col("kind") != "text") | (F.coalesce(F.lag("kind").over(by), F.lit("break")) != "text")
    lines = lines.withColumn("group", F.sum(starts.cast("int")).over(so_far)).where("kind <> 'break'")
    cells = F.filter(F.transform(F.split(F.regexp_replace(strip(F.col("line")), r"^\|+|\|+$", ""), r"\|", -1), strip), lambda c: c != "")
    said = F.when(F.col("kind") == "row", F.array_join(cells, "　")).when(F.col("kind") == "own", F.col("line")).otherwise(strip(F.col("line")))
    lines = lines.withColumn("said", said)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x.said)
    whole = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    out = lines.groupBy("slug", "group").agg(whole.alias("text"), F.max(F.col("kind") == "row").alias("row")).where("text <> '' or row")
    return out.select("slug", F.row_number().over(W.partitionBy("slug").orderBy("group")).alias("para_no"), "text")


# ---------------------------------------------------------------- DOCX and EPUB


def _word_paragraphs(xml: bytes, styles: dict[str, str], sensitive: re.Pattern) -> list[str]:
    out = []
    for p in ElementTree.fromstring(xml).iter(f"{WORD}p"):
        text = "".join({f"{WORD}t": n.text or "", f"{WORD}tab": "\t", f"{WORD}br": "\n"}.get(n.tag, "") for n in p.iter())
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name = styles.get(style.get(f"{WORD}val", ""), style.get(f"{WORD}val", "")) if style is not None else ""
        text = text.strip()
        if text and sensitive.match(text) and name not in LOCATION_STYLES:
            text = text[: text.index("〔") + 1] + SENTINEL + text[text.index("〔") + 1 :]
        if text:
            out.append(text)
    return out


#: Fixed value: markers that count only in paragraphs of certain styles.
SENSITIVE = re.compile(r"^\s*〔\s*(?:PMM\s*\d+\s*,|出所|主底本|補完底本|合成底本)")


def parse_docx(content: bytes) -> list[str]:
    """Body paragraphs, then, after a heading, those of foot- and endnotes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, styles = set(z.namelist()), {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style"):
                name = s.find(f"{WORD}name")
                if name is not None:
                    styles[s.get(f"{WORD}styleId", "")] = name.get(f"{WORD}val", "")
        out = _word_paragraphs(z.read("word/document.xml"), styles, SENSITIVE)
        notes = [p for part in ("word/footnotes.xml", "word/endnotes.xml") if part in names for p in _word_paragraphs(z.read(part), styles, SENSITIVE)]
    return out + ([NOTES, *notes] if notes else [])


class TolerantBlocks(HTMLParser):
    """Texts of block elements of broken markup: a new block ends the one before it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.tag, self.buffer, self.skipping = "", [], 0

    def end_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.buffer)).strip()
        if self.tag and text:
            self.blocks.append((self.tag, text))
        self.tag, self.buffer = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        elif tag in BLOCKS:
            self.end_block()
            self.tag = tag
        elif tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag == self.tag:
            self.end_block()

    def handle_data(self, data: str) -> None:
        if self.tag and not self.skipping:
            self.buffer.append(data)


def tolerant_blocks(markup: str) -> list[tuple[str, str]]:
    parser = TolerantBlocks()
    parser.feed(markup)
    parser.close()
    parser.end_block()
    return parser.blocks


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2].lower()


def xhtml_blocks(markup: str) -> list[tuple[str, str]]:
    """Texts of the outermost blocks of a page: nothing inside a block is a block again."""
    try:
        root = ElementTree.fromstring(markup)
    except ElementTree.ParseError:
        return tolerant_blocks(markup)
    out: list[tuple[str, str]] = []

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if _local(child.tag) in BLOCKS:
                text = re.sub(r"\s+", " ", _said(child)).strip()
                if text:
                    out.append((_local(child.tag), text))
            elif _local(child.tag) not in SKIPPED:
                walk(child)

    walk(root)
    return out


def _said(node: ElementTree.Element) -> str:
    parts = [node.text or ""]
    for child in node:
        parts += [" " if _local(child.tag) == "br" else "" if _local(child.tag) in SKIPPED else _said(child), child.tail or ""]
    return "".join(parts)


def spine(z: zipfile.ZipFile) -> list[str]:
    """The documents of an EPUB in reading order, navigation aside."""
    opf = ElementTree.fromstring(z.read("META-INF/container.xml")).find(f".//{CONTAINER}rootfile").get("full-path")
    base = opf.rpartition("/")[0]
    package = ElementTree.fromstring(z.read(opf))
    items = {i.get("id"): i for i in package.iter(f"{OPF}item")}
    out = []
    for ref in package.iter(f"{OPF}itemref"):
        item = items.get(ref.get("idref"))
        if item is not None and "nav" not in (item.get("properties") or "").split():
            out.append("/".join(filter(None, (base, unquote(item.get("href", ""))))))
    return [m for m in out if m in z.namelist()]


def parse_epub(content: bytes) -> list[tuple[int, str, str]]:
    """(document in spine order, block element, text). Broken documents keep their place among the others."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(k, tag, text) for k, name in enumerate(spine(z)) for tag, text in xhtml_blocks(z.read(name).decode("utf-8", "replace"))]


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """files(slug, content) -> slug, para_no, text."""

    @F.pandas_udf("array<string>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(parse_docx)

    return files.select("slug", F.posexplode(read("content")).alias("i", "text")).select("slug", (F.col("i") + 1).alias("para_no"), "text")


def epub_blocks(files: DataFrame) -> DataFrame:
    """files(slug, content) -> slug, document, para_no, tag, text."""

    @F.pandas_udf("array<struct<document:int,tag:string,text:string>>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda c: [dict(zip(("document", "tag", "text"), x, strict=True)) for x in parse_epub(c)])

    return files.select("slug", F.posexplode(read("content")).alias("i", "b")).select("slug", "b.document", (F.col("i") + 1).alias("para_no"), "b.tag", "b.text")


def html_blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> page_id, block, tag, text."""

    @F.pandas_udf("array<struct<tag:string,text:string>>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"tag": t, "text": x} for t, x in xhtml_blocks(h or "")])

    return pages.select("page_id", F.posexplode(read("html")).alias("block", "b")).select("page_id", "block", "b.tag", "b.text")


def epub_paragraphs(files: DataFrame) -> DataFrame:
    """paragraphs_of() whole EPUBs; see operators/packages.py for those that are read by members."""
    return paragraphs_of(epub_blocks(files))


def paragraphs_of(blocks: DataFrame) -> DataFrame:
    """Blocks of EPUBs -> slug, para_no, text, without facsimile-only documents and bibliographic sections.

    A section begins at a heading of that kind and ends at the next other heading or concrete marker.
    """
    doc = W.partitionBy("slug", "document")
    blocks = blocks.withColumn("picture", F.min(F.col("text").rlike(M.FACSIMILE).cast("int")).over(doc)).where("picture = 0")
    heading = F.col("tag").rlike("^h[1-6]$")
    event = F.when(heading, F.when(F.col("text").rlike(M.METADATA_HEADING), "skip").otherwise("go")).when(M.first_concrete(F.col("text")).isNotNull(), "go")
    state = F.last(event, True).over(doc.orderBy("para_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = blocks.withColumn("state", F.coalesce(state, F.lit("go"))).where("state = 'go'")
    return kept.select("slug", F.row_number().over(W.partitionBy("slug").orderBy("para_no")).alias("para_no"), "text")


def page_rows(works: DataFrame) -> DataFrame:
    """works(slug, page_text) -> slug, page_no (from 1), text. Pages end with form feeds; a blank last one goes."""
    pages = F.split("page_text", "\f", -1)
    pages = F.when(strip(F.element_at(pages, -1)) == "", F.slice(pages, F.lit(1), F.size(pages) - 1)).otherwise(pages)
    return works.select("slug", F.posexplode(pages).alias("i", "text")).select("slug", (F.col("i") + 1).alias("page_no"), "text")


def text_or_scanned(pages: DataFrame, scanned: DataFrame) -> DataFrame:
    """pages(slug, page_no, text), or for works without any text the pages of `scanned`; `mode` says which."""
    has = pages.groupBy("slug").agg((F.max(F.length(matchable(F.coalesce("text", F.lit("")))))).alias("n")).where("n > 0").select("slug")
    own = pages.join(has, "slug", "left_semi").select("slug", "page_no", "text", F.lit("text").alias("mode"))
    other = scanned.join(pages.select("slug").distinct(), "slug", "left_semi").join(has, "slug", "left_anti").select("slug", "page_no", "text", F.lit("scanned").alias("mode"))
    return own.unionByName(other)
