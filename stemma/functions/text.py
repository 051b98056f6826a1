"""Text functions. Built-in expressions first; Arrow UDFs only where Spark has none (Unicode forms, entities)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space as Unicode has it, and the byte order mark, which browsers count too.
SPACE = r"(?U)[\s\x{FEFF}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body has it, also where that stands inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows and bytes that a Python worker is sent at once. Texts can be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def short_batches() -> None:
    """Bound what Python workers of this session hold, whatever the size of tables and partitions. A smaller setting stays."""
    spark = SparkSession.getActiveSession()
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)) if spark else ():
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub("[^0-9]", "", spark.conf.get(key, None) or "") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def _form(name: str):
    short_batches()

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(name, x))

    return normal


def nfc(text: Column) -> Column:
    return _form("NFC")(text)


def nfkc(text: Column) -> Column:
    return _form("NFKC")(text)


def unescape(text: Column) -> Column:
    """Character references, where there are any."""
    short_batches()

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if x and "&" in x else x)

    return plain(text)


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def matchable(text: Column, form: bool = True) -> Column:
    """For matching: compatibility form, lower case, letters and digits only. form=False where texts are in it."""
    return F.regexp_replace(F.lower(nfkc(text) if form else text), r"[^\p{L}\p{N}]", "")


def comparable(text: Column, form: bool = True) -> Column:
    """For literal search: composed form, lower case, without white space. form=False where texts are in it."""
    return F.regexp_replace(F.lower(nfc(text) if form else text), SPACE, "")


def comparable_value(text: str) -> str:
    """comparable() of a query, on the driver."""
    return re.sub(r"[\s﻿]+", "", unicodedata.normalize("NFC", text).lower())


#: Markdown that clean_inline() takes away, and what it leaves of it.
IMAGE, LINK, TAG = r"!\[([^\]]*)\]\([^)]*\)", r"\[([^\]]+)\]\([^)]*\)", r"<[^>]+>"
TITLE, ITEM, QUOTE = r"(?U)^\s{0,3}#{1,6}\s*", r"(?U)^\s*(?:[-+*]|\d+[.)])\s+", r"(?U)^\s*>\s?"
STRONG, EMPHASIS = r"`|\*\*|__", r"(?U)(?<!\w)[*_~]+|[*_~]+(?!\w)"


def clean_inline(text: Column) -> Column:
    """A line of Markdown as plain text: links and images by their words, no tags, entities, prefixes, emphasis."""
    out = F.regexp_replace(F.regexp_replace(text, IMAGE, "$1"), LINK, "$1")
    out = unescape(F.regexp_replace(out, TAG, " "))
    for prefix in (TITLE, ITEM, QUOTE, STRONG):
        out = F.regexp_replace(out, prefix, "")
    return collapse(F.regexp_replace(out, EMPHASIS, ""))


def sentences(text: Column) -> Column:
    """Cut after sentence marks, which stay; no blank sentences."""
    parts = F.transform(F.split(text, "(?<=[。！？!?])", -1), strip)
    return F.filter(parts, lambda s: s != "")


#: Marks after which a long sentence may be cut.
CLAUSE = "、；;：:，,"


def pieces(sentence: Column, longest: int = 190) -> Column:
    """A sentence in pieces: whole if it fits, else up to the last clause mark near the limit, or up to the limit."""
    near = max(80, longest - 55)
    pattern = rf"(?s)(.{{1,{longest}}}\z|.{{{near},{longest}}}[{CLAUSE}]|.{{{longest}}})(?U:\s*)"
    return F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), strip), lambda p: p != "")


#: Places that grams() cuts from one piece: long texts are cut to pieces first, as each cut counts characters from the start.
PIECE = 64


def grams(text: Column, width: int = 6) -> Column:
    """The distinct runs of `width` characters; a shorter text is one, an empty one has none."""
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)), F.lit(PIECE)), lambda i: F.substring(text, i, F.lit(PIECE + width - 1)))
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - width + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(width)))
    many = F.array_distinct(F.flatten(F.transform(pieces, cut)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= width, F.array(text)).otherwise(many)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def script_json(json: Column) -> Column:
    """JSON that can stand in a script element."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(a), F.lit(b))
    return json


def _marked(text: Column, expression: str) -> Column:
    """HTML of a text with all matches of an expression marked: what is between them and they themselves, escaped piece by piece."""
    pattern = f"(?iu)({expression})"
    pieces = F.struct(F.split(text, pattern, -1).alias("plain"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("found"))
    mark = lambda m: F.coalesce(F.concat(F.lit("<mark>"), escape_html(m), F.lit("</mark>")), F.lit(""))
    return let(pieces, lambda s: F.array_join(F.transform(s.plain, lambda p, i: F.concat(escape_html(p), mark(F.get(s.found, i)))), ""))


def _literal(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def highlight(text: Column, query: str) -> Column:
    """HTML of a text with every occurrence of the query marked, white space between its characters aside."""
    letters = [c for c in unicodedata.normalize("NFC", query) if not c.isspace()]
    if not letters:
        return escape_html(nfc(text))
    return _marked(nfc(text), r"(?U:\s*)".join(map(_literal, letters)))


BEFORE, AFTER = 54, 116


def excerpt(text: Column, tokens: list[str]) -> Column:
    """A window about the first token, all tokens in it marked, longer ones first; dots where the text goes on."""
    tokens = [t for t in tokens if t]
    places = [F.nullif(F.instr(F.lower(text), F.lit(t.lower())), F.lit(0)) for t in tokens]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) if places else F.lit(1)
    start, end = F.greatest(F.lit(1), first - BEFORE), F.least(F.length(text), first - 1 + AFTER)
    window = F.substring(text, start, end - start + 1)
    marked = _marked(window, "|".join(map(_literal, sorted(tokens, key=len, reverse=True)))) if tokens else escape_html(window)
    return F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(end < F.length(text), "…").otherwise(""))


def surface_words(text: Column) -> Column:
    """Runs of letters and digits of a text in composed form, see nfc()."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def candidate_queries(words: Column) -> Column:
    """A query's words in a row, and with one word cut in two at each place, places near its middle first."""
    join = lambda ws: F.array_join(ws, " ")

    def cuts(word: Column, i: Column) -> Column:
        n = F.length(word)
        key = lambda k: F.struct(F.abs(k - n / 2).alias("far"), k.alias("k"))
        order = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda k: k > 0), key))
        split = lambda k: F.array(F.substring(word, F.lit(1), k), F.substring(word, k + 1, n))
        return F.transform(order, lambda o: join(F.concat(F.slice(words, F.lit(1), i), split(o.k), F.slice(words, i + 2, F.size(words)))))

    variants = F.concat(F.array(join(words)), F.flatten(F.transform(words, cuts)))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(variants, lambda v: v != "")))


#: Block ids have five digits, and as many more as they need.
BLOCK_ID = "^b(?:[0-9]{5}|[1-9][0-9]{5,})$"


def block_id(ordinal: Column) -> Column:
    return F.format_string("b%05d", ordinal)


def block_of(anchor: Column, url: Column) -> Column:
    """The block id of a search hit: its anchor, or the fragment of its address."""
    fragment = F.try_element_at(F.split(F.coalesce(url, F.lit("")), "#", -1), F.lit(2))
    return F.when(anchor.rlike(BLOCK_ID), anchor).when(fragment.rlike(BLOCK_ID), fragment)


def file_size(size: Column) -> Column:
    """Megabytes or kilobytes with one decimal."""
    mb = 1024.0 * 1024
    return F.when(size >= mb, F.concat(F.format_string("%.1f", size / mb), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB")))


def download_size(size: Column) -> Column:
    """Megabytes with one decimal, or whole kilobytes."""
    mb = 1024.0 * 1024
    return F.when(size >= mb, F.concat(F.format_string("%.1f", size / mb), F.lit(" MB"))).otherwise(F.concat(F.floor(size / 1024.0 + 0.5).cast("string"), F.lit(" KB")))


def japanese_date(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))


def japanese_count(text: Column) -> Column:
    """Kana and Han characters."""
    return F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"))


IMAGES, DESCRIBED = r"(?i)<img\b[^>]*>", r"(?i)<img\b[^>]*\salt\s*=\s*(?:\"[^\"]*[^\"\s][^\"]*\"|'[^']*[^'\s][^']*')[^>]*>"


def images(markup: Column) -> Column:
    """How many images a document refers to."""
    return F.regexp_count(markup, F.lit(IMAGES))


def images_without_text(markup: Column) -> Column:
    """How many of them have no words to stand for them."""
    return images(markup) - F.regexp_count(markup, F.lit(DESCRIBED))


def join_lines(left: Column, right: Column) -> Column:
    """Two printed lines as one: a hyphen keeps the joint, Latin words get a space, other scripts none."""
    last = F.regexp_extract(left, r"(\S+)\s*$", 1)
    latin = left.rlike(r"[A-Za-z0-9][,.;:]?\s*$") & right.rlike(r"^\s*[A-Za-z0-9]") & (F.length(last) > 1)
    space = F.when(left.rlike(r"[-‐]\s*$"), "").when(latin, " ").otherwise("")
    return F.concat(F.regexp_replace(left, r"\s+$", ""), space, F.regexp_replace(right, r"^\s+", ""))


def page_text(text: Column) -> Column:
    """Text from a page description: composed, without soft hyphens, bullets and missing glyphs made plain."""
    out = F.replace(nfc(text), F.lit("­"), F.lit(""))
    return collapse(F.translate(out, "\u0000", "•□"))


def repaired(text: Column, glyphs: dict[str, str]) -> Column:
    """Replace wrongly coded glyphs, longer ones first."""
    for a in sorted(glyphs, key=lambda g: (-len(g), g)):
        text = F.replace(text, F.lit(a), F.lit(glyphs[a]))
    return text


def archive_path(base: Column, target: Column) -> Column:
    """A relative address resolved against a member of an archive, without its fragment; null where it leaves it."""
    short_batches()

    @F.pandas_udf("string")
    def resolve(b: pd.Series, t: pd.Series) -> pd.Series:
        def one(member: str | None, address: str | None) -> str | None:
            if member is None or address is None or re.match(r"[a-z][a-z0-9+.-]*:|/", address, re.I):
                return None
            parts = member.split("/")[:-1] if address.partition("#")[0] else member.split("/")
            for p in filter(None, address.partition("#")[0].split("/")):
                if p == "..":
                    if not parts:
                        return None
                    parts.pop()
                elif p != ".":
                    parts.append(p)
            return "/".join(parts)

        return pd.Series([one(x, y) for x, y in zip(b, t, strict=True)], dtype=object)

    return resolve(base, target)
