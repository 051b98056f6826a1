"""Source-location markers in running text: finding them, judging them, naming them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.text import collapse, let, strip

#: The grammar of markers, as Java expressions (flags: ignore case, Unicode classes).
FLAGS = "(?iU)"
MARKER = FLAGS + (
    r"(?:〔\s*(?:(?:原刊|原冊|原資料|原書|原写本|写本(?=（)|自筆稿(?!の)|原稿|底本|原誌|原報告|クラウス\s*117\s*写本|出所|PMM\s*\d+\s*,|主底本|補完底本|合成底本)"
    r"[^〕\r\n]{0,240})〕|\{\{\s*SOURCE\s*:\s*[^{}\r\n]{1,240}\s*\}\})"
)
STANDALONE = r"(?U)^(?:原資料(?:画像)?頁\s*\d+(?:\s*[–-]\s*\d+)?|(?:未丁付)?第\s*\d+\s*葉[表裏])$"
FACSIMILE = r"(?U)^原資料(?:画像)?頁\s*\d+$"
HEADING = r"(?U)^\s*(?:#{1,6}\s*)?(?:\*{0,2})?日本語全訳(?:\*{0,2})?\s*$"
FRONT = r"(?U)^\s*(?:#{1,6}\s*(?:\*{0,2}|_{0,2}))?原刊(?:略標題紙|標題紙|内表紙|表紙|扉|前付)(?:\*{0,2}|_{0,2})\s*$"
METADATA_HEADING = r"^(?:書誌(?:・底本)?|底本|著作権(?:・(?:利用条件|翻訳方針))?|利用条件)$"
DEFAULT_LOCATION = "底本位置なし（前付）"
#: Labels that name a place, by the kind of source.
FOLIO = r"\b(?:f|ff|fol|fols)\.\s*\d+[rv]?"
PLACE_IN_RECORD = FLAGS + rf"(?:\b\d{{4}}年版\s*p\.?\s*\d|{FOLIO}|\b(?:p|pp|n)\.\s*\d)"
PLACE_IN_SERIES = FLAGS + FOLIO
PLACE_IN_COMPOSITE = FLAGS + rf"(?:\bp\.?\s*\d|{FOLIO}|(?:底本|デジタル)画像\s*\d)"
PLACE_IN_BOOK = FLAGS + (
    r"^(?:原刊(?:\s+(?:p\.?|fol\.?)|第二冊|旧付番|前付|巻頭書目|楽譜|図版|PDF|注\d+・原刊|\d|[ivxlcdm]+頁|・|半標題紙|外装表紙|折込地図|表紙|扉|標題紙)"
    r"|原冊(?:\s*f\.?\s*\d+[rv]|第\s*\d+\s*葉[表裏])|原書(?:\s+p\.?|折込図版)|原写本(?:\s+p\.?|・第|・無番号挿入葉)"
    r"|写本（[^）\r\n]+）\s*f\.?\s*\d+[rv]|自筆稿(?:\s+第\d+巻\s+f\.?\s*\d+[rv]?|\s+f\.?\s*\d+[rv]?)|原稿\s+p\."
    r"|底本(?:\s+p\.?|画像\s*\d)|デジタル画像\s*\d|原誌(?:\s*p\.?|\d+頁)|原報告第\d+(?:[–-]\d+)?頁|クラウス\s*117\s*写本\s+f\.?\s*\d+[rv])"
)
PLACEHOLDER = FLAGS + r"^(?:(?:原刊(?:旧付番)?|原書|原写本|原稿|底本|原誌)\s+p\.?\s*(?:X|fX)|原資料\s*[:：]\s*(?:X|○+)|出所\s+(?:X|○+))$"
SERIES = FLAGS + r"^PMM\s*\d+\s*,"
RESOURCE, RECORD, COMPOSITE = r"(?U)^原資料\s*[:：]", r"(?U)^出所\b", r"(?U)^(?:主底本|補完底本|合成底本)\b"
BRACES = FLAGS + r"^\{\{\s*SOURCE\s*:\s*|\s*\}\}$"


def _label(text: Column, inside: Column) -> Column:
    """The name of a marker `text` without space around it, by what stands `inside` it."""
    source = F.concat(F.lit("出所 "), collapse(F.regexp_replace(text, BRACES, "")))
    short = F.trim(F.regexp_extract(inside, "^([^。：、]*)", 1))
    return F.when(F.startswith(text, F.lit("{{")), source).when(inside.rlike(SERIES), short).otherwise(inside)


def _inside(text: Column) -> Column:
    return collapse(F.substring(text, F.lit(2), F.length(text) - 2))


def label(marker: Column) -> Column:
    """The name of a marker: what stands inside; for a series, up to its first stop."""
    return let(strip(marker), lambda text: let(_inside(text), lambda inside: _label(text, inside)))


def note(marker: Column) -> Column:
    """The editor's note that follows the label in a series marker, or null."""

    def said(text: Column) -> Column:
        return let(_inside(text), lambda inside: F.when(F.startswith(text, F.lit("〔")) & inside.rlike(SERIES), F.nullif(F.trim(F.regexp_extract(inside, "^[^。：、]+[。：、](.*)$", 1)), F.lit(""))))

    return let(strip(marker), said)


def named(value: Column) -> Column:
    """The name of a marker, or of what may be the text of one."""
    is_marker = lambda text: F.startswith(text, F.lit("〔")) | F.startswith(text, F.lit("{{"))
    return let(strip(value), lambda text: F.when(is_marker(text), let(_inside(text), lambda inside: _label(text, inside))).otherwise(text))


def names_place(name: Column) -> Column:
    """Whether a name is that of a place. The first rule that applies decides."""
    return (
        F.when(name.rlike(RESOURCE) | name.rlike(STANDALONE), True)
        .when(name.rlike(RECORD), name.rlike(PLACE_IN_RECORD))
        .when(name.rlike(SERIES), name.rlike(PLACE_IN_SERIES))
        .when(name.rlike(COMPOSITE), name.rlike(PLACE_IN_COMPOSITE))
        .otherwise(name.rlike(PLACE_IN_BOOK))
    )


def is_location(value: Column) -> Column:
    """Whether a marker, or the text of one, names a place."""
    return let(named(value), names_place)


def is_placeholder(value: Column) -> Column:
    return named(value).rlike(PLACEHOLDER)


def names_concrete(name: Column) -> Column:
    return names_place(name) & ~name.rlike(PLACEHOLDER)


def is_concrete(marker: Column) -> Column:
    return let(named(marker), names_concrete)


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))


def concrete(text: Column) -> Column:
    """(marker, name) of the markers that name a place, each named once."""
    found = F.transform(markers(text), lambda m: F.struct(m.alias("marker"), named(m).alias("name")))
    return F.filter(found, lambda x: names_concrete(x["name"]))


def first_concrete(text: Column) -> Column:
    """The first marker that names a place, or null."""
    return F.try_element_at(concrete(text), F.lit(1)).marker


def is_standalone(line: Column) -> Column:
    return strip(line).rlike(STANDALONE)
