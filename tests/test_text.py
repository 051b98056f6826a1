"""Text and marker functions on single values."""

import pytest
from pyspark.sql import functions as F

from stemma.functions import catalogue as C
from stemma.functions import markers as M
from stemma.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("Ａｂ-１ ﾊﾟ­", "ab1パ"), ("", ""), ("(Ⅻ) ² é", "xii2é"), ("a　b​", "ab"), ("😀x", "x")])
def test_matchable(spark, text, want):
    assert one(spark, T.matchable(F.col("t")), t=text) == want


@pytest.mark.parametrize("text", ["ポ　ラ", "ポラ", " ポ\nラ "])
def test_comparable(spark, text):
    assert one(spark, T.comparable(F.col("t")), t=text) == "ポラ" == T.comparable_value(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("## **Title** of [this](x) ![pic](y)", "Title of this pic"),
        ("- item *one* &amp; `two`", "item one & two"),
        ("> quoted <b>bold</b>  text", "quoted bold text"),
        ("3) third snake_case stays", "third snake_case stays"),
        ("", ""),
    ],
)
def test_clean_inline(spark, text, want):
    assert one(spark, T.clean_inline(F.col("t")), t=text) == want


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="一。二！ 三？four! five") == ["一。", "二！", "三？", "four!", "five"]


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 63, 64, 69, 70, 200])
def test_grams(spark, n):
    text = "".join(chr(97 + i * i % 23) for i in range(n))
    want = set() if not n else {text} if n <= 6 else {text[i : i + 6] for i in range(n - 5)}
    assert set(one(spark, T.grams(F.col("t")), t=text)) == want


def test_highlight(spark):
    assert one(spark, T.highlight(F.col("t"), "a b"), t="x A　B <ab>") == "x <mark>A　B</mark> &lt;<mark>ab</mark>&gt;"
    assert one(spark, T.highlight(F.col("t"), " "), t="a&b") == "a&amp;b"


def test_excerpt(spark):
    text = "x" * 100 + "needle" + "y" * 200
    got = one(spark, T.excerpt(F.col("t"), ["needle", "dle"]), t=text)
    assert got == "…" + "x" * 54 + "<mark>needle</mark>" + "y" * 110 + "…"


def test_candidate_queries(spark):
    assert one(spark, T.candidate_queries(T.surface_words(F.col("t"))), t="abcd ef!") == ["abcd ef", "ab cd ef", "a bcd ef", "abc d ef", "abcd e f"]
    assert one(spark, T.candidate_queries(T.surface_words(F.col("t"))), t="--") == []


@pytest.mark.parametrize("anchor, url, want", [("b00001", "", "b00001"), (None, "/x#b00002", "b00002"), ("b1", "/x#c", None), (None, None, None), ("b012345", "/x", None), ("b123456", "/x", "b123456")])
def test_block_of(spark, anchor, url, want):
    assert one(spark, T.block_of(F.col("a"), F.col("u")), a=anchor, u=url) == want


@pytest.mark.parametrize("base, target, want", [("OPS/a/x.xhtml", "../b.xhtml#n", "OPS/b.xhtml"), ("OPS/x.xhtml", "#n", "OPS/x.xhtml"), ("x", "../../y", None), ("x", "http://e/", None)])
def test_archive_path(spark, base, target, want):
    assert one(spark, T.archive_path(F.col("b"), F.col("t")), b=base, t=target) == want


@pytest.mark.parametrize("left, right, want", [("multi-", "part", "multi-part"), ("two", "words", "two words"), ("漢字", "仮名", "漢字仮名")])
def test_join_lines(spark, left, right, want):
    assert one(spark, T.join_lines(F.col("l"), F.col("r")), l=left, r=right) == want


def test_sizes(spark):
    sizes = spark.createDataFrame([(1048576,), (1536,), (256,)], "n long").select(T.file_size(F.col("n")).alias("x")).collect()
    assert [r.x for r in sizes] == ["1.0 MB", "1.5 KB", "0.3 KB"]


MARKERS = [
    ("〔原刊 p. 12〕", "原刊 p. 12", True, False),
    ("〔原刊 p. X〕", "原刊 p. X", True, True),
    ("〔底本画像 7〕", "底本画像 7", True, False),
    ("〔写本（甲）f. 3r〕", "写本（甲）f. 3r", True, False),
    ("〔出所 不明〕", "出所 不明", False, False),
    ("〔出所 1911年版 p. 4〕", "出所 1911年版 p. 4", True, False),
    ("{{SOURCE:  pp. 4–5 }}", "出所 pp. 4–5", True, False),
    ("{{ source: X}}", "出所 X", False, True),
    ("〔PMM 9, f. 12v。注の文〕", "PMM 9, f. 12v", True, False),
    ("〔PMM 9, 巻頭〕", "PMM 9, 巻頭", False, False),
    ("〔主底本 p. 3 ／補完底本 p. 4〕", "主底本 p. 3 ／補完底本 p. 4", True, False),
    ("〔クラウス 117 写本 f. 5v〕", "クラウス 117 写本 f. 5v", True, False),
    ("〔原報告第3–4頁〕", "原報告第3–4頁", True, False),
    ("〔原資料: 函三〕", "原資料: 函三", True, False),
    ("〔原資料：○○〕", "原資料：○○", True, True),
    ("〔底本位置なし（前付）〕", "底本位置なし（前付）", False, False),
]


@pytest.mark.parametrize("marker, label, location, placeholder", MARKERS)
def test_markers(spark, marker, label, location, placeholder):
    assert one(spark, M.markers(F.concat(F.lit("前 "), "t", F.lit(" 後"))), t=marker) == [marker]
    assert one(spark, M.label(F.col("t")), t=marker) == label
    assert one(spark, M.is_location(F.col("t")), t=marker) == location
    assert one(spark, M.is_placeholder(F.col("t")), t=marker) == placeholder


def test_other_brackets_are_no_markers(spark):
    assert one(spark, M.markers(F.col("t")), t="〔注 1〕 [原刊 p. 1] 〔自筆稿の話〕 〔写本 f. 1〕") == []
    assert one(spark, M.note(F.col("t")), t="〔PMM 9, f. 12v：補足〕") == "補足"
    assert one(spark, M.note(F.col("t")), t="〔原刊 p. 1。x〕") is None


@pytest.mark.parametrize("year, number, era", [("1598", 1598, "17世紀"), ("16世紀", 1599, ""), ("0世紀", None, ""), ("刊年不詳", None, ""), ("1850", 1850, "19世紀後半"), ("1911", 1911, "20世紀初頭"), (None, None, "")])
def test_years(spark, year, number, era):
    assert one(spark, C.sort_year(F.col("y")), y=year) == number
    assert one(spark, C.era(F.col("y")), y=year) == era


def test_marks_take_nothing_from_the_text(spark):
    """Private characters stay, and what is marked is escaped by itself."""
    text = "\ue000a<b\ue001 A<B &"
    assert one(spark, T.highlight(F.col("t"), "a<b"), t=text) == "\ue000<mark>a&lt;b</mark>\ue001 <mark>A&lt;B</mark> &amp;"
    assert one(spark, T.excerpt(F.col("t"), ["a<", "&"]), t=text) == "\ue000<mark>a&lt;</mark>b\ue001 <mark>A&lt;</mark>B <mark>&amp;</mark>"
