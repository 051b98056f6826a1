"""Readers, annotation, chunks, alignment, index."""

import io
import zipfile

from pyspark.sql import functions as F

from stemma.operators import align, annotate, index
from stemma.sources import formats, sinks

PLACE = "底本位置なし（前付）"


def paragraphs(spark, *texts):
    return spark.createDataFrame([("w", i + 1, t) for i, t in enumerate(texts)], "slug string, para_no int, text string")


def annotated(spark, *texts):
    return [(r.original_page, r.text) for r in annotate.annotated(paragraphs(spark, *texts)).orderBy("seq").collect()]


def test_marker_splits_a_paragraph(spark):
    assert annotated(spark, "はじめ", "前〔原刊 p. 1〕中〔注〕〔原刊 p. X〕後〔原刊 p. 2〕", "次") == [(PLACE, "はじめ"), (PLACE, "前"), ("原刊 p. 1", "中〔注〕後"), ("原刊 p. 2", "次")]


def test_page_line_names_itself(spark):
    assert annotated(spark, " 原資料頁 3 ", "文") == [("原資料頁 3", "原資料頁 3"), ("原資料頁 3", "文")]


def test_note_of_a_series(spark):
    assert annotated(spark, "〔PMM 9, f. 1r。覚え書き〕本文") == [("PMM 9, f. 1r", "訳注　覚え書き"), ("PMM 9, f. 1r", "本文")]


def test_works_do_not_mix(spark):
    rows = spark.createDataFrame([("a", 1, "〔原刊 p. 1〕x"), ("b", 1, "y")], "slug string, para_no int, text string")
    assert {(r.slug, r.original_page) for r in annotate.annotated(rows).collect()} == {("a", "原刊 p. 1"), ("b", PLACE)}


def test_trim(spark):
    keep = lambda *t, **k: [r.text for r in annotate.trimmed(paragraphs(spark, *t), **k).orderBy("para_no").collect()]
    assert keep("方針", "日本語全訳", "本文") == ["本文"]
    assert keep("方針", "原刊扉", "x", "〔原刊 p. 1〕") == ["原刊扉", "x", "〔原刊 p. 1〕"]
    assert keep("方針", "〔原刊 p. 1〕x", "日本語全訳") == ["〔原刊 p. 1〕x", "日本語全訳"]
    assert keep("方針", "〔原刊 p. 1〕x", marker_fallback=False) == ["方針", "〔原刊 p. 1〕x"]


MARKDOWN = """方針の説明

# 日本語全訳

## 第一章
一行目
二行目

| 甲 | 乙 |
|----|----|
| 丙 |   |
```
code  one
# not a heading
```
〔原刊 p. 3〕 三
原資料頁 4
終り"""


def test_markdown(spark):
    files = spark.createDataFrame([("w", MARKDOWN)], "slug string, text string")
    got = [r.text for r in formats.markdown_paragraphs(files).orderBy("para_no").collect()]
    assert got == ["## 第一章", "一行目 二行目", "甲　乙", "丙", "code  one # not a heading", "〔原刊 p. 3〕 三", "原資料頁 4", "終り"]


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx(spark):
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="s"/></w:pPr><w:r><w:t>〔出所 p. 1〕</w:t></w:r></w:p><w:p><w:r><w:t>〔出所 p. 2〕</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/></w:body></w:document>'
    styles = f'<w:styles {W}><w:style w:styleId="s"><w:name w:val="Source Page"/></w:style></w:styles>'
    notes = f'<w:footnotes {W}><w:footnote><w:p><w:r><w:t>注</w:t></w:r></w:p></w:footnote></w:footnotes>'
    content = archive(**{"word/document.xml": body, "word/styles.xml": styles, "word/footnotes.xml": notes})
    rows = formats.docx_paragraphs(spark.createDataFrame([("w", bytearray(content))], "slug string, content binary"))
    assert [r.text for r in rows.orderBy("para_no").collect()] == ["〔出所 p. 1〕", "〔出所 p. 2〕\tx", "原注", "注"]


def epub(**pages):
    items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k in pages)
    refs = "".join(f'<itemref idref="{k}"/>' for k in pages)
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="nav" href="nav.xhtml" properties="nav"/>{items}</manifest><spine><itemref idref="nav"/>{refs}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    return archive(**{"META-INF/container.xml": container, "O/p.opf": opf, "O/nav.xhtml": "<p>nav</p>"}, **{f"O/{k}.xhtml": v for k, v in pages.items()})


def test_epub(spark):
    content = epub(
        a="<html><body><h1>題</h1><p>一<br/>二</p><blockquote><p>内</p></blockquote><script>no</script></body></html>",
        b="<p>壊れた<p>文書 & more<script>x</script>",
        c="<html><body><p>原資料頁 1</p><p>原資料頁 2</p></body></html>",
        d="<html><body><h2>書誌</h2><p>skip</p><h2>本文</h2><p>keep</p></body></html>",
    )
    rows = formats.epub_paragraphs(spark.createDataFrame([("w", bytearray(content))], "slug string, content binary"))
    assert [r.text for r in rows.orderBy("para_no").collect()] == ["題", "一 二", "内", "壊れた", "文書 & more", "本文", "keep"]


def test_html_blocks():
    assert formats.xhtml_blocks("<html><script>var t='</p>';</script><p>a<b>b<p>c<li>d</ul>") == [("p", "ab"), ("p", "c"), ("li", "d")]
    assert formats.xhtml_blocks("") == []


def test_pages(spark):
    rows = formats.page_rows(spark.createDataFrame([("w", "a\fb\f \n"), ("v", "c")], "slug string, page_text string"))
    assert {tuple(r) for r in rows.collect()} == {("w", 1, "a"), ("w", 2, "b"), ("v", 1, "c")}


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"version https://git-lfs.github.com/spec/v1\noid x")
    (tmp_path / "b.bin").write_bytes(b"real")
    rows = formats.read_files(spark, str(tmp_path)).withColumn("ok", formats.is_usable(F.col("content"))).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.ok, r["size"]) for r in rows} == {"a.bin": (False, 48), "b.bin": (True, 4)}


def test_manifest(spark, tmp_path):
    import json

    import pytest

    for version in (1, 2):
        (tmp_path / f"{version}.json").write_text(json.dumps({"schemaVersion": version, "works": [{"slug": "a"}, {"slug": "b"}]}))
    assert formats.read_manifest(spark, str(tmp_path / "1.json")).count() == 2
    with pytest.raises(Exception, match="schema version 2"):
        formats.read_manifest(spark, str(tmp_path / "2.json")).collect()


def brute_chunks(text, target=170, longest=190):
    import re

    pieces = []
    for s in (p.strip() for p in re.split("(?<=[。！？!?])", text)):
        while len(s) > longest:
            at = max(s.rfind(c, 135, 191) for c in "、；;：:，,")
            at = at + 1 if at >= 135 else longest
            pieces.append(s[:at].strip())
            s = s[at:].strip()
        if s:
            pieces.append(s)
    out = []
    for p in pieces:
        if out and len(out[-1]) + len(p) <= target:
            out[-1] += p
        else:
            out.append(p)
    return [re.sub(r"\s+", " ", x).strip() for x in out]


def test_chunks(spark):
    texts = ["あ" * n + "。" for n in (1, 168, 169, 170, 189, 190, 191, 400)] + ["い" * 150 + "、" + "う" * 100 + "。え。", "。", "ab。cd！" * 60]
    rows = spark.createDataFrame([("w", i, PLACE, t) for i, t in enumerate(texts)], "slug string, seq int, original_page string, text string")
    got = annotate.chunks(rows).orderBy("ord").collect()
    want = [c for t in texts for c in brute_chunks(t) if len([x for x in c if x.isalnum()]) >= 2]
    assert [r.text for r in got] == want
    assert [r.id for r in got] == [f"b{i + 1:05d}" for i in range(len(want))]


def chunk_rows(spark, *rows):
    return spark.createDataFrame([("w", i + 1, p, t) for i, (p, t) in enumerate(rows)], "slug string, ord int, original_page string, text string")


def page_table(spark, *texts):
    return spark.createDataFrame([("w", i + 1, t) for i, t in enumerate(texts)], "slug string, page_no int, text string")


def test_alignment_passes(spark):
    long_ = lambda k: "".join(chr(0x3042 + (i * i * k + i) % 80) for i in range(60))
    a, b, c = long_(3), long_(5), long_(7)
    twice = "abcdefghijkl"
    pages = page_table(spark, a + "short", twice + b[:20], b[20:] + twice + "xyzxyz", c)
    changed = c[:30] + "!" + "改" + c[31:]
    rows = chunk_rows(spark, ("甲", a), ("乙", "short"), ("乙", b), ("丙", twice), ("丁", changed), ("戊", "absent text here"))
    got = {r.ord: (r.pdf_page, r.alignment) for r in align.align(rows, pages).collect()}
    assert got[1] == (1, "exact")
    assert got[3] == (2, "exact")  # over a page end: the page where it begins
    assert got[2] == (1, "inherited")  # too short to prove anything, but on a page nearby
    assert got[4][1] == "fuzzy" and got[4][0] in (2, 3)  # twice in the work, so not exact
    assert got[5] == (4, "fingerprint")
    assert got[6] == (4, "inherited")


def test_unique_labels(spark):
    pages = page_table(spark, "〔原刊 p. 1〕a 〔原刊 p. 2〕b", "〔原刊 p. 2〕c\n原資料頁 9")
    labels = {r.page_no: r.labels for r in align.page_labels(pages).collect()}
    assert labels == {1: ["原刊 p. 1", "原刊 p. 2"], 2: ["原刊 p. 2", "原資料頁 9"]}
    rows = chunk_rows(spark, ("原刊 p. 1", "x"), ("原刊 p. 2", "y"), ("原刊 p. 7／原資料頁 9", "z"))
    assert {r.ord: r.page_no for r in align.unique_labels(rows, align.page_labels(pages)).collect()} == {1: 1, 3: 2}


def test_no_anchor_is_unmapped(spark):
    got = align.align(chunk_rows(spark, ("甲", "nothing like it here")), page_table(spark, "完全に別の頁")).first()
    assert (got.pdf_page, got.alignment) == (None, "unmapped")


def test_occurrences_everywhere(spark):
    """Also needles over many pages, of which some are short or empty, and beyond what a block carries."""
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.choice((0, 1, 5, 300, 2500)))) for _ in range(14)] + ["a"] * 40 + [""] * 40 + ["b" * 30, "ab" * 2000]
    located = align.page_starts(page_table(spark, *texts))
    hay = "".join(texts)
    begins = {r.page_no: r.start for r in located.collect()}
    assert [begins[i + 1] for i in range(len(texts))] == [sum(map(len, texts[:i])) for i in range(len(texts))]
    page = lambda at: max(i + 1 for i, t in enumerate(texts) if t and begins[i + 1] <= at)
    needles = [hay[i : i + n] for n in (12, 16, 18, 40, 511, 512, 513, 600, 1025, 1537, 5000) for i in range(0, len(hay) - n, 811)] + ["a" * 600, "ab" * 300, "b" * 513]
    for shortest in (12, 18):
        keyed = [("w", i, n) for i, n in enumerate(needles) if len(n) >= shortest]
        rows = align.occurrences(spark.createDataFrame(keyed, "slug string, key int, needle string"), align.blocks(located), shortest).collect()
        assert {(r.key, r.at) for r in rows} == {(i, p) for _, i, n in keyed for p in range(len(hay)) if hay.startswith(n, p)}
        assert all(r.page_no == page(r.at) for r in rows)


def test_offsets_beyond_32_bits(spark):
    chunks = spark.createDataFrame([("w", 3_000_000_000 + i, 1, "x") for i in range(3)], "slug string, ord long, pdf_page int, text string")
    assert [(r["first"], r.chunks) for r in index.parts(chunks).collect()] == [(3_000_000_000, 3)]


def test_parts(spark):
    rows = [("w", i + 1, page, "x" * n) for i, (page, n) in enumerate([(1, 60), (1, 60), (2, 10), (2, 90), (3, 1), (3, 1), (4, 1), (4, 1), (5, 1)])]
    got = index.parts(spark.createDataFrame(rows, "slug string, ord int, pdf_page int, text string"), 100, 4).orderBy("part").collect()
    assert [(r.part, r["first"], r.chunks, r.chars) for r in got] == [(0, 1, 2, 120), (1, 3, 2, 100), (2, 5, 4, 4), (3, 9, 1, 1)]


def test_footnotes(spark):
    notes = spark.createDataFrame([("w", "O/n.xhtml", "../O/a.xhtml#r1", "注一"), ("w", "O/n.xhtml", "a.xhtml#r2", "注二"), ("w", "O/n.xhtml", "#x", "注三")], "slug string, member string, href string, text string")
    anchors = spark.createDataFrame([("w", "O/a.xhtml", "r1", "原刊 p. 4"), ("w", "O/a.xhtml", "r2", PLACE)], "slug string, member string, fragment string, original_page string")
    assert sorted(r.text for r in annotate.footnote_places(notes, anchors).collect()) == ["〔原刊 p. 4〕注一", "注三", "注二"]


def test_scanned_pages(spark):
    schema = "slug string, page_no int, text string"
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("b", 1, " - "), ("b", 2, None)], schema)
    scanned = spark.createDataFrame([("a", 1, "no"), ("b", 1, "yes"), ("c", 1, "no")], schema)
    assert {tuple(r) for r in formats.text_or_scanned(pages, scanned).collect()} == {("a", 1, "x", "text"), ("a", 2, "", "text"), ("b", 1, "yes", "scanned")}


def test_asset_manifest(spark):
    files = spark.createDataFrame([("file:/data/in/a b/c.pdf", 3, "s")], "path string, size long, sha256 string")
    assert tuple(sinks.asset_manifest(files, "/data/in", "https://h/").first()) == ("a b/c.pdf", "https://h/a%20b/c.pdf", 3, "s")
    parts = spark.createDataFrame([("ja_1", "w", "major-work", 0)], "part_id string, slug string, record_class string, part_index int")
    assert sinks.document_map(parts).first().mapping == '["w","major-work",0]'
