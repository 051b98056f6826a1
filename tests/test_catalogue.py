"""The catalogue, search on references, and integrity checks, on small tables."""

from pyspark.sql import functions as F

from stemma.operators import catalogue as K
from stemma.operators import integrity as I
from stemma.operators import outline, search


def pubs(spark, *rows):
    cols = "slug string, title string, author string, author_key string, year string, types array<string>, regions array<string>, languages array<string>, tags array<string>, ord long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], cols)


def book(slug, year, author="著者", types=("t",), regions=("r",), languages=("l",), tags=("g",)):
    return slug, f"題 {slug}", author, author.lower(), year, list(types), list(regions), list(languages), list(tags)


def test_year_order(spark):
    rows = pubs(spark, book("unknown", "不詳"), book("b", "1600"), book("c", "16世紀"), book("d", "1598"), book("e", "1600"), book("zero", "0世紀"))
    for ranked in (K.ranked, lambda df, sort: K.ranked_by_year(df, sort == "year-desc")):
        assert [r.slug for r in ranked(rows, "year-asc").orderBy("rank").collect()] == ["d", "c", "b", "e", "unknown", "zero"]
        assert [r.slug for r in ranked(rows, "year-desc").orderBy("rank").collect()] == ["b", "e", "c", "d", "unknown", "zero"]


def test_filters(spark):
    rows = pubs(spark, book("a", "1699", types=["x", "y"]), book("b", "1700", regions=[]), book("c", "16世紀"))
    got = lambda **s: {r.slug for r in K.matching(rows, K.State(**s)).collect()}
    assert got() == {"a", "b", "c"}
    assert got(q=" 題 A ") == {"a"}
    assert got(type="y") == {"a"} and got(region="r") == {"a", "c"}
    assert got(era="17世紀") == {"a"} and got(era="18世紀") == {"b"}


def test_pages(spark):
    rows = pubs(spark, *[book(f"s{i:02d}", str(1600 + i)) for i in range(13)])
    got = lambda **s: [r.slug for r in K.page(rows, K.State(**s)).orderBy("rank").collect()]
    assert got(per_page=6, page=3) == ["s12"]
    assert got(per_page=6, page=99) == ["s12"]  # the last page there is
    assert len(got(per_page=None)) == 13
    assert K.page_label(13, K.State(per_page=6, page=2)) == (7, 12) and K.page_label(0, K.State()) == (0, 0)
    assert K.page_strip(10, 5) == [1, "ellipsis", 4, 5, 6, "ellipsis", 10]
    assert K.page_strip(5, 3) == [1, 2, 3, 4, 5] and K.page_strip(9, 1, True) == [1, 2, "ellipsis", 9]
    assert K.parse_state({"perPage": "7", "page": "2.5", "q": "x"}) == K.State(q="x", page=2)


def test_authors(spark):
    rows = pubs(spark, book("z", "1700", "Ann"), book("y", "1690", "ANN"), book("x", "不詳", "ann"), book("w", "1700", "Bob"))
    got = {r.author_key: (r["name"], r.works) for r in K.author_groups(rows).collect()}
    assert got == {"ann": ("Ann", ["y", "z", "x"]), "bob": ("Bob", ["w"])}


def test_related(spark):
    rows = pubs(spark, book("a", "1700", regions=["p", "p"]), book("b", "1650", regions=["p"]), book("c", "1640", types=[], regions=[], languages=[], tags=[]), book("d", "1600", types=["t"], regions=[], languages=[], tags=[]), book("e", "1500", types=[], regions=[], languages=[], tags=[]))
    got = {}
    for r in K.related(rows).orderBy("slug", "rank").collect():
        got.setdefault(r.slug, []).append((r.related, r.score))
    assert got["a"] == [("b", 14), ("d", 3), ("e", 0)]  # a repeated value of the record itself counts twice
    assert got["b"] == [("a", 10), ("d", 3), ("e", 0)]
    assert got["e"] == [("d", 0), ("c", 0), ("b", 0)]


def test_assets(spark):
    import pytest

    rows = spark.createDataFrame([("a", "p/a", "e/a")], "slug string, pdf string, epub string")
    assets = spark.createDataFrame([("p/a", 5), ("e/a", 7)], "path string, size long")
    assert K.with_assets(rows, assets).first()[-2:] == (5, 7)
    with pytest.raises(Exception, match="no epub of a"):
        K.with_assets(rows, assets.where("size = 5")).collect()


def test_snippets(spark):
    rows = spark.createDataFrame([("w", 3, "p. 2", 9, "third"), ("w", 1, "p. 1", 9, "first"), ("w", 2, "p. 1", 9, "second"), ("w", 4, "p. 3", 8, "fourth")], "slug string, ord int, original_page string, pdf_page int, text string")
    got = {r.pdf_page: (r.block_id, r.original_page, r.ord, r.excerpt) for r in search.snippets(rows).collect()}
    assert got == {9: ("b00001", "p. 1／p. 2", 1, "first"), 8: ("b00004", "p. 3", 4, "fourth")}


def test_literal_search(spark):
    rows = spark.createDataFrame([("a", 1, "ポ　ラ", 0, "major-work"), ("b", 2, "ボラ", 1, "x"), ("b", 3, "ポラポラ", 1, "x")], "slug string, ord int, text string, work_ord int, record_class string")
    found = search.literal_chunks(rows, "ポラ")
    assert {r.ord for r in found.collect()} == {1, 3}
    assert [r.slug for r in search.works(found).orderBy("rank").collect()] == ["a", "b"] == [r.slug for r in search.works(found, 5).orderBy("rank").collect()]
    assert tuple(search.counts(search.by_work(found)).first()) == (1, 1)


def test_references(spark):
    import pytest

    schema = "part_id string, score double, pos int"
    exact = spark.createDataFrame([("p1", 1.0, 0), ("p2", 2.0, 1), ("p3", 3.0, 2)], schema)
    broad = spark.createDataFrame([("p1", 9.0, 0), ("p2", 0.0, 1)], schema)
    documents = spark.createDataFrame([("p1", "a", "x", 1), ("p2", "b", "x", 0), ("p3", "b", "x", 1)], "part_id string, slug string, record_class string, part_index int")
    got = [(r.slug, r.score, r.parts) for r in search.grouped_references(exact, broad, documents).orderBy("rank").collect()]
    assert got == [("a", 9.0, [1]), ("b", 5.0, [0, 1])]
    with pytest.raises(Exception, match="unmapped search document: p3"):
        search.grouped_references(exact, broad, documents.where("part_id <> 'p3'")).collect()
    results = spark.createDataFrame([("p", 1, 0, None, "/x#b00001", "late"), ("p", 0, 1, "b00001", "", "first"), ("p", 0, 2, None, "/y", "other")], "part_id string, variant int, position int, anchor string, url string, excerpt string")
    assert {r.excerpt for r in search.first_results(results).collect()} == {"first", "other"}


def checks(df):
    return {(r.check, r.key) for r in df.collect()}


def test_integrity(spark):
    slugs = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    archived = spark.createDataFrame([("a", "w/a"), ("x", "w/a")], "slug string, path string")
    fallbacks = spark.createDataFrame([("a", "p"), ("b", None)], "slug string, canonical_path string")
    assert checks(I.ledger(slugs, archived, fallbacks)) == {("overlap", "a"), ("missing", "c"), ("stale", "x"), ("path", "x"), ("path-twice", "w/a"), ("fallback", "b")}
    assert checks(I.required(spark.createDataFrame([("a", " ", None)], "slug string, t string, u string"), "slug", ["t", "u"])) == {("required", "a")}
    order = spark.createDataFrame([("ok", 0), ("ok", 1), ("gap", 0), ("gap", 2), ("twice", 0), ("twice", 0)], "slug string, n int")
    assert checks(I.contiguous(order, "slug", "n")) == {("sequence", "gap"), ("sequence", "twice")}
    parts = spark.createDataFrame([("ja_0f", "a", 0, 10), ("bad", "a", 1, 800_000), ("ja_1", "q", 0, 1)], "part_id string, slug string, part_index int, bytes long")
    expected = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "slug string, part_index int")
    assert checks(I.fragments(parts, expected)) == {("shape:part_id", "bad"), ("size", "bad"), ("fragment-missing", "b/0"), ("fragment-unknown", "q/0")}
    listed = spark.createDataFrame([("f", 1, "s"), ("g", 1, "s"), ("h", 1, "s")], "path string, size long, sha256 string")
    assert checks(I.checksums(listed, spark.createDataFrame([("f", 1, "s"), ("g", 2, "s")], listed.schema), "path")) == {("checksum", "g"), ("checksum", "h")}
    meta = spark.createDataFrame([(1, "a" * 40, "zz", 2, 0, 9)], "schema_version int, archive_commit string, manifest_sha256 string, books long, papers long, chunks long")
    assert checks(I.freshness(meta, slugs.withColumn("record_class", F.lit("major-work")))) == {("manifest", "index"), ("counts", "index")}
    want = spark.createDataFrame([("q", 1, 2, None), ("r", 1, 1, 1)], "query string, books long, papers long, pages long")
    assert checks(I.golden(spark.createDataFrame([("q", 1, 2, 7)], want.schema), want)) == {("golden", "r")}


def test_outline(spark):
    heads = spark.createDataFrame([("w", 1, 1), ("w", 2, 3), ("w", 3, 2), ("w", 4, 3), ("w", 5, 1)], "slug string, ord int, level int")
    assert {r.ord: r.parent for r in outline.nested(heads).collect()} == {1: None, 2: 1, 3: 1, 4: 3, 5: None}
