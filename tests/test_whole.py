"""Queries that do the whole job: no row, text or record is left out, however many there are."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import catalogue
from stemma.plans import tables
from stemma.plans.queries import QUERIES


def test_every_chunk_is_located(spark, small):
    rows = QUERIES["located_results"](spark, small)
    assert rows.count() == tables.chunks(spark, small).count()
    assert rows.select("pdf_page").distinct().count() == spark.read.parquet(f"{small}/documents.parquet").where(F.length(F.replace("text", F.lit("\n"))) > 0).count()


def test_long_documents_are_located(spark, tmp_path):
    spark.createDataFrame([(7, "\n".join(["x"] * 100_005), "en", "src1", 0), (9, "a\n\nb", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["located_results"](spark, str(tmp_path))
    assert rows.count() == rows.select("slug", "id").distinct().count() == 100_007
    assert {(r.slug, r.id) for r in rows.where("pdf_page = 9").collect()} == {("src1", "b900000"), ("src1", "b900002")}


def test_whole_texts_are_escaped(spark, tmp_path):
    text = "x" * 1000 + "<a & \"b\" 'c'>" + "y" * 1000 + "&"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    html = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#039;")
    assert [tuple(r) for r in QUERIES["escaped_html"](spark, str(tmp_path)).collect()] == [(1, len(html), hashlib.sha256(html.encode()).hexdigest())]


@pytest.mark.parametrize("most", [3, 5])
def test_related_without_pairs(spark, most, monkeypatch):
    """Against all pairs, with records of few values and of many."""
    monkeypatch.setattr(catalogue, "SET_VALUES", 6)
    r = random.Random(most)
    some = lambda n: [f"v{r.randrange(n)}" for _ in range(r.randrange(most))]
    rows = [(f"s{i}", r.choice(["1700", "1650", "?"]), i, some(6), some(4), some(2), some(20)) for i in range(120)]
    got = {}
    for x in catalogue.related(spark.createDataFrame(rows, "slug string, year string, ord int, types array<string>, regions array<string>, languages array<string>, tags array<string>")).collect():
        got.setdefault(x.slug, {})[x.rank] = (x.related, x.score)
    score = lambda a, b: sum(w * sum(v in b[k] for v in a[k]) for k, w in ((3, 3), (4, 4), (5, 1), (6, 2)))
    for a in rows:
        best = sorted((-score(a, b), b[1] == "?", b[1], b[2], b[0]) for b in rows if b is not a)[:3]
        assert got[a[0]] == {k + 1: (b[4], -b[0]) for k, b in enumerate(best)}


def test_related_runs_over_the_whole_catalogue(spark, small):
    """Every record of the catalogue has its three, and no value's records are paired."""
    rows = QUERIES["related_top3"](spark, small)
    assert rows.count() == 3 * tables.publications(spark, small).count()
    same = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("slug"), F.lit("1700").alias("year"), F.col("id").alias("ord"), *[F.array(F.lit("v")).alias(c) for c in catalogue.ARRAYS])
    assert {tuple(r) for r in catalogue.related(same).groupBy("related", "score").count().collect()} == {("s0", 10, 19_999), ("s1", 10, 19_999), ("s2", 10, 19_999), ("s3", 10, 3)}


def test_ranks_by_ranges(spark):
    """Against a plain sort: keys that are all different, few, equal or null, both ways."""
    from stemma.operators import ranking

    for seed, key in enumerate([lambda i, r: r.random(), lambda i, r: r.randrange(3), lambda i, r: 1, lambda i, r: r.choice([None, 2, r.random()])]):
        r = random.Random(seed)
        rows = [(i, v if (v := key(i, r)) is None else float(v)) for i in range(3000)]
        df = spark.createDataFrame(rows, "ord long, v double").repartition(7)
        for down in (False, True):
            want = sorted(rows, key=lambda x: (x[1] is None, 0 if x[1] is None else -x[1] if down else x[1], x[0]))
            got = ranking.numbered(df, F.col("v"), "ord", down).collect()
            assert {x.ord: x["rank"] for x in got} == {x[0]: n + 1 for n, x in enumerate(want)}


def test_carried_values_over_buckets(spark, monkeypatch):
    from stemma.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET", 5)
    r = random.Random(1)
    rows = [(w, i * r.choice((1, 2, 40)) + 1000 * j, r.choice([None, None, None, i])) for w in ("a", "b", None) for j, i in enumerate(range(60))]
    rows = sorted({(w, i): (w, i, v) for w, i, v in rows}.values(), key=str)
    df = spark.createDataFrame(rows, "w string, i long, v long")
    for strictly in (False, True):
        for back in (False, True):
            got = {(x.w, x.i): x.last for x in ranking.last_so_far(df, "w", ["i"], F.col("v"), "last", strictly, back).collect()}
            for w, i, _ in rows:
                seen = [x for x in sorted((y for y in rows if y[0] == w), key=lambda y: -y[1] if back else y[1]) if (x[1] > i if back else x[1] < i) or (x[1] == i and not strictly)]
                assert got[w, i] == next((x[2] for x in reversed(seen) if x[2] is not None), None)
    sums = {(x.w, x.i): x.total for x in ranking.sums_before(df, "w", ["i"], F.lit(2), "total").collect()}
    assert sums == {(w, i): 2 * sum(y[0] == w and y[1] < i for y in rows) for w, i, _ in rows}


def test_paths_are_in_the_order_of_code_units(spark):
    names = ["b", "a", "Z", "é", "\U0001f600", "\uffee", "a/b", "a b"]
    rows = spark.createDataFrame([(n, n + "1", None) for n in names], "cover string, pdf string, epub string")
    want = sorted([*names, *(n + "1" for n in names)], key=lambda x: x.encode("utf-16-be"))
    assert [x.path for x in sorted(catalogue.required_paths(rows).collect(), key=lambda x: x.n)] == want


def test_tables_and_links(spark, tmp_path):
    from stemma.operators import search
    from stemma.sources import sinks

    df = spark.range(10).selectExpr("id", "id % 2 as part")
    sinks.write_table(df, f"{tmp_path}/t", "part", rows_per_file=2)
    assert spark.read.parquet(f"{tmp_path}/t").where("part = 1").count() == 5
    urls = [("https://h/", "x y"), ("https://h/?fulltext=old", ""), ("https://h/?a=1&fulltext=o&b=2#t", "q"), ("https://h/#t", "é")]
    rows = spark.createDataFrame(urls, "url string, q string").select("q", search.with_query(F.col("url"), F.col("q")).alias("u")).select("u", search.query_of(F.col("u")).alias("back")).collect()
    assert [tuple(r) for r in rows] == [("https://h/?fulltext=x+y", "x y"), ("https://h/", ""), ("https://h/?a=1&b=2&fulltext=q#t", "q"), ("https://h/?fulltext=%C3%A9#t", "é")]
    groups = spark.createDataFrame([("k1", "b"), ("k2", "A"), ("k3", "a")], "author_key string, name string")
    assert [r.author_key for r in catalogue.by_name(groups).collect()] == ["k3", "k2", "k1"]


def test_commands(spark, tmp_path, capsys):
    from stemma.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "w1.md").write_text("〔原刊 p. 1〕\n\nThe river Usumacinta runs here. It runs on!\n\n〔原刊 p. 2〕 The end of the river.\n")
    (tmp_path / "src" / "w2.md").write_text("Nothing here but hills.\n")
    spark.createDataFrame([("w1", 1, "The river Usumacinta runs here. It runs on!"), ("w1", 2, "The end of the river.")], "slug string, page_no int, text string").write.parquet(f"{tmp_path}/pages")
    chunks, made = f"{tmp_path}/chunks", f"{tmp_path}/index"
    assert main(["extract", f"{tmp_path}/src", chunks, "--pages", f"{tmp_path}/pages"], spark) == 0
    assert main(["index", chunks, made], spark) == 0
    assert main(["verify", chunks], spark) == 0
    capsys.readouterr()
    assert main(["search", chunks, "THE RIVER"], spark) == main(["search", chunks, "the river", "--index", made], spark) == 0
    assert capsys.readouterr().out.split("\n") == ["1 w1 2", "1 w1 2", ""]
    spark.read.parquet(chunks).where("ord <> 1").write.parquet(f"{tmp_path}/less")
    assert main(["verify", f"{tmp_path}/less"], spark) == 1
    # the index against the chunks, and what else is made of files
    assert main(["verify", chunks, "--index", made], spark) == 0 == main(["verify", chunks, "--index", f"{made}"], spark)
    assert main(["verify", f"{tmp_path}/less", "--index", made], spark) == 1
    out = capsys.readouterr().out
    assert "map-unknown" in out and "index-unknown" in out and "part-chunks" in out
    assert main(["merge", made, f"{tmp_path}/merged"], spark) == 0
    assert main(["search", chunks, "the river", "--index", f"{tmp_path}/merged"], spark) == 0
    assert capsys.readouterr().out == "1 w1 2\n"
    assert main(["maps", chunks, f"{tmp_path}/maps"], spark) == 0
    assert sorted(p.name for p in (tmp_path / "maps").iterdir()) == ["w1.json", "w2.json"]
    assert main(["manifest", f"{tmp_path}/src", f"{tmp_path}/manifest", "--origin", "https://h/"], spark) == 0
    assert {(r.path, r.url) for r in spark.read.json(f"{tmp_path}/manifest").collect()} == {(f"w{k}.md", f"https://h/w{k}.md") for k in (1, 2)}


def test_epub_commands(spark, tmp_path, capsys):
    """Contents as they would be rebuilt, and faults, of a small EPUB."""
    import zipfile

    from stemma.__main__ import main

    xhtml = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body>%s</body></html>'
    members = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>',
        "O/b.opf": '<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest><item id="n" properties="nav" href="nav.xhtml"/><item id="a" href="t/a.xhtml"/><item id="b" href="t/b.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/></spine></package>',
        "O/nav.xhtml": xhtml % '<h1>Contents</h1><nav epub:type="toc"><ol><li><a href="t/b.xhtml#s">B</a></li></ol></nav>',
        "O/t/a.xhtml": xhtml % '<section id="s"><h1>One</h1><h2>Two <em>x</em></h2></section><div class="x unlisted"><h2>hidden</h2></div>',
        "O/t/b.xhtml": xhtml % '<h1 id="s">First</h1><h3>Deep</h3><p>text</p>',
    }

    def write(name, **changes):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for n, content in (members | changes).items():
                z.writestr(zipfile.ZipInfo(n), content)

    write("good.epub")
    assert main(["epubs", str(tmp_path)], spark) == 0
    capsys.readouterr()
    assert main(["contents", str(tmp_path)], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["good First t/b.xhtml#s", "good   Deep t/b.xhtml#reading-order-heading-00002", "good One t/a.xhtml#s", "good   Two x t/a.xhtml#reading-order-heading-00004"]
    write("bad.epub", mimetype="x")
    assert main(["epubs", str(tmp_path)], spark) == 1
    assert capsys.readouterr().out.split()[:2][0] == "type-said"
