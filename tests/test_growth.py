"""Steps that once grew faster than their tables, or gave other rows on larger ones."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stemma.operators import align, catalogue
from stemma.plans.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def same_as_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(folder)).select(columns).collect())) == sorted(cursor.fetchall())


def test_document_map_of_many_documents(spark, tmp_path):
    """numbers of more than four digits, and a number in two works."""
    rows = [(k, "a\nb", "en", f"src{k % 3}", 3) for k in (7, 9_999, 10_000, 123_456)] + [(7, "c", "en", "src0", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    same_as_sql(spark, "document_map", tmp_path, "documents")


def test_labels_on_very_many_pages(spark):
    """pages that share a label never meet a chunk one by one."""
    pages = spark.range(3000).select(F.lit("w").alias("slug"), F.col("id").alias("page_no"), F.array(F.lit("everywhere"), F.when(F.col("id") == 9, "once").otherwise("everywhere")).alias("labels"))
    chunks = spark.createDataFrame([("w", 1, "everywhere"), ("w", 2, "once"), ("w", 3, "once／everywhere"), ("w", 4, "nowhere"), ("v", 5, "once")], "slug string, ord long, original_page string")
    out = align.unique_labels(chunks, pages)
    assert [tuple(r) for r in out.collect()] == [("w", 2, 9)]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(joins) == 1 and "min(low" in plan[plan.index("Join") :]  # pages are one row a label before they meet


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_places_meet_without_texts(spark, monkeypatch, most):
    """what is spread over all places of all works has no text in it, and both kinds of joins find the same."""
    sides = []
    met = align._met
    monkeypatch.setattr(align, "BROADCAST_BYTES", most)
    monkeypatch.setattr(align, "_met", lambda there, asked, keys, size: sides.append((there.columns, keys)) or met(there, asked, keys, size))
    text = "".join(chr(97 + (k * k // 7) % 26) for k in range(4000))
    hay = align.blocks(align.page_starts(spark.createDataFrame([("w", 1, text[:1500]), ("w", 2, text[1500:]), ("v", 1, text[:30])], "slug string, page_no int, text string")))
    needles = {k: text[a : a + n] for k, (a, n) in enumerate([(0, 20), (1490, 40), (700, 1300), (3980, 20), (1015, 18)])} | {9: "z" * 18}
    rows = spark.createDataFrame([("w", k, t) for k, t in needles.items()], "slug string, key int, needle string")
    got = {(r.key, r.at, r.page_no) for r in align.occurrences(rows, hay, align.LONG).collect()}
    assert got == {(k, i, 1 if i < 1500 else 2) for k, t in needles.items() for i in range(len(text)) if text.startswith(t, i)} and len({k for k, *_ in got}) == 5
    assert sides and all("text" not in columns or keys == ["slug", "b"] for columns, keys in sides)


def test_fuzzy_in_small_groups(spark, monkeypatch):
    """pages and rows are compared in groups of any size, and no gram is a row."""
    monkeypatch.setattr(align, "GROUP_CHARS", 60)
    monkeypatch.setattr(align, "GROUP_GRAMS", 40)
    r = random.Random(5)
    say = lambda n: "".join(r.choice("abc") for _ in range(n))
    pages = [("w" if k % 3 else "v", k, say(r.choice([0, 3, 5, 6, 40, 90]))) for k in range(1, 40)]
    rows = [(s, k, say(r.choice([3, 6, 12, 30])), float(r.randrange(40)), lo, lo + r.choice([2, 60])) for s in "wv" for k in range(1, 30) for lo in [r.randrange(1, 20)]]
    rows += [(s, 100 + p, t[:20], 1.0, 1, 99) for s, p, t in pages if len(t) > 20]
    located = align.page_starts(spark.createDataFrame(pages, "slug string, page_no int, text string"))
    found = align.fuzzy(spark.createDataFrame(rows, "slug string, ord long, norm string, target double, from_page int, to_page int"), located)
    assert "explode(grams" not in found._jdf.queryExecution().optimizedPlan().toString() and found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    grams = lambda t: {t[i : i + 6] for i in range(max(1, len(t) - 5))} if t else set()
    want = {}
    for s, k, norm, target, lo, hi in rows:
        each = [(-len(grams(norm) & grams(t)) / len(grams(norm)), abs(p - target), p) for w, p, t in pages if w == s and lo <= p <= hi and grams(norm) & grams(t)]
        if each and -min(each)[0] >= align.FUZZY:
            want[s, k] = (min(each)[2], -min(each)[0])
    assert want and {(x.slug, x.ord): (x.page_no, x.score) for x in found.collect()} == want


@pytest.mark.parametrize("classes", [0, 100_000])
def test_related_by_classes(spark, monkeypatch, classes):
    """records of equal values are not spread over sets one by one; each is a row that meets its class."""
    monkeypatch.setattr(catalogue, "CLASSES", classes)
    rows = [(f"s{i}", ["1700", "1650", "?"][i % 3], i, [f"t{i % 4}", "t0"], [f"r{i % 2}"] if i % 5 else None, [], [None, "x"] if i % 7 == 0 else []) for i in range(400)] + [("alone", "1600", 900, ["t0", "t0"], ["r9"], ["l"], None)]
    out = catalogue.related(spark.createDataFrame(rows, "slug string, year string, ord int, types array<string>, regions array<string>, languages array<string>, tags array<string>"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and "Aggregate" not in plan
    got = {}
    for x in out.collect():
        got.setdefault(x.slug, {})[x["rank"]] = (x.related, x.score)
    score = lambda a, b: sum(w * sum(v is not None and v in (b[k] or []) for v in a[k] or []) for k, w in ((3, 3), (4, 4), (5, 1), (6, 2)))
    for a in rows:
        best = sorted((-score(a, b), b[1] == "?", b[1], b[2], b[0]) for b in rows if b is not a)[:3]
        assert got[a[0]] == {k + 1: (b[4], -b[0]) for k, b in enumerate(best)}
