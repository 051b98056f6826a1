"""The positional index finds what a scan finds, through later segments and their merge."""

import random

import numpy as np
import pytest

from stemma.functions import text as T
from stemma.operators import postings, search

SCHEMA = "slug string, ord long, text string, original_page string, pdf_page int"


def rows(seed, works, n):
    r = random.Random(seed)
    say = lambda: "".join(r.choice("aab ABé東京　.\n") for _ in range(r.choice([0, 2, 3, 10, 64, 65, 66, 67, 190, 300])))
    return [(w, k, say(), f"p. {k}", k // 3) for w in works for k in range(1, n)]


def test_same_as_a_scan(spark, tmp_path):
    first, later = rows(1, "uvw", 40), rows(2, "vx", 30)
    path = str(tmp_path / "index")
    postings.write_segment(spark.createDataFrame(first, SCHEMA).repartition(3), path)
    now = first

    def check():
        index = postings.read_index(spark, path)
        chunks = spark.createDataFrame(now, SCHEMA)
        texts = [T.comparable_value(t) for _, _, t, *_ in now]
        r = random.Random(3)
        queries = ["", "ab", "aab", "zzz", "東京a", "aaaa", "b" * 400] + [t[i : i + n] for t in r.sample([t for t in texts if len(t) > 90], 1) for i, n in ((5, 4), (0, len(t)), (60, 7))]
        for q in queries:
            want = {(x.slug, x.ord, x.text) for x in search.literal_chunks(chunks, q).collect()}
            got = [(x.slug, x.ord, x.text) for x in postings.search(index, q).collect()]
            assert set(got) == want and len(got) == len(want), q
            places = {(s, o, i) for (s, o, *_), t in zip(now, texts, strict=True) for i in range(len(t)) if t.startswith(T.comparable_value(q), i)}
            if len(T.comparable_value(q)) >= 3:
                assert {tuple(x) for x in postings.phrase(index, T.comparable_value(q)).collect()} == places

    check()
    # A later batch takes the place of its works, and can take works away.
    postings.write_segment(spark.createDataFrame(later, SCHEMA), path, 1, spark.createDataFrame([("w",)], "slug string"))
    postings.write_segment(spark.createDataFrame(later, SCHEMA), path, 1, spark.createDataFrame([("w",)], "slug string"))  # again
    now = [x for x in first if x[0] == "u"] + later
    check()
    path, old = str(tmp_path / "merged"), path
    postings.merge(spark, old, path)
    check()
    assert postings.search(postings.read_index(spark, path), "aab").columns == SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")


def test_only_hits_are_compared(spark, tmp_path):
    """No text is put in comparable form again, and the comparison needs the hit's place, so it is not on the scan."""
    postings.write_segment(spark.createDataFrame(rows(1, "uv", 30), SCHEMA), str(tmp_path))
    plan = postings.search(postings.read_index(spark, str(tmp_path)), "aabaab")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.index("substring(cmp") < plan.index("Relation")
    assert "Join Inner" in plan[: plan.index("substring(cmp")]


def test_lists_are_made_where_texts_are_read(spark, tmp_path, monkeypatch):
    """No place is a row of what is stored or moved; blocks of any size give the same places."""
    now = rows(4, "uv", 60)
    chunks = spark.createDataFrame(now, SCHEMA)
    texts = {(w, o): T.comparable_value(t) for w, o, t, *_ in now}
    want = sorted((postings._key(t[i : i + 3]), w, o, i) for (w, o), t in texts.items() for i in range(len(t) - 2))
    for block in (10, 2_000_000):
        monkeypatch.setattr(postings, "BLOCK", block)
        made = postings.lists(search.with_search_text(chunks).sort("slug", "ord").coalesce(1).selectExpr("slug", "1 as part", "ord as no", "cmp"))
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[0]
        postings.write_segment(chunks, f"{tmp_path}/{block}")
        index = postings.read_index(spark, f"{tmp_path}/{block}")
        got = index.postings.join(index.chunks.select("slug", "part", "no", "ord"), ["slug", "part", "no"]).select("gram", "slug", "ord", "at")
        assert sorted(map(tuple, got.collect())) == want
    assert made.count() == len({(g, w) for g, w, *_ in want}) < len(want) / 10  # a list a gram and work
    plan = postings.phrase(index, "aabb")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), In(gram" in plan or "Or(EqualTo(gram" in plan


def test_hits_of_any_number(spark, tmp_path, monkeypatch):
    """Many hits meet their texts by a merge, few are broadcast, and nothing else is."""
    now = rows(5, "uv", 50)
    postings.write_segment(spark.createDataFrame(now, SCHEMA), str(tmp_path))
    want = sorted((w, o) for w, o, t, *_ in now if "aab" in T.comparable_value(t))
    for most, kind in ((128 * len(want), "broadcast"), (128 * (len(want) - 1), "merge")):
        monkeypatch.setattr(postings, "BROADCAST_BYTES", most)
        found = postings.search(postings.read_index(spark, str(tmp_path)), "aab")
        assert f"strategy={kind}" in found._jdf.queryExecution().analyzed().toString()
        assert sorted((r.slug, r.ord) for r in found.collect()) == want


@pytest.mark.parametrize("letters", [3, 60_000])
def test_order_of_places(letters):
    """By gram and then by place, with a few characters and with so many that their numbers do not fit beside places."""
    points = np.random.default_rng(1).integers(0, letters, 300_000)
    at = np.arange(len(points) - 2)
    got = postings._sorted(points, at)
    key = points[at] * letters**2 + points[at + 1] * letters + points[at + 2]
    assert (got == np.argsort(key, kind="stable")).all()


def test_orders_of_a_smaller_type(spark, tmp_path):
    """Texts meet the places of their grams whatever type their numbers have."""
    chunks = spark.createDataFrame([("w", 7, "東京 abc", "", 1)], SCHEMA.replace("ord long", "ord int"))
    postings.write_segment(chunks, str(tmp_path))
    assert [(r.ord, r.text) for r in postings.search(postings.read_index(spark, str(tmp_path)), "京abc").collect()] == [(7, "東京 abc")]
