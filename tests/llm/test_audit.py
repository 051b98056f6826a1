"""The filter audit against filtering documents one order at a time."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stemma.llm import audit as A


def fails(docs):
    """One set of failed letters a document, in the order of the rows."""
    out = []
    for i, lang, text in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = set()
        if len(w) < 200:
            bad.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if any(j is not None and i is not None and j < i and (u or "") == t for j, _, u in docs):
            bad.add("E")
        out.append(bad)
    return out


def brute(docs, labels):
    good, toxic = ({d for d, q, x in labels if v(q, x) == 1} for v in (lambda q, x: q, lambda q, x: x))
    bad = fails(docs)
    rows = {}
    for part in {lang or "" for _, lang, _ in docs}:
        own = [(i, b) for (i, lang, _), b in zip(docs, bad, strict=True) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, b) for i, b in left if f in b]
                was = len([b for _, b in own if f in b]) - len(gone)
                left = [(i, b) for i, b in left if f not in b]
                shapley[f] += len(gone)
                rows[part, "".join(order), step] = [len(left), len(gone), was, sum(b == {f} for _, b in own), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)]
        for (p, order, step), r in rows.items():
            if p == part:
                r.append(shapley[order[step - 1]])
    return rows


@pytest.fixture
def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    say = lambda n, most=400: " ".join(r.choice(words[:most]) for _ in range(n))
    texts = [say(250), say(250, 20), say(30), say(260) + " $5", ("AB " * 60) + say(240), "", None, "  \t\r\n\x0b\x0c ", "x y z " * 70, "ÀÉ " * 210, "A|B", say(200), say(199)]
    docs = [(k, r.choice(["en", "de", None, ""]), r.choice(texts)) for k in range(90)]
    docs += [(3, "en", texts[0]), (3, "en", texts[0]), (None, "de", texts[0]), (None, None, None), (200, "fr", say(100_000, 300)), (-5, "en", texts[3])]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_every_order(spark, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({n: F.lit("clash") for n in ("part", "fails", "n", "key", "salt", "before", "filter", "good", "quality", "toxic", "first", "loose", "once")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({n: F.lit("clash") for n in ("lang", "salt", "n", "part")})
    got = {(r.part, r.filter_order, r.step): [r[c] for c in A.COUNTS] for r in A.audit(frame.repartition(3), marks).collect()}
    want = brute(docs, labels)
    assert len(got) == 600 * len({p for p, *_ in want})
    assert got == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = A.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert {(r.kept, r.removed) for r in rows if r.filter_order[0] == "A" and r.step == 1} == {(0, 1)}


def test_edges(spark):
    """80 edges a part, and each step of an order follows one of them."""
    cells = spark.createDataFrame([("p", 0, False, False, 3), ("p", 5, True, False, 2), ("p", 31, False, True, 1)], "part string, fails int, good boolean, toxic boolean, n long")
    edges = A.lattice(cells).collect()
    assert len(edges) == 80
    assert all(e.kept + e.removed + sum(n for m, n in ((5, 2), (31, 1)) if m & e.before) == 6 for e in edges)
    steps = A.paths(spark).collect()
    assert len(steps) == 600 and len({(s.before, s.filter) for s in steps}) == 80
