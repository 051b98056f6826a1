"""No text is lost where a doc_id, a length or a share of copies is unusual."""

import hashlib

import numpy as np

import corpus_pipeline as P
from stemma.llm import neardup as N
from stemma.llm import repeats as R


def test_texts_of_one_doc_id(make_docs, prose, small, spark):
    """Different texts of one doc_id are texts of their own: each class keeps one, and each text finds its near copies."""
    a, b, c = (prose(120, k) for k in (1, 2, 3))
    near = lambda t, k: " ".join([*t.split()[:60], f"other{k}", *t.split()[61:]])
    docs = [(5, a), (5, b), (5, ""), (6, b), (7, near(a, 0)), (8, near(b, 0)), (9, c), (9, near(c, 0)), (10, c), (11, "x"), (None, a)]
    rows = P.drop_near_duplicates(spark, make_docs(docs).repartition(3), small)
    got = sorted((r.doc_id or 0, r.text) for r in rows.collect())
    assert [g for g in got if g[0] != 9] == sorted([(0, a), (5, a), (5, b), (5, ""), (11, "x")])
    assert [g[1] in (c, near(c, 0)) for g in got if g[0] == 9] == [True]
    # b has no id of its own, and is the class of 6 and 8 all the same
    rows = N.near_duplicates(make_docs(docs)).collect()
    assert {(r.doc_id, r.text_id, r.class_id) for r in rows} == {(5, 5, 5), (6, 5, 5), (7, 7, 5), (8, 8, 5), (9, 9, 9), (10, 9, 9), (11, 11, 11), (None, None, None)}


def test_near_texts_of_shared_ids(make_docs, prose):
    """Near texts meet though neither is the least text of its doc_id."""
    t = "zz " + prose(120, 4)
    near = " ".join([*t.split()[:60], "other", *t.split()[61:]])
    docs = make_docs([(1, prose(90, 5)), (1, t), (2, prose(90, 6)), (2, near)])
    assert sorted((r.doc_id, r.class_id) for r in N.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1), (2, 2)]


def removed(docs, length=100):
    """doc_id -> bytes removed, every string of the length looked up among all earlier ones."""
    seen, out = set(), {}
    for i, text in docs:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if text[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(text[p : p + length])
        out[i] = int(gone.sum())
    return out


def test_repeats_at_the_end_of_long_texts(make_docs):
    """Texts just past a multiple of the segment, with repeats at the end that differ in how far they go."""
    noise = lambda k, n: "".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest() for j in range(n // 64 + 1))[:n]
    docs = []
    for extra in (99, 100, 101, 150, 199, 207, 208, 209, 300):
        tail = noise(f"tail{extra}", extra)
        docs += [(len(docs) + j, t) for j, t in enumerate((noise(f"a{extra}", 1000) + tail, noise(f"b{extra}", 2000) + tail, tail[:-9] + noise(f"c{extra}", 50), noise(f"d{extra}", 40) + tail[9:], noise(f"e{extra}", 1000) + tail))]
    got = {r.doc_id: sum(s.end - s.start for s in r.removed) for r in R.remove_repeats(make_docs(docs), segment=1000).collect()}
    assert got == removed(docs)
