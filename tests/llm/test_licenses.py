import re

import duckdb

from stemma.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    ws = WORD.findall((text or "").translate(LOWER))
    hits = [(i, label) for p, label in L.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(ws), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "CC-BY CC BY-NC 4.0 MIT License mit LICENSE É gnu general",
    "GNU General Public License, version 3. gnu general public license cc by cc by",
    "mit licenses apache licence cc bye",
    NOTICE,
    NOTICE.replace("hereby", "not"),
    "",
    None,
    "the of and " * 20000 + "MIT License",
]


def test_scan(spark, make_docs, tmp_path):
    make_docs([*TEXTS, "MIT License", "MIT License"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in L.op4_license_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
    assert got[0].labels == "apache,apache-2.0"
    assert got[1].labels == "cc-by,cc-by-nc,cc-by-nc-4.0,mit"
    assert got[2].labels == "cc-by,gpl,gpl-3.0"
    assert (got[4].labels, got[4].n_base) == ("mit", 0)
    assert got[5].labels == "" and got[5].score == 0
    assert len(got) == len(TEXTS) + 2


def test_no_rows(make_docs):
    assert L.scan(make_docs([])).count() == 0


def test_query(spark, small):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small}/documents.parquet')").fetchall())
    rows = L.op4_license_scan(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])


def every(text):
    """Labels and the best share, each template tried at each place."""
    ws, made, labels, best = L.split((text or "").encode()), L.templates(), set(), 0.0
    for x in made:
        for start in range(-len(x.words), len(ws)):
            if all(start + at >= 0 and tuple(ws[start + at : start + at + len(k)]) == k for at, k in x.keys):
                share = sum(0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(x.words)) / len(x.words)
                if share >= L.COVER:
                    labels.add(x.label)
                    best = max(best, share)
    return ",".join(sorted(labels)), best


def test_labels_and_scores(spark, make_docs, tmp_path):
    """Against all templates at all places, in whole notices, damaged ones and pieces of them."""
    import random

    r = random.Random(4)
    texts = [t for t in TEXTS if not t or len(t) < 10_000]
    for _, text, _ in L.NOTICES:
        ws = text.split()
        texts += [text, " ".join(ws[:-3]), " ".join(w if r.random() < 0.9 else "other" for w in ws), "a b " + text + " " + text, " ".join(ws[r.randrange(len(ws)) :])]
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    for x in L.op4_license_scan(spark, str(tmp_path)).collect():
        labels, score = every(texts[x.doc_id])
        assert x.labels == labels, texts[x.doc_id]
        assert abs(x.score - score) < 1e-12


def test_words_that_are_rare_are_looked_up_first():
    made = L.templates()
    idf = {b"apache": 5.0, b"license": 1.0, b"version": 2.0, b"2": 0.5, b"0": 0.4}
    index = L.Index(made, idf, 2)
    here = {w for w, posts in index.posts.items() if any(made[t].label == "apache-2.0" and made[t].words[:2] == (b"apache", b"license") for t, _ in posts)}
    assert here == {b"apache", b"version"}
