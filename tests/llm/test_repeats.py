import hashlib
import random

import duckdb
import numpy as np
import pytest

from stemma.llm import repeats as R


def brute(docs, length=100):
    """doc_id -> bytes, removed, runs, what is kept: every string of the length looked up among all earlier ones."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[i] = (len(raw), int(gone.sum()), runs, kept)
    return out


def run(docs, length=100, segment=R.SEGMENT):
    out = {}
    for r in R.remove_repeats(docs, length, segment=segment).collect():
        out[r.doc_id] = (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept))
    return out


def texts(prose):
    r = random.Random(8)
    passage, line = prose(40, 1), prose(16, 2)
    base = prose(300, 3)
    out = [base, base, base[:500] + "X" + base[501:], base[37:900], base[:-1], "z" + base]
    out += [prose(30, 10 + k) + " " + passage + " " + prose(30, 50 + k) for k in range(12)]
    out += [(line + "\n") * 30, "ab" * 400, "a" * 1000, "a" * 99, "a" * 100, "a" * 101, "", None, "é" * 120, "x" + "é" * 120]
    edited = list(base)
    for _ in range(12):
        edited[r.randrange(len(edited))] = "#"
    return [*out, "".join(edited), passage[:99], passage[:100], passage[3:103]]


def test_same_as_brute_force(make_docs, prose):
    docs = list(enumerate(texts(prose)))
    assert run(make_docs(docs).repartition(3)) == brute(docs)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(make_docs, seed):
    r = random.Random(seed)
    bank = ["".join(r.choice("ab") for _ in range(r.randrange(90, 300))) for _ in range(5)]
    docs = []
    for i in range(25):
        t = "".join(r.choice(bank)[r.randrange(60) :] if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randrange(150))) for _ in range(r.randrange(6)))
        docs.append((i, t))
    assert run(make_docs(docs)) == brute(docs)


@pytest.mark.parametrize("length", [100, 70])
def test_long_texts_in_parts(make_docs, prose, length):
    docs = [(0, prose(900, 1)), (1, prose(200, 2) + prose(900, 1)[333:4333] + prose(100, 3)), (2, prose(900, 1))]
    assert run(make_docs(docs), length, 1000) == brute(docs, length)


def test_odd_ids(make_docs, prose):
    t = prose(60, 5)
    rows = R.remove_repeats(make_docs([(5, t), (5, t), (None, t), (9, t), (5, "short")])).collect()
    by = sorted((-1 if r.doc_id is None else r.doc_id, sum(s.end - s.start for s in r.removed)) for r in rows)
    assert by == [(-1, 0), (5, 0), (5, 0), (5, 0), (9, len(t))]


def test_no_rows(make_docs):
    assert run(make_docs([])) == {}


def test_query(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small}/documents.parquet')").fetchall()
    want = {i: (n, g, k, hashlib.sha256(kept).hexdigest()) for i, (n, g, k, kept) in brute(docs).items()}
    assert {r.doc_id: tuple(r)[1:] for r in R.op10_suffix_array_dedup(spark, small).collect()} == want
