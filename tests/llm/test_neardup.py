import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import common
from stemma.llm import neardup as N
from stemma.llm.components import components
from stemma.llm.words import shingle_list, word_list, words


def bag(text):
    return Counter(shingle_list(word_list((text or "").encode()), N.SHINGLE))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(docs, threshold=N.THRESHOLD):
    """The least id of each component, all pairs compared."""
    ids = sorted(docs)
    bags, up = {i: bag(docs[i]) for i in ids}, {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (docs[i] or "") == (docs[j] or "") or (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= threshold):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def family(prose, r, seed, n, size):
    base = prose(size, seed).split()
    out = [" ".join(base)]
    for k in range(n - 1):
        ws = (base if r.random() < 0.6 else out[-1].split()).copy()
        for _ in range(r.randrange(1, 9)):
            ws[r.randrange(len(ws))] = f"edit{seed}x{k}y{r.randrange(99)}"
        out.append(" ".join(ws))
    return out


def test_same_as_all_pairs(make_docs, prose):
    r = random.Random(2)
    passage = prose(60, 999)
    texts = [t for s in range(6) for t in family(prose, r, s, 25, 120)]
    texts += [passage + " " + prose(40, 100 + s) for s in range(20)]  # a passage that many share
    texts += ["", "", None, "!!!", "...", "one two", "One, two!", "one two three", "x " * 3000, "x " * 3001]
    texts += [texts[0]] * 30 + [texts[3]]
    docs = dict(enumerate(texts))
    rows = N.near_duplicates(make_docs(list(docs.items())).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes(docs)
    assert len(rows) == len(texts)


def test_repeated_and_null_ids(make_docs):
    rows = N.near_duplicates(make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f.")])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_no_rows(make_docs):
    assert N.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_signatures_estimate_weighted_jaccard(share):
    r = np.random.default_rng(4)
    n = 400
    base = r.integers(0, 2**63, n).astype(np.uint64)
    other = base.copy()
    changed = r.random(n) > share
    other[changed] = r.integers(0, 2**63, changed.sum()).astype(np.uint64)
    weights = [r.integers(1, 30, n), r.integers(1, 30, n)]
    a, b = dict(zip(base.tolist(), weights[0], strict=True)), dict(zip(other.tolist(), weights[1], strict=True))
    keys = a.keys() | b.keys()
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    h = np.concatenate([base, other])
    s = N.bag_min_hash(h, np.repeat([0, 1], n), np.concatenate(weights), 2, 4096)
    assert np.isfinite(s).all()
    assert abs((s[0] == s[1]).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5


def test_words_and_shingles():
    texts = [b"The CAT, sat.", "É é x".encode(), b"", b"--", b"a b c d e f a b c d e", b"the cat sat"]
    w = words(texts)
    assert np.diff(w.first).tolist() == [3, 3, 0, 0, 11, 3]
    h, d = w.shingles(5)
    assert np.bincount(d, minlength=6).tolist() == [len(shingle_list(word_list(t), 5)) for t in texts]
    by = [h[d == i].tolist() for i in range(6)]
    assert by[0] == by[5] and len(set(by[4])) == 6


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    docs = {x for e in edges for x in e}
    up = {x: x for x in docs}
    for _ in docs:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: up[x] for x in docs if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark, small):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small}/documents.parquet')").fetchall())
    assert {r.doc_id: r.class_id for r in N.op6_minhash_near_dedup(spark, small).collect()} == classes(docs)


def test_packed_tables_are_not_broadcast(spark, tmp_path):
    """a table whose files are far smaller than its rows in memory is not broadcast by the size of its files."""
    n = 3_000_000
    spark.range(n).select("id", (F.col("id") % 7).alias("component")).write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t"))
    assert common.BROADCAST_FILES < common.estimated_bytes(many)
    plans = []
    with common._settings(spark, common._small_broadcasts(spark)):
        plans.append(spark.range(0, 10**9, 7).join(many, "id")._jdf.queryExecution().sparkPlan().toString())
    small = spark.range(9).selectExpr("id AS doc_id", "'a b c d e f ' || id % 2 AS text")
    plans.append(N.near_duplicates(small)._jdf.queryExecution().sparkPlan().toString())
    assert all("BroadcastHashJoin" not in p and "SortMergeJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
