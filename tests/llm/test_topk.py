import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import topk as K


def brute(vectors, asked, k=10):
    out = set()
    ints = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in vectors.items()}
    for q in asked:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def run(spark, rows, k=10, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dist string, ring string")
    return {tuple(r) for r in K.top_k(df, F.col("vec_id") % every == 0, k, **options).collect()}


@pytest.mark.parametrize("seed, n, dim", [(1, 300, 8), (2, 60, 64)])
def test_same_as_brute_force(spark, seed, n, dim):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    vectors = {i: (centres[i % 4] + 0.3 * r.normal(size=dim)).astype(np.float32).tolist() for i in range(n)}
    for i in range(30, 40):
        vectors[i] = vectors[30]  # copies: ties go to the smaller id
    got = run(spark, [(i, v, "a", "b") for i, v in vectors.items()], block=16, query_block=7, pivots=5)
    assert got == brute(vectors, [i for i in vectors if i % 5 == 0])


def test_few_and_bad_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "", ""), (5, [0.5], "", ""), (6, [], "", ""), (7, None, "", ""), (8, [1.0, None], "", ""), (9, [nan, 1.0], "", ""), (10, [inf, 1.0], "", ""), (None, [1.0, 1.0], "", ""), (6, [], "", "")]
    got = run(spark, rows)
    assert got == {(0, 1, 5, 1024 * 512), (0, 2, 6, 0), (5, 1, 0, 1024 * 512), (5, 2, 6, 0)}
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0], "", "")]) == set()


def test_large_values_are_exact(spark):
    vectors = {i: [float(np.float32(1.5e5 * (i + 1))), float(np.float32(-1e3 * i * i)), 0.001] for i in range(12)}
    assert run(spark, [(i, v, "", "") for i, v in vectors.items()], k=3) == brute(vectors, [0, 5, 10], 3)


def test_query(spark, small):
    import duckdb

    vectors = dict(duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{small}/embeddings.parquet')").fetchall())
    got = {tuple(r) for r in K.op3_topk_search(spark, small).select("query_id", "rank", "vec_id", "score").collect()}
    m = np.floor(1024 * np.array([vectors[i] for i in sorted(vectors)], dtype=np.float64)).astype(np.int64)
    ids, want = np.array(sorted(vectors)), set()
    for q in ids[ids % 100 == 0]:
        s = m @ m[np.searchsorted(ids, q)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:10]
        want |= {(int(q), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)}
    assert got == want
