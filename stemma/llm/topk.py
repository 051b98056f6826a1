"""Exact top-k search by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import short_batches, staged, table

SCALE = 1024
PIVOTS, PIVOT_SAMPLE, RINGS = 64, 4096, 32
#: Vectors and queries of one block, and the candidates that a query's first round looks at, at least.
BLOCK_VECTORS, BLOCK_QUERIES, FIRST = 8192, 4096, 2048
RESULT = "query_id long, vec_id long, score long"


def _integers(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """A matrix of floor(scale * x), rows padded with zeros to `dim`, in doubles. Values beyond a long saturate."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in doubles where every partial sum is an exact double, else in Python's integers."""
    if exact:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    big = (1 << 63) - 1
    return np.array([max(-big - 1, min(big, sum(int(a) * b for a, b in zip(v, q, strict=True)))) for v in vectors], dtype=np.int64)


def _pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample by Lloyd's rounds, from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, 1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    return centres


def top_k(vectors: DataFrame, queries: F.Column, k: int = 10, scale: float = SCALE, pivots: int = PIVOTS, block: int = BLOCK_VECTORS, query_block: int = BLOCK_QUERIES) -> DataFrame:
    """For each row of vectors(vec_id, embedding) that meets `queries`: the k highest inner products with other rows.

    Returns query_id, rank (from 1), vec_id, score. Components count as floor(scale * x); the score is their
    integer inner product; ties go to the smaller vec_id; with fewer candidates there are fewer rows.

    Vectors get one more component that gives all of them one length, so the highest product is the least
    distance. Each is keyed by its nearest pivot (centres of a sample of at most PIVOT_SAMPLE rows; every
    row is indexed) and its distance to it, and distances are cut into at most RINGS annuli a pivot, of
    blocks of bounded size. A query sorts the annuli by the least distance the triangle inequality allows.
    The first round searches the nearest of them; the k-th best score found bounds the distance of what is
    left, and the second round searches just the annuli, and the part of them, within that bound.

    Null vectors, those that hold null, NaN or an infinity, and null ids take no part. Shorter vectors count
    as padded with zeros. Rows that repeat a vec_id count as one, with the higher score. No rows: no rows.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.alias("asks")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    base = base.withColumn("asks", F.coalesce("asks", F.lit(False)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dim = int(max(np.diff(b.column(1).offsets.to_numpy()), default=0))
                m = _integers(b.column(1), dim, scale)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (b.num_rows, b.column(2).true_count, dim, float(np.abs(m).max(initial=0)), float((m**2).sum(1).max()))], ["n", "q", "dim", "most", "norm"])

    stats = base.mapInArrow(measured, "n long, q long, dim long, most double, norm double").agg(F.sum("n"), F.sum("q"), F.max("dim"), F.max("most"), F.max("norm")).first()
    n, asked, dim, most, norm = stats
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = most * most * max(dim, 1) < 2.0**53
    kind = "<i4" if most < 2.0**31 else "<f8"

    def longer(m: np.ndarray) -> np.ndarray:
        return np.hstack([m, np.sqrt(np.maximum(norm - (m**2).sum(1), 0))[:, None]])

    sample = base.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow().column("embedding")
    centres = _pivots(longer(_integers(sample, dim, scale)), pivots)
    squares = (centres**2).sum(1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _integers(b.column(1), dim, scale)
                far = squares - 2 * longer(m) @ centres.T
                near = far.argmin(1)
                dist = np.sqrt(np.maximum(far[np.arange(len(m)), near] + norm, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(near.astype(np.int32)), pa.array(dist), pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())], ["vec_id", "asks", "pivot", "dist", "vec"])

    index = staged(base.mapInArrow(keyed, "vec_id long, asks boolean, pivot int, dist double, vec binary"), "pivots")
    cells = {r.pivot: r for r in index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}  # a row a pivot
    step = [1.0] * len(centres)
    low = [0.0] * len(centres)
    for p, c in cells.items():
        low[p], step[p] = c.lo, max(c.hi - c.lo, 1e-9) / min(RINGS, -(-c.n // block))
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("pivot") + 1)
    index = index.withColumn("ring", F.least(F.floor((F.col("dist") - at(low)) / at(step)), F.lit(RINGS - 1)).cast("int"))
    rings = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()  # at most PIVOTS * (RINGS + 1) rows
    pivot = np.array([r.pivot for r in rings])
    ring = np.array([r.ring for r in rings])
    count = np.array([r.n for r in rings])
    lo, hi = np.array([r.lo for r in rings]), np.array([r.hi for r in rings])
    salts = -(-count // block)
    query_salts = -(-asked // query_block)
    slack = 1e-6 * (1 + norm**0.5)

    def visits(first_round: bool):
        """Rows (block, query) to search: the nearest annuli, or those left within the bound."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    q = np.frombuffer(b.column(1)[i].as_py(), dtype=kind).astype(np.float64)
                    own = (q**2).sum()
                    far = np.sqrt(np.maximum(own - 2 * centres[:, :-1] @ q + squares, 0))[pivot]
                    least = np.maximum(np.maximum(far - hi, lo - far), 0)
                    order = np.argsort(least, kind="stable")
                    first = int(np.searchsorted(np.cumsum(count[order]), FIRST)) + 1
                    if first_round:
                        go, bound, reach = order[:first], None, np.inf
                    else:
                        bound = b.column(2)[i].as_py()
                        reach = np.inf if bound is None else np.sqrt(max(own + norm - 2.0 * bound, 0)) + slack
                        go = order[first:]
                        go = go[least[go] <= reach]
                    if len(go):
                        times = salts[go]
                        j = np.repeat(go, times)
                        salt = np.concatenate([np.arange(t) for t in times])
                        m = len(j)
                        ids = np.full(m, b.column(0)[i].as_py())
                        yield pa.RecordBatch.from_arrays([pa.array(pivot[j].astype(np.int32)), pa.array(ring[j].astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(ids), pa.array([b.column(1)[i].as_py()] * m, pa.binary()), pa.array([bound] * m, pa.int64()), pa.array(far[j] - reach), pa.array(far[j] + reach)], ["pivot", "ring", "salt", "query_id", "vec", "bound", "from", "to"])

        return visit

    def search(asking: pa.Table, block_rows: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if asking.num_rows and block_rows.num_rows:
            block_rows = block_rows.sort_by("dist")
            ids, dist = block_rows.column("vec_id").to_numpy(), block_rows.column("dist").to_numpy()
            vecs = np.frombuffer(b"".join(block_rows.column("vec").to_pylist()), dtype=kind).reshape(len(ids), -1).astype(np.float64)
            for query, vec, bound, start, end in zip(*(asking.column(c).to_pylist() for c in ("query_id", "vec", "bound", "from", "to")), strict=True):
                a, z = np.searchsorted(dist, start), np.searchsorted(dist, end, "right")
                s = _scores(vecs[a:z], np.frombuffer(vec, dtype=kind).astype(np.float64), exact)
                keep = (ids[a:z] != query) if bound is None else (ids[a:z] != query) & (s >= bound)
                s, c = s[keep], ids[a:z][keep]
                if len(s) > k:
                    top = np.lexsort((c, -s.astype(object) if not exact else -s))[:k] if len(np.unique(c)) == len(c) else np.arange(len(s))
                    s, c = s[top], c[top]
                found.append(np.array([np.full(len(s), query), c, s]))
        rows = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        return pa.table({"query_id": pa.array(rows[0].astype(np.int64)), "vec_id": pa.array(rows[1].astype(np.int64)), "score": pa.array(rows[2].astype(np.int64))})

    shapes = spark.createDataFrame([(int(p), int(r), int(n)) for p, r, n in zip(pivot, ring, salts, strict=True)], "pivot int, ring int, salts int")
    blocks = index.join(F.broadcast(shapes), ["pivot", "ring"])  # at most PIVOTS * (RINGS + 1) rows
    blocks = blocks.select("pivot", "ring", F.pmod(F.xxhash64("vec_id", "dist"), F.col("salts")).cast("int").alias("salt"), "vec_id", "dist", "vec")
    asking = index.where("asks").select("vec_id", "vec").dropDuplicates(["vec_id", "vec"])
    keys = ["pivot", "ring", "salt", "part"]

    def searched(rows: DataFrame, first_round: bool) -> DataFrame:
        rows = rows.mapInArrow(visits(first_round), "pivot int, ring int, salt int, query_id long, vec binary, bound long, from double, to double")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(int(query_salts))).cast("int"))
        # A block goes once to each part of the queries that visits it, and nowhere else.
        visited = staged(rows.select(keys).distinct(), "visited")
        return rows.groupBy(*keys).cogroup(blocks.join(visited, keys[:3]).groupBy(*keys)).applyInArrow(search, RESULT)

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    first = staged(best(searched(asking.withColumn("bound", F.lit(None).cast("long")), True)), "first")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("bound"))
    rest = searched(asking.join(bound, F.col("vec_id") == F.col("q"), "left").select("vec_id", "vec", "bound"), False)
    return best(first.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
