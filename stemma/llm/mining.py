"""Hard negatives: for an anchor and a row like it, rows of other labels that score almost as high."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import short_batches, staged, table
from stemma.llm.topk import _integers

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows of which the rotation is learnt and by which searches begin; vectors and anchors of one group, about; anchors scored at once.
SAMPLE, BLOCK_VECTORS, BLOCK_ANCHORS, AT_ONCE = 4096, 8192, 2048, 128
#: Below this share of open pairs they are gone through one by one.
SPARSE = 0.1
_LONG = (1 << 63) - 1


def rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions of the sample's rows, strongest first."""
    size = float(np.abs(sample).max(initial=0)) or 1.0
    return np.linalg.eigh((sample / size).T @ (sample / size))[1][:, ::-1]


def exact_products(a: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of rows with rows: in doubles where every partial sum is one, else in Python's integers, saturated."""
    if exact:
        return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i : i + 65536], v[i : i + 65536]) for i in range(0, len(a), 65536))]).astype(np.int64)
    return np.array([max(-_LONG - 1, min(_LONG, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, v, strict=True)], dtype=np.int64)


class Rotated:
    """Vectors along the principal directions, with the norms of what is left beyond each step's components."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray):
        dim = len(basis)
        self.plain, self.turned = vectors, vectors @ basis
        self.steps = sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), dim})
        left = np.sqrt(np.cumsum((self.turned**2)[:, ::-1], 1)[:, ::-1])
        self.norm = np.sqrt((vectors**2).sum(1))
        self.left = {c: left[:, c] if c < dim else np.zeros(len(vectors)) for c in self.steps}


def scored(a: Rotated, v: Rotated, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and integer products of the allowed pairs (a matrix) whose product lies within [least, most] of its row of `a`.

    Partial products over leading components grow step by step. What is missing is at most the product of the norms
    beyond them, and rounding at most a small share of the whole norms' product; a pair that this keeps out of its
    range goes. Those left are scored again in integers.
    """
    slack = (len(a.turned.T) + 64) * 2.0**-45  # rotation and sums of doubles err by some dim * 2**-52 of the norms
    done, s, alive, i, j = 0, np.zeros(allowed.shape), allowed, None, None
    for c in a.steps:
        if i is None:
            s += a.turned[:, done:c] @ v.turned[:, done:c].T
            reach = a.left[c][:, None] * v.left[c][None] + slack * a.norm[:, None] * v.norm[None]
            alive = alive & (s + reach >= least[:, None]) & (s - reach <= most[:, None])
            if c == a.steps[-1] or alive.mean() < SPARSE:
                i, j = np.nonzero(alive)
                s = s[i, j]
        else:
            for k in range(0, len(i), 65536):
                p, q = i[k : k + 65536], j[k : k + 65536]
                s[k : k + 65536] += np.einsum("ij,ij->i", a.turned[p, done:c], v.turned[q, done:c])
            reach = a.left[c][i] * v.left[c][j] + slack * a.norm[i] * v.norm[j]
            keep = (s + reach >= least[i]) & (s - reach <= most[i])
            i, j, s = i[keep], j[keep], s[keep]
        done = c
    score = exact_products(a.plain[i], v.plain[j], exact)
    return i, j, score


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of each group, ties to smaller ids, in that order."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def bands(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer s with low * p <= 100 * s <= high * p, for each p."""
    lo = [-(-low * int(p) // 100) for p in positive]
    hi = [high * int(p) // 100 for p in positive]
    return np.array(lo, np.int64), np.array(hi, np.int64)


class Block:
    """The vectors that a group compares: ids, labels, coordinates. Rows that stand twice count once."""

    def __init__(self, rows: pa.Table, kind: str, basis: np.ndarray):
        ids = rows.column("vec_id").to_numpy()
        at = np.unique(ids, return_index=True)[1]
        rows = rows.take(pa.array(at))
        self.ids, self.labels = ids[at], np.array(rows.column("label").to_pylist(), dtype=object)
        self.v = Rotated(np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=kind).reshape(len(at), len(basis)).astype(np.float64), basis)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, block: int = BLOCK_VECTORS, anchor_block: int = BLOCK_ANCHORS, sample: int = SAMPLE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(scale * x); a score is the integer inner product of two rows. The positives of a row that
    meets `anchors` are the `positives` best other rows of its label; the negatives of each the `negatives` best rows of
    other labels whose score is low to high percent of the positive's. Ties go to the smaller vec_id. Fewer rows where
    there are fewer candidates, none for a positive with a score below zero.

    All vectors are turned to the principal directions of a sample of at most `sample` rows (any rotation keeps products;
    all rows are candidates). The sample's own scores give each anchor a first bound. Then blocks of vectors are searched:
    scored() adds up leading components and drops a pair once the norms of the rest rule it out; the others are scored
    in integers. Rows meet anchors of their label, for positives, in blocks of that label: a label of very many rows
    has many, small ones share one. For negatives every anchor meets every block.

    Rows with a null id, label or vector, or with null, NaN or infinite components take no part. Shorter vectors count
    as padded with zeros. Of rows that repeat a vec_id one counts, with the least label, then the least vector. Scores
    beyond a long saturate. No rows, or no anchors: no rows.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding", F.coalesce(anchors, F.lit(False)).alias("asks"))
    base = base.where("vec_id is not null and label is not null and embedding is not null").where(~bad)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dim = int(np.diff(b.column(0).offsets.to_numpy()).max())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([dim]), pa.array([float(np.abs(_integers(b.column(0), dim, scale)).max(initial=0))])], ["n", "dim", "most"])

    n, dim, most = base.select("embedding").mapInArrow(measured, "n long, dim long, most double").agg(F.sum("n"), F.max("dim"), F.max("most")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], result)
    dim = max(dim, 1)
    exact, kind = most * most * dim < 2.0**53, "<i4" if most < 2.0**31 else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _integers(b.column(2), dim, scale).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in m], pa.binary()), b.column(3)], ["vec_id", "label", "vec", "asks"])

    single = base.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "asks")).alias("r")).select("vec_id", "r.label", "r.embedding", "r.asks")
    index = staged(single.mapInArrow(packed, "vec_id long, label string, vec binary, asks boolean"), "vectors")
    some = index.select("vec_id", "label", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    basis = rotation(np.frombuffer(b"".join(some.column("vec").to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64))
    n, asked = index.agg(F.count("*"), F.count_if("asks")).first()
    if not asked:
        return spark.createDataFrame([], result)

    # Positives: what the sample has of an anchor's label bounds them; then blocks of the label.
    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Block(some, kind, basis)
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                asking = b.slice(k, AT_ONCE)
                rows = Block(pa.Table.from_batches([asking]), kind, basis)
                alike = (rows.labels[:, None] == known.labels[None]) & (rows.ids[:, None] != known.ids[None])
                none = np.full(len(rows.ids), np.inf)
                i, j, s = scored(rows.v, known.v, alike, -none, none, exact)
                best = first_of(i, s, known.ids[j], positives)
                floor = np.full(len(rows.ids), _LONG, np.int64)
                np.minimum.at(floor, i[best], s[best])
                floor[np.bincount(i[best], minlength=len(floor)) < positives] = -_LONG - 1
                yield pa.RecordBatch.from_arrays([pa.array(rows.ids), pa.array(rows.labels, pa.string()), pa.array([r.astype(kind).tobytes() for r in rows.v.plain], pa.binary()), pa.array(floor)], ["vec_id", "label", "vec", "floor"])

    asking = staged(index.where("asks").select("vec_id", "label", "vec").mapInArrow(begun, "vec_id long, label string, vec binary, floor long"), "anchors")
    labels = index.groupBy("label").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).where("q > 0")
    labels = staged(labels.select("label", "n", F.ceil(F.col("n") / block).cast("int").alias("salts"), F.ceil(F.col("q") / anchor_block).cast("int").alias("parts")), "labels")
    groups = max(1, -(-labels.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] // block))
    group = F.pmod(F.xxhash64("label", "salt", "part"), F.lit(groups)).alias("g")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    dealt = lambda k, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(k)).cast("int")
    left = asking.join(labels, "label").withColumns({"part": dealt("parts", 1), "salt": each("salts")}).select(group, "vec_id", "label", "vec", "floor")
    right = index.join(labels, "label").withColumns({"salt": dealt("salts", 2), "part": each("parts")}).select(group, "vec_id", "label", "vec")

    def alike(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        if asking.num_rows and rows.num_rows:
            there = Block(rows, kind, basis)
            for k in range(0, asking.num_rows, AT_ONCE):
                part = asking.slice(k, AT_ONCE)
                mine = Block(part, kind, basis)
                floor = part.column("floor").to_numpy()[np.unique(part.column("vec_id").to_numpy(), return_index=True)[1]]
                allowed = (mine.labels[:, None] == there.labels[None]) & (mine.ids[:, None] != there.ids[None])
                i, j, s = scored(mine.v, there.v, allowed, np.where(floor == -_LONG - 1, -np.inf, floor), np.full(len(floor), np.inf), exact)
                best = first_of(i, s, there.ids[j], positives)
                out.append(np.array([mine.ids[i[best]], there.ids[j[best]], s[best]], np.int64))
        return pa.Table.from_arrays(list(map(pa.array, np.concatenate(out, 1))), ["anchor_id", "positive_id", "score"])

    found = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(alike, "anchor_id long, positive_id long, score long").distinct()
    order = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    chosen = staged(found.withColumn("r", order).where(F.col("r") <= positives), "positives", labels)
    wanted = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "score"))).alias("pos"))  # `positives` rows a group
    asked_rows = asking.select("vec_id", "label", "vec").join(wanted, "vec_id")

    # Negatives: the sample bounds each positive's range from below, then every block.
    def ranges(part: pa.Table, mine: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A row a positive: the index of its anchor, its id, and its score's band."""
        at = np.unique(part.column("vec_id").to_numpy(), return_index=True)[1]
        pos = part.take(pa.array(at)).column("pos").to_pylist()
        owner = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
        ids, score = (np.array([x[name] for p in pos for x in p], np.int64) for name in ("positive_id", "score"))
        return owner, ids, score, *bands(score, low, high)

    def within(mine: Block, there: Block, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first negatives of each range among these rows: range, index, score."""
        least, most = np.full(len(mine.ids), np.inf), np.full(len(mine.ids), -np.inf)
        can = lo <= hi
        np.minimum.at(least, owner[can], floor[can].astype(np.float64))
        np.maximum.at(most, owner[can], hi[can].astype(np.float64))
        i, j, s = scored(mine.v, there.v, mine.labels[:, None] != there.labels[None], least, most, exact)
        # Each scored pair meets its anchor's ranges.
        slots = np.bincount(owner, minlength=len(mine.ids))
        start = np.cumsum(slots) - slots
        pair = np.repeat(np.arange(len(i)), slots[i])
        r = start[i[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(slots[i]) - slots[i], slots[i])
        keep = (s[pair] >= floor[r]) & (s[pair] <= hi[r]) & can[r]
        pair, r = pair[keep], r[keep]
        best = first_of(r, s[pair], there.ids[j[pair]], negatives)
        return r[best], j[pair[best]], s[pair[best]]

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Block(some, kind, basis)
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = pa.Table.from_batches([b.slice(k, AT_ONCE)])
                mine = Block(part, kind, basis)
                owner, ids, score, lo, hi = ranges(part, mine)
                r, _, s = within(mine, known, owner, lo, hi, lo)
                floor = lo.copy()
                full = np.flatnonzero(np.bincount(r, minlength=len(lo)) == negatives)
                tenth = np.full(len(lo), _LONG, np.int64)
                np.minimum.at(tenth, r, s)
                floor[full] = tenth[full]
                slots = np.bincount(owner, minlength=len(mine.ids))
                ends = pa.array(np.concatenate([[0], np.cumsum(slots)]), pa.int32())
                pos = pa.StructArray.from_arrays([pa.array(x) for x in (ids, score, floor)], ["positive_id", "score", "floor"])
                yield pa.RecordBatch.from_arrays([pa.array(mine.ids), pa.array(mine.labels, pa.string()), pa.array([x.astype(kind).tobytes() for x in mine.v.plain], pa.binary()), pa.ListArray.from_arrays(ends, pos)], ["vec_id", "label", "vec", "pos"])

    pos = "array<struct<positive_id:long,score:long,floor:long>>"
    asked_rows = staged(asked_rows.mapInArrow(bounded, f"vec_id long, label string, vec binary, pos {pos}"), "bounded")
    salts, parts = -(-n // block), -(-asked // anchor_block)
    spread = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    here = lambda k, seed, name: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int").alias(name)
    left = asked_rows.select(here(parts, 1, "part"), spread(salts, "salt"), "vec_id", "label", "vec", "pos")
    right = index.select(spread(parts, "part"), here(salts, 2, "salt"), "vec_id", "label", "vec")

    def apart(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros((5, 0), np.int64)]
        if asking.num_rows and rows.num_rows:
            there = Block(rows, kind, basis)
            for k in range(0, asking.num_rows, AT_ONCE):
                part = asking.slice(k, AT_ONCE)
                mine = Block(part, kind, basis)
                owner, ids, score, lo, hi = ranges(part, mine)
                at = np.unique(part.column("vec_id").to_numpy(), return_index=True)[1]
                floor = np.array([x["floor"] for p in part.take(pa.array(at)).column("pos").to_pylist() for x in p], np.int64)
                r, j, s = within(mine, there, owner, lo, hi, floor)
                out.append(np.array([mine.ids[owner[r]], ids[r], there.ids[j], score[r], s], np.int64))
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pa.Table.from_arrays(list(map(pa.array, np.concatenate(out, 1))), names)

    made = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInArrow(apart, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = made.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is one off, on purpose."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positive AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    negative AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN pair USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT * FROM negative WHERE rank <= 10"""
