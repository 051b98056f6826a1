"""Benchmark decontamination: short test items inside long documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import narrowed, short_batches, slices, table, text_bytes
from stemma.llm.words import mix, shingle_list, word_list, words

SHINGLE, THRESHOLD = 5, 0.8
#: Least hashes that an item of any size keeps, at most, and bytes of items that one pass over the documents looks for.
SKETCH, PASS_BYTES = 32, 4 << 20


class Probes(NamedTuple):
    """The items of one shingle length, by size; sketches point to them."""

    n: int
    items: list[int]
    sizes: np.ndarray
    sets: list[np.ndarray]
    hashes: np.ndarray  # of all sketches, sorted
    first: np.ndarray
    at: np.ndarray  # items of hash i: at[first[i]:first[i + 1]]
    seen: np.ndarray  # whether a hash with these upper bits is in a sketch


def probes(texts: list[bytes], threshold: float = THRESHOLD, shingle: int = SHINGLE) -> list[Probes]:
    """Sketch the items.

    An item keeps its least hashes under one random order, a MinHash sketch of itself alone: where it is
    contained, each of them is in the document with a probability of `threshold` at least, however long the
    document is. Items are partitioned by size (powers of two), and the partition sets the sketch: one hash
    more than may be missing finds the item for certain; beyond SKETCH hashes the chance to miss all is
    under (1 - threshold) ** SKETCH. Items shorter than a shingle are runs of their own length.
    """
    counts = [len(word_list(t)) for t in texts]
    by = defaultdict(list)
    for i, c in enumerate(counts):
        if c:
            by[min(c, shingle)].append(i)
    out = []
    for n, items in sorted(by.items()):
        sets = []
        for i in items:
            sets.append(np.unique(words([texts[i]]).grams(n)[0]))
        sizes = np.array([len(s) for s in sets])
        keys, owners = [], []
        for j, s in enumerate(sets):
            upper = 1 << int(len(s)).bit_length()
            keep = min(SKETCH, int((1 - threshold) * upper) + 1)
            sketch = s[np.argsort(mix(s), kind="stable")[:keep]]
            keys.append(sketch)
            owners.append(np.full(len(sketch), j))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        hashes, first = np.unique(keys[order], return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        out.append(Probes(n, items, sizes, sets, hashes, np.append(first, len(keys)), owners[order], seen))
    return out


def contained(texts: list[bytes], items: list[bytes], probed: list[Probes], threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(text, item, shared shingles, the item's shingles) wherever the share is at least `threshold`."""
    found = []
    hashed = words(texts)
    sizes = np.diff(hashed.first)
    for p in probed:
        h, doc = hashed.grams(p.n)
        hit = np.flatnonzero(p.seen[h >> np.uint64(44)])
        slot = np.minimum(np.searchsorted(p.hashes, h[hit]), len(p.hashes) - 1)
        hit = hit[same := p.hashes[slot] == h[hit]]
        slot = slot[same]
        pairs = {(int(d), int(j)) for d, s in zip(doc[hit], slot, strict=True) for j in p.at[p.first[s] : p.first[s + 1]]}
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        spelt: dict[int, set] = {}
        for d, j in sorted(pairs):
            if sizes[d] - p.n + 1 < threshold * p.sizes[j]:
                continue  # the document's partition is too small for the item's
            own = h[bounds[d] : bounds[d + 1]]
            if np.isin(p.sets[j], own).sum() < threshold * p.sizes[j]:
                continue
            if d not in spelt:
                spelt[d] = set(_grams(word_list(texts[d]), p.n))
            wanted = set(shingle_list(word_list(items[p.items[j]]), p.n))
            shared = len(wanted & spelt[d])
            if shared >= threshold * len(wanted):
                found.append((d, p.items[j], shared, len(wanted)))
    return found


def _grams(ws: list[bytes], n: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(ws[k:] for k in range(n)), strict=False)


def passes(items: DataFrame) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts of the items, in parts of about PASS_BYTES, each small enough to send to all tasks."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-total // PASS_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = items.where(part == k).orderBy("item_id", "text").collect()
        if rows:
            yield [r.item_id for r in rows], [r.text.encode() for r in rows]


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, item_id, containment, shared, shingles) for items(item_id, text) inside docs(doc_id, text).

    Containment is the share of an item's distinct word shingles that the document has; words are lower-cased
    runs of letters, digits and other characters beyond ASCII. Shingles met by hash are compared as words.
    The documents are read once for each part of the items, and are never moved.

    Items without words are nowhere. Null and empty documents hold nothing. Repeated items count once,
    repeated documents each. A null id stays null. No rows on either side: no rows.
    """
    short_batches(docs.sparkSession)
    source = narrowed(docs, "doc_id", "text")
    schema = "doc_id long, item_id long, containment double, shared long, shingles long"
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in passes(items):

        def find(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            probed = probes(texts, threshold, shingle)
            for b in slices(batches):
                found = contained(text_bytes(b), texts, probed, threshold)
                if found:
                    doc_ids = b.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_ids[d] for d, *_ in found], pa.int64()), pa.array([ids[i] for _, i, *_ in found], pa.int64()), pa.array([s / n for *_, s, n in found], pa.float64()), pa.array([s for _, _, s, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())],
                        ["doc_id", "item_id", "containment", "shared", "shingles"],
                    )

        out = out.unionByName(source.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, all their columns, that contain no item; else as find_contained()."""
    short_batches(docs.sparkSession)
    for _, texts in passes(items):

        def keep(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            probed = probes(texts, threshold, shingle)
            for b in slices(batches):
                mask = np.ones(b.num_rows, bool)
                for d, *_ in contained(text_bytes(b), texts, probed, threshold):
                    mask[d] = False
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
