"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, Hamming distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import discard, narrowed, short_batches, slices, staged, table, text_bytes, tidy
from stemma.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Blocks of a fingerprint. Two that differ in DISTANCE bits agree in all but so many blocks, so in BLOCKS - DISTANCE whole ones.
BLOCKS = 7
#: Fingerprints that share blocks are compared with each other up to so many; beyond, all their neighbours are cheaper.
PAIRWISE = 2048
CAPITALS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each run of words; of all words where there are fewer, and none where there is no word."""
    words = text.translate(CAPITALS).split()  # ASCII white space only, as bytes
    if not words:
        return []
    plain, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    start, h = [0, *end[:-1]], xxhash.xxh64_intdigest
    last = end[shingle - 1 :] or end[-1:]
    return [h(plain[a : z - 1], SEED) for a, z in zip(start, last, strict=False)]


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, most: int = 1 << 16) -> np.ndarray:
    """A 64-bit fingerprint for each text: the bits that are set in over half of its shingles' hashes; at most `most` at once."""
    ones, size = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        h = np.array(shingle_hashes(text, shingle), np.uint64)
        size[i] = len(h)
        for a in range(0, len(h), most):
            bits = np.unpackbits(h[a : a + most].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[i] += bits.sum(0, dtype=np.int64)
    over = (2 * ones > size[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]


def block_keys(fingerprint: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """An array with a key for each choice of blocks - distance of the blocks that a fingerprint is cut into.

    Fingerprints that differ in `distance` bits at most share one, as those bits lie in `distance` blocks at most.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [sum(c) for c in combinations(masks, blocks - distance)]
    return F.array(*(F.struct(F.lit(i).alias("of"), fingerprint.bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for i, m in enumerate(chosen)))


def linked(members: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For distinct fingerprints, the index of the first that each is linked to, in steps of at most `distance` bits.

    Each round compares the fingerprints of the last round's finds with those not found yet, so a dense group costs little.
    """
    n = len(members)
    root = np.full(n, -1)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        ahead = np.array([first])
        while len(ahead):
            open_ = np.flatnonzero(root < 0)
            if not len(open_):
                break
            found = np.zeros(len(open_), bool)
            for a in range(0, len(ahead), 64):
                found |= (np.bitwise_count(members[ahead[a : a + 64], None] ^ members[open_][None]) <= distance).any(0)
            ahead = open_[found]
            root[ahead] = first
    return root


def neighbours(members: np.ndarray, bits: int) -> np.ndarray:
    """A row for each fingerprint: itself, and all that differ from it in up to `bits` bits."""
    masks = [sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(64), k)]
    return members[:, None] ^ np.array(masks, np.uint64)[None]


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """prints(fp), distinct -> u, v: links whose components are those of all pairs within `distance` (even, and below `blocks`).

    Prints meet by shared blocks. Up to `pairwise` that share them are compared by Hamming distance, and come out as
    a star each component, not as pairs. Where more share blocks, each of these prints meets the others in prints
    within half the distance of both: two prints are within the distance if and only if there is such a one between
    them. That takes some 2,000 rows a print and no comparisons, however many prints are near each other.
    """
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.of", "k.bits")
    sizes = staged(keyed.groupBy("of", "bits").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
    # A key with very many prints is split by this join; what it leaves for groups is short.
    shared = staged(keyed.join(sizes, ["of", "bits"]), "sharing", sizes)
    groups = shared.where(F.col("n") <= pairwise).groupBy("of", "bits").agg(F.array_sort(F.collect_list("fp")).alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0)
            flat, ends = fps.flatten().to_numpy(zero_copy_only=False), fps.offsets.to_numpy() - fps.offsets[0].as_py()
            bits, first, size = flat.view(np.uint64), ends[:-1], np.diff(ends)
            pair = first[size == 2]  # most groups are pairs
            pair = pair[np.bitwise_count(bits[pair] ^ bits[pair + 1]) <= distance]
            us, vs = [flat[pair]], [flat[pair + 1]]
            for a, n in zip(first[size > 2], size[size > 2], strict=True):
                root = linked(bits[a : a + n], distance)
                other = np.flatnonzero(root != np.arange(n))
                us.append(flat[a + root[other]])
                vs.append(flat[a + other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    near = groups.select("fps").mapInArrow(compare, "u long, v long").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                own = b.column(0)[a : a + 256].to_numpy()
                around = neighbours(own.view(np.uint64), distance // 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, around.shape[1])), pa.array(around.reshape(-1).view(np.int64))], ["fp", "at"])

    crowded = shared.where(F.col("n") > pairwise).select("fp").distinct().mapInArrow(spread, "fp long, at long")
    # The least print around each place, from which the others hang; a place that all share is pre-aggregated and split.
    least = crowded.groupBy("at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("at", "u")
    far = crowded.join(least, "at").select("u", F.col("fp").alias("v")).where("u <> v").distinct()
    out = staged(near.unionByName(far), "near-prints")
    discard(shared)
    return out


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fp (a long of the fingerprint's bits), as a staged table."""
    short_batches(docs.sparkSession)
    source = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(text_bytes(b), shingle).view(np.int64))], ["doc_id", "fp"])
        tidy()

    return staged(source.mapInArrow(made, "doc_id long, fp long"), "fingerprints")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach).

    A document's shingles are the runs of four words of its text (A-Z lower-cased), repeats included, or all its words
    where there are fewer; a bit of the fingerprint is set if it is in over half of their XXH64. Documents are linked
    where fingerprints differ in at most `distance` bits. Equal fingerprints are one from the start.

    A null text counts as empty; a text without words has the fingerprint zero. Rows that repeat a doc_id get a row each,
    by their own text. Rows without a doc_id link others too, but give no component its name: where all are without, it
    is null. No rows: no rows.
    """
    rows = fingerprinted(docs)
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    near = links(prints.select("fp"), distance)
    part = components(near)
    joined = staged(prints.join(part, prints["fp"] == part["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "joined", prints, part, near)
    name = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(joined.join(name, "component").select("fp", "component_id"), "named", joined)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
