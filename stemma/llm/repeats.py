"""Removal of repeated passages: position ranks refined at growing lengths until unique or past the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import narrowed, short_batches, slices, staged, table, text_bytes
from stemma.llm.words import mix, prefix_hashes, range_hashes

#: Length of a repeated string, of the seeds by which positions are first ranked, and positions of a block.
LENGTH, SEED, BLOCK = 100, 32, 8
#: Bytes of one document that are searched at once; longer ones are cut with an overlap of LENGTH - 1.
SEGMENT = 1 << 20
_ODD = np.uint64(0xD1342543DE82EF95)


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    out, size = a, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - size :][: len(a) - width + 1]) if size < width else out


class Segments:
    """Parts of texts in one buffer, with the hash of any range of it."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int) -> None:
        self.doc = np.array([d for d, _, _ in parts], np.int64)
        self.base = np.array([at for _, at, _ in parts], np.int64)
        self.sizes = np.array([len(x) for *_, x in parts], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(x for *_, x in parts), np.uint8)
        self.length = length
        self.sums = prefix_hashes(self.raw)

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in the buffer where a string of `length` bytes begins, and their parts."""
        n = np.maximum(self.sizes - self.length + 1, 0)
        part = np.repeat(np.arange(len(n)), n)
        return np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + self.start[part], part

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return range_hashes(self.sums, start, end) + (end - start).astype(np.uint64) * _ODD


def segments(texts: list[bytes], overlap: int, length: int, size: int = SEGMENT) -> Iterator[Segments]:
    """Texts in buffers of bounded size; those longer than `size` in parts that share `overlap` bytes.

    There is a part for each multiple of `size` where a string of `length` bytes begins, whatever the overlap.
    """
    parts, total = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), size):
            parts.append((i, at, t[at : at + size + overlap]))
            total += len(parts[-1][2])
            if total >= size:
                yield Segments(parts, length)
                parts, total = [], 0
    if parts:
        yield Segments(parts, length)


def anchors(s: Segments, seed: int = SEED) -> dict[str, np.ndarray]:
    """The sampled positions: for each string of `length` bytes the least seed (by hash, then leftmost) in it.

    Which seed that is depends on the string alone, so equal strings have equal seeds at equal distance.
    Returns for each anchor its part, the first of the strings that chose it, their number, how far on from
    the first it stands, the rank of the seed (core) and that of all bytes of the strings (union).
    """
    places, part = s.positions()
    if not len(places):
        return {k: np.zeros(0, np.int64) for k in ("part", "first", "n", "a", "core", "union")}
    at = np.arange(len(s.raw) - seed + 1)
    h = range_hashes(s.sums, at, at + seed)
    low = np.uint64((1 << 22) - 1)  # a buffer is shorter than that
    least = _window_min((h & ~low) | at.astype(np.uint64), s.length - seed + 1)
    chosen = (least[places] & low).astype(np.int64)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1])
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(chosen)))
    first, anchor = places[i], chosen[i]
    union = mix(s.hashes(first, first + n - 1 + s.length) + (anchor - first).astype(np.uint64) * _ODD)
    return {"part": part[i], "first": first, "n": n, "a": anchor - first, "core": h[anchor].view(np.int64), "union": union.view(np.int64)}


def blocks(s: Segments, part: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
    """Cut runs of positions into blocks that end at multiples of BLOCK before the anchor, wherever a run begins.

    A block's core is what all positions of a whole block share, so it is the same for a block that its run
    cuts short; its union is the bytes of the strings that are there. `each` has every position's own hash.
    """
    high, low = a // BLOCK, (a - n + 1) // BLOCK
    row = np.repeat(np.arange(len(first)), high - low + 1)
    k = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
    begin = s.start[part[row]] + first[row]
    end = begin + a[row] - BLOCK * k
    start = np.maximum(begin, end - BLOCK + 1)
    stop = np.minimum(begin + n[row] - 1, end)
    core = range_hashes(s.sums, end, end - BLOCK + 1 + s.length)
    union = s.hashes(start, stop + s.length) + (start - end + BLOCK).astype(np.uint64) * _ODD
    at = np.minimum(start[:, None] + np.arange(BLOCK), stop[:, None])
    each = range_hashes(s.sums, at.reshape(-1), at.reshape(-1) + s.length).reshape(-1, BLOCK)
    return {"part": part[row], "first": start - s.start[part[row]], "n": stop - start + 1, "core": core.view(np.int64), "union": mix(union).view(np.int64), "each": each.view(np.int64)}


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1).alias("last"))


def _refine(rows: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """One round: staged rows(core, union, doc_id, first, n, ...) that share a core -> (repeated, open).

    Rows of equal union repeat the first of them. Of what is left, one row a union, those whose core stands
    in other unions too are still open: some of their strings may be repeated, some not. The rows go.
    """
    place = F.struct("doc_id", "first")
    best = staged(rows.groupBy("core", "union").agg(F.min(place).alias("best")), "ranks")
    ranked = rows.join(best, ["core", "union"]).select("core", "doc_id", "first", "n", keep, (place == F.col("best")).alias("first_of_union"))
    ranked = staged(ranked, "ranked", rows, best)
    repeated = staged(_spans(ranked.where("not first_of_union")), "repeated")
    firsts = ranked.where("first_of_union")
    several = staged(firsts.groupBy("core").agg(F.count("*").alias("unions")).where("unions > 1").select("core"), "several")
    open_ = firsts.join(several, "core", "left_semi").select("core", "doc_id", "first", "n", keep)
    return repeated, staged(open_, "open", ranked, several)


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """doc_id, spans: where strings of `length` bytes begin, from start to last, that also begin earlier.

    Prefix doubling over every byte would sort each position several times over. Here positions are sampled
    by content first, and ranked at growing lengths, by pairs (rank of what a row's strings have in common,
    rank of all their bytes):
    - anchors, one in about 33 positions: seeds of `seed` bytes. A unique seed ends the search for its strings.
    - blocks of BLOCK positions of the anchors still open: common parts of length - BLOCK + 1 bytes.
    - single positions of the blocks still open, at the full length.
    Each round groups by the first rank, drops what is unique, groups by the pair, and hands on what differs.
    Both ranks are hashes of 64 bits over different ranges of bytes, and rows are equal where both are.
    """
    short_batches(docs.sparkSession)
    schema = "core long, union long, doc_id long, first int, n int"

    def rows(b: pa.RecordBatch, s: Segments, r: dict[str, np.ndarray], last: str) -> pa.RecordBatch:
        ids = b.column(0).take(pa.array(s.doc[r["part"]]))
        cols = [pa.array(r["core"]), pa.array(r["union"]), ids, pa.array((r["first"] + s.base[r["part"]]).astype(np.int32)), pa.array(r["n"].astype(np.int32))]
        if last == "a":
            cols.append(pa.array(r["a"].astype(np.int32)))
        else:
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, r["each"].size + 1, BLOCK), pa.int32()), pa.array(r["each"].reshape(-1))))
        return pa.RecordBatch.from_arrays(cols, ["core", "union", "doc_id", "first", "n", last])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for s in segments(text_bytes(b), length - 1, length, segment):
                r = anchors(s, seed)
                yield rows(b, s, r | {"first": r["first"] - s.start[r["part"]]}, "a")

    found = docs.mapInArrow(seeded, schema + ", a int")
    again = found.groupBy("core").agg(F.count("*").alias("rows")).where("rows > 1").select("core")
    again = staged(again, "cores")
    covered, open_ = _refine(staged(found.join(again, "core", "left_semi"), "seeds", again), "a")
    runs = open_.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "a")).alias("runs"))
    runs = docs.join(runs, "doc_id").select("doc_id", "text", "runs")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists, texts = b.column(2), text_bytes(b)
            first, n, a = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            for s in segments(texts, 2 * length + BLOCK, length, segment):
                key = s.doc * (1 << 24) + s.base // segment  # a run lies in the part in which it begins
                run = doc * (1 << 24) + first // segment
                part = np.minimum(np.searchsorted(key, run), len(key) - 1)
                own = first - s.base[part]
                # a run of another row with the same doc_id may not fit into this text
                here = (key[part] == run) & (own + n - 1 + length <= s.sizes[part])
                if here.any():
                    yield rows(b, s, blocks(s, part[here], own[here], n[here], a[here]), "each")

    parts = staged(runs.mapInArrow(blocked, schema + ", each array<long>"), "blocks", open_)
    again = staged(parts.groupBy("core").agg(F.count("*").alias("rows")).where("rows > 1").select("core"), "common")
    more, open_ = _refine(staged(parts.join(again, "core", "left_semi"), "shared-blocks", parts, again), "each")
    # Equal strings stand in blocks of equal core, so the pair of both hashes, 128 bits, stands for a string.
    single = open_.select("core", "doc_id", "first", F.posexplode(F.slice("each", F.lit(1), F.col("n"))).alias("i", "own"))
    single = staged(single.select("core", "own", "doc_id", (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("n")), "positions", open_)
    best = single.groupBy("core", "own").agg(F.min(F.struct("doc_id", "first")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    best = staged(best, "firsts")
    last = staged(_spans(single.join(best, ["core", "own"]).where(F.struct("doc_id", "first") != F.col("best"))), "repeated", single, best)
    spans = covered.unionByName(more).unionByName(last)
    return staged(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "last")).alias("spans")), "spans", covered, more, last)


def removed_ranges(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (start, end) of the bytes that strings of `length` bytes at start to last cover."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    start, end = spans[:, 0], np.maximum.accumulate(spans[:, 1] + length)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([start[at], end[np.append(at[1:], len(start)) - 1]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, removed (array of start and end in bytes), kept (binary).

    Every byte goes that a string of `length` bytes covers which also starts earlier: in a smaller doc_id or
    before it in the same document. Strings are judged on the input and never cross documents.

    Null counts as empty. Rows that repeat a doc_id are judged as if each stood there alone, and get a row
    each. A null doc_id takes no part: its text is kept. No rows: no rows.
    """
    source = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(source.where("doc_id is not null"), length, seed, segment)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for b in slices(iter([whole])):
                sizes, ranges, kept = [], [], []
                for text, own in zip(text_bytes(b), b.column(2).to_pylist(), strict=True):
                    own = [(s["start"], s["last"]) for s in own or () if s["last"] + length <= len(text)]
                    gone = removed_ranges(np.array(own, np.int64), length) if own else np.zeros((0, 2), np.int64)
                    sizes.append(len(text))
                    ranges.append([{"start": int(a), "end": int(z)} for a, z in gone])
                    edges = [0, *gone.reshape(-1).tolist(), len(text)]
                    kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    joined = source.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r.end - r.start)
    return out.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
