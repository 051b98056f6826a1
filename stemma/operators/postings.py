"""A positional index of chunks' texts: phrases by where their grams stand, batches as segments, one folder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from stemma.functions import text as T
from stemma.operators.ranking import kept

#: Characters of a gram. Three code points of 21 bits fit in a long, so a gram is a number and no two share one.
WIDTH, BITS = 3, 21
#: Texts are kept by ranges of ids.
TEXT_BUCKETS = 16
#: Characters whose places a task lists at once.
BLOCK = 2_000_000
#: How lists are stored: as differences, which dictionaries would keep out, and in short pages, the least that is read of a gram.
LISTS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1000", "compression": "zstd"}
#: Hits are broadcast up to this, by counted rows of so many bytes.
BROADCAST_BYTES, HIT_BYTES = 32 << 20, 128
POSTINGS, CHUNKS, GONE = "postings", "chunks", "gone"


class Index(NamedTuple):
    """postings(gram, slug, part, no, at) and chunks(slug, ord, text, ..., cmp, part, no) of what is alive.

    Chunks of a segment have numbers without gaps where they are stored, so the differences in lists are small.
    """

    postings: DataFrame
    chunks: DataFrame


def _key(gram: str) -> int:
    return sum(ord(c) << BITS * (WIDTH - 1 - k) for k, c in enumerate(gram))


def _sorted(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places by gram and then by place; one sort of plain numbers where those of the characters at hand are small enough."""
    seen = np.zeros(1 << BITS, np.int64)
    seen[points] = 1
    small = (np.cumsum(seen) - 1)[points]
    letter, low = int(seen.sum()).bit_length(), len(points).bit_length()
    key = sum(small[at + k] << letter * (WIDTH - 1 - k) for k in range(WIDTH))
    if WIDTH * letter + low > 63:
        return at[np.argsort(key, kind="stable")]
    return np.sort(key << low | at) & (1 << low) - 1


def _listed(held: list[tuple], slug: pa.DataType) -> pa.RecordBatch:
    """The lists of pieces (work and part, number, first place, text), by gram, and in each by piece and place."""
    works, numbers, firsts, texts = zip(*held, strict=True)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    whole = np.ones(len(points), bool)
    for k in range(1, WIDTH):  # grams do not go over the end of a piece
        whole[ends - k] = False
    at = _sorted(points, np.flatnonzero(whole))
    gram = sum(points[at + k] << BITS * (WIDTH - 1 - k) for k in range(WIDTH))
    piece = np.repeat(np.arange(len(sizes)), sizes)[at]
    work = np.cumsum([False, *(a != b for a, b in zip(works, works[1:], strict=False))])[piece]
    first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (work[1:] != work[:-1])])
    names, parts = zip(*(works[p] for p in piece[first].tolist()), strict=True)
    offsets = pa.array(np.r_[first, len(gram)].astype(np.int32))
    places = np.array(numbers, np.int64)[piece], (at - (ends - sizes)[piece] + np.array(firsts)[piece]).astype(np.int32)
    columns = [pa.array(gram[first]), pa.array(names, slug), pa.array(parts, pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in places)]
    return pa.RecordBatch.from_arrays(columns, names=["gram", "slug", "part", "nos", "ats"])


def lists(chunks: DataFrame) -> DataFrame:
    """chunks(slug, part, no, cmp) -> gram, slug, part, nos, ats: every gram of WIDTH characters, and where it stands in a work (at: from 0).

    A task lists what it reads, BLOCK characters at once, sorted by gram; so no place is a row, none is moved, and a list that
    is in several blocks is several rows. They are fewest where chunks of a work follow each other.
    """
    block = BLOCK

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, slug = [], 0, None
        for batch in batches:
            slug = batch.schema.field("slug").type
            for w, part, no, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(0, len(text) - WIDTH + 1, block):
                    piece = text[i : i + block + WIDTH - 1]
                    held.append(((w, part), no, i, piece))
                    size += len(piece)
                    if size >= block:
                        yield _listed(held, slug)
                        held, size = [], 0
        if held:
            yield _listed(held, slug)

    T.short_batches()
    schema = S.StructType([S.StructField("gram", S.LongType()), chunks.schema["slug"], *(S.StructField(n, t) for n, t in (("part", S.IntegerType()), ("nos", S.ArrayType(S.LongType())), ("ats", S.ArrayType(S.IntegerType()))))])
    return chunks.where(F.length("cmp") >= WIDTH).select("slug", "part", "no", "cmp").mapInArrow(listed, schema)


def places(rows: DataFrame) -> DataFrame:
    """lists() -> gram, slug, part, no, at: a row a place, which a condition on grams comes before."""
    return rows.select("gram", "slug", "part", "ats", F.posexplode("nos").alias("k", "no")).select("gram", "slug", "part", "no", F.get("ats", F.col("k")).alias("at"))


def _part() -> Column:
    return F.pmod(F.xxhash64("slug", "ord"), F.lit(TEXT_BUCKETS)).cast("int")


def write_segment(chunks: DataFrame, path: str, number: int = 0, gone: DataFrame | None = None) -> None:
    """Add chunks(slug, ord, text, ...) to an index as segment `number`; of the works in it, and in gone(slug), only it counts from then on.

    Texts are dealt once and put in comparable form where they are written. Their lists are made from what is stored, in the
    tasks that read it, and written as they come: sorted by gram in each block, which Parquet keeps as differences with bounds
    for each page, so a query reads a few pages of a block for each of its grams. Writing a segment again replaces it.
    """
    to = lambda name: f"{path}/{name}/segment={number}"
    rows = chunks.withColumn("part", _part()).hint("rebalance", "part")
    rows = rows if "cmp" in chunks.columns else rows.withColumn("cmp", T.comparable(F.col("text")))
    rows = rows.sortWithinPartitions("part", "slug", "ord").withColumn("no", F.monotonically_increasing_id())
    rows.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(to(CHUNKS))
    made = lists(chunks.sparkSession.read.schema(rows.schema).parquet(to(CHUNKS)))
    made.write.mode("overwrite").options(**LISTS).parquet(to(POSTINGS))
    works = chunks.select("slug")
    (works.unionByName(gone.select("slug")) if gone is not None else works).distinct().write.mode("overwrite").parquet(to(GONE))


def read_index(spark: SparkSession, path: str) -> Index:
    """An index as all its segments make it: of each work, what its last segment has."""
    last = spark.read.parquet(f"{path}/{GONE}").groupBy("slug").agg(F.max("segment").alias("last"))
    alive = lambda name: spark.read.parquet(f"{path}/{name}").join(last, "slug").where("segment = last").drop("last", "segment")
    several = spark.read.parquet(f"{path}/{GONE}").select("segment").distinct().limit(2).count() > 1
    whole = lambda name: spark.read.parquet(f"{path}/{name}").drop("segment")
    postings, chunks = map(alive if several else whole, (POSTINGS, CHUNKS))
    return Index(places(postings), chunks)


def merge(spark: SparkSession, path: str, into: str) -> None:
    """Write an index of several segments as one of one segment, in a new folder; the old one can be read until it is deleted."""
    write_segment(read_index(spark, path).chunks.drop("part", "no"), into)


def _starts(index: Index, needle: str) -> DataFrame:
    """slug, part, no, at: where the grams of a needle stand one after the other.

    As many grams as cover the needle; each says where the needle would begin, and all have to agree.
    """
    offsets = sorted({*range(0, len(needle) - WIDTH + 1, WIDTH), len(needle) - WIDTH})
    grams = {o: _key(needle[o : o + WIDTH]) for o in offsets}
    here = F.col("gram").isin(*sorted(set(grams.values())))
    which = F.filter(F.array(*[F.struct(F.lit(g).cast("long").alias("g"), F.lit(o).alias("o")) for o, g in grams.items()]), lambda x: x.g == F.col("gram"))
    starts = index.postings.where(here).select("slug", "part", "no", F.explode(F.transform(which, lambda x: F.col("at") - x.o)).alias("at")).where("at >= 0")
    return starts.groupBy("slug", "part", "no", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).drop("n")


def phrase(index: Index, needle: str) -> DataFrame:
    """slug, ord, at: where a needle (as comparable_value() has it, of WIDTH characters or more) stands."""
    return _starts(index, needle).join(index.chunks.select("slug", "part", "no", "ord"), ["slug", "part", "no"]).select("slug", "ord", "at")


def search(index: Index, query: str) -> DataFrame:
    """Chunks that hold the query, as literal_chunks() has it: of those where all its grams agree, texts are compared.

    Chunks meet the hits by their parts and numbers: of those tables only parts with hits are read, and texts are moved only
    if there are more hits than BROADCAST_BYTES hold. A query of fewer characters than a gram has no grams; all texts are compared.
    """
    needle = T.comparable_value(query)
    if len(needle) < WIDTH:
        return index.chunks.where(F.contains("cmp", F.lit(needle)) if needle else F.lit(False)).drop("part", "no", "cmp")
    hits = kept(_starts(index, needle).groupBy("slug", "part", "no").agg(F.min("at").alias("_at")))
    most = BROADCAST_BYTES // HIT_BYTES
    hits = F.broadcast(hits) if hits.limit(most + 1).count() <= most else hits.hint("merge")
    # The place is the hit's, so texts are compared where they have met one, not before.
    same = F.substring("cmp", F.col("_at") + 1, F.lit(len(needle))) == needle
    return index.chunks.join(hits, ["part", "slug", "no"]).where(same).drop("part", "no", "_at", "cmp")
