"""Near-duplicate documents: BagMinHash signatures, banding, and exact multiset overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import narrowed, short_batches, slices, staged, table, text_bytes, tidy
from stemma.llm.components import components
from stemma.llm.words import mix, words

SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 4: a pair at the threshold shares no band with a probability of (1 - 0.8 ** 4) ** 24, 3 in a million.
BANDS, ROWS = 24, 4
#: What a verifying group compares, about: texts and bytes on either side of a block, pairs and bytes of a group.
BLOCK_X, BLOCK_Y, BLOCK_BYTES = 128, 512, 2 << 20
GROUP_PAIRS, GROUP_BYTES = 1024, 4 << 20
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, shingle) with their counts, by text and then by shingle."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def bag_min_hash(hashes: np.ndarray, doc: np.ndarray, count: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """A matrix of `slots` components a text; two texts agree in one with the probability of their weighted Jaccard.

    A shingle's weight is its count, discretised to integers and cut into [0, 1), [1, 2), [2, 4), [4, 8)...
    Each of these ranges is a Poisson process of its own, with points at rate slots * width; a point has a
    random slot and a random level in its range, and counts where the level is below the weight. So a weight
    w needs log2(w) + 1 processes, and equal shingles make the same points whatever their weights. A process
    stops once its next point is beyond the greatest component of its text.
    """
    best = np.full(texts * slots, np.inf)
    level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # the last range that begins below the count
    row = np.repeat(np.arange(len(hashes)), level + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    width = np.where(k > 0, low, 1)
    seed = mix(hashes[row] + (k.astype(np.uint64) + np.uint64(1)) * _ODD)
    of, weight, x = doc[row], count[row], np.zeros(len(row))
    point = 0
    while len(seed):
        point += 1
        r = mix(seed + np.uint64(point * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (slots * width)
        r = mix(r + _ODD)
        slot = ((r >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)
        at = low + ((r & np.uint64((1 << 40) - 1)) % width.astype(np.uint64)).astype(np.int64)
        hit = at < weight
        np.minimum.at(best, (of * slots + slot)[hit], x[hit])
        limit = best.reshape(texts, slots).max(1)
        go = x <= limit[of]
        seed, of, weight, x, low, width = (a[go] for a in (seed, of, weight, x, low, width))
    return best.reshape(texts, slots)


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), count, rows)
    h = np.zeros((len(signature), count), np.uint64) + np.arange(1, count + 1, dtype=np.uint64) * _GOLD
    for j in range(rows):
        h = mix(h * _ODD + bits[:, :, j])
    return h.view(np.int64)


Bag = tuple[np.ndarray, np.ndarray]


NONE: Bag = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def common(a: Bag, b: Bag) -> Bag:
    """The intersection of two multisets, each as sorted hashes and their counts."""
    h, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return h, np.minimum(a[1][i], b[1][j])


def overlap(a: Bag, b: Bag) -> int:
    """Its size."""
    return int(common(a, b)[1].sum())


def excess(a: Bag, b: Bag) -> Bag:
    """What b has beyond a."""
    count = b[1].copy()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    count[j] -= a[1][i]
    return b[0][count > 0], count[count > 0]


def _bags(texts: list[bytes], shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    h, d, n = counted(*words(texts).shingles(shingle))
    at = np.searchsorted(d, np.arange(len(texts) + 1))
    return [(h[a:z], n[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]


def verified(pairs: DataFrame, bodies: DataFrame, shingle: int = SHINGLE, share: float | None = None) -> DataFrame:
    """pairs(near, x, y) and bodies(id, text, size) -> x, y, shared, nx, ny, inside, beyond.

    Pairs with one `near` are dealt out in blocks of about BLOCK_X times BLOCK_Y texts, and fewer where these
    have more than BLOCK_BYTES on a side. So a text goes once to each block that needs it, not once a pair,
    and a `near` with very many pairs, or long texts, fills many blocks. A group has a few small blocks or one.
    With a `share`, `beyond` is what y has and x has not, and `inside` what they have in common, where that is
    so much of y; else both are empty.
    """
    size = bodies.select("id", "size")
    sized = pairs.join(size.select(F.col("id").alias("x"), F.col("size").alias("sx")), "x").join(size.select(F.col("id").alias("y"), F.col("size").alias("sy")), "y")
    sized = staged(sized.select("near", "x", "y", "sx", "sy"), "sized")
    each = sized.groupBy("near").agg(F.approx_count_distinct("x").alias("x"), F.approx_count_distinct("y").alias("y"), F.avg("sx").alias("sx"), F.avg("sy").alias("sy"), F.count("*").alias("n"))
    parts = lambda k, most: F.ceil(F.greatest(F.col(k) / most, F.col(k) * F.col(f"s{k}") / BLOCK_BYTES))
    each = each.select("near", "n", parts("x", BLOCK_X).alias("nx"), parts("y", BLOCK_Y).alias("ny"), (F.col("x") * F.col("sx")).alias("bx"), (F.col("y") * F.col("sy")).alias("by"))
    each = staged(each, "sizes")
    n, total = each.agg(F.sum("n"), F.sum(F.col("bx") * F.col("ny") + F.col("by") * F.col("nx"))).first()
    groups = max(1, -(-(n or 0) // GROUP_PAIRS), int(total or 0) // GROUP_BYTES)
    block = F.xxhash64("near", F.pmod(F.xxhash64("x"), F.col("nx")), F.pmod(F.xxhash64("y", F.lit(1)), F.col("ny")))
    dealt = sized.join(each, "near").select(F.pmod(block, F.lit(groups)).alias("g"), "x", "y").distinct()
    dealt = staged(dealt, "dealt", sized, each)
    left = dealt.select("g", F.col("x").alias("id")).distinct().join(bodies, "id").select("g", "id", "text")
    bodies = bodies.select(F.col("id").alias("y"), F.col("text").alias("body"))
    right = dealt.groupBy(F.col("g").alias("h"), "y").agg(F.collect_set("x").alias("xs")).join(bodies, "y").select("h", "y", "xs", "body")
    shared = pa.struct([("h", pa.int64()), ("c", pa.int32())])

    def lists(bags: list[Bag]) -> pa.Array:
        h, c = (np.concatenate([b[k] for b in bags]) if bags else np.zeros(0, np.uint64) for k in (0, 1))
        rows = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32))], fields=list(shared))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(b[0]) for b in bags)]), pa.int32()), rows)

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        out: list[tuple] = []
        inner: list[Bag] = []
        outer: list[Bag] = []
        if xs.num_rows and ys.num_rows:
            raw = lambda column: [x.encode() for x in column.to_pylist()]
            bag = dict(zip(xs.column("id").to_pylist(), _bags(raw(xs.column("text")), shingle), strict=True))
            for first in range(0, ys.num_rows, 64):
                part = ys.slice(first, 64)
                for y, wanted, own in zip(part.column("y").to_pylist(), part.column("xs").to_pylist(), _bags(raw(part.column("body")), shingle), strict=True):
                    n = int(own[1].sum())
                    for x in wanted:
                        both = common(bag[x], own)
                        out.append((x, y, int(both[1].sum()), int(bag[x][1].sum()), n))
                        if share is not None:
                            inner.append(both if out[-1][2] >= share * n else NONE)
                            outer.append(excess(bag[x], own))
        none = [NONE] * len(out)
        cols = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
        return pa.Table.from_arrays([*cols, lists(inner or none), lists(outer or none)], ["x", "y", "shared", "nx", "ny", "inside", "beyond"])

    bags = "array<struct<h:long,c:int>>"
    return left.groupBy("g").cogroup(right.groupBy("h")).applyInArrow(compare, f"x long, y long, shared long, nx long, ny long, inside {bags}, beyond {bags}")


def _open_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """members(c, id, component, shared, n, inside, beyond) -> near, x, y: pairs of unlike component that may be near.

    All members of c have been compared with the text c: `inside` is what they share with it (where that is
    enough for a pair by itself), `beyond` the rest of them. Near texts share at least threshold of either,
    and threshold / (1 + threshold) of both sizes together. Two cases:
    - With something in common beyond c, that is threshold * n - shared at least, whatever the other's size.
    - With nothing there, they share that much inside c: no more than the lesser of what each shares with c,
      so a member's own counts bound the size of the other.
    In both, with what is left of a member ordered from the rarest shingle on, one of those before the last so
    many must be in the other too. Pairs come from an equality join on these prefixes, which hardly ever hold
    a common passage, and in the second case on narrow ranges of sizes too; nothing is paired by c alone.
    """
    share = threshold / (1 + threshold) - 1e-9
    main = members.groupBy("c", "component").agg(F.count("*").alias("k")).groupBy("c").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"))
    main = staged(main.where("parts > 1").select("c", "main"), "main")
    rest = staged(members.join(main, "c").withColumn("stray", F.col("component") != F.col("main")), "rest", main)
    row = ["id", "component", "shared", "n", "stray"]
    name = lambda df, a, *more: df.select("c", "h", *more, *[F.col(k).alias(k + a) for k in row])
    apart = (F.col("component1") != F.col("component2")) & (~F.col("stray2") | (F.col("id1") < F.col("id2")))

    def prefixes(of: DataFrame, bag: str, need: Column) -> DataFrame:
        own = of.select("c", *row, F.explode(bag).alias("b")).select("c", *row, "b.h", F.col("b.c").alias("k"))
        times = staged(own.groupBy("c", "h").agg(F.count("*").alias("times")).where("times > 1"), "times")
        text = W.partitionBy("c", "id")
        before = F.coalesce(F.sum("k").over(text.orderBy(F.coalesce("times", F.lit(1)), "h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        own = own.join(times, ["c", "h"], "left").withColumn("prefix", before <= F.sum("k").over(text) - need).where("prefix and times > 1")
        return staged(own.select("c", "h", *row), bag, times)

    beyond = prefixes(rest, "beyond", F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - F.col("shared") - 1e-6)))
    met = name(beyond.where("stray"), "1").join(name(beyond, "2"), ["c", "h"]).where(apart).select("c", "id1", "id2")
    # With nothing beyond c, a member's partners have at most `reach` shingles; those out of all strays' reach are not spread.
    reach = F.col("shared") / share - F.col("n")
    able = rest.where(F.col("shared") >= threshold * F.col("n"))
    wanted = able.where("stray").groupBy("c").agg(F.max(reach).alias("most"), F.min("n").alias("least"))
    able = able.join(wanted, "c").where(F.col("stray") | ((F.col("n") <= F.col("most")) & (reach >= F.col("least")))).drop("most", "least")
    inside = prefixes(able, "inside", F.ceil(threshold * F.col("n") - 1e-6))
    size = lambda n: F.floor(F.log(n) / math.log(1.02))
    other = F.least(F.col("n") / threshold, F.col("shared") / share - F.col("n"))
    ranges = F.explode(F.sequence(size(threshold * F.col("n")) - 1, size(F.greatest(other, threshold * F.col("n"))) + 1))
    enough = F.least("shared1", "shared2") >= share * (F.col("n1") + F.col("n2"))
    plain = name(inside.where("stray"), "1", ranges.alias("size")).join(name(inside, "2", size(F.col("n")).alias("size")), ["c", "h", "size"]).where(apart & enough)
    out = met.unionByName(plain.select("c", "id1", "id2")).groupBy(F.col("id1").alias("x"), F.col("id2").alias("y")).agg(F.min("c").alias("near")).select("near", "x", "y")
    return staged(out, "open-pairs", rest, beyond, inside)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, text_id, class_id: the least doc_id of its equal texts, and of its class.

    A class is a connected component of texts whose multisets of word shingles (lower-cased words, counts as
    weights) overlap by `threshold` or more, by weighted Jaccard. Equal texts are one text from the start.

    Texts are banded by BagMinHash. Pairs of a bucket are not spelt out. First each bucket, and each finer one
    of two or four bands together, compares its members with the one that meets most others, and what is
    linked becomes a component. Then, only where a bucket still holds several components, pairs of different
    ones are compared unless what they share with the bucket's centre, and with each other beyond it, shows
    that they cannot be near. So every pair that shares a band is compared, implied by links, or ruled out.

    Null counts as empty; empty texts are equal texts, and texts without words are near no other text. Rows
    that repeat a doc_id get one row each, with the class of their own text; classes that meet only in such a
    doc_id stay apart, though both may be called by it. Rows with a null doc_id get null ids. No rows: no rows.
    """
    rows, named = _classes(docs, threshold, shingle)
    # This join runs after staged() has let its settings go, so it is said here that no side is broadcast.
    out = rows.select("doc_id", "k1", "k2").join(named.select("k1", "k2", "text_id", F.col("first.text_id").alias("class_id")).hint("merge"), ["k1", "k2"], "left")
    known_id = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(known_id, F.col("text_id")).alias("text_id"), F.when(known_id, F.col("class_id")).alias("class_id"))


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def first_texts(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, k1, k2, repeated: of each class the text with the least doc_id, by text_keys().

    `repeated`: whether several rows have this doc_id and this text.
    """
    rows, named = _classes(docs, threshold, shingle)
    first = named.where(F.struct("text_id", "k1", "k2") == F.col("first")).select(F.col("text_id").alias("doc_id"), "k1", "k2")
    times = rows.groupBy("doc_id", "k1", "k2").agg((F.count("*") > 1).alias("repeated"))
    return staged(first.join(times, ["doc_id", "k1", "k2"]), "firsts", rows, named)


def _classes(docs: DataFrame, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, bands), and texts (k1, k2, text_id, first), where first is the least (text_id, k1, k2) of the class."""
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce("text", F.lit(""))
    source = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    k1, k2 = text_keys(F.col("text"))
    keyed = source.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, d, n = counted(*words(text_bytes(b)).shingles(shingle))
            has = np.zeros(b.num_rows, bool)
            has[d] = True
            where = np.cumsum(has) - 1
            made = bands(bag_min_hash(h, where[d], n, int(has.sum()), BANDS * ROWS))
            flat = pa.array(made.reshape(-1), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["doc_id", "k1", "k2", "bands"])
        tidy()

    rows = staged(keyed.mapInArrow(signed, "doc_id long, k1 long, k2 long, bands array<long>"), "signatures")
    texts = rows.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands"))
    # A text is a node, called by its doc_id; where that is the least of several texts, by its hash.
    all_texts = texts = staged(texts, "all-texts")
    twice = staged(texts.groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1").select("text_id", F.lit(True).alias("twice")), "twice")
    every = texts.join(twice, "text_id", "left").withColumn("id", F.when(F.col("twice"), F.col("k1")).otherwise(F.col("text_id"))).drop("twice")
    texts = every.where(F.size("bands") > 0)
    buckets = texts.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    sizes = staged(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = buckets.join(sizes, "bucket")
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    several = staged(degree.join(texts, "id").select("id", "text_id", "k1", "k2", "degree", "bands"), "several", sizes)
    wanted = several.select("id", F.col("text_id").alias("doc_id"), "k1", "k2")
    bodies = keyed.join(wanted, ["doc_id", "k1", "k2"]).groupBy("id").agg(F.min("text").alias("text"))
    bodies = staged(bodies.withColumn("size", F.octet_length("text") + 64), "bodies")

    def centred(width: int) -> DataFrame:
        """Bucket, member, centre, for runs of `width` bands."""
        run = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.xxhash64(i, *[F.element_at("bands", (i + (j - 1)) % BANDS + 1) for j in range(width)]))
        inside = several.select("id", "degree", F.explode(run).alias("bucket"))
        centre = inside.groupBy("bucket").agg(F.max(F.struct("degree", F.bitwise_not("id").alias("id"))).alias("c"), F.count("*").alias("n")).where("n > 1")
        return inside.join(centre.select("bucket", F.bitwise_not("c.id").alias("centre")), "bucket").select("bucket", "id", "centre")

    stars = centred(1)
    for width in (2, 4):
        stars = stars.unionByName(centred(width))
    pairs = stars.where("id <> centre").select(F.col("centre").alias("near"), F.col("centre").alias("x"), F.col("id").alias("y")).distinct()
    pairs = staged(pairs, "stars")
    near = F.col("shared") >= threshold * (F.col("nx") + F.col("ny") - F.col("shared"))
    links = staged(verified(pairs, bodies, shingle).where(near).select(F.col("x").alias("u"), F.col("y").alias("v")), "links", pairs)
    part = components(links)

    # Centres whose members are still in several components, and those members.
    member = centred(1).select(F.col("centre").alias("c"), "id").distinct().join(part, F.col("id") == F.col("node"), "left").select("c", "id", F.coalesce("component", "id").alias("component"))
    member = staged(member, "members", part, several)
    mixed = staged(member.groupBy("c").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("c"), "mixed")
    member = staged(member.join(mixed, "c", "left_semi").where("c <> id"), "open-members", member, mixed)
    against = verified(member.select(F.col("c").alias("near"), F.col("c").alias("x"), F.col("id").alias("y")), bodies, shingle, threshold)
    against = against.select(F.col("x").alias("c"), F.col("y").alias("id"), "shared", F.col("ny").alias("n"), "inside", "beyond")
    against = staged(member.join(against, ["c", "id"]), "against", member)
    open_ = _open_pairs(against, threshold)
    more = verified(open_, bodies, shingle).where(near).select(F.col("x").alias("u"), F.col("y").alias("v"))
    both = staged(links.unionByName(more), "all-links", links, open_, against, bodies)
    classes = components(both)

    own = F.struct("text_id", "k1", "k2")
    linked = staged(every.select("id", "text_id", "k1", "k2").join(classes, F.col("id") == F.col("node")).select("k1", "k2", "text_id", "component"), "linked", classes, both)
    firsts = linked.groupBy("component").agg(F.min(own).alias("first"))
    first = linked.join(firsts, "component").select("k1", "k2", "first")
    named = every.select("k1", "k2", "text_id").join(first, ["k1", "k2"], "left").select("k1", "k2", "text_id", F.coalesce("first", own).alias("first"))
    return rows, staged(named, "named", linked, all_texts, twice)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
