"""Sharding by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.common import discard, narrowed, staged, table

SHARDS = 24
ROUNDS = 4
#: A hub larger than this share of a shard is placed as a whole beforehand; there can be few of them.
LARGE = 8
#: Labels may hold more than a shard by this share meanwhile, else few hubs could move where all rows are linked.
SLACK = 12
#: Rows of a numbering bucket, which one task holds.
BUCKET_ROWS = 20_000


def _shares(load: list[int], moves: dict[tuple[int, int], int], room: int) -> list[float]:
    """Which share of those who want to come each label takes, so that none has more than `room` in the end.

    Who leaves makes room for others, but only as far as the label it goes to takes it; so this is iterated.
    """
    shards = range(len(load))
    share = [1.0] * len(load)
    for _ in range(50):
        leave = [sum(n * share[t] for (s, t), n in moves.items() if s == k) for k in shards]
        come = [sum(n for (_, t), n in moves.items() if t == k) for k in shards]
        share = [min(1.0, max(0.0, room - load[k] + leave[k]) / come[k]) if come[k] else 0.0 for k in shards]
    return share


def propagate(links: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels of linked documents: links(doc_id, hub) -> doc_id, label, main (its hub), size (of that hub).

    A hub stands for documents that belong together, an edge being a hub of two. One with more than `room`
    documents, which no shard holds, is cut into parts that may fit, by a hash of the document. The largest
    hubs are placed first, each as a whole where most room is left. Then, in each round, a hub counts its
    members by label, a document adds up its hubs' counts, and would go where most neighbours are. Where more
    would come than a label has room for, counting what leaves it, whole hubs come or wait, by a hash of the hub.
    """
    # Staged, so that the join below has plain exchanges on both sides and a hot hub is split at run time.
    sizes = staged(links.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "hubs")
    parts = F.ceil(F.col("n") / F.lit(room))
    cut = links.join(sizes, "hub").select("doc_id", F.xxhash64("hub", F.when(F.col("n") > room, F.pmod(F.xxhash64("doc_id"), parts))).alias("hub"))
    links = staged(cut.distinct(), "links", sizes)
    sizes = staged(links.groupBy("hub").agg(F.count("*").alias("size")), "sizes")
    free, place = [room] * shards, {}
    for r in sizes.where(F.col("size") * LARGE > room).orderBy(F.desc("size"), "hub").limit(LARGE * shards).collect():
        place[r.hub] = max(range(shards), key=lambda s: (free[s], -s))
        free[place[r.hub]] -= r.size
    large = links.sparkSession.createDataFrame(list(place.items()), "hub long, fixed int")  # at most LARGE * shards rows
    member = links.join(sizes, "hub").join(F.broadcast(large), "hub", "left")
    first = F.min_by(F.struct("hub", "size", "fixed"), F.struct(F.col("fixed").isNull(), "hub")).alias("f")
    labels = member.groupBy("doc_id").agg(first).select("doc_id", F.col("f.hub").alias("main"), "f.size", "f.fixed")
    labels = labels.withColumn("label", F.coalesce("fixed", F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(shards)).cast("int")))
    labels = staged(labels, "labels", sizes)
    for k in range(rounds):
        votes = links.join(labels.select("doc_id", "label"), "doc_id").groupBy("hub", "label").agg(F.count("*").alias("n"))
        # A hub's counts travel as one row of at most `shards` entries.
        votes = votes.groupBy("hub").agg(F.collect_list(F.struct("label", "n")).alias("votes"))
        wanted = links.join(votes, "hub").select("doc_id", F.explode("votes").alias("v")).groupBy("doc_id", "v.label").agg(F.sum("v.n").alias("n"))
        wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("n", F.col("label").alias("to"))).alias("votes"))
        # Ties go by a hash of hub and label: alike for all members of a hub, and evenly over the labels.
        best = F.array_max(F.transform("votes", lambda v: F.struct(v.n, F.xxhash64("main", v.to, F.lit(k)).alias("tie"), v.to)))
        moves = labels.join(wanted, "doc_id", "left").withColumn("to", F.when(F.col("fixed").isNull(), best.to).otherwise(F.col("label"))).drop("votes")
        moves = staged(moves, "moves", labels)
        counts = {(r.label, r.to): r.n for r in moves.groupBy("label", "to").agg(F.count("*").alias("n")).collect()}  # at most shards * shards rows
        load = [sum(n for (s, _), n in counts.items() if s == k) for k in range(shards)]
        share = _shares(load, {m: n for m, n in counts.items() if m[0] != m[1]}, room + room // SLACK)
        lot = F.pmod(F.xxhash64("main", F.lit(f"lot{k}")), F.lit(1 << 20)) / F.lit(float(1 << 20))
        goes = (F.col("to") != F.col("label")) & (lot < F.element_at(F.array(*map(F.lit, share)), F.col("to") + 1))
        labels = staged(moves.withColumn("label", F.when(goes, F.col("to")).otherwise(F.col("label"))).drop("to"), "labels", moves)
    discard(links)
    return labels.select("doc_id", "label", "main", "size")


def shard(docs: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Put every row of `docs` into a shard: its columns, then shard (int) and slot (long, gapless from 0).

    Shards' row counts differ by one at most. Linked documents (links: doc_id, hub) are brought together
    by propagate(); other rows start where a hash of doc_id puts them and then fill the shards up: rows
    are numbered within their shard, linked ones first, and those beyond its quota go to the free slots of
    others. Numbers come from counts of buckets of bounded size, so no task sees a whole shard or hub.

    Repeated rows are placed each, rows of one doc_id by one label; a null doc_id has no links. Columns
    `shard` and `slot` of `docs` are replaced; others keep their names, whatever they are, and their values,
    however long. No rows: no rows.
    """
    total = docs.count()
    labels = propagate(narrowed(links, "doc_id", "hub"), shards, max(1, total // shards), rounds)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.col("doc_id").alias("doc"), F.struct(*[docs[c] for c in names]).alias("row"))
    base = rows.join(labels.withColumnRenamed("doc_id", "id"), F.col("doc") == F.col("id"), "left").drop("id")
    buckets = max(64, total // (shards * BUCKET_ROWS))
    base = base.withColumn("label", F.coalesce("label", F.pmod(F.xxhash64("doc", F.lit("label")), F.lit(shards)).cast("int")))
    base = base.withColumn("bucket", F.when(F.col("main").isNotNull(), F.pmod("main", F.lit(buckets))).otherwise(F.pmod(F.xxhash64("doc", F.lit("bucket")), F.lit(buckets)) + buckets))
    # A hub of more rows than a bucket has is numbered in several.
    base = base.withColumn("sub", F.when(F.col("size") > BUCKET_ROWS, F.pmod(F.xxhash64("doc", F.lit("sub")), F.ceil(F.col("size") / BUCKET_ROWS))).otherwise(0))
    base = staged(base, "placed")
    counts = base.groupBy("label", "bucket", "sub").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("label").orderBy("bucket", "sub").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("label", "bucket", "sub", F.coalesce(before, F.lit(0)).alias("before"))
    load = dict.fromkeys(range(shards), 0) | {r.label: r.n for r in base.groupBy("label").agg(F.count("*").alias("n")).collect()}
    fullest = sorted(load, key=lambda s: (-load[s], s))
    quota = {s: total // shards + (i < total % shards) for i, s in enumerate(fullest)}
    over, free, overs, frees = 0, 0, [], []
    for s in range(shards):
        overs.append(over)
        over += max(0, load[s] - quota[s])
        free += max(0, quota[s] - load[s])
        frees.append(free)
    array = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    at = lambda xs, i: F.element_at(array(xs), i.cast("int") + 1)
    order = W.partitionBy("label", "bucket", "sub").orderBy(F.col("main").asc_nulls_last(), F.xxhash64("doc"), "doc")
    label, rank = F.col("label"), F.col("before") + F.col("number") - 1
    most = at([quota[s] for s in range(shards)], label)
    ranked = base.withColumn("number", F.row_number().over(order)).join(counts, ["label", "bucket", "sub"]).withColumn("rank", rank)
    ranked = ranked.withColumn("left", F.when(F.col("rank") >= most, F.col("rank") - most + at(overs, label)))
    ranked = ranked.withColumn("to", F.when(F.col("left").isNotNull(), F.size(F.filter(array(frees), lambda c: c <= F.col("left")))))
    starts = [0, *frees[:-1]]
    slot = F.when(F.col("to").isNull(), F.col("rank")).otherwise(at([load[s] for s in range(shards)], F.col("to")) + F.col("left") - at(starts, F.col("to")))
    return ranked.select(*[F.col("row").getField(c).alias(c) for c in names], F.coalesce("to", label).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; equal texts are linked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    docs = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hub"))
    docs = staged(docs, "sizes")
    links = docs.where("doc_id is not null").select("doc_id", F.xxhash64("hub", "text_crc32", "size").alias("hub"))
    out = shard(docs.drop("hub"), links)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
