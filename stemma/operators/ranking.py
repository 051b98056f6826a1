"""Ranks, running sums and carried values without one task that holds a whole table or a whole work.

Rows are dealt to ranges of the order; what a range needs to know of those before it follows from one small row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of an integer order column that share a bucket.
BUCKET = 65_536
_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """A table that several passes read, computed once: reliably checkpointed where there is a folder for that, else persisted.

    release() lets go of what was persisted; Spark deletes checkpoints with the tables that read them where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    if context.getCheckpointDir():
        return df.checkpoint()
    _KEPT.append(df.persist())
    return _KEPT[-1]


def release() -> None:
    """Let go of all that kept() has persisted; what is still read of it is computed again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the number (from 1) of each row in an order, of any types, that no two rows share.

    Rows are dealt by ranges of the whole order, so many rows of one first key are several ranges, and sorted in
    each. A row's place in its range and the counts of the ranges before give its number: one shuffle, no window
    over rows, and a table of one row a range, of which Spark has as many as the rows need.
    """
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = kept(rows)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # a row a range
    return rows.withColumn("_part", part).join(offsets, "_part").select(*df.columns, (F.col("_before") + place + 1).alias(name))


def numbered(df: DataFrame, key: Column, ties: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """Add the rank (from 1) by `key`, nulls last either way, and then by `ties`."""
    return ranked(df, key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(ties).asc(), name=name)


def _bucketed(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.withColumn("_bucket", F.floor(F.col(order[0]) / BUCKET))


def sums_before(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of `value` over the rows of the same `by` that come before. order[0] is an integer column."""
    rows = _bucketed(rows, order).withColumn("_value", value)
    buckets = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    total = rows.groupBy(by, "_bucket").agg(F.sum("_value").alias("_n")).select(by, "_bucket", F.coalesce(F.sum("_n").over(buckets), F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    joined = rows.join(total.withColumnsRenamed({by: "_by", "_bucket": "_b"}), F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_by", "_b", "_bucket", "_before", "_inside", "_value")


def numbered_within(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Add the number (from 1) of each row among those of the same `by`."""
    return sums_before(rows, by, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def last_so_far(rows: DataFrame, by: str, order: list[str], value: Column, name: str, strictly: bool = False, backwards: bool = False) -> DataFrame:
    """Add the last non-null `value` at or before each row, among those of the same `by`.

    strictly: before it only. backwards: the first at or after it (strictly: after it).
    """
    return lasts_so_far(rows, by, order, {name: value}, strictly, backwards)


def lasts_so_far(rows: DataFrame, by: str, order: list[str], values: dict[str, Column], strictly: bool = False, backwards: bool = False) -> DataFrame:
    """last_so_far() of several values in one go. order[0] is an integer column."""
    turned = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    rows = _bucketed(rows, order).withColumns({f"_value_{k}": v for k, v in values.items()})
    upto = W.partitionBy(by, "_bucket").orderBy(*turned).rowsBetween(W.unboundedPreceding, -1 if strictly else W.currentRow)
    inside = rows.withColumns({f"_inside_{k}": F.last(f"_value_{k}", True).over(upto) for k in values})
    last = lambda k: (F.min_by if backwards else F.max_by)(f"_value_{k}", F.when(F.col(f"_value_{k}").isNotNull(), F.struct(*order)))
    every = rows.groupBy(by, "_bucket").agg(*[last(k).alias(f"_last_{k}") for k in values])
    buckets = W.partitionBy(by).orderBy(F.col("_bucket").desc() if backwards else F.col("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    before = every.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), *[F.last(f"_last_{k}", True).over(buckets).alias(f"_carried_{k}") for k in values])
    joined = inside.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    found = joined.withColumns({k: F.coalesce(f"_inside_{k}", f"_carried_{k}") for k in values})
    return found.drop("_by", "_b", "_bucket", *[f"_{part}_{k}" for k in values for part in ("value", "inside", "carried")])
