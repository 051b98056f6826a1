"""Headings: unique ids, nesting, tables of contents, captions nearby."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.ranking import kept, lasts_so_far, numbered_within


def heading_ids(headings: DataFrame) -> DataFrame:
    """headings(slug, ord, base) -> id: the base, and from the second on the base with a number."""
    n = F.row_number().over(W.partitionBy("slug", "base").orderBy("ord"))
    return headings.withColumn("id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))))


def _lasts(headings: DataFrame, deepest: int) -> tuple[DataFrame, list[Column]]:
    """Headings with the last one before of each level, and those columns."""
    names = [f"_last_{k}" for k in range(1, deepest + 1)]
    rows = lasts_so_far(headings, "slug", ["ord"], {n: F.when(F.col("level") == k, F.col("ord")) for k, n in enumerate(names, 1)}, strictly=True)
    return rows, [F.col(n) for n in names]


def nested(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """headings(slug, ord, level) -> parent: the last heading before with a smaller level."""
    rows, last = _lasts(headings, deepest)
    parent = F.greatest(*[F.when(F.col("level") > k, x) for k, x in enumerate(last, 1)])
    return rows.withColumn("parent", parent).select(*headings.columns, "parent")


def numbered_tree(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """headings(slug, ord, level), numbered from 1 by `ord` -> depth, last, left, right: where each stands in the tree.

    depth counts the headings that it is inside of; `last` is the last heading inside it. left and right number the
    beginnings and ends of all in one go, so that one is inside another if and only if its numbers are between the
    other's. They follow from place and depth: before a heading, all earlier ones have begun, and all have ended
    that it is not inside of. Nothing is walked from parent to child.
    """
    rows, last = _lasts(headings, deepest)
    none = F.lit(0).cast("long")
    depth = none
    for k, x in enumerate(last, 1):
        above = F.greatest(none, none, *[F.coalesce(y, none) for y in last[: k - 1]])
        depth = depth + F.when((F.col("level") > k) & (F.coalesce(x, none) > above), 1).otherwise(0)
    rows = rows.withColumn("depth", depth).select(*headings.columns, "depth")
    # The next heading that is not inside: of this level or a smaller one.
    names = {f"_next_{k}": F.when(F.col("level") <= k, F.col("ord")) for k in range(1, deepest + 1)}
    rows = lasts_so_far(rows, "slug", ["ord"], names, strictly=True, backwards=True)
    total = headings.groupBy(F.col("slug").alias("_slug")).agg(F.max("ord").alias("_total"))
    rows = rows.join(total, F.col("slug").eqNullSafe(F.col("_slug")))
    end = F.element_at(F.array(*names), F.col("level").cast("int"))
    rows = rows.withColumn("last", F.coalesce(end - 1, F.col("_total"))).withColumn("left", 2 * F.col("ord") - 1 - F.col("depth"))
    return rows.withColumn("right", F.col("left") + 2 * (F.col("last") - F.col("ord")) + 1).select(*headings.columns, "depth", "last", "left", "right")


#: Levels that a table of contents has, and the anchors that it gives.
CONTENTS, ANCHOR = 4, "reading-order-heading-%05d"


def contents(headings: DataFrame) -> DataFrame:
    """headings(slug, seq, path, level, label, anchor, unlisted) -> the entries of each work's table of contents.

    slug, ord (from 1), seq, level, label, anchor, target, added, and what numbered_tree() says. Headings of the first four
    levels count, in the order of `seq`, without those that are unlisted or blank. One without an anchor, or whose
    address an earlier one has, gets an anchor of its own (`added`), so that each address is listed once.
    """
    label = T.collapse(F.coalesce("label", F.lit("")))
    listed = headings.where(F.col("level").between(1, CONTENTS) & ~F.coalesce("unlisted", F.lit(False))).withColumn("label", label).where("label <> ''")
    rows = numbered_within(listed.select("slug", "seq", "path", F.col("level").cast("int").alias("level"), "label", F.nullif("anchor", F.lit("")).alias("anchor")), "slug", ["seq"], "ord")
    rows = kept(rows)
    first = rows.where("anchor is not null").groupBy("slug", "path", "anchor").agg(F.min("ord").alias("first"))
    rows = rows.join(first, ["slug", "path", "anchor"], "left").withColumn("added", ~F.col("ord").eqNullSafe(F.col("first")))
    anchor = F.when(F.col("added"), F.format_string(ANCHOR, "ord")).otherwise(F.col("anchor"))
    rows = rows.withColumn("anchor", anchor).withColumn("target", F.concat("path", F.lit("#"), "anchor"))
    return numbered_tree(rows.select("slug", "ord", "seq", "level", "label", "anchor", "target", "added"), CONTENTS)


def contents_markup(entries: DataFrame) -> DataFrame:
    """contents() -> slug, ord, markup: the list's lines in order, one an entry; put together they are one nested list.

    An entry opens a list if there are entries inside it; the last inside others closes theirs. Both follow from its
    depth and that of the next, so no row holds a list.
    """
    following = entries.select("slug", (F.col("ord") - 1).alias("ord"), F.col("depth").alias("then"))
    rows = entries.join(following, ["slug", "ord"], "left").withColumn("then", F.coalesce("then", F.lit(0)))
    link = F.concat(F.lit('<li><a href="'), T.escape_html(F.col("target")), F.lit('">'), T.escape_html(F.col("label")), F.lit("</a>"))
    close = F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), (F.col("depth") - F.col("then")).cast("int")))
    return rows.select("slug", "ord", F.concat(link, F.when(F.col("then") > F.col("depth"), F.lit('<ol class="toc">')).otherwise(close)).alias("markup"))


def captions(blocks: DataFrame, images: DataFrame, reach: int = 3) -> DataFrame:
    """images(slug, ord) -> the caption block (slug, ord, priority, text) nearby with the least priority * 10 + distance.

    A band join: a block is offered to the places within reach, so that the join is by equality.
    """
    near = blocks.where("priority is not null").select("slug", "priority", "text", F.col("ord").alias("at"), F.explode(F.sequence(F.col("ord") - reach, F.col("ord") + reach)).alias("ord"))
    met = images.select("slug", "ord").join(near, ["slug", "ord"]).where("at <> ord")
    cost = F.col("priority") * 10 + F.abs(F.col("at") - F.col("ord"))
    return met.groupBy("slug", "ord").agg(F.min_by("text", F.struct(cost, "at")).alias("caption"))
