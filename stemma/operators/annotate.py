"""Source locations carried through paragraphs, and cutting to searchable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import markers as M
from stemma.functions import text as T
from stemma.operators.ranking import kept, last_so_far, numbered_within

TARGET, LONGEST = 170, 190


def trimmed(paragraphs: DataFrame, marker_fallback: bool = True) -> DataFrame:
    """Paragraphs from where the work begins: after its heading, from its front matter, or from its first marker.

    What the first of each are is a count a work, of however many paragraphs; no window holds one.
    """
    at = lambda c, name: F.min(F.when(c, F.col("para_no"))).alias(name)
    firsts = paragraphs.groupBy("slug").agg(at(F.col("text").rlike(M.HEADING), "h"), at(F.col("text").rlike(M.FRONT), "f"), at(M.first_concrete(F.col("text")).isNotNull(), "m"))
    no_marker = F.col("m").isNull()
    start = F.when(F.col("h").isNotNull() & (no_marker | (F.col("h") <= F.col("m"))), F.col("h") + 1).when(F.col("f").isNotNull() & (no_marker | (F.col("f") <= F.col("m"))), F.col("f"))
    start = F.coalesce(start, F.col("m") if marker_fallback else F.lit(None).cast("int"), F.lit(0))
    firsts = firsts.select(F.col("slug").alias("_slug"), start.alias("_start"))
    return paragraphs.join(firsts, F.col("slug").eqNullSafe(F.col("_slug"))).where(F.col("para_no") >= F.col("_start")).select("slug", "para_no", "text")


def annotated(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(slug, para_no, text) -> slug, seq, original_page, text.

    A paragraph falls apart at markers that name a place: what stands before one keeps the place before.
    The place of a row is the last marker at or before it, within its work.
    """
    all_ = M.markers(F.col("text"))  # with placeholders, which name nothing and leave the text
    pieces = F.split(F.col("text"), M.MARKER, -1)
    rows = paragraphs.withColumn("alone", M.is_standalone(F.col("text"))).withColumn("zip", F.arrays_zip(pieces.alias("piece"), all_.alias("marker")))
    rows = rows.select("slug", "para_no", "alone", F.col("text").alias("whole"), F.posexplode("zip").alias("i", "z")).select("slug", "para_no", "alone", "whole", "i", "z.piece", "z.marker")
    rows = rows.where("not alone or i = 0")
    rows = rows.withColumn("name", M.named(F.col("marker")))
    kind = F.when(F.col("marker").isNull(), "end").when(F.col("name").rlike(M.PLACEHOLDER), "drop").when(M.names_place(F.col("name")), "place").otherwise("keep")
    rows = rows.withColumn("kind", kind)
    by = W.partitionBy("slug", "para_no").orderBy("i")
    rows = rows.withColumn("part", F.coalesce(F.sum((F.col("kind") == "place").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.concat(F.col("piece"), F.when(F.col("kind") == "keep", F.col("marker")).otherwise(""))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", own.alias("own")))), lambda x: x.own), "")
    parts = rows.groupBy("slug", "para_no", "part").agg(said.alias("said"), F.max(F.when(F.col("kind") == "place", F.col("marker"))).alias("marker"), F.max("alone").alias("alone"), F.max("whole").alias("whole"))
    alone = T.collapse(F.col("whole"))
    # (step, place that begins here, text)
    row = lambda step, place, value: F.struct(F.lit(step).alias("step"), place.alias("place"), value.alias("text"))
    none = F.lit(None).cast("string")
    note = M.note(F.col("marker"))
    parts = parts.withColumn("clean", T.clean_inline(F.regexp_replace("said", M.FLAGS + r"\x{E000}", "")))
    emitted = F.when(F.col("alone"), F.array(row(0, alone, alone))).otherwise(F.array(row(0, none, F.nullif(F.col("clean"), F.lit(""))), row(1, M.label(F.col("marker")), F.concat(F.lit("訳注　"), note))))
    out = parts.select("slug", "para_no", "part", F.explode(emitted).alias("e")).select("slug", "para_no", "part", "e.*")
    order = ["para_no", "part", "step"]
    out = last_so_far(kept(out), "slug", order, F.col("place"), "place")
    out = kept(out.withColumn("original_page", F.coalesce("place", F.lit(M.DEFAULT_LOCATION))).where("text is not null"))
    return numbered_within(out, "slug", order, "seq").select("slug", "seq", "original_page", "text")


def packed(pieces: Column, target: int = TARGET) -> Column:
    """Pieces put together while they fit: a fold that keeps what is done and what is open, with its length."""
    sized = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.length(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, piece: Column) -> Column:
        fits = (F.size(state.open) == 0) | (state.n + piece.n <= target)
        done = F.when(fits, state.done).otherwise(F.concat(state.done, F.array(F.array_join(state.open, ""))))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state.open, F.array(piece.p))).otherwise(F.array(piece.p)).alias("open"), (F.when(fits, state.n).otherwise(0) + piece.n).alias("n"))

    out = F.aggregate(sized, start, add, lambda s: F.when(F.size(s.open) == 0, s.done).otherwise(F.concat(s.done, F.array(F.array_join(s.open, "")))))
    return F.transform(out, T.collapse)


def chunks(rows: DataFrame, target: int = TARGET) -> DataFrame:
    """annotated rows -> slug, ord (from 1), id, original_page, text. Chunks never cross rows; tiny ones go."""
    pieces = F.flatten(F.transform(T.sentences(F.col("text")), lambda s: T.pieces(s, LONGEST)))
    out = rows.select("slug", "seq", "original_page", F.posexplode(packed(pieces, target)).alias("i", "text"))
    out = kept(out.where(F.length(T.matchable(F.col("text"))) >= 2))
    return numbered_within(out, "slug", ["seq", "i"], "ord").select("slug", "ord", T.block_id(F.col("ord")).alias("id"), "original_page", "text")


def carried(events: DataFrame, value: Column, by: str, order: list[str], default: str) -> DataFrame:
    """Add `location`: the last non-null value at or before a row, else the default. order[0] is an integer."""
    return last_so_far(events, by, order, value, "location").withColumn("location", F.coalesce("location", F.lit(default)))


def footnote_places(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """notes(slug, member, href, text) whose back-links lead to anchors(slug, member, fragment, original_page).

    A note gets the place of the anchor that its link leads to, and shows it in front of its text. Links
    are resolved within the archive; a note without an anchor, or one before any marker, stays as it is.
    """
    target = T.archive_path(F.col("member"), F.col("href"))
    asked = notes.withColumn("target", target).withColumn("fragment", F.regexp_extract("href", "#(.*)$", 1))
    there = anchors.select("slug", F.col("member").alias("target"), "fragment", "original_page").dropDuplicates(["slug", "target", "fragment"])
    out = asked.join(there, ["slug", "target", "fragment"], "left")
    shown = F.when(F.coalesce(F.col("original_page"), F.lit(M.DEFAULT_LOCATION)) != M.DEFAULT_LOCATION, F.concat(F.lit("〔"), "original_page", F.lit("〕"), "text"))
    return out.withColumn("text", F.coalesce(shown, "text")).drop("target", "fragment")
