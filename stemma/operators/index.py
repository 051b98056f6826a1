"""Index assembly: parts, page map, document map, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.ranking import kept, last_so_far, sums_before

PART_CHARS, PART_CHUNKS = 100_000, 1_200


def page_runs(chunks: DataFrame) -> DataFrame:
    """chunks(slug, ord, pdf_page, text) -> slug, run, first, chunks, chars, head: consecutive chunks of one page.

    Numbers run on from bucket to bucket of `ord`, so a work of any length is many tasks.
    """
    rows = chunks.select("slug", "ord", "pdf_page", F.length("text").cast("long").alias("n"))
    rows = last_so_far(rows, "slug", ["ord"], F.struct(F.col("pdf_page").alias("page")), "before", strictly=True)
    new = F.col("before").isNull() | ~F.col("pdf_page").eqNullSafe(F.col("before.page"))
    rows = sums_before(kept(rows.select("slug", "ord", "n", new.cast("long").alias("new"))), "slug", ["ord"], F.col("new"), "run")
    # A part may close before the run only by what it holds then, and within a run only its first chunk counts.
    return rows.groupBy("slug", (F.col("run") + F.col("new")).alias("run")).agg(F.min("ord").alias("first"), F.count("*").alias("chunks"), F.sum("n").alias("chars"), F.min_by("n", "ord").alias("head"))


def _next_at(runs: DataFrame, value: str, limit: F.Column, at_limit: bool) -> DataFrame:
    """slug, run, to: the first run whose `value`, which does not fall, is beyond `limit` (or at it), for each run.

    A range search without a range join: limits and values are put in one order, and each limit takes the next run.
    """
    of = lambda v, kind, run: F.struct(v.alias("v"), F.lit(kind).alias("kind"), run.cast("long").alias("key"), F.col("run").alias("run"))
    both = F.array(of(F.col(value), 1 if at_limit else 0, F.col("run")), of(limit, 0 if at_limit else 1, F.lit(None)))
    rows = runs.select("slug", F.explode(both).alias("x")).select("slug", "x.*")
    rows = last_so_far(rows, "slug", ["v", "kind", "run"], F.col("key"), "to", backwards=True)
    return rows.where("key is null and to is not null").select("slug", "run", "to")


def reached(steps: DataFrame, first: DataFrame) -> DataFrame:
    """steps(slug, run, to) and first(slug, run) -> slug, run, n: what is reached from the first by n steps, for all n.

    Pointer doubling: with the pointers of 2^k steps, those reached by fewer than 2^k steps reach as many more, so
    the number of rounds is the logarithm of the longest way. Pointers only lead ahead, so it ends.
    """
    out, size = kept(first.select("slug", "run", F.lit(0).cast("long").alias("n"))), 1
    steps = kept(steps.select("slug", "run", "to"))
    while True:
        more = out.join(steps, ["slug", "run"]).select("slug", F.col("to").alias("run"), (F.col("n") + size).alias("n"))
        more = kept(more)
        if not more.limit(1).count():
            return out
        out = kept(out.unionByName(more))
        far = steps.select("slug", F.col("run").alias("to"), F.col("to").alias("beyond"))
        steps = kept(steps.join(far, ["slug", "to"]).select("slug", "run", F.col("beyond").alias("to")))
        size *= 2


def parts(chunks: DataFrame, most_chars: int = PART_CHARS, most_chunks: int = PART_CHUNKS) -> DataFrame:
    """slug, part, first (ord), chunks, chars: pages packed greedily, none split, so limits are soft.

    A part ends before the first page at whose first chunk it has too many characters, or at which it has enough
    chunks. Sums of what comes before turn that into a search, so each page knows where a part that begins with it
    would end; which pages do begin a part is what the first one reaches.
    """
    runs = kept(page_runs(chunks))
    runs = sums_before(runs, "slug", ["run"], F.col("chars"), "chars_before")
    runs = kept(sums_before(runs, "slug", ["run"], F.col("chunks"), "chunks_before").withColumn("close", F.col("chars_before") + F.col("head")))
    by_chars = _next_at(runs, "close", F.col("chars_before") + most_chars, False)
    by_chunks = _next_at(runs, "chunks_before", F.col("chunks_before") + most_chunks, True)
    steps = by_chars.select("slug", "run", F.greatest("to", F.col("run") + 1).alias("to"))  # a part has one page at least
    steps = steps.unionByName(by_chunks).groupBy("slug", "run").agg(F.min("to").alias("to"))
    known = runs.select("slug", F.col("run").alias("to"), F.col("chars_before").alias("chars_to"), F.col("chunks_before").alias("chunks_to"))
    ends = steps.join(known, ["slug", "to"])  # without what would be beyond the last run
    begins = reached(ends, runs.where("run = 1"))
    total = runs.groupBy("slug").agg(F.sum("chars").alias("all_chars"), F.sum("chunks").alias("all_chunks"))
    out = begins.join(runs.select("slug", "run", "first", "chars_before", "chunks_before"), ["slug", "run"]).join(ends, ["slug", "run"], "left").join(total, "slug")
    held = lambda k: F.coalesce(f"{k}_to", f"all_{k}") - F.col(f"{k}_before")
    return out.select("slug", F.col("n").cast("int").alias("part"), "first", held("chunks").alias("chunks"), held("chars").alias("chars"))


def page_map(chunks: DataFrame) -> DataFrame:
    """id -> location, page and order, a row a chunk."""
    return chunks.select("slug", F.format_string("b%05d", "ord").alias("id"), "original_page", "pdf_page", (F.col("ord") - 1).alias("order"))


def document_url(slug: str, part: str) -> F.Column:
    """The address of a part, whose number has four digits, and as many more as it needs."""
    return F.concat(F.lit("/__fulltext/"), F.col(slug), F.lit("/part-"), F.format_string("%04d", part), F.lit("/"))


def totals(chunks: DataFrame, made: DataFrame, works: DataFrame) -> DataFrame:
    """One row: works, books, papers, parts, chunks, characters."""
    a = works.agg(F.count("*").alias("works"), F.count_if(F.col("record_class") == "major-work").alias("books"))
    b = made.agg(F.count("*").alias("parts"))
    c = chunks.agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return a.crossJoin(b).crossJoin(c).select("works", "books", (F.col("works") - F.col("books")).alias("papers"), "parts", "chunks", "chars")
