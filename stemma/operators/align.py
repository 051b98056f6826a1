"""Alignment of chunks with physical pages: exact, by fingerprint, fuzzy, by label, inherited."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import markers as M
from stemma.functions import text as T
from stemma.operators.ranking import kept, last_so_far, sums_before

METHODS = ("exact", "fingerprint", "fuzzy", "sourcePage", "inherited", "unmapped")
VERIFIED = ("exact", "fingerprint", "fuzzy", "sourcePage")
SEED, LONG, SHORT, FUZZY = 12, 18, 12, 0.24
PROBE, NEAR_PAGES, MIN_RATE = 16, 2, 0.9
#: Characters of a block of a work, and of the next one that a block carries, so that matches over its end are seen.
BLOCK, TAIL = 1024, 512
#: Long pages are cut to pieces of this size first, as each cut counts characters from the start.
PIECE = 65_536
#: Pages of a range by which short rows meet them.
PAGE_RANGE = 64


#: A side of a join with exploded pages is broadcast up to so many bytes; how many rows it has is looked up first.
BROADCAST_BYTES = 32 << 20
#: What a row of those sides has at most, about: a hash; a place or a key with two hashes.
GRAM_BYTES, ASKED_BYTES = 64, 128
#: Characters of a group of pages, and grams of a group of rows, that are compared together.
GROUP_CHARS, GROUP_GRAMS = 4 << 20, 1 << 20


def _met(there: DataFrame, asked: DataFrame, keys: list[str], row_bytes: int) -> DataFrame:
    """Join exploded page rows with what is asked for: broadcast if that is checked to be small, by a merge else.

    The pages' side is never broadcast; its size after exploding is far from what a planner expects.
    """
    most = BROADCAST_BYTES // row_bytes
    few = asked.limit(most + 1).count() <= most
    return there.join(F.broadcast(asked) if few else asked.hint("merge"), keys)


def page_starts(pages: DataFrame) -> DataFrame:
    """pages(slug, page_no, text) -> slug, page_no, txt (for matching), start (0-based place in the work)."""
    rows = kept(pages.select("slug", "page_no", T.matchable(F.coalesce("text", F.lit(""))).alias("txt")))
    starts = sums_before(rows.select("slug", "page_no", F.length("txt").alias("n")), "slug", ["page_no"], F.col("n"), "start")
    return rows.join(starts.select("slug", "page_no", "start"), ["slug", "page_no"])


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """rows(start, txt) cut at places that are multiples of `size`, with `b`, the number of the range."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.length("txt") - 1) / size)
    rows = rows.where(F.length("txt") > 0).withColumn("b", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("b") * size)
    part = F.substring("txt", (begin - F.col("start") + 1).cast("int"), ((F.col("b") + 1) * size - begin).cast("int"))
    return rows.select("slug", "page_no", "b", begin.alias("start"), part.alias("txt"))


def blocks(pages: DataFrame) -> DataFrame:
    """page_starts() -> slug, b, text, marks: works in blocks of BLOCK characters, whatever their pages are.

    A block carries the first TAIL characters of the next; marks are the pages (start, page_no) that are in it.
    Texts are moved once, by block, so neither rows nor tasks grow with a work or a page.
    """
    parts = _cut(_cut(pages, PIECE), BLOCK)
    reach = F.col("b") * BLOCK + TAIL - F.col("start")
    row = lambda b, txt, page: F.struct(b.alias("b"), F.col("start"), txt.alias("txt"), page.alias("page_no"))
    own = row(F.col("b"), F.col("txt"), F.col("page_no"))
    tail = row(F.col("b") - 1, F.substring(F.col("txt"), F.lit(1), reach.cast("int")), F.lit(None).cast(pages.schema["page_no"].dataType))
    rows = parts.select("slug", F.explode(F.when((reach > 0) & (F.col("b") > 0), F.array(own, tail)).otherwise(F.array(own))).alias("x")).select("slug", "x.*")
    inside = F.array_sort(F.collect_list(F.struct("start", "txt", "page_no")))
    made = rows.groupBy("slug", "b").agg(inside.alias("parts"))
    marks = F.transform(F.filter("parts", lambda p: p.page_no.isNotNull()), lambda p: F.struct(p.start, p.page_no))
    return made.select("slug", "b", F.array_join(F.transform("parts", lambda p: p.txt), "").alias("text"), marks.alias("marks")).where(F.size("marks") > 0)


def occurrences(needles: DataFrame, hay: DataFrame, shortest: int) -> DataFrame:
    """needles(slug, key, needle) in blocks(): slug, key, at (0-based place in the work), page_no.

    Needles without a slug are looked for in all works. One longer than TAIL is looked for piece by piece; it is
    where all its pieces are, at their distances. Occurrences may overlap and may run over page ends; they belong
    to the page where they begin.
    """
    n = F.length("needle")
    offsets = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(n / TAIL).cast("int") - 1), lambda k: k * TAIL), F.array(n - TAIL)))
    cut = needles.withColumn("offsets", F.when(n > TAIL, offsets).otherwise(F.array(F.lit(0)))).withColumn("o", F.explode("offsets"))
    key = F.struct("key", F.col("o").alias("offset"), F.size("offsets").alias("pieces"))
    cut = cut.select(*_slug(needles), key.alias("key"), F.substring("needle", F.col("o") + 1, F.lit(TAIL)).alias("needle"))
    place = F.col("at") - F.col("key.offset")
    met = _short(cut, hay, shortest).groupBy("slug", F.col("key.key").alias("key"), place.alias("at")).agg(F.count("*").alias("n"), F.min("key.pieces").alias("pieces"), F.min_by("page_no", "key.offset").alias("page_no"))
    return met.where("n = pieces or pieces = 1").select("slug", "key", "at", "page_no")


def _short(needles: DataFrame, hay: DataFrame, shortest: int) -> DataFrame:
    """occurrences() of needles up to TAIL characters.

    Seed and verify: blocks give a seed at every k-th place, needles at their first k, so each occurrence of a
    needle of `shortest` characters or more meets in an equality join. Seeds travel as hashes, without texts, and those
    that no needle has fall first; only places where a needle may begin meet their block again, which has a text once. There
    needles are compared as hashes, and then in full.
    """
    stride, own = shortest - SEED + 1, _slug(needles)
    seed = lambda text, at: F.xxhash64(*own, F.substring(text, at, F.lit(SEED))).alias("seed")
    size = F.least(F.lit(BLOCK), F.length("text"))
    there = hay.select("slug", "b", "text", F.explode(F.sequence(F.lit(1), size + (stride - 1), F.lit(stride))).alias("q"))
    there = there.where(F.col("q") <= F.length("text") - (SEED - 1)).select("slug", "b", "q", seed(F.col("text"), F.col("q")))
    asked = needles.select(*own, "key", "needle", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("o"))
    asked = kept(asked.select(*own, "key", "o", F.length("needle").alias("n"), F.xxhash64("needle").alias("h"), seed(F.col("needle"), F.col("o") + 1)))
    there = _met(there, asked.select("seed").distinct(), ["seed"], GRAM_BYTES)
    begin = _met(there, asked, [*own, "seed"], ASKED_BYTES).withColumn("s", F.col("q") - F.col("o")).where((F.col("s") >= 1) & (F.col("s") <= BLOCK))
    begin = kept(begin.select("slug", "b", "s", "key", "n", "h"))
    here = _met(hay, begin, ["slug", "b"], ASKED_BYTES).withColumn("piece", F.substring("text", F.col("s"), F.col("n"))).where(F.xxhash64("piece") == F.col("h"))
    at = F.col("b") * BLOCK + F.col("s") - 1
    page = F.element_at(F.filter("marks", lambda m: m.start <= at), -1).page_no
    here = here.select("slug", "key", at.alias("at"), page.alias("page_no"), F.col("piece").alias("needle"))
    return here.join(needles, [*own, "key", "needle"]).select("slug", "key", "at", "page_no").distinct()


def _slug(df: DataFrame) -> list[str]:
    return ["slug"] if "slug" in df.columns else []


def all_hits(chunks: DataFrame, hay: DataFrame) -> DataFrame:
    """chunks(slug, ord, norm) in blocks() -> slug, ord, at, page_no: everywhere that a chunk is in its work."""
    keyed = chunks.select(*_slug(chunks), F.col("ord").alias("key"), F.col("norm").alias("needle"))
    long_ = occurrences(keyed.where(F.length("needle") >= LONG), hay, LONG)
    short = occurrences(keyed.where(F.length("needle").between(SHORT, LONG - 1)), hay, SHORT)
    return long_.unionByName(short).withColumnRenamed("key", "ord")


def exact(chunks: DataFrame, hay: DataFrame) -> DataFrame:
    """chunks(slug, ord, norm) in blocks() -> slug, ord, hits, page_no: how often a chunk is in its work, and where first."""
    return counted(all_hits(chunks, hay))


def counted(hits: DataFrame) -> DataFrame:
    return hits.groupBy("slug", "ord").agg(F.count("*").alias("hits"), F.min_by("page_no", "at").alias("page_no"))


def within(open_: DataFrame, hits: DataFrame, pages: DataFrame) -> DataFrame:
    """open_(slug, ord, norm, target, from_page, to_page) -> slug, ord, inside_page: the page in range nearest the target that holds a row whole.

    Rows of SHORT characters or more are where all_hits() has found them. Shorter ones are looked for in the pages of their
    range, which meet them by ranges of PAGE_RANGE pages; no row carries more than itself, and a page goes to a range once.
    """
    ends = pages.select("slug", "page_no", (F.col("start") + F.length("txt")).alias("end"))
    known = open_.where(F.length("norm") >= SHORT).join(hits, ["slug", "ord"]).join(ends, ["slug", "page_no"]).where(F.col("at") + F.length("norm") <= F.col("end"))
    known = known.select("slug", "ord", "target", "from_page", "to_page", "page_no")
    part = lambda c: F.floor(F.col(c) / PAGE_RANGE)
    asked = open_.where(F.length("norm") < SHORT).select("slug", "ord", "norm", "target", "from_page", "to_page", F.explode(F.sequence(part("from_page"), part("to_page"))).alias("range"))
    there = pages.select("slug", part("page_no").alias("range"), "page_no", "txt")
    seen = asked.join(there, ["slug", "range"]).where(F.contains("txt", "norm")).select(known.columns)
    near = F.struct(F.abs(F.col("page_no") - F.col("target")), "page_no")
    found = known.unionByName(seen).where(F.col("page_no").between(F.col("from_page"), F.col("to_page")))
    return found.groupBy("slug", "ord").agg(F.min_by("page_no", near).alias("inside_page"))


def probes(norm: Column) -> Column:
    """Offsets and pieces of a chunk by which it may be found when it is not there as a whole."""
    n = F.length(norm)
    width = F.least(F.lit(48), F.greatest(F.lit(20), F.floor(n / 2).cast("int")))
    offsets = F.array_distinct(F.array(F.lit(0), F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.greatest(F.lit(0), n - width)))
    pieces = F.transform(offsets, lambda o: F.struct(o.alias("offset"), F.substring(norm, o + 1, width).alias("piece")))
    return F.filter(pieces, lambda p: F.length(p.piece) >= PROBE)


def fingerprints(chunks: DataFrame, hay: DataFrame) -> DataFrame:
    """chunks(slug, ord, norm) in blocks() -> slug, ord, at, page_no: the least place that a probe's first occurrence implies."""
    each = chunks.select(*_slug(chunks), "ord", F.explode(probes(F.col("norm"))).alias("p")).select(*_slug(chunks), F.struct("ord", "p.offset").alias("key"), F.col("p.piece").alias("needle"))
    first = occurrences(each, hay, PROBE).groupBy("slug", "key").agg(F.min("at").alias("at"))
    place = first.groupBy("slug", F.col("key.ord").alias("ord")).agg(F.min(F.greatest(F.lit(0), F.col("at") - F.col("key.offset"))).alias("at"))
    return at_page(place, hay)


def at_page(places: DataFrame, hay: DataFrame) -> DataFrame:
    """As-of join: the last page that starts at or before a place(slug, ord, at). Both sides meet by block."""
    asked = places.withColumn("b", F.floor(F.col("at") / BLOCK))
    page = F.element_at(F.filter("marks", lambda m: m.start <= F.col("at")), -1).page_no
    return asked.join(hay.select("slug", "b", "marks"), ["slug", "b"]).select("slug", "ord", "at", page.alias("page_no"))


def neighbours(rows: DataFrame, anchor: Column, last_page: Column) -> DataFrame:
    """Add the anchors before and after each row (prev_*, next_*), the page in between (target), and the range to search."""
    keep = F.when(anchor, F.struct(F.col("ord").alias("ord"), F.col("page_no").alias("page"), F.col("original_page").alias("label")))
    rows = last_so_far(rows, "slug", ["ord"], keep, "prev", strictly=True)
    rows = last_so_far(rows, "slug", ["ord"], keep, "next", strictly=True, backwards=True)
    p, n = F.col("prev.page"), F.col("next.page")
    between = p + (n - p) * (F.col("ord") - F.col("prev.ord")) / (F.col("next.ord") - F.col("prev.ord"))
    low, high = F.coalesce(p, F.lit(1)), F.coalesce(n, last_page)
    return (
        rows.withColumn("target", F.coalesce(between, p.cast("double"), n.cast("double"), F.lit(1.0)))
        .withColumn("from_page", F.greatest(F.lit(1), F.least(low, high) - NEAR_PAGES))
        .withColumn("to_page", F.least(last_page, F.greatest(low, high) + NEAR_PAGES))
    )


WIDTH = 6
_FACTORS = np.random.default_rng(6).integers(1, 1 << 63, WIDTH, np.uint64) | np.uint64(1)


def _hashed(text: str) -> np.ndarray:
    """Hashes of the distinct runs of WIDTH characters of a text, sorted; a shorter text is one run, an empty one has none."""
    if not text:
        return np.zeros(0, np.uint64)
    at = np.frombuffer(text.ljust(WIDTH, "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(at) - WIDTH + 1
    out = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        out += at[k : k + n] * _FACTORS[k]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _compared(pages: pa.Table, rows: pa.Table, threshold: float, schema: pa.Schema) -> pa.Table:
    """Of some pages and rows of one work: for each row its best page among these, if its score is enough."""
    own = [_hashed(x) for x in rows.column("norm").to_pylist()]
    total = np.array([len(x) for x in own], np.int64)
    row = np.repeat(np.arange(len(own)), total)
    grams = np.concatenate(own) if own else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    low, high = (rows.column(c).to_numpy() for c in ("from_page", "to_page"))
    target = rows.column("target").to_numpy()
    best: dict[int, tuple[float, float, int]] = {}
    for page, text in zip(pages.column("page_no").to_pylist(), pages.column("txt").to_pylist(), strict=True) if len(grams) else ():
        there = _hashed(text)
        at = np.minimum(np.searchsorted(there, grams), max(len(there) - 1, 0))
        met = np.bincount(row[there[at] == grams], minlength=len(own)) if len(there) else np.zeros(len(own), np.int64)
        score = met / np.maximum(total, 1)
        for i in np.flatnonzero((score >= threshold) & (met > 0) & (low <= page) & (page <= high)).tolist():
            found = (-float(score[i]), abs(page - float(target[i])), page)
            best[i] = min(best.get(i, found), found)
    chosen = sorted(best)
    made = {"slug": pages.column("slug").to_pylist()[:1] * len(chosen), "ord": rows.column("ord").take(pa.array(chosen, pa.int64())), "page_no": [best[i][2] for i in chosen], "score": [-best[i][0] for i in chosen], "far": [best[i][1] for i in chosen]}
    return pa.table({f.name: pa.array(made[f.name], f.type) if isinstance(made[f.name], list) else made[f.name] for f in schema}, schema=schema)


def fuzzy(rows: DataFrame, pages: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """rows(slug, ord, norm, target, from_page, to_page) and page_starts() -> slug, ord, page_no, score: best page by 6-gram containment.

    Ties go to the page nearest the target, then to the lower one. Rows without a slug are compared with all works.

    Texts are compared where they meet, not gram by gram: a work's pages are cut into groups of GROUP_CHARS characters, and
    rows go to the groups that their range touches; where those have more than GROUP_GRAMS grams, they are several groups
    with the same pages. A group gives a row for each of its rows at most.
    """
    own = _slug(rows)
    pages = pages.where(F.length("txt") > 0).select("slug", "page_no", "txt", F.floor(F.col("start") / GROUP_CHARS).alias("g"))
    groups = kept(pages.groupBy("slug", "g").agg(F.min("page_no").alias("low"), F.max("page_no").alias("high")))
    asked = rows.where(F.length("norm") > 0).select(*own, "ord", "norm", F.col("target").cast("double").alias("target"), F.col("from_page").cast("long").alias("from_page"), F.col("to_page").cast("long").alias("to_page"))
    met = asked.join(groups, "slug") if own else asked.crossJoin(groups)
    met = met.where((F.col("low") <= F.col("to_page")) & (F.col("from_page") <= F.col("high"))).drop("low", "high")
    parts = kept(met.groupBy("slug", "g").agg(F.ceil(F.sum(F.length("norm")) / GROUP_GRAMS).alias("parts")))
    dealt = met.join(parts, ["slug", "g"]).withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts"))).drop("parts")
    there = pages.join(parts, ["slug", "g"]).select("slug", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "page_no", "txt")
    kinds = {"slug": "string", "ord": rows.schema["ord"].dataType.simpleString(), "page_no": pages.schema["page_no"].dataType.simpleString(), "score": "double", "far": "double"}
    schema = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[k]) for c, k in kinds.items()])
    by = ["slug", "g", "part"]
    dealt = dealt.withColumnsRenamed({c: f"_{c}" for c in by})
    found = there.groupBy(*by).cogroup(dealt.groupBy(*[f"_{c}" for c in by])).applyInArrow(lambda p, r: _compared(p, r, threshold, schema), ", ".join(f"{c} {k}" for c, k in kinds.items()))
    best = W.partitionBy("slug", "ord").orderBy(F.desc("score"), "far", "page_no")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("slug", "ord", "page_no", "score")


def page_labels(pages: DataFrame) -> DataFrame:
    """pages(slug, page_no, text) -> slug, page_no, labels: distinct markers in order, then page lines."""
    marks = F.transform(M.concrete(F.col("text")), lambda x: x["name"])
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n", -1), T.collapse), lambda x: x.rlike(M.STANDALONE))
    return pages.select("slug", "page_no", F.array_distinct(F.concat(marks, lines)).alias("labels"))


def unique_labels(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """chunks(slug, ord, original_page) and page_labels() -> slug, ord, page_no where a chunk's labels name one page only."""
    # One page is named where the first and the last are the same, so a label is a row, however many pages have it.
    ends = lambda low, high: [F.min(low).alias("low"), F.max(high).alias("high")]
    there = labels.select("slug", "page_no", F.explode("labels").alias("l")).groupBy("slug", "l").agg(*ends("page_no", "page_no"))
    there = there.select("slug", T.matchable(F.col("l")).alias("label"), "low", "high").groupBy("slug", "label").agg(*ends("low", "high"))
    mine = chunks.select("slug", "ord", F.explode(F.split("original_page", "／", -1)).alias("l")).select("slug", "ord", T.matchable(F.col("l")).alias("label")).distinct()
    pages = mine.join(there, ["slug", "label"]).groupBy("slug", "ord").agg(*ends("low", "high"))
    return pages.where("low = high").select("slug", "ord", F.col("low").alias("page_no"))


def align(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks(slug, ord, original_page, text) x pages(slug, page_no, text) -> chunks with pdf_page, alignment.

    Each pass is one set-based step, for within a pass anchors are fixed: unique exact hits and fingerprints;
    fuzzy matches near the anchors; what is left, by a short hit nearby or from the nearest anchor, first one
    with the same label; and last, labels that name one page overrule all but the first two methods.
    What later passes read again is checkpointed to the session's shared folder, so a lost executor costs no pass.
    """
    located = kept(page_starts(pages))
    hay = kept(blocks(located))
    last = located.groupBy("slug").agg(F.max("page_no").alias("last_page"))
    rows = kept(chunks.withColumn("norm", T.matchable(F.col("text")))).join(last, "slug", "left")
    hits = kept(all_hits(rows, hay))
    rows = rows.join(counted(hits).select("slug", "ord", "hits", F.col("page_no").alias("hit_page")), ["slug", "ord"], "left")
    missing = rows.where((F.length("norm") >= LONG) & F.col("hits").isNull())
    found = fingerprints(missing, hay).select("slug", F.col("ord").cast("long").alias("ord"), F.col("page_no").alias("print_page"))
    rows = rows.join(found, ["slug", "ord"], "left")
    rows = rows.withColumn("alignment", F.when(F.col("hits") == 1, "exact").when(F.col("print_page").isNotNull(), "fingerprint").otherwise("unmapped"))
    rows = kept(rows.withColumn("page_no", F.when(F.col("hits") == 1, F.col("hit_page")).otherwise(F.col("print_page"))))

    rows = neighbours(rows, F.col("alignment") != "unmapped", F.col("last_page"))
    near = fuzzy(rows.where((F.col("alignment") == "unmapped") & (F.length("norm") >= SHORT)), located).select("slug", "ord", F.col("page_no").alias("near_page"))
    rows = rows.drop("prev", "next", "target", "from_page", "to_page").join(near, ["slug", "ord"], "left")
    rows = rows.withColumn("alignment", F.when(F.col("near_page").isNotNull(), "fuzzy").otherwise(F.col("alignment"))).withColumn("page_no", F.coalesce("near_page", "page_no"))
    rows = kept(rows)

    rows = neighbours(rows, F.col("alignment") != "unmapped", F.col("last_page"))
    open_ = rows.where((F.col("alignment") == "unmapped") & (F.length("norm") > 0))
    inside = within(open_.select("slug", "ord", "norm", "target", "from_page", "to_page"), hits, located)
    rows = rows.join(inside, ["slug", "ord"], "left")
    p, n, label = F.col("prev"), F.col("next"), F.col("original_page")
    nearer = F.when((F.col("ord") - p.ord) < (n.ord - F.col("ord")), p.page).otherwise(n.page)
    inherited = F.when(n.label == label, n.page).when(p.label == label, p.page).otherwise(F.when(p.isNull(), n.page).when(n.isNull(), p.page).otherwise(nearer))
    open_row = F.col("alignment") == "unmapped"
    method = F.when(~open_row, F.col("alignment")).when(F.col("inside_page").isNotNull() & (F.length("norm") >= SHORT), "exact").when(F.coalesce(F.col("inside_page"), inherited).isNotNull(), "inherited").otherwise("unmapped")
    rows = rows.withColumn("page_no", F.when(open_row, F.coalesce(F.col("inside_page"), inherited)).otherwise(F.col("page_no"))).withColumn("alignment", method)

    labelled = unique_labels(rows, page_labels(pages)).select("slug", "ord", F.col("page_no").alias("label_page"))
    rows = rows.join(labelled, ["slug", "ord"], "left")
    by_label = F.col("label_page").isNotNull() & ~F.col("alignment").isin("exact", "fingerprint")
    return rows.select("slug", "ord", *[c for c in chunks.columns if c not in ("slug", "ord")], F.when(by_label, F.col("label_page")).otherwise(F.col("page_no")).alias("pdf_page"), F.when(by_label, "sourcePage").otherwise(F.col("alignment")).alias("alignment"))


def relabelled(aligned: DataFrame, pages: DataFrame) -> DataFrame:
    """The labels on a chunk's page replace its own, where there are any."""
    labels = page_labels(pages).where(F.size("labels") > 0).select("slug", F.col("page_no").alias("pdf_page"), F.array_join("labels", "／").alias("page_label"))
    return aligned.join(labels, ["slug", "pdf_page"], "left").withColumn("original_page", F.coalesce("page_label", "original_page")).drop("page_label")


def summary(aligned: DataFrame, minimum: float = MIN_RATE) -> DataFrame:
    """For each work the chunks by method, the rate of verified ones among those of substance, and whether it is enough."""
    solid = F.length(T.matchable(F.col("text"))) >= SHORT
    rate = F.coalesce(F.count_if(solid & F.col("alignment").isin(*VERIFIED)) / F.nullif(F.count_if(solid), F.lit(0)), F.lit(1.0))
    return aligned.groupBy("slug").agg(*[F.count_if(F.col("alignment") == m).alias(m) for m in METHODS], F.round(rate, 6).alias("verified_rate"), (rate >= minimum).alias("accepted"))
