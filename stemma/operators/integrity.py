"""Integrity checks. Each gives violations: check, key, detail; no rows mean that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.text import BLOCK_ID

#: Shapes of keys.
SLUG, COMMIT, SHA, FRAGMENT, BLOCK = "^[a-z0-9-]+$", "^[a-f0-9]{40}$", "^[a-f0-9]{64}$", "^ja_[a-f0-9]+$", BLOCK_ID
LOCATION_PREFIX = r"^(?:原刊|原冊|原資料|原書|原写本|写本|自筆稿|原稿|底本|原誌|原報告|クラウス|出所|PMM|主底本|補完底本|合成底本|デジタル画像|未丁付|第)"
FRAGMENT_BYTES = 750_000
#: What page maps and ledgers may say.
SOURCE_MODES, TEXT_MODES, PENDING = ("canonical-master", "approved-epub-mirror"), ("embedded", "japanese-ocr"), "pending_lfs"
MASTER_FILE, TAG = r"^[A-Za-z0-9_.-]+\.(?:docx|md)$", "^[A-Za-z0-9._-]+$"


def violations(df: DataFrame, check: str, key: str | Column, bad: Column, detail: Column | None = None) -> DataFrame:
    name = F.col(key) if isinstance(key, str) else key
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(check).alias("check"), name.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def required(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null or blank fields, one row each."""
    empty = F.filter(F.array(*[F.struct(F.lit(c).alias("c"), (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias("e")) for c in columns]), lambda x: x.e)
    return df.select(key, F.explode(empty).alias("x")).select(F.lit("required").alias("check"), F.col(key).cast("string").alias("key"), F.col("x.c").alias("detail"))


def unique(df: DataFrame, key: str) -> DataFrame:
    return violations(df.groupBy(key).agg(F.count("*").alias("n")), "unique", key, F.col("n") > 1, F.col("n"))


def shape(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return violations(df, f"shape:{column}", key, ~F.col(column).rlike(pattern), F.col(column))


def set_difference(left: DataFrame, right: DataFrame, key: str, missing: str, extra: str) -> DataFrame:
    """Keys on the left only (missing) and on the right only (extra)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return all_of(violations(a.join(b, key, "left_anti"), missing, key, F.lit(True)), violations(b.join(a, key, "left_anti"), extra, key, F.lit(True)))


def ledger(rows: DataFrame, archived: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """publications(slug) against the ledger's archived(slug, path) and fallbacks(slug, canonical_path): coverage and shape."""
    known = archived.select("slug").unionAll(fallbacks.select("slug"))
    overlap = archived.join(fallbacks, "slug", "left_semi")
    doubled = archived.groupBy("path").agg(F.count("*").alias("n"))
    return all_of(
        violations(overlap, "overlap", "slug", F.lit(True)),
        set_difference(rows, known, "slug", "missing", "stale"),
        violations(archived, "path", "slug", ~F.contains("path", F.col("slug")), F.col("path")),
        violations(doubled, "path-twice", "path", F.col("n") > 1, F.col("n")),
        violations(fallbacks, "fallback", "slug", F.col("canonical_path").isNull() | (F.col("canonical_path") == "")),
    )


def manifest(publications: DataFrame, assets: DataFrame, each: int = 3) -> DataFrame:
    """Every publication's paths are assets, no other assets are there, and there are `each` for each."""
    paths = publications.select(F.explode(F.array("cover", "pdf", "epub")).alias("path"))
    total = publications.agg(F.count("*").alias("p")).crossJoin(assets.agg(F.count("*").alias("a")))
    return all_of(set_difference(paths, assets, "path", "asset-missing", "asset-unknown"), violations(total, "asset-count", F.col("p"), F.col("a") != F.col("p") * each, F.col("a")))


def checksums(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Files whose size or SHA-256 is another than listed, or that are not there."""
    rows = expected.join(actual.select(key, F.col("size").alias("size_now"), F.col("sha256").alias("sha_now")), key, "left")
    return violations(rows, "checksum", key, ~(F.col("size").eqNullSafe(F.col("size_now")) & F.col("sha256").eqNullSafe(F.col("sha_now"))))


def contiguous(df: DataFrame, key: str, ordinal: str, first: int = 0) -> DataFrame:
    """Groups whose ordinals are not first..first+n-1, each once."""
    n = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(ordinal).alias("d"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    fine = (F.col("n") == F.col("d")) & (F.col("lo") == first) & (F.col("hi") == first + F.col("n") - 1)
    return violations(n, "sequence", key, ~fine, F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", "d", "lo", "hi")]))


def fragments(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Index fragments(part_id, slug, record_class, part_index, bytes) against the parts that should be there."""
    both = expected.select("slug", "part_index", F.lit(1).alias("e")).join(found.select("slug", "part_index", F.lit(1).alias("f")), ["slug", "part_index"], "full")
    key = F.concat_ws("/", "slug", F.col("part_index").cast("string"))
    return all_of(
        shape(found, "part_id", "part_id", FRAGMENT),
        violations(found, "part", "part_id", F.col("part_index") < 0),
        violations(found, "size", "part_id", F.col("bytes") > FRAGMENT_BYTES, F.col("bytes")),
        violations(both, "fragment-missing", key, F.col("f").isNull()),
        violations(both, "fragment-unknown", key, F.col("e").isNull()),
        contiguous(found, "slug", "part_index"),
    )


def page_map(chunks: DataFrame, works: DataFrame) -> DataFrame:
    """Blocks of each work: id, label, page within the work, and an unbroken order."""
    rows = chunks.join(works.select("slug", "page_count"), "slug")
    key = F.concat_ws("/", "slug", "id")
    return all_of(
        violations(rows, "block", key, ~F.col("id").rlike(BLOCK)),
        violations(rows, "label", key, ~F.col("original_page").rlike(LOCATION_PREFIX), F.col("original_page")),
        violations(rows, "page", key, ~F.col("pdf_page").between(1, F.col("page_count")), F.col("pdf_page")),
        contiguous(chunks, "slug", "ord", 1),
    )


def alignment(summary: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rates that are too low, unmapped chunks, and methods that do not add up to the blocks."""
    from stemma.operators.align import METHODS

    rows = summary.join(blocks.groupBy("slug").agg(F.count("*").alias("blocks")), "slug", "left")
    return all_of(
        violations(rows, "rate", "slug", ~F.col("accepted"), F.col("verified_rate")),
        violations(rows, "unmapped", "slug", F.col("unmapped") > 0, F.col("unmapped")),
        violations(rows, "methods", "slug", reduce(Column.__add__, map(F.col, METHODS)) != F.col("blocks")),
    )


def freshness(meta: DataFrame, works: DataFrame) -> DataFrame:
    """One row of index metadata (schema_version, archive_commit, manifest_sha256, books, papers, chunks) against the works."""
    rows = meta.crossJoin(works.agg(F.count("*").alias("n"), F.count_if(F.col("record_class") == "major-work").alias("b")))
    key = F.lit("index")
    return all_of(
        violations(rows, "version", key, F.col("schema_version") != 1),
        violations(rows, "commit", key, ~F.col("archive_commit").rlike(COMMIT)),
        violations(rows, "manifest", key, ~F.col("manifest_sha256").rlike(SHA)),
        violations(rows, "counts", key, (F.col("books") != F.col("b")) | (F.col("books") + F.col("papers") != F.col("n"))),
        violations(rows, "chunks", key, F.col("chunks") < F.col("n")),
    )


def golden(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts of golden queries(query, books, papers, pages); a null expectation is not checked."""
    rows = expected.join(found.select("query", *[F.col(c).alias(f"{c}_now") for c in ("books", "papers", "pages")]), "query", "left")
    wrong = [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"{c}_now")) for c in ("books", "papers", "pages")]
    return violations(rows, "golden", "query", reduce(Column.__or__, wrong))


def toc_order(entries: DataFrame) -> DataFrame:
    """Entries(slug, n, spine) of a table of contents that go back in the spine."""
    before = F.lag("spine").over(W.partitionBy("slug").orderBy("n"))
    return violations(entries.withColumn("before", before), "toc", F.concat_ws("/", "slug", F.col("n").cast("string")), F.coalesce(F.col("spine") < F.col("before"), F.lit(False)))


def unresolved_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """links(slug, target) whose member of the archive is not there."""
    return violations(links.join(members.select("slug", F.col("member").alias("target")), ["slug", "target"], "left_anti"), "link", F.concat_ws("/", "slug", "target"), F.lit(True))


def page_map_files(maps: DataFrame, works: DataFrame) -> DataFrame:
    """Heads of page maps against works(slug, pdf_url, pdf_sha256, epub_sha256, master_path): addresses, checksums, modes."""
    now = works.select("slug", *[F.col(c).alias(f"{c}_now") for c in ("pdf_url", "pdf_sha256", "epub_sha256", "master_path")])
    rows = maps.join(now, "slug", "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"{c}_now"))
    mirror = (F.col("source_mode") == SOURCE_MODES[1]) & ~F.col("source_sha256").eqNullSafe(F.col("epub_sha256_now"))
    shape_ = F.coalesce(F.col("source_sha256"), F.lit("")).rlike(SHA)
    return all_of(
        violations(rows, "map-url", "slug", F.col("canonical_url") != F.concat(F.lit("/publications/"), "slug", F.lit("/"))),
        violations(rows, "map-pdf", "slug", ~same("pdf_url")),
        violations(rows, "map-sha", "slug", ~same("pdf_sha256")),
        violations(rows, "map-master", "slug", F.col("master_path").isNull() | ~same("master_path")),
        violations(rows, "map-mode", "slug", ~F.col("source_mode").isin(*SOURCE_MODES)),
        violations(rows, "map-source", "slug", mirror | ~shape_),
        violations(rows, "map-text", "slug", ~F.col("pdf_text_mode").isin(*TEXT_MODES)),
    )


def canonical_paths(rows: DataFrame, archived: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """publications(slug) -> slug, path: the archived one, else that of the fallback, else null."""
    out = rows.select("slug").join(archived.select("slug", "path"), "slug", "left").join(fallbacks.select("slug", "canonical_path"), "slug", "left")
    return out.select("slug", F.coalesce("path", "canonical_path").alias("path"))


def ledger_shapes(ledger: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """One row of ledger(schema_version, archive_commit), and its fallbacks: versions, states, commits, checksums, names."""
    key = F.lit("ledger")
    some = ledger.crossJoin(fallbacks.agg(F.count("*").alias("n")))
    rows = fallbacks.crossJoin(F.broadcast(ledger.select("archive_commit")))  # one row
    return all_of(
        violations(ledger, "ledger-version", key, ~F.col("schema_version").isin(1, 2)),
        violations(ledger, "ledger-commit", key, ~F.col("archive_commit").rlike(COMMIT)),
        violations(some, "ledger-fallbacks", key, (F.col("schema_version") == 1) & (F.col("n") > 0)),
        violations(rows, "fallback-status", "slug", F.col("status") != PENDING),
        violations(rows, "fallback-commit", "slug", ~F.col("ledger_commit").rlike(COMMIT) | (F.col("ledger_commit") != F.col("archive_commit"))),
        violations(rows, "fallback-sha", "slug", ~F.col("master_sha256").rlike(SHA)),
        violations(rows, "fallback-size", "slug", F.col("master_size") < 1),
        violations(rows, "fallback-file", "slug", ~F.col("master_filename").rlike(MASTER_FILE)),
        violations(rows, "fallback-tag", "slug", ~F.col("release_tag").rlike(TAG)),
    )
