"""Sources and sinks of their own: archives by members, JSON files, and what a failure leaves."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stemma.operators import packages
from stemma.sources import sinks, storage


def test_archives_come_back(spark, tmp_path):
    rows = [("a.zip", 1, "mimetype", b"t", True), ("a.zip", 2, "x/y.txt", b"hello " * 500, False), ("a.zip", 3, "empty", None, False), ("d/b.zip", 1, "only", b"\x00\xff", False)]
    frame = spark.createDataFrame(rows, "file string, n int, member string, content binary, stored boolean").repartition(4)
    storage.write_files(frame, storage.Archives, str(tmp_path), "n")
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.namelist() == ["mimetype", "x/y.txt", "empty"] and z.testzip() is None
        assert [i.compress_type for i in z.infolist()] == [0, 8, 8]
    got = storage.read_archives(spark, str(tmp_path), "*.zip", task_bytes=100)
    assert got.rdd.getNumPartitions() == 4 and storage.read_archives(spark, str(tmp_path), "*.zip").rdd.getNumPartitions() == 1  # by bytes
    assert sorted((r.archive.rpartition("/")[2], r.n, r.member, r.method, r.size, bytes(r.content)) for r in got.collect()) == [("a.zip", 0, "mimetype", 0, 1, b"t"), ("a.zip", 1, "x/y.txt", 8, 3000, b"hello " * 500), ("a.zip", 2, "empty", 8, 0, b""), ("b.zip", 0, "only", 8, 2, b"\x00\xff")]
    some = storage.read_archives(spark, str(tmp_path / "a.zip"), members="*.txt")
    assert {r.member: r.content is None for r in some.collect()} == {"mimetype": True, "x/y.txt": False, "empty": True}
    # written again, the file is replaced
    storage.write_files(frame.where("file = 'a.zip' and n = 1"), storage.Archives, str(tmp_path), "n")
    assert zipfile.ZipFile(tmp_path / "a.zip").namelist() == ["mimetype"]


def test_json_files(spark, tmp_path):
    rows = [("w", k, 'p. "%d"\n\\' % k if k % 3 else None, k, f"text {k}") for k in range(1, 300)] + [("v", 100_001, "é", 7, "x")]
    chunks = spark.createDataFrame(rows, "slug string, ord long, original_page string, pdf_page int, text string").repartition(7)
    sinks.write_page_maps(chunks, str(tmp_path / "maps"))
    got = json.loads((tmp_path / "maps/w.json").read_text())
    assert got == {f"b{k:05d}": [p, page, k - 1] for _, k, p, page, _ in rows[:-1]} and list(got) == sorted(got)
    assert json.loads((tmp_path / "maps/v.json").read_text()) == {"b100001": ["é", 7, 100_000]}
    sinks.write_corpus(chunks, str(tmp_path / "corpus"))
    assert json.loads((tmp_path / "corpus/w.json").read_text())["b00002"] == ['p. "2"\n\\', 2, "text 2"]
    parts = spark.createDataFrame([("ja_2", "v", "short-work", 1), ("ja_1", "w", "major-work", 0)], "part_id string, slug string, record_class string, part_index int")
    sinks.write_document_map(parts, str(tmp_path / "maps"))
    assert list(json.loads((tmp_path / "maps/documents.json").read_text()).items()) == [("ja_1", ["w", "major-work", 0]), ("ja_2", ["v", "short-work", 1])]


def test_a_failure_leaves_nothing(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("file"), F.col("id").cast("string").alias("key"), F.when(F.col("id") == 150, F.raise_error(F.lit("stopped")).cast("string")).otherwise("1").alias("value"))
    with pytest.raises(Exception, match="stopped"):
        storage.write_files(rows, storage.JsonFiles, str(tmp_path / "out"), "key")
    assert not list((tmp_path / "out").glob("*")) if (tmp_path / "out").exists() else True
    # rows of one file in several tasks are refused, and leave nothing either
    storage.register(spark)
    split = spark.range(8).repartition(4).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("key"), F.lit("1").alias("value"))
    with pytest.raises(Exception, match="several tasks"):
        split.write.format("stemma-json").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*"))


def test_short_works(spark):
    order = spark.createDataFrame([("a", 0, "O/cover.xhtml"), ("a", 1, "O/nav.xhtml"), ("a", 2, "O/ch001.xhtml"), ("a", 3, "O/ch002.xhtml"), ("b", 0, "O/title_page.xhtml"), ("b", 1, "O/other.xhtml")], "archive string, k int, path string")
    short = packages.short_order(order)
    assert sorted((r.archive, r.k, r.path) for r in short.collect()) == [("a", 0, "O/ch001.xhtml"), ("a", 1, "O/ch002.xhtml"), ("b", 0, "O/other.xhtml")]
    assert [(r.key, r.detail) for r in packages.short_starts(short).collect()] == [("b", "O/other.xhtml")]
    assert packages.check(spark.createDataFrame([], "archive string, n int, member string, method int, size long, content binary")).count() == 0
