"""Incremental ingest: each change once, through restarts, failures and files that come back."""

import pytest
from pyspark.sql import functions as F

from stemma.streaming import ingest

read = lambda rows: rows.select("path", F.length("content").alias("n"))


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def run(spark, place, reader=read):
    query = ingest.ingest(ingest.stream(spark, str(place / "in"), "*.txt"), str(place / "state"), str(place / "out"), reader)
    query.awaitTermination()
    return query


def put(place, name, text, time):
    import os

    file = place / "in" / f"{name}.txt"
    file.write_text(text)
    os.utime(file, (time, time))


def rows(spark, place):
    return sorted((r.path.rpartition("/")[2], r.n) for r in spark.read.parquet(str(place / "out/rows")).collect())


def test_changes(spark, place):
    put(place, "a", "1", 1000)
    put(place, "b", "22", 1000)
    run(spark, place)
    put(place, "c", "333", 2000)
    put(place, "a", "1", 3000)  # touched, not changed
    put(place, "b", "55555", 3000)
    query = run(spark, place)  # a new query on the same state
    assert rows(spark, place) == [("a.txt", 1), ("b.txt", 2), ("b.txt", 5), ("c.txt", 3)]
    state = [p for p in query.recentProgress if p["stateOperators"]]
    assert state[-1]["stateOperators"][0]["numRowsTotal"] == 3
    # what is current: the last of each file
    got = sorted((r.path.rpartition("/")[2], r.n) for r in ingest.current(spark, str(place / "out")).collect())
    assert got == [("a.txt", 1), ("b.txt", 5), ("c.txt", 3)]
    put(place, "b", "22", 4000)  # as it was at first
    run(spark, place)
    got = sorted((r.path.rpartition("/")[2], r.n) for r in ingest.current(spark, str(place / "out")).collect())
    assert got == [("a.txt", 1), ("b.txt", 2), ("c.txt", 3)]


def test_a_batch_that_fails_runs_again(spark, place):
    """A batch that stops after its first table leaves each row once when the query starts again."""
    put(place, "a", "1", 1000)
    run(spark, place)
    put(place, "a", "4444", 2000)
    put(place, "b", "22", 2000)

    def broken(batch):
        read(batch).write.parquet(str(place / "out/rows/batch=1"))
        raise ValueError("stopped")

    with pytest.raises(Exception, match="stopped"):
        run(spark, place, broken)
    run(spark, place)
    assert rows(spark, place) == [("a.txt", 1), ("a.txt", 4), ("b.txt", 2)]
    run(spark, place)
    assert rows(spark, place) == [("a.txt", 1), ("a.txt", 4), ("b.txt", 2)]
