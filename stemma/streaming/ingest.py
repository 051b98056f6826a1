"""Incremental ingest: only files whose contents are new are read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stemma.sources import storage

FILES = "path string, sha256 string, time long, content binary"
KNOWN = "path string, sha256 string, batch long"
STORES = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changed(StatefulProcessor):
    """Of the files of a path, those that differ from the last one; the state of a path is that one's checksum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha256 string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        files = pd.concat(list(rows)).sort_values(["time", "sha256"])
        now = files.iloc[[-1]]
        if now.sha256.iloc[0] != before:
            self.last.update((now.sha256.iloc[0],))
            yield now

    def close(self) -> None:
        pass


def stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as they are written, or written again, with checksums; see storage.Folder."""
    storage.register(spark)
    files = spark.readStream.format(storage.Folder.name()).option("pattern", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "time", "content")


def changed(files: DataFrame) -> DataFrame:
    """A stream of files(path, sha256, time, content) without those whose path had this content last.

    The last checksum of each path is kept in the query's state, by path, so a batch costs what it reads, however many
    files came before. Of several of one path in a batch the latest counts. A batch that runs again finds the state
    as it was before it. Needs the RocksDB state store, see ingest().
    """
    columns = files.select("path", "sha256", "time", "content")
    return columns.groupBy("path").transformWithStateInPandas(Changed(), FILES, "Update", "None")


def write_batch(rows: DataFrame, number: int, output: str, read: Callable[[DataFrame], DataFrame]) -> None:
    """Write the rows of one batch, and which files it read, to folders of its own; running it again overwrites them."""
    rows = rows.persist()
    try:
        read(rows).write.mode("overwrite").parquet(f"{output}/rows/batch={number}")
        rows.select("path", "sha256").write.mode("overwrite").parquet(f"{output}/files/batch={number}")
    finally:
        rows.unpersist()


def ingest(files: DataFrame, checkpoint: str, output: str, read: Callable[[DataFrame], DataFrame]):
    """Start a query that turns each batch of changed files into rows of a table; see changed() and current()."""
    spark = files.sparkSession
    if "RocksDB" not in spark.conf.get(STORES, ""):
        spark.conf.set(STORES, ROCKSDB)
    run = lambda rows, number: write_batch(rows, number, output, read)
    writer = changed(files).writeStream.outputMode("update").foreachBatch(run)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, output: str, path: str = "path") -> DataFrame:
    """The rows of each file as it was last read; `path` is the column of the rows that names it."""
    last = spark.read.schema(KNOWN).parquet(f"{output}/files").groupBy("path").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{output}/rows")
    return rows.join(last.withColumnRenamed("path", path), [path, "batch"], "left_semi").drop("batch")
