"""What the operators of this subpackage share: tables, staging and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch is kept short.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once: batches by rows and by bytes. A smaller setting stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub("[^0-9]", "", spark.conf.get(key, None) or "") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session. Only on one machine, where none is set, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="stemma-")
    return f"file://{_OWN['dir']}"


_STAGED: dict[str, SparkSession] = {}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Bytes of files up to which a table is broadcast unasked. Packed ids and counts take many times that in the driver.
BROADCAST_FILES = 1 << 20


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _small_broadcasts(spark: SparkSession) -> dict[str, str]:
    """What is broadcast by the size of its files is bounded by BROADCAST_FILES; by sizes that Spark has measured, as before."""
    java = spark._jsparkSession.sessionState().conf()
    now, measured = java.autoBroadcastJoinThreshold(), spark.conf.get(_MEASURED, None)
    return {_BROADCAST: str(min(now, BROADCAST_FILES)), _MEASURED: measured or str(now)}


def staged(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; staged tables in `done` are then deleted.

    This cuts the lineage: a lost executor costs no more than its own tasks, and no stage before this
    one runs again. The write's own shuffle files go when it ends. Only small files are broadcast in it unasked.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stemma-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, {_FREE_SHUFFLES: "true"} | _small_broadcasts(spark)):
        df.write.mode("overwrite").parquet(path)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for x in tables:
        if x.staged_at in _STAGED:
            _delete(_STAGED.pop(x.staged_at), x.staged_at)


def clear_staged() -> None:
    """Delete all staged tables. Results that were returned read the last of theirs, so these have to be written first."""
    for path, spark in list(_STAGED.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)
        _STAGED.pop(path, None)


atexit.register(clear_staged)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [n or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist()]
        first = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        yield batch.slice(first)


def tidy() -> None:
    """At the end of a task: give memory that is free again back to the system, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def estimated_bytes(df: DataFrame) -> int | None:
    """What the planner takes the size of a table to be; None where it does not know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def narrowed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others, whatever they are called, never reach an operator."""
    return docs.select(*[docs[n] for n in names])


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """body(value), with value computed once even where body has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
