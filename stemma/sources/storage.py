"""Files as Spark sources that its own lack: rewritten files as a stream, members of archives, and files put together from rows."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stemma.functions.text import short_batches

#: Bytes of files or members that one task reads, and that one batch has, about; what an entry counts besides its bytes.
TASK_BYTES, BATCH_BYTES, ENTRY_BYTES = 32 << 20, 8 << 20, 1 << 10


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it; an address without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found(path: str, pattern: str) -> list[fs.FileInfo]:
    """Files below a folder, or the one file, whose names fit a pattern, by path."""
    system, base = place(path)
    info = system.get_file_info(base)
    files = system.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((f for f in files if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)), key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    """What one task reads: (path, time) of files."""

    files: list[tuple[str, int]]


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")

    def initialOffset(self) -> dict:
        return {"time": -1}

    def latestOffset(self) -> dict:
        return {"time": max((f.mtime_ns for f in found(self.path, self.pattern)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        groups, size = [[]], 0
        for f in found(self.path, self.pattern):
            if start["time"] < f.mtime_ns <= end["time"]:
                if groups[-1] and size + f.size > TASK_BYTES:
                    groups.append([])
                    size = 0
                groups[-1].append((f.path, f.mtime_ns))
                size += f.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = place(self.path)
        for path, time in partition.files:
            with system.open_input_stream(path) as f:
                yield path, time, f.read()


class Folder(DataSource):
    """A stream of files(path, time, content) below `path` whose names fit `pattern`, each whenever it is written.

    Spark's own file source gives each path once. Here an offset is a time of change, so a file that is written again
    comes again. Listing is all that grows with the folder. A file that changes while a batch waits is in a later one.
    """

    @classmethod
    def name(cls) -> str:
        return "stemma-folder"

    def schema(self) -> str:
        return "path string, time long, content binary"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(self.options)


# ---------------------------------------------------------------- archives


@dataclass
class Members(InputPartition):
    """What one task reads: archives, and of each (number, name, method, bytes) of members."""

    archives: list[tuple[str, list[tuple[int, str, int, int]]]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.only = options["path"], options.get("pattern", "*"), options.get("members", "*")
        self.bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Members one after the other, a new task wherever one has enough: large archives are many, small ones share one."""
        system, _ = place(self.path)
        out: list[InputPartition] = []
        task, size = [], 0
        for f in found(self.path, self.pattern):
            with system.open_input_file(f.path) as file, zipfile.ZipFile(file) as z:
                task.append((f.path, []))
                for n, m in enumerate(z.infolist()):
                    if m.is_dir():
                        continue
                    if size and size + m.file_size > self.bytes:
                        out.append(Members(task))
                        task, size = [(f.path, [])], 0
                    task[-1][1].append((n, m.filename, m.compress_type, m.file_size))
                    size += m.file_size + ENTRY_BYTES
        return [*out, Members(task)] if task else out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        names = ["archive", "n", "member", "method", "size", "content"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for path, members in partition.archives:
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                infos, rows, held = z.infolist(), [], 0
                for n, name, method, size in members:
                    content = z.read(infos[n]) if fnmatch(name, self.only) else None
                    rows.append((path, n, name, method, size, content))
                    held += len(content or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written beside their places: (temporary, final)."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Rows that come together are written to one file beside its place; only the whole job's commit moves files there."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def begin(self, file) -> object:
        raise NotImplementedError

    def add(self, out, row: Row) -> None:
        raise NotImplementedError

    def end(self, out) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from uuid import uuid4

        system, base = place(self.path)
        files, name, out, file = [], None, None, None
        token = uuid4().hex
        system.create_dir(base, recursive=True)
        try:
            for row in iterator:
                if row.file != name:
                    if file:
                        self.end(out)
                        file.close()
                    name = row.file
                    final = f"{base}/{name}"
                    files.append((f"{base}/_{token}-{len(files)}", final))
                    file = system.open_output_stream(files[-1][0])
                    out = self.begin(file)
                self.add(out, row)
            if file:
                self.end(out)
                file.close()
        except BaseException:
            self._drop(files)
            raise
        return Written(files)

    def _drop(self, files: list[tuple[str, str]]) -> None:
        system, _ = place(self.path)
        for temporary, _ in files:
            if system.get_file_info(temporary).type != fs.FileType.NotFound:
                system.delete_file(temporary)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        twice = len(files) - len({final for _, final in files})
        if twice:
            self._drop(files)
            raise ValueError(f"{twice} files have rows in several tasks; see whole_files()")
        system, _ = place(self.path)
        for temporary, final in files:
            system.create_dir(final.rpartition("/")[0], recursive=True)
            system.move(temporary, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop([f for m in messages if m for f in m.files])


class ArchiveWriter(FileWriter):
    """Rows (file, member, content, stored) become members in the order in which they come."""

    def begin(self, file) -> zipfile.ZipFile:
        self.file = file
        return zipfile.ZipFile(_Sink(file), "w", zipfile.ZIP_DEFLATED)

    def add(self, out: zipfile.ZipFile, row: Row) -> None:
        info = zipfile.ZipInfo(row.member)
        out.writestr(info, bytes(row.content or b""), zipfile.ZIP_STORED if row.stored else zipfile.ZIP_DEFLATED)

    def end(self, out: zipfile.ZipFile) -> None:
        out.close()


class _Sink(io.RawIOBase):
    """A stream that can only be written to, for writers that ask for one."""

    def __init__(self, file):
        self.file = file

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.file.write(bytes(data))
        return len(data)


class Archives(DataSource):
    """ZIP archives, members as rows(archive, n, member, method, size, content), in the order of the directory.

    Reading: `path` is a file or a folder, `pattern` chooses files, `members` whose content is read (others are null). Only
    directories are read to plan; a large archive is as many tasks as its members fill, so none is ever one cell, and small ones share. Writing: rows
    (file, member, content, stored) of one file must come one after the other in one task, see whole_files().
    """

    @classmethod
    def name(cls) -> str:
        return "stemma-archives"

    def schema(self) -> str:
        return "archive string, n int, member string, method int, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)


# ---------------------------------------------------------------- JSON


class JsonWriter(FileWriter):
    """Rows (file, key, value), value being JSON, become one object a file, an entry a line."""

    def begin(self, file) -> list:
        file.write(b"{")
        return [file, b"\n"]

    def add(self, out: list, row: Row) -> None:
        file, joint = out
        file.write(joint + json.dumps(row.key, ensure_ascii=False).encode() + b":" + row.value.encode())
        out[1] = b",\n"

    def end(self, out: list) -> None:
        out[0].write(b"\n}\n")


class JsonFiles(DataSource):
    """One JSON object a file, from rows(file, key, value) that come in its order; see whole_files()."""

    @classmethod
    def name(cls) -> str:
        return "stemma-json"

    def schema(self) -> str:
        return "file string, key string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return JsonWriter(self.options)


# ---------------------------------------------------------------- use


def register(spark: SparkSession) -> None:
    """Make the sources of this module known to a session, and bound the rows that their workers put together at once."""
    short_batches()
    for source in (Folder, Archives, JsonFiles):
        spark.dataSource.register(source)


def read_archives(spark: SparkSession, path: str, pattern: str = "*", members: str = "*", task_bytes: int = TASK_BYTES) -> DataFrame:
    """archive, n, member, method, size, content of the members of ZIP archives; see Archives."""
    register(spark)
    return spark.read.format(Archives.name()).option("pattern", pattern).option("members", members).option("taskbytes", task_bytes).load(path)


def whole_files(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by their file and sorted in each, so that a writer streams each file; no row and no task holds one."""
    return rows.repartition("file").sortWithinPartitions("file", *order)


def write_files(rows: DataFrame, kind: type[DataSource], path: str, *order: str) -> None:
    """Write each file from its rows, in an order. Files appear when all are written; a task or job that fails leaves none."""
    register(rows.sparkSession)
    columns = {Archives: ["file", "member", "content", "stored"], JsonFiles: ["file", "key", "value"]}[kind]
    whole_files(rows, *order).select(*columns).write.format(kind.name()).mode("append").save(path)
