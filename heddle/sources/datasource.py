"""A Python Data Source for stored source files: a writer with opaque keys and one commit per job, and a reader of what is committed.

A file is stored under the hash of its content, by a temporary name first, so a task that runs again writes the same file, and readers see whole files only.  Each task lists its files
in a list of its own; the commit names the lists in one small file, which is what makes a job's files visible.  A reader's partitions are the committed lists, so neither the listing nor the
contents pass through the driver.  A folder that this writer didn't write is read file by file.

Register it with ``register(spark)``, then ``spark.read.format("heddle_files").load(path)`` gives (path, key, content), and with option as=blocks the blocks of ``files.read_blocks``.
All executors must reach the path by pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from heddle.sources.markup import blocks_of

FORMAT = "heddle_files"
CONTENTS = "path string, key string, content binary"
BLOCKS = "path string, n int, kind string, text string, level int, start int, stop int, source string, problem string"
_LISTS, _COMMITS = "_lists", "_commits"


def open_folder(path: str) -> fs.FileSystem:
    """The file system below a path, with or without a scheme; Hadoop's file:/x is taken as file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return fs.SubTreeFileSystem(base, system)


def put(folder: fs.FileSystem, name: str, content: bytes) -> None:
    """Writes a file whole or not at all."""
    part = f"{name}.{uuid.uuid4().hex}.part"
    with folder.open_output_stream(part) as out:
        out.write(content)
    folder.move(part, name)


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


@dataclass
class FileList(InputPartition):
    """Either a committed list, or one file of a plain folder."""

    name: str
    listed: bool


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class FilesReader(DataSourceReader):
    def __init__(self, path: str, blocks: bool):
        self.path, self.blocks = path, blocks

    def partitions(self) -> list[FileList]:
        folder = open_folder(self.path)
        commits = [x for x in folder.get_file_info(fs.FileSelector(_COMMITS, allow_not_found=True)) if x.base_name.endswith(".json")]
        if commits:
            names = [name for x in sorted(commits, key=lambda x: x.path) for name in json.loads(folder.open_input_stream(x.path).read())]
            return [FileList(name, True) for name in names] or [FileList("", True)]
        plain = [x.path for x in folder.get_file_info(fs.FileSelector("", recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        return [FileList(name, False) for name in sorted(plain)] or [FileList("", True)]

    def read(self, partition: FileList) -> Iterator[tuple]:
        if not partition.name:
            return
        folder = open_folder(self.path)
        entries = json.loads(folder.open_input_stream(partition.name).read()) if partition.listed else [(partition.name, partition.name)]
        for path, key in entries:
            content = folder.open_input_stream(key).read()
            if self.blocks:
                yield from blocks_of(path, content)
            else:
                yield path, key, content


class FilesWriter(DataSourceWriter):
    """Rows (path, content).  An overwrite's commit takes the place of all before it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        folder, entries = open_folder(self.path), []
        folder.create_dir(_LISTS)
        for row in rows:
            content, ending = bytes(row["content"]), extension(row["path"])
            key = hashlib.sha256(content).hexdigest()[:32] + (f".{ending}" if ending else "")
            put(folder, key, content)
            entries.append((row["path"], key))
        if not entries:
            return Written(None)
        name = f"{_LISTS}/{self.job}-{uuid.uuid4().hex}.json"
        put(folder, name, json.dumps(entries).encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        folder = open_folder(self.path)
        folder.create_dir(_COMMITS)
        before = [x.path for x in folder.get_file_info(fs.FileSelector(_COMMITS)) if x.base_name.endswith(".json")] if self.overwrite else []
        put(folder, f"{_COMMITS}/{self.job}.json", json.dumps([m.name for m in messages if m and m.name]).encode())
        for old in before:
            folder.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        folder = open_folder(self.path)
        for m in messages:
            if m and m.name:
                folder.delete_file(m.name)


class StoredFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCKS if self.options.get("as") == "blocks" else CONTENTS

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], self.options.get("as") == "blocks")

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredFiles)
