"""A Spark data source that writes rows as files of their own names, committed as a whole.

    df.select("name", "value").write.format("named_files").mode("overwrite").save(path)

Rows of one name that follow each other in a task are one file, written as they come.
Files are dealt over bounded folders by a hash of their names.  All are written beside
the target; a task gives a file its name only once it is whole, so one that runs again or
twice puts the same file in the same place.  The commit swaps the folder in by a rename
and an abort removes it; until then readers see what was there.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Files a folder holds, about, if the writer is told how many there are.
FOLDER = 1000
DONE = "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    """How many files a task has written; names don't travel."""

    n: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:/x as Spark spells it, too), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.folders = max(1, int(options.get("folders", "1")))
        self.overwrite = overwrite
        store, root = opened(self.path)
        if not overwrite and store.get_file_info(root).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already; write with mode('overwrite')")
        self.staging = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = opened(self.staging)
        n = 0
        for name, rows in itertools.groupby(iterator, key=lambda row: row["name"]):
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not a file's name: {name!r}")
            folder = f"{root}/{zlib.crc32(name.encode()) % self.folders:04d}" if self.folders > 1 else root
            store.create_dir(folder, recursive=True)
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                for row in rows:
                    out.write((row["value"] or "").encode())
            store.move(part, f"{folder}/{name}")  # replaces what another attempt wrote
            n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.staging)
        store.create_dir(root, recursive=True)
        left = [x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.base_name.startswith(".")]
        for path in left:  # of attempts that ended half way
            store.delete_file(path)
        with store.open_output_stream(f"{root}/{DONE}") as out:
            out.write(str(sum(m.n for m in messages if m)).encode())
        final = opened(self.path)[1]
        if store.get_file_info(final).type != fs.FileType.NotFound:
            store.delete_dir(final) if store.get_file_info(final).type == fs.FileType.Directory else store.delete_file(final)
        store.move(root, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"name", "value"} <= set(schema.names):
            raise ValueError("named_files writes columns name and value")
        return NamedFilesWriter(dict(self.options), overwrite)


def write_named(files: DataFrame, path: str, n_files: int | None = None) -> None:
    """Writes (name, value) as one file a name, whose rows stand together in one partition, replacing the folder; with n_files, in folders of about 1,000."""
    SparkSession.active().dataSource.register(NamedFiles)
    folders = 1 if n_files is None else -(-n_files // FOLDER)
    files.select("name", "value").write.format("named_files").mode("overwrite").option("folders", folders).save(path)
