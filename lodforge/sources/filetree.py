"""A tree of files from rows of (uri, payload): written by any number of tasks, there as a whole or not at all.

Each task writes its files under a staging folder beside the target. When all have ended, the commit takes over a staged file for each
uri that a successful task names, entries last, so a reader never finds a document that refers to files not there yet; a whole
replacement swaps folders, which takes one rename. A task that dies leaves its files in the staging folder, which commit and abort delete.
A task names its files to the driver in a list beside them, which the commit reads line by line, so the driver holds few names however many there are.

Paths are those pyarrow can write (local or shared folders, HDFS, object stores).
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "lodforge_files"
#: Names of files that a task tells the driver by itself; further ones stand in its list.
TOLD = 1000
#: Folders that a writer remembers to have made.
MADE = 100_000


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its path there; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _plain(uri: str) -> str:
    """A uri's path under the root; an error if it isn't relative or leaves the root."""
    path = posixpath.normpath(uri)
    if not uri or path.startswith(("/", "..")) or path == "." or ":" in path.split("/")[0]:
        raise ValueError(f"not a path under the root: {uri!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]
    listed: bool = False


class FileTreeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool, columns: list[str]) -> None:
        self.path, self.last, self.overwrite = options["path"].rstrip("/"), options.get("last", ""), overwrite
        self.uri, self.payload = columns.index("uri"), columns.index("payload")
        self.staging = f"{posixpath.dirname(self.path)}/.{posixpath.basename(self.path)}-{uuid.uuid4().hex}"
        files, root = place(self.staging)
        files.create_dir(root, recursive=True)

    def write(self, rows: Iterator) -> Staged:
        files, root = place(self.staging)
        context = TaskContext.get()
        folder = f"{context.partitionId()}-{context.taskAttemptId()}"
        names, made, more = {}, {root}, None

        def within(above: str) -> None:
            """Makes a folder below the staging folder, but never that one again once it has been dropped."""
            if above not in made:
                within(posixpath.dirname(above))
                files.create_dir(above, recursive=False)
                if len(made) > MADE:
                    made.intersection_update({root})
                made.add(above)

        try:
            for row in rows:
                name = _plain(row[self.uri])
                full = f"{root}/{folder}/{name}"
                again = name in names or (len(names) == TOLD and files.get_file_info(full).type != fs.FileType.NotFound)
                within(posixpath.dirname(full))
                with files.open_output_stream(full) as out:
                    out.write(bytes(row[self.payload] or b""))
                if len(names) < TOLD:
                    names[name] = None
                elif not again:
                    more = more or files.open_output_stream(f"{root}/{folder}.names")
                    more.write(f"{json.dumps(name)}\n".encode())
        finally:
            if more:
                more.close()
        return Staged(folder, list(names), more is not None)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = place(self.staging)
        _, target = place(self.path)
        into, made, last = f"{root}/whole" if self.overwrite else target, set(), None
        files.create_dir(into, recursive=True)

        def move(source: str, name: str) -> None:
            if (above := posixpath.dirname(f"{into}/{name}")) not in made:
                files.create_dir(above, recursive=True)
                if len(made) > MADE:
                    made.clear()
                made.add(above)
            try:
                files.move(source, f"{into}/{name}")
            except OSError:  # stores that never move a file onto another
                if files.get_file_info(f"{into}/{name}").type != fs.FileType.File:
                    raise
                files.delete_file(f"{into}/{name}")
                files.move(source, f"{into}/{name}")

        for m in messages:
            for name in self._names(files, root, m) if m else ():
                source = f"{root}/{m.folder}/{name}"
                if name == self.last:
                    last = source
                else:
                    move(source, name)
        if last:
            move(last, self.last)
        if self.overwrite:
            if files.get_file_info(target).type != fs.FileType.NotFound:
                files.move(target, f"{root}/before")
            files.move(into, target)
        self._drop(files, root)

    @staticmethod
    def _names(files: fs.FileSystem, root: str, m: Staged) -> Iterator[str]:
        yield from m.names
        if m.listed:
            with io.TextIOWrapper(files.open_input_stream(f"{root}/{m.folder}.names"), "utf-8") as lines:
                yield from map(json.loads, lines)

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop(*place(self.staging))

    def _drop(self, files: fs.FileSystem, root: str) -> None:
        """Deletes the staging folder under another name, as tasks of a failed job may still write to it."""
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.move(root, f"{root}-dropped")
            files.delete_dir(f"{root}-dropped")


class FileTree(DataSource):
    """``df.write.format("lodforge_files")`` for rows with ``uri`` and ``payload``; option ``last``: the uri that is moved after all others."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "uri string, payload binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options, overwrite, schema.names)


def write_files(rows: DataFrame, path: str, append: bool = False, last: str = "") -> None:
    """Writes ``rows`` (uri, payload) as files under ``path``, instead of what is there or beside it.

    A uri that isn't relative or leaves the root fails the write, and nothing changes. Of rows with one uri, one is kept. Null payloads
    are empty files. No rows: an empty folder.
    """
    rows.sparkSession.dataSource.register(FileTree)
    kept = rows.select("uri", "payload")
    kept.write.format(FORMAT).mode("append" if append else "overwrite").option("last", last).save(path)
