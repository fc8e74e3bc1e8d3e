"""Files of given names, as a data source: what a browser fetches beside a page (pages.json, sitemap.xml) isn't called part-00000.

    write_named(rows, root)                  # rows: path (below root), ordinal, value

A file holds the values of its path in their order, and is streamed: a task keeps one row of it at a time, so a large file costs no memory.
Tasks write below a folder of the job; the driver moves the files to their names once all tasks are done, so that a failed job leaves nothing,
and a task that runs twice leaves one file. Only the names of the tasks' folders travel with the commit.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Moves that the driver has under way at a time, and the names it lists before it starts them.
MOVES, NAMES_AT_ONCE = 16, 10_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (file:, hdfs:, s3:, gs:, or a local path), and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def checked(path: str | None) -> str:
    """A path below the root: neither empty, absolute, a folder's, nor with dots as a part."""
    if not path or any(part in ("", ".", "..") for part in path.split("/")):
        raise ValueError(f"not the name of a file below the root: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    folder: str


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.head, self.separator, self.tail = (options.get(k, "").encode() for k in ("head", "separator", "tail"))
        self.staging = f"_named-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.root)
        folder = posixpath.join(root, self.staging, uuid.uuid4().hex)
        files.create_dir(folder, recursive=True)
        path = out = last = None
        try:
            for row in iterator:
                value = (row.value or "").encode()
                if row.path != path or out is None:
                    if out is not None:
                        out.write(self.tail)
                        out.close()
                    path = checked(row.path)
                    target = posixpath.join(folder, path)
                    if files.get_file_info(target).type != fs.FileType.NotFound:
                        raise ValueError(f"rows of {path!r} don't follow each other")
                    if posixpath.dirname(target) != last:
                        last = posixpath.dirname(target)
                        files.create_dir(last, recursive=True)
                    out = files.open_output_stream(target)
                    out.write(self.head + value)
                else:
                    out.write(self.separator + value)
            if out is not None:
                out.write(self.tail)
        finally:
            if out is not None:
                out.close()
        return Written(posixpath.basename(folder))

    def commit(self, messages: list) -> None:
        files, root = opened(self.root)
        folders = [posixpath.join(root, self.staging, m.folder) for m in messages if m is not None]
        try:
            for names in self._named(files, folders):  # all are looked at before any is moved
                taken = [t for _, t in names if not self.overwrite and files.get_file_info(posixpath.join(root, t)).type != fs.FileType.NotFound]
                if taken:
                    raise FileExistsError(f"{taken[0]} is there already; overwrite replaces it")
            with ThreadPoolExecutor(MOVES) as pool:
                for names in self._named(files, folders):
                    for folder in {posixpath.dirname(t) for _, t in names}:  # once for all of its files
                        files.create_dir(posixpath.join(root, folder), recursive=True)
                    list(pool.map(lambda n: files.move(n[0], posixpath.join(root, n[1])), names))
        finally:
            self._clear(files, root)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.root))

    def _named(self, files: fs.FileSystem, folders: list[str]) -> Iterator[list[tuple[str, str]]]:
        """(path, path below the root) of the tasks' files, some thousands at a time."""
        names = []
        for folder in folders:
            for info in files.get_file_info(fs.FileSelector(folder, recursive=True)):
                if info.type == fs.FileType.File:
                    names.append((info.path, posixpath.relpath(info.path, folder)))
                if len(names) >= NAMES_AT_ONCE:
                    yield names
                    names = []
        yield names

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        staging = posixpath.join(root, self.staging)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class NamedFiles(DataSource):
    """Rows (path, value). Options: path (the root), head, separator and tail of each file. Appending refuses names that exist; overwriting replaces them and leaves other files alone."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options, overwrite)


def write_named(rows: DataFrame, root: str, head: str = "", separator: str = "", tail: str = "", overwrite: bool = True) -> None:
    """A file root/path for each path of rows (path, ordinal, value), with its values by ordinal, ties by value, between head and tail. Null values are
    empty; paths that are null, empty or leave the root are refused. Without rows nothing is written."""
    rows.sparkSession.dataSource.register(NamedFiles)
    dealt = rows.select("path", "ordinal", "value").repartition("path").sortWithinPartitions("path", "ordinal", "value").select("path", "value")
    dealt.write.format("named_files").mode("overwrite" if overwrite else "append").options(head=head, separator=separator, tail=tail).save(root)
