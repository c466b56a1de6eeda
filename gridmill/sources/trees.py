"""Folders and archives as Spark data sources."""

from __future__ import annotations

import gzip
import io
import json
import os
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How each kind of entry that is no regular file is called.
KINDS = ((stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISFIFO, "FIFO"), (stat.S_ISSOCK, "socket"), (stat.S_ISCHR, "character device"), (stat.S_ISBLK, "block device"))


def kind_of(mode: int) -> str:
    return next((name for test, name in KINDS if test(mode)), "file")


def open_file(path: str) -> BinaryIO:
    """A file's bytes as a stream: a plain path, or a URI of a store that pyarrow reads."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside)


def list_entries(entries: list[str], report_dirs: bool = False, skip_win_hidden: bool = False) -> Iterator[tuple[str, str, str, str | None]]:
    """fn (resolved), origfn, code (NONE or SKIP), msg of each entry; a resolved path once, links apart."""
    seen: set[str] = set()
    for entry in entries:
        status = os.lstat(entry)
        kind, hidden = kind_of(status.st_mode), getattr(status, "st_file_attributes", 0) & stat.FILE_ATTRIBUTE_HIDDEN
        if kind == "symlink":
            yield entry, entry, "SKIP", f"link to {os.readlink(entry)}"
            continue
        if skip_win_hidden and hidden:
            yield entry, entry, "SKIP", "hidden"
            continue
        real = os.path.realpath(entry)
        if real in seen:
            continue
        seen.add(real)
        if kind == "file":
            yield real, entry, "NONE", None
        elif kind != "directory" or report_dirs:
            yield real, entry, "SKIP", f"a {kind}"


def below(path: str) -> list[str]:
    """All entries below a folder, or the path itself if it is none."""
    if not os.path.lexists(path):
        raise FileNotFoundError(path)
    return [os.path.join(d, n) for d, dirs, names in os.walk(path) for n in sorted(dirs + names)] if os.path.isdir(path) and not os.path.islink(path) else [path]


def list_files(path: str, report_dirs: bool = False) -> Iterator[tuple[str, str, str, str | None]]:
    yield from list_entries(below(path), report_dirs)


#: Folders into which the listing of a tree is split, and single entries that a task looks at.
TREE_PARTS, PART_ENTRIES = 64, 1000


def roots_of(paths: list[str]) -> list[str]:
    """The paths without repeated ones and without those inside another."""
    real = {}
    for p in paths:
        if not os.path.lexists(p):
            raise FileNotFoundError(p)
        real.setdefault(os.path.abspath(p) if os.path.islink(p) else os.path.realpath(p), p)
    inside = lambda x: any(x != y and x.startswith(y.rstrip("/") + "/") and not os.path.islink(y) for y in real)
    return [p for x, p in real.items() if not inside(x)]


def split_tree(paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """(entries, folders to walk) of each task: folders are opened here until there are TREE_PARTS of them."""
    entries, folders = [], []
    for p in roots_of(paths):
        (folders if os.path.isdir(p) and not os.path.islink(p) else entries).append(p)
    while folders and len(folders) < TREE_PARTS:
        inner = []
        for folder in folders:
            for x in sorted(os.scandir(folder), key=lambda x: x.name):
                entries.append(x.path)
                if x.is_dir(follow_symlinks=False):
                    inner.append(x.path)
        folders = inner
    size = max(PART_ENTRIES, -(-len(entries) // TREE_PARTS))
    return [(entries[i : i + size], []) for i in range(0, len(entries), size)] + [([], [f]) for f in folders]


class FileTreeDataSource(DataSource):
    """Options report_dirs, skip_win_hidden; path is a folder or file that every executor sees, or paths a JSON list of such."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "fn string, origfn string, code string, msg string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def given_paths(options: dict) -> list[str]:
    given = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    return [p.removeprefix("file://").removeprefix("file:") for p in given]


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = given_paths(options)
        self.flags = options.get("report_dirs", "false") == "true", options.get("skip_win_hidden", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in split_tree(self.paths)] or [InputPartition(([], []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        entries, folders = partition.value
        yield from list_entries(entries + [x for f in folders for x in below(f)], *self.flags)


def list_hashable(spark: SparkSession, paths: list[str], report_dirs: bool = False, skip_win_hidden: bool = False) -> DataFrame:
    """fn, origfn, code, msg of all entries below all paths; a file that several paths lead to comes once."""
    spark.dataSource.register(FileTreeDataSource)
    flag = lambda x: str(x).lower()
    return spark.read.format("file_tree").option("paths", json.dumps(paths)).option("report_dirs", flag(report_dirs)).option("skip_win_hidden", flag(skip_win_hidden)).load()


# Endings of archives.
TARS = (".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz", ".txz", ".tbz")
ARCHIVES = (".zip", *TARS, ".gz")


def archive_entries(names: tuple[str, ...], data: bytes) -> Iterator[tuple[tuple[str, ...], str, bytes | None]]:
    """Chain of names, kind and content of a file and, if it is an archive, of all entries inside, archives in archives too."""
    last = names[-1].lower()
    stream = io.BytesIO(data)
    if last.endswith(".zip") and zipfile.is_zipfile(stream):
        yield names, "archive", None
        with zipfile.ZipFile(stream) as z:
            for info in z.infolist():
                if info.is_dir():
                    yield (*names, info.filename), "directory", None
                else:
                    yield from archive_entries((*names, info.filename), z.read(info))
    elif last.endswith(TARS):
        yield names, "archive", None
        with tarfile.open(fileobj=stream) as t:
            for info in t:
                if info.isfile():
                    yield from archive_entries((*names, info.name), t.extractfile(info).read())
                else:
                    yield (*names, info.name), "directory" if info.isdir() else "symlink" if info.issym() or info.islnk() else kind_of(info.mode), None
    elif last.endswith(".gz"):
        yield names, "archive", None
        yield from archive_entries((*names, names[-1][:-3].rpartition("/")[2]), gzip.decompress(data))
    else:
        yield names, "file", data


#: Bytes of files that one task opens, about.
ARCHIVE_BYTES = 64_000_000


class ArchiveDataSource(DataSource):
    """All entries below a folder (option path, or paths as a JSON list) and inside archives: names array<string>, kind, content.

    Option content is false to leave the contents of plain files unread.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return "names array<string>, kind string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.content = given_paths(options), options.get("content", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        """Runs of entries that hold about ARCHIVE_BYTES."""
        out, held = [[]], 0
        for p in roots_of(self.paths):
            for entry in below(p):
                status = os.lstat(entry)
                kind = kind_of(status.st_mode)
                size = status.st_size if kind == "file" else 0
                if out[-1] and held + size > ARCHIVE_BYTES:
                    out.append([])
                    held = 0
                out[-1].append((entry, kind))
                held += size
        return [InputPartition(x) for x in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, kind in partition.value:
            if kind != "file":
                yield [path], kind, None
            elif not self.content and not path.lower().endswith(ARCHIVES):
                yield [path], "file", None
            else:
                with open(path, "rb") as f:
                    for names, inner, content in archive_entries((path,), f.read()):
                        yield list(names), inner, content if self.content else None
