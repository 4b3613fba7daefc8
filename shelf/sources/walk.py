"""Every file of a folder tree, whatever its name, by tasks that list folders; as rounds of a batch and as a stream.

Spark's own file sources leave out names that start with ``_``. Here folders are rows: a round lists all folders of a level
in tasks, and the folders found are the next round's rows, so neither names nor folders pass through the driver.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shelf.session import spread, write_down

ENTRY = "path string, folder boolean, mtime timestamp, length bigint, appeared bigint"
#: Stores that tasks reach by themselves, with the names that Hadoop has for them.
SCHEMES = {"": "", "file": "", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
MIN_PARTS = 64


def reachable(root: str) -> bool:
    """Tasks can list and open what is below ``root`` without the JVM."""
    return urlsplit(root).scheme in SCHEMES


def local_path(path: str) -> str | None:
    """The path of a file of this machine or a mounted folder, else None."""
    parts = urlsplit(path)
    if parts.scheme == "file":
        return (path[len("file://") + len(parts.netloc) :] if path.startswith("file://") else path[len("file:") :]) or "/"
    return path if parts.scheme == "" else None


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as fs

    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{rest}")


def _moment(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1e6, timezone.utc)


def entries(folder: str) -> Iterator[tuple[str, bool, int, int, int]]:
    """(path, is a folder, change time and time of appearance in microseconds, length) of what a folder holds.

    Names that start with ``.`` are left out; links to folders are not followed. A folder that may not be listed has no
    entries; a file that cannot be looked at, such as a link to nothing, has length -1. On this machine a file appears when
    its inode last changed, so also one that is moved in with an old change time; in other stores when it was written."""
    here = local_path(folder)
    if here is None:
        import pyarrow.fs as fs

        store, inner = _store(folder)
        prefix = folder.rstrip("/")
        for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if not info.base_name.startswith("."):
                at = (info.mtime_ns or 0) // 1000
                yield f"{prefix}/{info.base_name}", info.type == fs.FileType.Directory, at, info.size or 0, at
        return
    try:
        found = list(os.scandir(here))
    except OSError:
        return
    for e in found:
        if e.name.startswith("."):
            continue
        if e.is_dir(follow_symlinks=False):
            yield os.path.join(here, e.name), True, 0, 0, 0
        elif not e.is_dir():
            try:
                s = e.stat()
            except OSError:
                yield os.path.join(here, e.name), False, 0, -1, 0
                continue
            yield os.path.join(here, e.name), False, s.st_mtime_ns // 1000, s.st_size, max(s.st_mtime_ns, s.st_ctime_ns) // 1000


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            rows = list(entries(folder))
            path, is_folder, mtime, length, appeared = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(path, pa.string()), pa.array(is_folder, pa.bool_()), pa.array(mtime, pa.timestamp("us", "UTC")), pa.array(length, pa.int64()), pa.array(appeared, pa.int64())],
                ["path", "folder", "mtime", "length", "appeared"],
            )


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(full_path, mtime, length) of every file below ``root``: one job per level of folders, each level written down."""
    start = local_path(root)
    start = os.path.abspath(start) if start is not None else root.rstrip("/")
    level, files = spark.createDataFrame([(start,)], "path string"), None
    while True:
        listed = write_down(spread(level).mapInArrow(_list, ENTRY), "level")
        here = listed.filter("not folder").select(F.col("path").alias("full_path"), F.when(F.col("length") >= 0, F.col("mtime")).alias("mtime"), F.when(F.col("length") >= 0, F.col("length")).alias("length"))
        files = here if files is None else files.unionByName(here)
        level = listed.filter("folder").select("path")
        if level.isEmpty():
            return files


class _Part(InputPartition):
    """One folder, with all below it where ``deep``; files that appeared after ``after`` and not after ``until``."""

    def __init__(self, folder: str, deep: bool, after: int, until: int):
        self.folder, self.deep, self.after, self.until = folder, deep, after, until


def split_folders(root: str, least: int = MIN_PARTS) -> tuple[list[str], list[str]]:
    """Folders to list alone, and folders to walk whole: levels are opened until there are ``least`` folders to walk."""
    alone, whole = [], [root]
    while whole and len(whole) < least:
        alone += whole
        whole = [path for folder in whole for path, is_folder, *_ in entries(folder) if is_folder]
    return alone, whole


def _files(part: _Part) -> Iterator[tuple[str, datetime, int]]:
    folders = [part.folder]
    while folders:
        for path, is_folder, mtime, length, appeared in entries(folders.pop()):
            if is_folder:
                if part.deep:
                    folders.append(path)
            elif length >= 0 and part.after < appeared <= part.until:
                yield path, _moment(mtime), length


def _parts(root: str, after: int, until: int) -> list[_Part]:
    alone, whole = split_folders(root)
    return [_Part(f, False, after, until) for f in alone] + [_Part(f, True, after, until) for f in whole]


class _Batch(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        return _parts(self.root, -1, 1 << 62)

    def read(self, partition: _Part) -> Iterator[tuple[str, datetime, int]]:
        return _files(partition)


class _Appearing(DataSourceStreamReader):
    """Offsets are times: a batch has the files that appeared between two of them, so no list of seen files is kept."""

    def __init__(self, root: str, settle: float):
        self.root, self.settle = root, settle

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1e6)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _parts(self.root, start["until"] or -1, end["until"])

    def read(self, partition: _Part) -> Iterator[tuple[str, datetime, int]]:
        return _files(partition)

    def commit(self, end: dict) -> None:
        pass


class FolderFiles(DataSource):
    """``format("folder_files")``: (full_path, mtime, length) below the folder of option ``path``; partitions are folders."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "full_path string, mtime timestamp, length bigint"

    def _root(self) -> str:
        root = self.options["path"]
        here = local_path(root)
        return os.path.abspath(here) if here is not None else root.rstrip("/")

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self._root())

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Appearing(self._root(), float(self.options.get("settle", "0.1")))


def file_bytes(path: str, offset: int = 0, n: int | None = None) -> bytes:
    """``n`` bytes of a file from ``offset``, or all of them; for use in tasks."""
    here = local_path(path)
    if here is not None:
        with open(here, "rb") as f:
            f.seek(offset)
            return f.read() if n is None else f.read(n)
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        f.seek(offset)
        return f.read() if n is None else f.read(n)


def write_bytes(path: str, raw: bytes) -> None:
    """Write a file, with the folders above it; for use in tasks. A file that is there is replaced."""
    here = local_path(path)
    if here is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        part = f"{here}.{os.getpid()}.tmp"
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, here)
        return
    store, inner = _store(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(raw)
