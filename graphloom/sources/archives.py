"""Repository archives: gzipped tars to one row an entry."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

MOST_BYTES, MOST_FILES = 2 << 30, 200_000
BATCH_BYTES = 4 << 20
ENTRIES = "archive string, path string, kind string, size long, content binary, skipReason string, error string"
FIELDS = [x.split()[0] for x in ENTRIES.split(", ")]
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]


class Refused(Exception):
    """The whole archive is refused; the message begins with a code."""


class _Counted(io.RawIOBase):
    """A stream that ends the reading after a number of decompressed bytes."""

    def __init__(self, inner, most: int):
        self.inner, self.left = inner, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.inner.read(len(buffer))
        self.left -= len(data)
        if self.left < 0:
            raise Refused("REPO_TOO_LARGE: the archive exceeds its byte limit")
        buffer[: len(data)] = data
        return len(data)


def strip_top(name: str) -> str | None:
    name = name.removeprefix("./")
    return name.split("/", 1)[1] if "/" in name else None


def valid_path(path: str) -> bool:
    reserved = re.compile(P.RESERVED_NAMES.removeprefix("(?i)"), re.I)
    return all(part and not re.search(r"[\x00-\x1f\x7f]", part) and not reserved.match(part) for part in path.split("/"))


def escapes(path: str) -> bool:
    depth = 0
    for part in path.split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return True
    return depth == 0


def explode_archive(data, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> Iterator[tuple]:
    """(path, kind, size, body, skipReason) of each entry, as it is read; raises Refused.

    The body of a file is a stream that must be read before the next entry is asked for.
    """
    stream = io.BufferedReader(_Counted(gzip.GzipFile(fileobj=data), most_bytes))
    with tarfile.open(fileobj=stream, mode="r|") as tar:
        n = 0
        while (entry := tar.next()) is not None:
            n += 1
            tar.members.clear()  # else the headers of all entries stay
            if n > most_files:
                raise Refused("REPO_TOO_LARGE: the archive exceeds its file limit")
            if entry.size > most_bytes:
                raise Refused("REPO_TOO_LARGE: an entry exceeds the byte limit")
            if entry.name.startswith(("/", "\\")) or re.match(r"[a-zA-Z]:", entry.name):
                raise Refused("UNSAFE_ARCHIVE: an absolute path")
            path = strip_top(entry.name)
            if path == "" or (path is None and entry.isdir()):
                continue
            reason = (
                "NO_TOP_LEVEL_PREFIX" if path is None else "SYMLINK" if entry.issym() else "HARDLINK" if entry.islnk()
                else "UNSUPPORTED_ENTRY_TYPE" if not (entry.isreg() or entry.isdir()) else None
            )
            if reason is None and escapes(path):
                raise Refused("UNSAFE_ARCHIVE: a path leaves the archive")
            if reason is None and not valid_path(path.rstrip("/")):
                reason = "INVALID_FILENAME"
            if reason:
                yield path if path is not None else entry.name, "skipped", entry.size, None, reason
            elif entry.isreg():
                yield path, "file", entry.size, tar.extractfile(entry), None
    while stream.read(BATCH_BYTES):  # what follows the last entry counts as well
        pass


def explode_archives(archives: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """Entries of each archive of (path, content); a refused archive is one row with its error.

    Entries are streamed in batches of a few MB.  An archive is refused as a whole: its
    entries before the fault are dropped by ``accepted``.  Archives that are too large for a
    row are read by ``stream_archives``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for path, kind, n, body, reason in explode_archive(pa.BufferReader(content.as_buffer()), most_bytes, most_files):
                        rows.append((name, path, kind, n, body and body.read(), reason, None))
                        size += n if body else 0
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], FIELDS)
                            rows, size = [], 0
                except (Refused, tarfile.TarError, EOFError, OSError) as e:
                    rows.append((name, None, "refused", None, None, None, str(e) if isinstance(e, Refused) else f"UNSAFE_ARCHIVE: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], FIELDS)

    return archives.select("path", "content").mapInArrow(run, ENTRIES)


def accepted(entries: DataFrame, kinds: tuple[str, ...] = ("file",)) -> DataFrame:
    """Entries of some kinds, files unless told otherwise, of archives that were not refused."""
    refused = entries.where("kind = 'refused'").select("archive").distinct()
    return entries.where(F.col("kind").isin(*kinds)).join(refused, "archive", "left_anti")


def skip_histogram(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'skipped'").groupBy("skipReason").agg(F.count("*").alias("entries"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("path", "content")


def _system(root: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root) else (fs.LocalFileSystem(), root)
    return system, base.rstrip("/")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below a folder as (path, size), paths relative to it.

    Spark's own file sources leave out empty files and names that begin with a dot or an
    underscore.  The driver lists the folder itself; tasks list the folders in it, and then those in
    these to any depth, so no one lists a whole tree.
    """
    from pyarrow import fs

    listing = "path string, size long, folder boolean"

    def entries(folder: str, recursive: bool) -> list[tuple[str, int | None, bool]]:
        system, base = _system(root)
        found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=recursive))
        found = [f for f in found if f.type == fs.FileType.File or (f.type == fs.FileType.Directory and not recursive)]
        return [(f.path[len(base) + 1 :], f.size, f.type == fs.FileType.Directory) for f in found]

    def below(recursive: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    columns = list(zip(*entries(folder, recursive), strict=True)) or [(), (), ()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "size", "folder"])

        return run

    top = spark.createDataFrame(entries("", False), listing)
    width = spark.sparkContext.defaultParallelism
    second = top.where("folder").select("path").repartition(width).mapInArrow(below(False), listing)
    deep = second.where("folder").select("path").repartition(width).mapInArrow(below(True), listing)
    return top.unionByName(second).unionByName(deep).where("NOT folder").select("path", "size")


def with_content(files: DataFrame, root: str, wanted: Column) -> DataFrame:
    """Adds the content of those files of (path, size) below ``root`` that are ``wanted``; others are not opened.

    Files are dealt over all cores and read in batches of a few MB; one of 2 GB or more does not fit in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        names, types = ["path", "size", "_wanted", "content"], [pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        rows, held = [], 0
        for batch in batches:
            for path, size, open_it in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = None
                if open_it:
                    with system.open_input_stream(f"{base}/{path}", compression=None) as stream:
                        body = stream.read()
                    held += len(body)
                rows.append((path, size, open_it, body))
                if held > BATCH_BYTES or len(rows) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    dealt = files.select("path", "size", wanted.alias("_wanted")).repartition(files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "path string, size long, _wanted boolean, content binary").drop("_wanted")


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Regular files below a folder as (path, size[, content]), paths relative to it.

    Without ``content`` only the listing is read, which is enough to count what is ignored.
    """
    listed = list_tree(spark, root)
    return with_content(listed, root, F.lit(True)) if content else listed


def read_kept(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below a folder as (path, size, hardIgnored, content); ignored ones are listed but not opened."""
    ignored = P.is_hard_ignored(F.col("path"))
    return with_content(list_tree(spark, root), root, ~ignored).select("path", "size", ignored.alias("hardIgnored"), "content")
