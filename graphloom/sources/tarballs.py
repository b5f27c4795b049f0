"""A data source of archives by path: entries are streamed where the task runs, whatever an archive's size.

Every archive is read twice.  The first reading keeps nothing but one digest a file and tells
whether the archive is refused, so the second gives out rows of good archives only and nothing has
to be taken back.  Bodies come in chunks; a task holds one batch, however long an entry is.
An archive is one gzip stream and cannot be split, so a partition is one archive or several small ones.

Defined results: a refused or unreadable archive is one row with its error; an empty file has one
chunk without bytes; entries of one name are rows of their own, told apart by ``entry``; a
folder without archives gives no rows.
"""

from __future__ import annotations

import hashlib
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import BATCH_BYTES, MOST_BYTES, MOST_FILES, Refused, explode_archive

CHUNK_BYTES = 1 << 20
PARTITION_BYTES = 64 << 20
SCHEMA = "archive string, entry long, path string, kind string, size long, hash string, chunk long, content binary, skipReason string, error string"
ARROW = pa.schema([
    ("archive", pa.string()), ("entry", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("hash", pa.string()),
    ("chunk", pa.int64()), ("content", pa.binary()), ("skipReason", pa.string()), ("error", pa.string()),
])


class Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def inspect(system: fs.FileSystem, path: str, most_bytes: int, most_files: int, chunk_bytes: int) -> tuple[list[str], str | None]:
    """(digests of the files in their order, the error that refuses the archive)."""
    digests = []
    try:
        with system.open_input_stream(path, compression=None) as data:
            for _, _, _, body, _ in explode_archive(data, most_bytes, most_files):
                if body:
                    digest = hashlib.sha256()
                    while block := body.read(chunk_bytes):
                        digest.update(block)
                    digests.append(digest.hexdigest())
    except Refused as e:
        return [], str(e)
    except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
        return [], f"UNSAFE_ARCHIVE: {e}"
    return digests, None


def stream_entries(system: fs.FileSystem, path: str, most_bytes: int, most_files: int, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of SCHEMA of one archive; none but the refusal if it is refused."""
    name = path.rsplit("/", 1)[-1]
    digests, error = inspect(system, path, most_bytes, most_files, chunk_bytes)
    if error:
        yield name, None, None, "refused", None, None, None, None, None, error
        return
    hashes = iter(digests)
    with system.open_input_stream(path, compression=None) as data:
        for n, (inner, kind, size, body, reason) in enumerate(explode_archive(data, most_bytes, most_files)):
            if body is None:
                yield name, n, inner, kind, size, None, None, None, reason, None
                continue
            digest, chunk = next(hashes), 0
            block = body.read(chunk_bytes)
            while True:
                yield name, n, inner, kind, size, digest, chunk, block, None, None
                block, chunk = body.read(chunk_bytes), chunk + 1
                if not block:
                    break


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        number = lambda name, default: int(options.get(name, default))
        self.limits = number("most_bytes", MOST_BYTES), number("most_files", MOST_FILES), number("chunk_bytes", CHUNK_BYTES)
        self.partition_bytes = number("partition_bytes", PARTITION_BYTES)
        self.tasks = number("tasks", 1)
        self.suffix = options.get("suffix", ".tar.gz")

    def partitions(self) -> list[InputPartition]:
        system, base = fs.FileSystem.from_uri(self.folder)
        found = [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and x.path.endswith(self.suffix)]
        plan: list[list[str]] = []
        most, room = min(self.partition_bytes, -(-sum(x.size for x in found) // self.tasks)), 0
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            if x.size > room:
                plan.append([])
                room = most
            plan[-1].append(x.path)
            room -= x.size
        return [Archives(paths) for paths in plan]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
        rows, size = [], 0
        for path in partition.paths if partition else ():
            for row in stream_entries(system, path, *self.limits):
                rows.append(row)
                size += 256 + len(row[7] or b"")
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class TarballSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarballs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def stream_archives(spark: SparkSession, folder: str, **options: int | str) -> DataFrame:
    """The entries of all archives below a folder, bodies in chunks.

    Options: most_bytes and most_files refuse an archive, chunk_bytes cuts bodies, partition_bytes
    gathers small archives, as long as all cores (``tasks``) have some.  ``folder`` must be on a store that tasks can open by path.
    """
    spark.dataSource.register(TarballSource)
    options = {"tasks": spark.sparkContext.defaultParallelism} | options
    return spark.read.format("tarballs").options(**{k: str(v) for k, v in options.items()}).load(folder)


def small_files(entries: DataFrame, most: int) -> DataFrame:
    """Whole bodies of the files of at most so many bytes, in the columns of ``archives.explode_archives``.

    Other entries and longer files keep their row, without content: an index skips what is over its limit.
    """
    none = F.lit(None).cast("binary")
    part = F.when(F.col("size") <= most, F.col("content")).otherwise(none)
    rows = entries.where(F.coalesce("chunk", F.lit(0)).eqNullSafe(0) | (F.col("size") <= most)).withColumn("content", part)
    keys = ["archive", "entry", "path", "kind", "size", "skipReason", "error"]
    chunks = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("chunk", "content"))))
    joined = F.aggregate(chunks, F.lit(b""), lambda whole, c: F.concat(whole, c.content))
    whole = rows.groupBy(*keys).agg(F.when(F.size(chunks) > 0, joined).alias("content"))
    return whole.select("archive", "path", "kind", "size", "content", "skipReason", "error")
