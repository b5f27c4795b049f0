"""Media columns: payloads as images in archives, read by a custom Spark data source.

``write_archives`` stores each payload as an 8-bit RGB PNG, 64 pixels (192 bytes) a row, as
one member of a ZIP archive in the shared folder.  The data source ``media_archive`` plans
byte ranges over the archives of a folder, finds a range's members in the archive's own
directory, streams them in Arrow batches, and retries each member by its offset.

Defined results: a null text is an empty one, whose payload is one row of blanks; repeated
rows are members of their own; a text of any length is one member, stored whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..partitions import spread
from .store import fresh_path

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 128 << 20, 4 << 20  # an archive has two ranges, so its directory is read twice
MANIFEST = "_manifest.json"


def filesystem(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // ROW)) * ROW
    return raw.ljust(size, b" "), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != ROW // 3 or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not an 8-bit RGB image of 64 pixels a row")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered scan lines are not supported")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean in hundredths, mean square, and a 64-bit average hash over 64 stretches of the samples.

    All sums are of integers below 2**53, so they are exact in any order.
    """
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64)
    sizes = np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = cells * len(x) > int(x.sum(dtype=np.int64)) * sizes
    wide = x.astype(np.float64)
    squares = int(np.dot(wide, wide))
    mean = int(x.sum(dtype=np.int64)) * 100 // len(x)
    return f"m{mean}-v{squares // len(x)}-h{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write the payloads of all rows to archives in ``folder``; returns the archives' names.

    Each task attempt writes files of its own, and only the files of successful attempts reach
    the manifest: one short row an archive is what the driver gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        sink = archive = None
        size = count = 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal sink, archive, size, count
            if archive is not None:
                archive.close()
                sink.close()
                done[-1] = (done[-1][0], count, size)
                sink = archive = None

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    done.append((name, 0, 0))
                    sink = system.open_output_stream(f"{base}/{name}")
                    archive, size, count = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0, 0
                payload, n = payload_of(text.as_py())
                media = to_png(payload)
                archive.writestr(zipfile.ZipInfo(f"{count}/{doc_id.as_py()}/{n}.png"), media)
                size, count = size + len(media), count + 1
                if size >= archive_bytes:
                    close()
        close()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "members", "bytes"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = spread(source).mapInArrow(run, "archive string, members long, bytes long").collect()
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    names = sorted(r.archive for r in rows)
    with system.open_output_stream(f"{base}/{MANIFEST}") as f:
        f.write(json.dumps(names).encode())
    return names


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


def read_member(open_at, offset: int, size: int, crc: int, retries: int, wait: float = 0.05) -> tuple[bytes | None, int, str | None]:
    """(bytes, attempts, error) of one stored member; each attempt opens and seeks anew after a fault."""
    error = None
    for attempt in range(1, retries + 2):
        try:
            f = open_at(attempt > 1)
            f.seek(offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no local header")
            name, extra = struct.unpack_from("<HH", head, 26)
            f.seek(offset + 30 + name + extra)
            data = f.read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError("short or damaged member")
            return data, attempt, None
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                time.sleep(wait * 2 ** (attempt - 1))
    return None, retries + 1, error


class ArchiveReader(DataSourceReader):
    """options: path; rangebytes; retries; onerror = ``raise`` or ``row`` (a row with the error and no media)."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("onerror", "raise")

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        system, base = filesystem(self.path)
        if system.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{base}/{MANIFEST}") as f:
                names = json.loads(f.read())
            files = system.get_file_info([f"{base}/{n}" for n in names])
        else:
            files = [x for x in system.get_file_info(fs.FileSelector(base)) if x.path.endswith(".zip")]
        return [
            ByteRange(x.path, at, min(at + self.range_bytes, x.size))
            for x in sorted(files, key=lambda x: x.path)
            for at in range(0, x.size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, _ = filesystem(self.path)
        handle = system.open_input_file(partition.archive)

        def open_at(again: bool):
            nonlocal handle
            if again:
                handle = system.open_input_file(partition.archive)
            return handle

        with zipfile.ZipFile(handle) as directory:
            members = sorted((m.header_offset, m.file_size, m.CRC, m.filename) for m in directory.infolist() if partition.start <= m.header_offset < partition.end)
        rows, size = [], 0
        for offset, length, crc, name in members:
            data, attempts, error = read_member(open_at, offset, length, crc, self.retries)
            if error and self.on_error == "raise":
                raise OSError(f"{partition.archive} at {offset}: {error}")
            rows.append((partition.archive, offset, name, data, attempts, error))
            size += length
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "name", "media", "attempts", "error"])


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, attempts int, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, media in zip(batch.column(0), batch.column(1), strict=True):
            _, doc_id, n = name.as_py().removesuffix(".png").split("/")
            media = media.as_py()
            payload = from_png(media)
            rows.append((
                None if doc_id == "None" else int(doc_id), int(n), len(payload), hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload),
            ))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as media, read the stored bytes back and describe them."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "media")
    write_archives(docs, folder)
    return read_archives(spark, folder).select("name", "media").mapInArrow(_describe, SCHEMA)
