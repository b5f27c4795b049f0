"""A streaming source of append-only delivery logs with byte offsets.

A receiver appends one JSON line a delivery to files ``<shard>-<number>.log``; a file with a later
number closes the earlier ones of its shard.  The offset is, a shard, the newest file and how many
of its bytes are whole lines, so it grows with the shards and not with the files.  What lies between
two offsets is fixed, so a batch that is repeated reads the same bytes: no line is lost or read twice.

Defined results: a line that is still being written waits for its end; the last line of a closed
file needs none; an empty line is skipped; a line that is no JSON object is a delivery
without headers, which admission refuses; a missing folder is an empty one.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
TAIL = 64 << 10
SCHEMA = "file string, position long, line binary"
NAME = re.compile(r"(.+)-(\d+)\.log")
ENTRY = "deliveryId string, eventType string, signature string, body string, receivedAt timestamp"


class Range(InputPartition):
    """Lines that begin at ``start`` or later and before ``end``."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def whole_lines(system: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The end of the last whole line of a file, ``start`` if there is none after it."""
    with system.open_input_file(path) as data:
        end = size
        while end > start:
            begin = max(start, end - TAIL)
            data.seek(begin)
            at = data.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def lines_of(data, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line without its end) of the lines that begin in [start, end)."""
    data.seek(max(0, start - 1))
    lines = io.BufferedReader(data, 1 << 20)
    at = start
    if start:
        at = start - 1 + len(lines.readline())  # the rest of a line that began earlier, or the end of the one before
    while at < end and (line := lines.readline()):
        body = line.rstrip(b"\r\n")
        if body:
            yield at, body
        at += len(line)


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def _files(self) -> dict[str, list[tuple[int, str, int]]]:
        """(number, path, size) of the files of each shard, in order."""
        system, base = fs.FileSystem.from_uri(self.folder)
        shards: dict[str, list[tuple[int, str, int]]] = {}
        for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = NAME.fullmatch(x.base_name)
            if x.is_file and name:
                shards.setdefault(name[1], []).append((int(name[2]), x.path, x.size))
        return {shard: sorted(found) for shard, found in shards.items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = fs.FileSystem.from_uri(self.folder)
        return {shard: [files[-1][0], whole_lines(system, files[-1][1], 0, files[-1][2])] for shard, files in sorted(self._files().items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found, plan = self._files(), []
        for shard, (last, upto) in end.items():
            first, begin = start.get(shard, (-1, 0))
            for number, path, size in found.get(shard, ()):
                if first <= number <= last:
                    a, b = begin if number == first else 0, upto if number == last else size
                    plan += [Range(path, k, min(k + self.range_bytes, b)) for k in range(a, b, self.range_bytes)]
        return plan

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        batch = lambda rows: pa.RecordBatch.from_pydict({"file": pa.array([name] * len(rows), pa.string()), "position": pa.array([r[0] for r in rows], pa.int64()), "line": pa.array([r[1] for r in rows], pa.binary())})
        rows, size = [], 0
        with system.open_input_file(partition.path) as data:
            for row in lines_of(data, partition.start, partition.end):
                rows.append(row)
                size += 64 + len(row[1])
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    def commit(self, end: dict) -> None:
        pass


class DeliveryLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delivery_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


def read_lines(spark: SparkSession, folder: str, **options: int | str) -> DataFrame:
    """(file, position, line) of the logs in a folder, as a stream."""
    spark.dataSource.register(DeliveryLog)
    return spark.readStream.format("delivery_log").options(**{k: str(v) for k, v in options.items()}).load(folder)


def deliveries(lines: DataFrame) -> DataFrame:
    """Lines as ``ledger.admit`` takes them; bodies are base64 in the log, so a signature is over the bytes that came."""
    entry = F.from_json(F.col("line").cast("string"), ENTRY)
    rows = lines.select(entry.alias("e")).select("e.*")
    return rows.select("deliveryId", "eventType", "signature", F.try_to_binary("body", F.lit("base64")).alias("body"), "receivedAt")
