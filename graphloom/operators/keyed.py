"""State tables by key as delta segments: what changed is written, not the table.

A table is a list of segments, newest first for a key.  Each segment has its rows, dealt into
ranges of the keys' hashes, and beside them a Bloom filter by words of 64 bits, dealt alike.  A
look-up reads the filters' words that its keys hit, then only segments that may hold one of them,
and of those only the ranges.  Segments of a level are merged into one of the next, so there are
few of them however many changes there were, and a row is rewritten once a level.

Writers commit by ``versions``: a change that was made from an old version runs again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Versions
from . import state

FAN = 8  # segments of a level before they are merged
KEYS_A_WORD = 4  # 16 bits a key, three of them set: one miss in about 100 is opened
RANGE_WORDS = 1 << 18  # a range has about a million keys
MOST_RANGES = 4096  # that are named one by one in a filter; more are all read
GONE = "_gone"


class Segment(NamedTuple):
    path: str
    rows: int
    words: int
    level: int
    first: int  # the tags, of batches or versions, that it holds
    last: int


class KeyedTable:
    """A table below ``folder`` with the columns of ``schema`` and one row for each value of ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str], fan: int = FAN):
        self.spark, self.root, self.keys, self.fan = spark, folder.rstrip("/"), list(keys), fan
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.versions = Versions(spark, folder)

    # Reading

    def segments(self, before: int | None = None) -> list[Segment]:
        """Of the newest version, oldest first; ``before``: without those of later tags."""
        return _listed(self.versions.latest()[1], before)

    def snapshot(self, segments: list[Segment] | None = None) -> DataFrame:
        """All rows, the newest of each key."""
        return self._newest([self._rows(s, None) for s in (self.segments() if segments is None else segments)])

    def rows_of(self, wanted: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        """The newest rows of the keys of ``wanted``."""
        keys = wanted.select(*self.keys).distinct()
        found, ranges = self.opened(keys, self.segments() if segments is None else segments)
        here = [self._rows(s, ranges.get(n)) for n, s in found]
        same = lambda rows: reduce(lambda a, b: a & b, (rows[k].eqNullSafe(keys[k]) for k in self.keys))
        return self._newest([rows.join(keys, same(rows), "left_semi") for rows in here])

    def opened(self, keys: DataFrame, segments: list[Segment]) -> tuple[list[tuple[int, Segment]], dict[int, list[int]]]:
        """(numbered segments that may hold some of the keys, the ranges to read of each; all where none are named)."""
        if not segments:
            return [], {}
        hashed = F.xxhash64(*self.keys)
        ask = [F.struct(F.lit(n).alias("n"), F.pmod(hashed, F.lit(s.words)).alias("word")) for n, s in enumerate(segments)]
        asked = keys.select(_mask(hashed).alias("mask"), F.explode(F.array(*ask)).alias("a")).select("mask", "a.*").withColumn("_range", _range("word"))
        named = asked.select("n", "_range").distinct().limit(MOST_RANGES + 1).collect()
        ranges: dict[int, list[int]] = {}
        if len(named) <= MOST_RANGES:
            for r in named:
                ranges.setdefault(r.n, []).append(r["_range"])
        words = [self._part(s, "bloom", "word long, bits long", ranges.get(n)).withColumn("n", F.lit(n)) for n, s in enumerate(segments)]
        bloom = reduce(DataFrame.unionByName, words)
        hits = asked.join(bloom.drop("_range"), ["n", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        may = {r.n for r in hits.select("n").distinct().collect()}  # a number a segment
        return [(n, s) for n, s in enumerate(segments) if n in may], ranges

    def _part(self, segment: Segment, name: str, schema: str | T.StructType, ranges: list[int] | None) -> DataFrame:
        full = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField("_range", T.IntegerType())])
        rows = self.spark.read.schema(full).parquet(f"{segment.path}/{name}")
        return rows if ranges is None else rows.where(F.col("_range").isin(ranges))

    def _rows(self, segment: Segment, ranges: list[int] | None) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        return self._part(segment, "rows", stored, ranges).drop("_range").withColumn("_tag", F.lit(segment.last))

    def _newest(self, parts: list[DataFrame], gone: bool = False) -> DataFrame:
        """The newest row of each key; with ``gone`` also those that say that a key is gone."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts)
        rest = [c for c in (*self.schema.names, GONE) if c not in self.keys]
        if len(parts) > 1:
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_tag").alias("_r")).select(*self.keys, "_r.*")
        return rows.select(*self.schema.names, GONE) if gone else rows.where(~F.col(GONE)).select(*self.schema.names)

    # Writing

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> Segment | None:
        """A segment of rows with GONE; nothing names it before it is committed."""
        rows = rows.withColumn("_h", F.xxhash64(*self.keys)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = rows.count()
            if not n:
                return None
            words = max(64, 1 << (n // KEYS_A_WORD).bit_length())
            path = f"{self.root}/segments/{last:012}-{uuid.uuid4().hex}"
            placed = rows.withColumn("_w", F.pmod(F.col("_h"), F.lit(words)))
            deal = lambda df: df.repartition("_range") if words > RANGE_WORDS else df.coalesce(1)
            deal(placed.withColumn("_range", _range("_w"))).drop("_h", "_w").write.partitionBy("_range").parquet(f"{path}/rows")
            bloom = placed.groupBy(F.col("_w").alias("word")).agg(F.bit_or(_mask(F.col("_h"))).alias("bits")).withColumn("_range", _range("word"))
            deal(bloom).write.partitionBy("_range").parquet(f"{path}/bloom")
            return Segment(path, n, words, level, first, last)
        finally:
            rows.unpersist()

    def _merged(self, segments: list[Segment], before: int) -> list[Segment]:
        """Segments whose tags all lie before another, merged wherever a level has FAN of them."""
        level = 0
        while level <= max((s.level for s in segments), default=-1):
            full = [s for s in segments if s.level == level and s.last < before]
            if len(full) >= self.fan:
                oldest = min(s.first for s in full) <= min(s.first for s in segments)
                rows = self._newest([self._rows(s, None) for s in full], gone=True)
                made = self._write(rows.where(~F.col(GONE)) if oldest else rows, level + 1, min(s.first for s in full), max(s.last for s in full))
                segments = [s for s in segments if s not in full] + ([made] if made else [])
            level += 1
        return sorted(segments, key=lambda s: (s.last, -s.level))

    def put(self, rows: DataFrame, tag: int, gone: Column | None = None) -> list[Segment]:
        """The rows of batch ``tag``, in the place of what it had put before; ``gone``: which keys are deleted.

        Batches come in order: only earlier ones are merged, so that the last can be repeated.
        """
        made = self._write(self._stored(rows, gone), 0, tag, tag)

        def change(manifest):
            segments = [s for s in _listed(manifest) if (s.first, s.last) != (tag, tag)]
            if any(s.last >= tag for s in segments):
                raise ValueError(f"batch {tag} comes after later ones")
            return [*self._merged(segments, tag), *([made] if made else [])]

        return _listed(self.versions.update(change)[1])

    def change(self, delta: Callable[[list[Segment]], DataFrame | None], attempts: int = 20) -> int:
        """Commit the rows that ``delta`` makes from the segments of a version as the next; again if others were first.

        Returns how many rows changed; none where ``delta`` is None or empty, and no version is made.
        """
        count = 0

        def step(manifest):
            nonlocal count
            segments = _listed(manifest)
            tag = max((s.last for s in segments), default=0) + 1
            rows = delta(segments)
            made = None if rows is None else self._write(self._stored(rows, F.col(GONE) if GONE in rows.columns else None), 0, tag, tag)
            count = made.rows if made else 0
            return [*self._merged(segments, tag), made] if made else None

        self.versions.update(step, attempts)
        return count

    def upsert(self, changes: DataFrame, update: Sequence[str]) -> int:
        """Insert or update by key: only the rows of changed keys are read and written."""
        return self.change(lambda segments: state.upsert(self.rows_of(changes, segments), changes, self.keys, update))

    def update_from(self, values: DataFrame, columns: Sequence[str]) -> int:
        """UPDATE ... FROM (VALUES ...) by the single key; keys that are not there change nothing."""
        return self.change(lambda segments: state.update_from(self.rows_of(values, segments), values, self.keys[0], columns))

    def guarded_update(self, guard: Column, values: dict[str, Column]) -> int:
        """Set columns where the guard holds and return how many rows it held for, decided on one version."""
        return self.change(lambda segments: self.snapshot(segments).where(guard).withColumns(values))

    def acquire_lock(self, guard: Column) -> int:
        """Compare and set: of several writers one gets each lockable row, the others count none."""
        return self.guarded_update(guard & state.can_lock(F.col("indexStatus")), {"indexStatus": F.lit("INDEXING")})

    def delete(self, guard: Column) -> int:
        return self.change(lambda segments: self.snapshot(segments).where(guard).withColumn(GONE, F.lit(True)))

    def replace(self, guard: Column, rows: DataFrame) -> int:
        """Full replacement of the rows of a guard (a repository's) by others, in one version."""

        def delta(segments):
            old = self.snapshot(segments).where(guard).select(*self.schema.names)
            same = [old[k].eqNullSafe(rows[k]) for k in self.keys]
            left = old.join(rows.select(*self.keys), reduce(lambda a, b: a & b, same), "left_anti").withColumn(GONE, F.lit(True))
            return left.unionByName(rows.select(*self.schema.names).withColumn(GONE, F.lit(False)))

        return self.change(delta)

    def vacuum(self) -> list[str]:
        """Delete segments that no kept version names, nor is being written after it; returns their names."""
        numbers = self.versions.numbers()
        manifests = [_listed(self.versions.read(n)) for n in numbers]
        used = {s.path.rsplit("/", 1)[1] for m in manifests for s in m}
        newest = max((s.last for s in manifests[-1]), default=-1) if manifests else -1
        from ..sources.versions import Folder

        folder = Folder(self.spark, f"{self.root}/segments")
        stale = [n for n in folder.names() if n not in used and int(n.split("-")[0]) < newest]
        for n in stale:
            folder.delete(n)
        return stale

    def _stored(self, rows: DataFrame, gone: Column | None) -> DataFrame:
        made = rows.withColumn(GONE, F.lit(False) if gone is None else gone)
        return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields), GONE)


def _listed(manifest, before: int | None = None) -> list[Segment]:
    segments = [Segment(*x) for x in manifest or []]
    return segments if before is None else [s for s in segments if s.last < before]


def _mask(hashed: Column) -> Column:
    """Three bits of a word, by a second hash."""
    again = F.xxhash64(hashed, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(again, k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(16)).bitwiseOR(bit(32))


def _range(word: str) -> Column:
    return F.floor(F.col(word) / RANGE_WORDS).cast("int")
