"""Collocations: frequent phrases by association, mined with hashed bucket counts.

Pass k over the texts counts the k-word candidates exactly and, beside them, hashes the (k+1)-grams
into buckets.  The buckets that reach the least count come back as a bitmap that is sent to all
tasks: in the next pass a gram is counted only if its bucket's bit is set and both grams within
it, one word shorter, are frequent, which is looked up in a bitmap of hashed frequent grams.  From
the second pass on only grams whose parts passed are put into buckets.  Both bitmaps have a
fixed greatest size; a clash, or a bitmap too small to prune, costs counting and not results.
Counts are kept by the words themselves, in a task by whole numbers for words and grams.

Defined results: a null or empty text has no words and a null language is ``und``; repeated rows
count as often as they occur; null and repeated ids do not matter; a text of any length is counted
whole; ties in score and count are broken by the phrase's bytes; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import spread
from .components import follow
from .hashing import column_bytes, mix, ngrams, pieces, slices
from .store import materialize, plan_bytes

LONGEST, LEAST, FIRST = 5, 100, 2000
UNKNOWN = "und"
TEXT_BYTES = 8 << 20  # of texts counted at once
INPUT_A_BUCKET = 64  # bytes of input for each bucket, up to the most
LEAST_BITS, MOST_BITS = 16, 26  # of bucket numbers: a bitmap has 8 MB at most
PART_BYTES = 16 << 20  # of bucket counts that meet in a task
SALTS = 64

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
SPACE, BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK


class Grams:
    """The words of adjoining texts: their codes, piece and language; hashes of their n-grams."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        kind = KIND[buf]
        word = kind == 0
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[inner] |= word[inner]
        starts = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner - 1] |= word[inner - 1]
        stops = np.flatnonzero(ends) + 1
        self.count = len(starts)
        cuts = np.concatenate([[0], np.cumsum(stops - starts)])
        data = FOLD[buf[word]]
        words = pa.StringArray.from_buffers(self.count, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own, own_cuts = column_bytes(self.words)
        self.hash = slices(own, own_cuts[:-1], own_cuts[1:])[self.code] if self.count else np.empty(0, np.uint64)
        # a piece's number grows with each break and each text
        doc = np.searchsorted(offsets, starts, "right") - 1
        self.piece = np.cumsum(kind == BREAK)[starts] + doc if self.count else np.empty(0, np.int64)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        salts = np.array([int.from_bytes(hashlib.md5(x.encode(), usedforsecurity=False).digest()[:8], "little") for x in self.langs.to_pylist()], np.uint64)
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] if self.count else np.empty(0, np.int64)
        self.salt = mix(salts)[self.lang] if self.count else np.empty(0, np.uint64)

    def inside(self, n: int) -> np.ndarray:
        """Whether the gram of n words at each word lies in one piece; grams cut off by the end are left out."""
        return self.piece[: max(0, self.count - n + 1)] == self.piece[n - 1 :]

    def hashes(self, n: int) -> np.ndarray:
        return ngrams(self.hash, n) ^ self.salt[: max(0, self.count - n + 1)]

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the distinct grams at some words."""
        key, most = self.lang[at], len(self.langs)
        for k in range(n):
            if most * (len(self.words) + 1) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                most = len(at) + 1
            key = key * len(self.words) + self.code[at + k]
            most *= len(self.words)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        parts = [self.words.take(pa.array(self.code[first + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[first])), phrase, pa.array(count.astype(np.int64))], ["lang", "phrase", "n"])


def read_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        buf, offsets = column_bytes(batch.column(1))
        for lo, hi in pieces(offsets, TEXT_BYTES):
            yield Grams(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], batch.column(0).slice(lo, hi - lo))


class Bitmap:
    """A set of hashes, by their highest bits; None holds everything."""

    def __init__(self, bits: int, data: bytes | None):
        self.bits, self.data = bits, None if data is None else np.frombuffer(data, np.uint8)

    def __getstate__(self):
        return self.bits, None if self.data is None else self.data.tobytes()

    def __setstate__(self, state):
        self.__init__(*state)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.ones(len(hashes), bool)
        at = hashes >> np.uint64(64 - self.bits)
        return self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


EVERYTHING = Bitmap(0, None)


class Buckets:
    """Counts by bucket in one task, held at the least count, which is all that matters."""

    def __init__(self, bits: int, least: int, parts: int):
        self.bits, self.least, self.parts = bits, least, parts
        self.counts = np.zeros(1 << bits, np.uint8 if least < 1 << 8 else np.uint64)

    def add(self, hashes: np.ndarray, weight: int = 1) -> None:
        at, n = np.unique(hashes >> np.uint64(64 - self.bits), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n.astype(np.uint64) * np.uint64(weight), np.uint64(self.least)).astype(self.counts.dtype)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(part, counts): all counts of a part, or its positions and counts if that is shorter."""
        width = len(self.counts) // self.parts
        for k in range(self.parts):
            part = self.counts[k * width : (k + 1) * width]
            at = np.flatnonzero(part).astype("<u4")
            if not len(at):
                continue
            sparse = len(at) * (4 + part.itemsize) < part.nbytes
            yield k, b"\1" + at.tobytes() + part[at].tobytes() if sparse else b"\0" + part.tobytes()

    def total(self, rows: list[bytes]) -> bytes:
        """The bits of a part's buckets that reach the least count."""
        kind = self.counts.dtype
        total = np.zeros(len(self.counts) // self.parts, np.uint64)
        for row in rows:
            if row[0]:
                n = (len(row) - 1) // (4 + kind.itemsize)
                at = np.frombuffer(row, "<u4", n, 1)
                total[at] += np.frombuffer(row, kind, n, 1 + 4 * n)
            else:
                total += np.frombuffer(row, kind, len(total), 1)
        return np.packbits(total >= self.least, bitorder="little").tobytes()


PASS = "lang string, phrase string, n long, part int, counts binary"
_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


def _bucket_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    part, counts = zip(*rows, strict=True)
    k = len(rows)
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array(part, pa.int32()), pa.array(counts, pa.binary())], schema=_PASS)


def _pass(n: int, shared, bits: int, least: int, parts: int, more: bool):
    """Exact counts of the n-word candidates and bucket counts of grams of n + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_set, frequent = shared.value
        buckets = Buckets(bits, least, parts) if more else None
        for grams in read_grams(batches):
            taken = grams.inside(n)
            if n > 1:
                at = np.flatnonzero(taken)
                shorter = frequent.holds(grams.hashes(n - 1))
                at = at[shorter[at] & shorter[at + 1]]
                taken = np.zeros(len(taken), bool)
                taken[at[bucket_set.holds(grams.hashes(n)[at])]] = True
            at = np.flatnonzero(taken)
            if not len(at):
                continue
            exact = grams.counted(at, n)
            yield pa.RecordBatch.from_arrays([*exact.columns, pa.nulls(len(exact), pa.int32()), pa.nulls(len(exact), pa.binary())], schema=_PASS)
            if more:
                longer = np.flatnonzero(taken[:-1] & taken[1:])
                longer = longer[grams.inside(n + 1)[longer]]
                if len(longer):
                    buckets.add(grams.hashes(n + 1)[longer])
        if more:
            for row in buckets.rows():
                yield _bucket_batch([row])

    return run


def _bitmap(rows: DataFrame, bits: int, least: int, parts: int) -> Bitmap:
    """The bits of all parts; together 2**bits, so of bounded size."""

    def run(table: pa.Table) -> pa.Table:
        total = Buckets(0, least, 1)
        total.counts, total.parts = np.empty(1 << bits, total.counts.dtype), parts
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([total.total(table.column("counts").to_pylist())], pa.binary())})

    found = rows.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(run, "part int, bits binary").collect()
    data = np.zeros((parts, (1 << bits) // parts // 8), np.uint8)
    for r in found:
        data[r.part] = np.frombuffer(r.bits, np.uint8)
    return Bitmap(bits, data.tobytes())


def _hashed(frequent: DataFrame, n: int, bits: int, parts: int) -> Bitmap:
    """The bitmap of frequent grams of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits, 1, parts)
        for grams in read_grams(batches):
            buckets.add(grams.hashes(n)[::n])
        for row in buckets.rows():
            yield _bucket_batch([row])

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, PASS), bits, 1, parts)


def _bits(size: int, most: int) -> int:
    return min(max(LEAST_BITS, most if size >> most else size.bit_length()), most)


def _words(column: str, lo: Column | int, size: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(column, lo, size))


def counted_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases with at least ``least`` occurrences, (lang, n) of all words)."""
    source = spread(docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    size = plan_bytes(source)
    bits = _bits(size // INPUT_A_BUCKET, most_bits)
    parts = 1
    while parts < 1 << bits - LEAST_BITS + 3 and ((size >> 24) + 1 << bits) // parts > PART_BYTES:
        parts *= 2
    bucket_set = known = EVERYTHING
    tables, totals = [], None
    for n in range(1, longest + 1):
        shared = docs.sparkSession.sparkContext.broadcast((bucket_set, known))
        found = materialize(source.mapInArrow(_pass(n, shared, bits, least, parts, n < longest), PASS), f"grams-{n}")
        exact = found.where("part IS NULL")
        if totals is None:
            totals = materialize(exact.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        frequent = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        frequent = materialize(frequent.select("lang", "phrase", F.lit(n).alias("words"), "n"), f"frequent-{n}")
        tables.append(frequent)
        count = frequent.count()
        if not count:
            break
        if n < longest:
            bucket_set = _bitmap(found, bits, least, parts)
            hashed = _bits(16 * count, most_bits)
            known = _hashed(frequent, n, hashed, max(1, (1 << hashed) >> 20))
    phrases = tables[0]
    for table in tables[1:]:
        phrases = phrases.unionByName(table)
    return phrases, totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score.

    a, l and r count the phrase, and the parts of the cut that scores least; n all words of the
    language.  Products are decimals of 38 digits, for counts up to 10**17.  Phrases that always
    stand inside one longer phrase go.  The best of a language are ranked in salted parts first.
    """
    phrases, totals = counted_phrases(docs, longest, least, most_bits)
    named = phrases.withColumn("w", F.split("phrase", " "))
    several = named.where("words > 1")
    cut = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select(
        F.struct("lang", "phrase").alias("key"), F.col("n").alias("a"), "cut",
        F.struct("lang", _words("w", 1, F.col("cut")).alias("phrase")).alias("left"), F.struct("lang", _words("w", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("phrase")).alias("right"),
    )
    known = lambda key, n: phrases.select(F.struct("lang", "phrase").alias(key), F.col("n").alias(n))
    cut = follow(follow(cut, "left", known("left", "l")), "right", known("right", "r"))
    cut = follow(cut.withColumn("lang", F.col("key.lang")), "lang", totals)
    wide = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    cut = cut.withColumn("score", F.expr(f"({wide(1000)} * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})"))
    scored = cut.groupBy("key").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("least"))
    # a longer phrase that holds this one as often holds it with one word more, first or last
    longer = several.where("words > 2").select(
        "lang", "n", F.explode(F.array(_words("w", 1, F.col("words") - 1), _words("w", 2, F.col("words") - 1))).alias("phrase")
    ).select(F.struct("lang", "phrase").alias("key"), F.col("n").alias("a")).distinct()
    kept = scored.select("key", "least.*").join(longer, ["key", "a"], "left_anti").select("key.lang", "key.phrase", "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= first)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
