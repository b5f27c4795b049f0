"""Shortest-pack-first packing over the histogram of lengths.

Texts are encoded and cut into items of at most ``capacity`` tokens.  Only the histogram of the
items' lengths is planned: lengths are placed longest first, each into the shortest packs open
(those with most room), whole runs of equal packs at once; a pack is opened where the length
fits into none.  As many packs are opened as the tokens fill; from then on a length that fits
nowhere is cut to the room of the shortest pack and its rest placed with the shorter lengths.
What does not fill a whole pack goes to packs of powers of two, so nothing is padded.

Items of one length are ranked; a placement maps a run of ranks to a run of packs, and items
find their packs by length and rank.  The plan depends on the histogram, not on the rows.

Defined results: a null or empty text is the end-of-text id alone; a text of over ``capacity``
tokens has several pieces; ties are broken by the order of rows in the stored tokens; repeated
rows, and rows of a null id, are packed as rows of their own; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import spread
from .hashing import column_bytes
from .store import materialize

CAPACITY = 4096
END = 2  # the id after each text
CACHE_WORDS = 1_000_000  # distinct words that a Python worker remembers before it starts anew
TEXT_BYTES = 4 << 20  # of texts encoded at once
JOINED_WORDS = 2_000
PLAN_BYTES, BASE_ROWS = 64 << 20, 1 << 18  # up to which a plan, and first ranks, are sent to all tasks


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and ends tokens at it.

    The library encodes each distinct word once.  Two changes of the text leave the ids as they
    are and let more words agree: ASCII letters are lower-cased, if the normaliser lower-cases and no
    combining mark follows that could join them; and a space parts a Latin letter from the
    punctuation after it, where the pre-tokenizer parts them anyway.
    """

    MARK = "\x01"  # parts words that are encoded together; words that hold it are encoded alone

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        mark = self._ids([self.MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.size = self.library.get_vocab_size()
        self.forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.begin = np.zeros(1, np.int64)
        self.pool = np.empty(0, np.int32)

    def learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.mark is None or self.MARK in w]
        rest = [w for w in words if self.mark is not None and self.MARK not in w]
        found = self._ids(alone)
        tokens, count = [np.fromiter(chain.from_iterable(found), np.int32)], [np.fromiter(map(len, found), np.int64)]
        for lo in range(0, len(rest), JOINED_WORDS):
            part = rest[lo : lo + JOINED_WORDS]
            ids = np.array(self._ids([f" {self.MARK} ".join(part)])[0], np.int32)
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
            count.append(np.diff(cuts) - 1)
            tokens.append(ids[ids != self.mark])
        self.index.update(zip(chain(alone, rest), range(len(self.begin) - 1, len(self.begin) - 1 + len(words)), strict=True))
        sizes = np.concatenate(count)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, *tokens])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's)."""
        texts = pc.fill_null(texts, "")
        data, _ = column_bytes(texts)
        if not ((data == 0xCC) | (data == 0xCD)).any():  # the first bytes of combining marks
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, r"([a-zà-öø-ÿ])([.,;:!?])", r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self.forget()
        self.learn([w for w in words if w not in self.index])
        known = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        at = known[coded.indices.to_numpy(zero_copy_only=False)]
        count = self.begin[at + 1] - self.begin[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.begin[at] - ends[:-1], count) + np.arange(ends[-1])]
        lists = split.offsets.to_numpy()
        return ids, ends[lists - lists[0]]


_encoders: dict[int, WordEncoder] = {}


def encoder(data: bytes) -> WordEncoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = WordEncoder(data)
    return _encoders[key]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


ITEMS = "doc_id long, doc_tokens long, start long, size int, block int, nth long, ids binary"


def _tokenise(shared, capacity: int, end: int, kind: np.dtype):
    """Items of each text, with their number among the items of their size in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, cuts = column_bytes(batch.column(1))
            for lo, hi in runs(cuts, TEXT_BYTES):
                ids, offsets = own.encode(batch.column(1).slice(lo, hi - lo))
                total = np.diff(offsets) + 1
                flat = np.insert(ids.astype(kind), offsets[1:], kind.type(end))
                n = -(-total // capacity)
                at = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                size = np.minimum(total[at] - start, capacity)
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order])
                nth = np.empty(len(at), np.int64)
                nth[order] = np.arange(len(at)) - first + seen[size[order]]
                seen += np.bincount(size, minlength=capacity + 1)
                bounds = (np.append((np.cumsum(total) - total)[at] + start, len(flat)) * kind.itemsize).astype(np.int32)
                columns = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(at)), pa.array(total[at]), pa.array(start), pa.array(size.astype(np.int32)), pa.array(np.full(len(at), block, np.int32)), pa.array(nth),
                    pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ITEMS.split(", ")])

    return run


class Plan(NamedTuple):
    """Placements: of items of ``size`` the ranks from ``rank`` on, ``count`` of them, have ``length``
    tokens from ``start`` on in the packs from ``sequence`` on, at ``offset``."""

    size: np.ndarray
    start: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The placements of all items of a histogram {size: count}."""
    full, rest = divmod(sum(size * n for size, n in histogram.items()), capacity)
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> (first pack, packs, tokens in each)
    levels: list[int] = []
    pending: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (size, start, first rank, ranks)
    lengths: list[int] = []
    placed: list[tuple[int, ...]] = []
    opened = 0

    def add(left: int, packs: tuple[int, int, int]) -> None:
        if left and packs[1]:
            if not room.get(left):
                room[left] = []
                heapq.heappush(levels, -left)
            room[left].append(packs)

    def wait(length: int, items: tuple[int, int, int, int]) -> None:
        if length not in pending:
            pending[length] = []
            heapq.heappush(lengths, -length)
        pending[length].append(items)

    for k, bit in enumerate(b for b in range(rest.bit_length()) if rest >> b & 1):
        add(1 << bit, (full + k, 1, 0))
    for size, n in histogram.items():
        wait(size, (size, 0, 0, n))
    while lengths:
        length = -heapq.heappop(lengths)
        for size, start, rank, n in pending.pop(length):
            while n:
                while levels and not room[-levels[0]]:
                    del room[-heapq.heappop(levels)]
                left = -levels[0] if levels else 0
                if left < length and opened < full:
                    more = min(-(-n // (capacity // length)), full - opened)
                    add(capacity, (opened, more, 0))
                    opened += more
                    continue
                packs, many, used = room[left].pop()
                m, take = min(n, many), min(length, left)
                placed.append((size, start, rank, m, take, packs, used))
                if m < many:
                    room[left].append((packs + m, many - m, used))
                add(left - take, (packs, m, used + take))
                if take < length:
                    wait(length - take, (size, start + take, rank, m))
                rank, n = rank + m, n - m
    columns = np.array(placed, np.int64).reshape(-1, 7)
    return Plan(*columns[np.lexsort((columns[:, 2], columns[:, 1], columns[:, 0]))].T)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PIECES.split(", ")])


def assign(items: pa.Table | pa.RecordBatch, plan: Plan, kind: np.dtype) -> pa.Table:
    """The pieces of some items (ITEMS and ``rank``): each is looked up by size, start and rank until it is whole."""
    number = lambda name: items.column(name).to_numpy().astype(np.int64)
    size, begin, rank = number("size"), number("start"), number("rank")
    raw, cuts = column_bytes(items.column("ids"))
    values, cuts = raw.view(kind), cuts[:-1] // kind.itemsize
    wide = int(plan.size.max(initial=0)) + 1
    code = plan.size * wide + plan.start
    codes, first = np.unique(code, return_index=True)
    span = int((plan.rank + plan.count).max(initial=0)) + 1
    key = np.searchsorted(codes, code) * span + plan.rank
    todo, start, rows, parts, starts = np.arange(len(size)), np.zeros(len(size), np.int64), [], [], []
    while len(todo):
        at = np.searchsorted(key, np.searchsorted(codes, size[todo] * wide + start) * span + rank[todo], "right") - 1
        rows.append(todo)
        parts.append(at)
        starts.append(start)
        start = start + plan.length[at]
        more = start < size[todo]
        todo, start = todo[more], start[more]
    row, part, start = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, parts, starts))
    length = plan.length[part]
    ends = np.cumsum(length)
    tokens = values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(cuts[row] + start - (ends - length), length)].astype("<u4")
    bounds = (np.append(0, ends) * 4).astype(np.int32)
    take = lambda name: items.column(name).take(pa.array(row))
    return pa.table([
        take("doc_id"), begin[row] + start, length, pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(tokens)]),
        take("doc_tokens"), plan.sequence[part] + rank[row] - plan.rank[part], plan.offset[part],
    ], schema=_PIECES)


def pack_texts(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, plan_bytes: int = PLAN_BYTES, base_rows: int = BASE_ROWS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row a piece.

    ``ids`` are the piece's tokens, little-endian, four bytes each; ``start`` counts the text's
    tokens before it, ``offset`` the pack's.  Tokens are stored once, with the number of each item
    among those of its size in its task, so a repeated task changes no rank.  The histogram has
    ``capacity`` rows at most and is planned on the driver; a plan of over ``plan_bytes`` is not sent to
    all tasks but met by size and ranges of ranks, and so are first ranks beyond ``base_rows``.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        data = f.read()
    kind = np.dtype(np.uint16 if max(end + 1, encoder(data).size) <= 1 << 16 else np.uint32)
    shared = spark.sparkContext.broadcast(data)
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    items = materialize(source.mapInArrow(_tokenise(shared, capacity, end, kind), ITEMS), "tokens")
    counts = items.groupBy("block", "size").agg(F.count("*").alias("n"))
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "bases")
    histogram = dict(bases.groupBy("size").agg(F.sum("n")).collect())  # a row a size: at most ``capacity``
    plan = shortest_pack_first(histogram, capacity)
    few = bases.count() <= base_rows
    bases = bases.drop("n")
    ranked = items.join(F.broadcast(bases) if few else bases.hint("merge"), ["block", "size"]).withColumn("rank", F.col("base") + F.col("nth")).drop("block", "nth", "base")
    if sum(x.nbytes for x in plan) <= plan_bytes:
        known = spark.sparkContext.broadcast(plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from assign(batch, known.value, kind).combine_chunks().to_batches()

        return ranked.mapInArrow(run, PIECES)
    width = 1 << 12  # ranks that meet in a group
    rows = spark.createDataFrame(pa.table(dict(zip(Plan._fields, plan, strict=True))))
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("rank") / width), F.floor((F.col("rank") + F.col("count") - 1) / width))))
    rows = rows.withColumnRenamed("size", "of")

    def meet(own: pa.Table, placements: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _PIECES.empty_table()
        columns = placements.rename_columns(["size" if c == "of" else c for c in placements.column_names])
        table = np.stack([columns.column(c).to_numpy().astype(np.int64) for c in Plan._fields])
        return assign(own.combine_chunks(), Plan(*table[:, np.lexsort((table[2], table[1], table[0]))]), kind)

    return ranked.withColumn("part", F.floor(F.col("rank") / width)).groupBy("size", "part").cogroup(rows.groupBy("of", "part")).applyInArrow(meet, PIECES)
