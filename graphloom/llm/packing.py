"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts are encoded by byte-level BPE, each followed by a separator, and cut into pieces no
longer than the largest permitted length.  Pieces are dealt into shards of bounded size and
packed shard by shard: in descending length each goes to the open bin with the least room that
still fits.  Where none fits, a bin is opened at the length of least cost a token, all
permitted lengths weighed against each other: what a length costs (a step's overhead, its
positions, attention over them) after downsizing, over what the pieces still to come can fill
of it, longest first.  Finally every bin is downsized to the shortest permitted length that
holds its contents.  The result is one row a bin, with its tokens.

Defined results: a null or empty text has no tokens and is in no bin; a text of over the
largest length yields several pieces with their token offsets, the separator after its last;
ties are broken by id, piece and token order; repeated rows are packed as rows of their own;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import spread
from .bpe import codec, parse_ranks, text_batches
from .hashing import column_bytes
from .store import plan_bytes

CAPACITIES = (512, 1024, 2048, 4096)
SEPARATOR = 50256  # the end-of-text id that the public 50k vocabularies leave free
#: Cost of a bin of length n: OVERHEAD + n + n * n / ATTENTION, in tokens.
OVERHEAD, ATTENTION = 16, 1 << 16
SHARD_BYTES = 4 << 20


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


def planned_fill(room: int, ascending: Sequence[int], sums: Sequence[int], rest: int) -> int:
    """What ascending[:rest] fills of ``room`` if the longest piece that fits is always next.

    sums: running totals of ``ascending``, from 0; whole runs of pieces are taken at once.
    """
    filled, hi = 0, rest
    while hi:
        hi = bisect_right(ascending, room, 0, hi)
        lo = bisect_left(sums, sums[hi] - room, 0, hi + 1)
        filled += sums[hi] - sums[lo]
        room -= sums[hi] - sums[lo]
        hi = lo
    return filled


def opening_capacity(length: int, ascending: Sequence[int], sums: Sequence[int], rest: int, capacities: Sequence[int]) -> int:
    """The permitted length of least cost a token for a bin that starts with ``length``; of equal ones the shortest."""
    best, least = capacities[-1], float("inf")
    for cap in capacities[bisect_left(capacities, length) :]:
        filled = length + planned_fill(cap - length, ascending, sums, rest)
        each = cost(capacities[bisect_left(capacities, filled)]) / filled
        if each < least:
            best, least = cap, each
    return best


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin number and offset of each piece, and the final length of each bin.

    ``lengths`` must be positive, in descending order and not above the largest capacity.
    """
    capacities = sorted(capacities)
    ascending = list(reversed(lengths))
    sums = list(accumulate(ascending, initial=0))
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    bins, offsets = [], []
    for i, n in enumerate(lengths):
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = opening_capacity(n, ascending, sums, len(lengths) - i - 1, capacities), len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


PIECES = "doc_id long, salt long, piece int, token_offset long, n_tokens int, ids binary"  # ids: packed, two bytes each where the vocabulary allows
SCHEMA = (
    "bin_id string, capacity int, n_tokens int, doc_ids array<long>, "
    "pieces array<struct<doc_id:long,piece:int,token_offset:long,n_tokens:int,bin_offset:int>>, input_ids array<int>"
)
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("token_offset", pa.int64()), ("n_tokens", pa.int32()), ("bin_offset", pa.int32())])


class Salts:
    """A number for each row of a task that depends on its id, its text and how many equal rows came before.

    Equal rows are interchangeable, so which rows get which number, taken together, does not hang
    on the order or the batches in which a task reads them: a repeated task deals alike.
    """

    def __init__(self) -> None:
        self.seen: dict[tuple[int | None, bytes], int] = {}

    def __call__(self, doc_id: int | None, text: str) -> int:
        digest = hashlib.md5(text.encode(), usedforsecurity=False)
        key = doc_id, digest.digest()
        n = self.seen[key] = self.seen.get(key, -1) + 1
        digest.update(n.to_bytes(8, "little"))
        return int.from_bytes(digest.digest()[:8], "little", signed=True)


def id_kind(data: bytes, separator: int) -> np.dtype:
    """The narrowest type of the ids of a vocabulary and a separator."""
    return np.dtype(np.uint16 if max(separator, max(parse_ranks(data).values())) < 1 << 16 else np.int32)


def _tokenise(shared, pattern: str, capacity: int, separator: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, salts = codec(shared.value, pattern), Salts()
        for batch in batches:
            for lo, texts in text_batches(batch.column(1)):
                ids, offsets = own.encode_batch(texts)
                count = np.diff(offsets)
                size = count + (count > 0)
                flat = np.insert(ids.astype(kind), offsets[1:][count > 0], kind.type(separator))
                n = -(-size // capacity)
                at = np.repeat(np.arange(len(size)), n)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                begin = (np.cumsum(size) - size)[at] + nth * capacity
                part = batch.column(0).slice(lo, len(texts))
                salt = np.fromiter(map(salts, part.to_pylist(), texts), np.int64, len(texts))[at]
                length = np.minimum(size[at] - nth * capacity, capacity)
                numbers = ((salt, np.int64), (nth, np.int32), (nth * capacity, np.int64), (length, np.int32))
                cuts = (np.append(begin, len(flat)) * kind.itemsize).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                columns = [part.take(pa.array(at)), *(pa.array(x.astype(k)) for x, k in numbers), tokens]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

    return run


def _pack_shard(capacities: Sequence[int], kind: np.dtype):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        raw, cuts = column_bytes(table.column("ids"))
        start, values = cuts[:-1] // kind.itemsize, raw.view(kind)
        size = table.column("n_tokens").to_numpy().astype(np.int64)
        doc, piece = table.column("doc_id"), table.column("piece").to_numpy()
        known, number = doc.is_valid().to_numpy(), doc.fill_null(0).to_numpy()
        order = np.lexsort((start, piece, number, known, -size))
        # pieces of one id, number and length come in the order of their tokens
        same = [tuple(x[order[1:]] == x[order[:-1]]) for x in (size, number, known, piece)]
        tied = np.append(False, np.logical_and.reduce(np.array(same, bool).reshape(4, -1)))
        if tied.any():
            run_of = np.cumsum(~tied)
            content = [values[s : s + n].tobytes() if t else b"" for s, n, t in zip(start[order], size[order], tied | np.append(tied[1:], False), strict=True)]
            order = order[sorted(range(len(order)), key=lambda i: (run_of[i], content[i]))]
        bins, offsets, final = pack(size[order].tolist(), capacities)
        bins, offsets = np.array(bins, np.int64), np.array(offsets, np.int64)
        by_bin = np.lexsort((offsets, bins))
        order, bins, offsets = order[by_bin], bins[by_bin], offsets[by_bin]
        length = size[order]
        ends = np.cumsum(length)
        joined = values[np.arange(ends[-1]) + np.repeat(start[order] - (ends - length), length)]
        edge = np.searchsorted(bins, np.arange(len(final) + 1))
        tokens = np.concatenate([[0], ends])[edge]
        parts = [table.column(c).combine_chunks().take(pa.array(order)) for c in ("doc_id", "piece", "token_offset", "n_tokens")]
        parts.append(pa.array(offsets.astype(np.int32)))
        lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        return pa.table({
            "bin_id": pa.array([f"{shard}-{b}" for b in range(len(final))], pa.string()), "capacity": pa.array(final, pa.int32()), "n_tokens": pa.array(np.diff(tokens).astype(np.int32)),
            "doc_ids": lists(parts[0], edge), "pieces": lists(pa.StructArray.from_arrays(parts, fields=list(_PIECE)), edge), "input_ids": lists(pa.array(joined.astype(np.int32)), tokens),
        })

    return run


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacities: Sequence[int] = CAPACITIES, separator: int = SEPARATOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(bin_id, capacity, n_tokens, doc_ids, pieces, input_ids): one row a packed sequence.

    ``pieces`` tells where each piece lies in its text's tokens and in the bin; ``input_ids``
    are the bin's tokens, n_tokens of them, to be padded to ``capacity``.  A shard holds about
    ``shard_bytes`` of input, so packing memory is bounded and the share of half-filled bins (a
    few a shard) does not grow with the data.  Pieces are dealt by a hash of id, piece, text and
    the number of earlier equal rows of the task: pieces of one very long text, and rows of a null or
    repeated id, spread as well, and alike when a task is repeated.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    kind = id_kind(data, separator)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(1, -(-plan_bytes(source) // shard_bytes))
    sizes = spread(source).mapInArrow(_tokenise(shared, pattern, max(capacities), separator, kind), PIECES)
    return sizes.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)).alias("shard")).applyInArrow(_pack_shard(tuple(sorted(capacities)), kind), SCHEMA)
