"""Document groups that talk through hash buckets.

Texts are dealt into groups by a hash of id and text, about GROUP_BYTES each.  A group sends
every distinct key that it has once (however often it occurs in the group) to the bucket of
that key; a bucket answers each group about its own keys; the group then works on its texts
with the answers.  A key that occurs in a third of all rows thus costs one entry a group.  Both
sides of every step share one exchange of the texts.

Messages are packed arrays: (g, kind, b, n, payload, ids), one row a group and bucket.  Where so
many groups and buckets would exchange messages of a few bytes, these travel in two steps: a
group's messages to FAN neighbouring buckets are one row, which meets those of FAN neighbouring
groups and is turned into one row a bucket; answers come back the same way.  Groups and buckets
therefore keep their bounds at any size of the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import column_bytes
from .store import plan_bytes, whole_row

GROUP_BYTES, BUCKET_BYTES = 1 << 20, 2 << 20  # of the input's files
MOST_BYTES = 8 << 20  # of the input's files, to which groups and buckets may grow
MESSAGE_BYTES = 1 << 10  # of the input for each message: what groups and buckets grow for, and beyond it messages are relayed
NULL_ID = np.iinfo(np.int64).min  # a null id comes before all others
MESSAGE = "g int, kind int, b int, n long, payload binary, ids array<long>"
PACKED = "b int, g int, n long, payload binary"
PACKED_SCHEMA = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
MESSAGE_SCHEMA = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64()))])
COPIES, RELAYED = 0, -1  # the kinds of message that list a group's repeated texts, and that hold other messages


def texts_of(docs: DataFrame, carry: bool = False) -> DataFrame:
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    return docs.select(*own, *([whole_row(docs, without=("text",))] if carry else []))


class Layout(NamedTuple):
    """Numbers of groups and buckets; how many neighbours share a relay, 1 for none."""

    groups: int
    buckets: int
    fan: int


def grouped(docs: DataFrame, carry: bool = False) -> tuple[DataFrame, Layout]:
    """(doc_id, text[, row], g) and the layout that suits the input; row: all columns but the text."""
    plan = layout(plan_bytes(docs))
    return texts_of(docs, carry).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.groups)).cast("int")), plan


def layout(size: int) -> Layout:
    """For an input of so many bytes.

    Every group may send a message to every bucket.  Past a certain input both grow with its
    square root, so that there is one message for each MESSAGE_BYTES of input at most, up to
    MOST_BYTES (some 60 GB); from there on their size is fixed and messages are relayed.
    """
    least = min(math.isqrt(size * MESSAGE_BYTES), MOST_BYTES)
    groups, buckets = (max(1, -(-size // max(base, least))) for base in (GROUP_BYTES, BUCKET_BYTES))
    fan = 1 if groups * buckets * MESSAGE_BYTES <= 2 * size + MESSAGE_BYTES else math.isqrt(buckets) + 1
    return Layout(groups, buckets, fan)


def copies(texts: DataFrame) -> DataFrame:
    """Messages with the 128-bit digests of a group's texts that occur again anywhere, and the least id of each.

    Rows are counted by digest and group before they meet by digest: a text in a third of all
    rows is one row a group there.
    """
    own = texts.select("g", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).groupBy("digest", "g").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    again = own.groupBy("digest").agg(F.min("least").alias("rep"), F.sum("n").alias("n")).where("n > 1").select("digest", "rep")
    known = own.select("digest", F.col("g").alias("to")).join(again, "digest")
    return known.groupBy("to").agg(F.collect_list(F.struct("digest", "rep")).alias("c")).select(  # a group's own digests: bounded
        F.col("to").alias("g"), F.lit(COPIES).alias("kind"), F.lit(0).alias("b"), F.size("c").cast("long").alias("n"), F.unhex(F.array_join("c.digest", "")).alias("payload"), F.col("c.rep").alias("ids")
    )


class Texts:
    """The texts of a group in ascending order of ids; the least id with each text, and which are later copies."""

    def __init__(self, table: pa.Table, messages: pa.Table):
        self.table = table = table.sort_by("doc_id") if table.num_rows else table
        self.ids = table.column("doc_id").to_numpy().astype(np.int64) if table.num_rows else np.empty(0, np.int64)
        self.g = int(table.column("g")[0].as_py()) if table.num_rows else -1
        self.buf, self.offsets = column_bytes(table.column("text"))
        known: dict[bytes, int] = {}
        for kind, payload, ids in zip(messages.column("kind").to_pylist(), messages.column("payload"), messages.column("ids"), strict=True):
            if kind == COPIES:
                digests = payload.as_py()
                known |= {digests[16 * k : 16 * k + 16]: rep for k, rep in enumerate(ids.as_py())}
        self.least = self.ids.copy()
        if known:
            for d in range(len(self.ids)):
                text = self.buf[self.offsets[d] : self.offsets[d + 1]]
                self.least[d] = known.get(hashlib.md5(text, usedforsecurity=False).digest(), self.ids[d])
        self.copy = self.ids > self.least

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, d: int) -> bytes:
        return self.buf[self.offsets[d] : self.offsets[d + 1]].tobytes()


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def packed_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | fingerprint.  Fingerprints only pre-select: a clash costs work, not results."""
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of an ascending array."""
    if not len(bucket):
        return
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        yield int(bucket[lo]), slice(lo, hi)


def packed_table(g: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """rows: (bucket, entries, payload)."""
    b, n, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int32()), pa.array([g] * len(b), pa.int32()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], schema=PACKED_SCHEMA)


def answer_table(kind: int, rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """rows: (group, bucket, entries, payload)."""
    g, b, n, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    k = len(g)
    return pa.table(
        [pa.array(g, pa.int32()), pa.array([kind] * k, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))],
        schema=MESSAGE_SCHEMA,
    )


def unpack(payload: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """Arrays of n values each, then whatever is left as bytes."""
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    out.append(np.frombuffer(payload, np.uint8, -1, at))
    return out


def packed_rows(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(group, entries, payload) of a bucket, in a fixed order."""
    return sorted(zip(table.column("g").to_pylist(), table.column("n").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda r: r[0])


def same_prints(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first entries in it) of classes of equal fingerprints."""
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


def answer_repeated(kind: int):
    """Answers whether each key of a group occurs again: in another group, or flagged in its own."""

    def run(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        rows = [(g, n, *unpack(payload, n, "<u4")) for g, n, payload in packed_rows(table)]
        prints = np.concatenate([r[2] for r in rows])
        weight = np.concatenate([np.unpackbits(bits, count=n) for _, n, _, bits in rows]) + 1
        order, begin = same_prints(prints)
        total = np.add.reduceat(weight[order], begin, dtype=np.int64)
        repeated = np.empty(len(prints), bool)
        repeated[order] = np.repeat(total > 1, np.diff(np.append(begin, len(prints))))
        out, at = [], 0
        for g, n, *_ in rows:
            out.append((g, b, n, np.packbits(repeated[at : at + n]).tobytes()))
            at += n
        return answer_table(kind, out)

    return run


def answers(messages: pa.Table, kind: int) -> dict[int, tuple[int, bytes]]:
    """bucket -> (entries, payload) of the answers of one kind."""
    return {
        b: (n, payload)
        for k, b, n, payload in zip(*(messages.column(c).to_pylist() for c in ("kind", "b", "n", "payload")), strict=True)
        if k == kind
    }


def enclose(rows: list[tuple]) -> bytes:
    """Rows of some integers and a payload, as one payload."""
    numbers = np.array([(*r[:-1], len(r[-1])) for r in rows], np.int64)
    return np.int64([len(rows), numbers.shape[1]]).tobytes() + numbers.tobytes() + b"".join(r[-1] for r in rows)


def disclose(payload: bytes) -> Iterator[tuple]:
    count, width = np.frombuffer(payload, np.int64, 2).tolist()
    numbers = np.frombuffer(payload, np.int64, count * width, 16).reshape(count, width).tolist()
    at = 16 + 8 * count * width
    for *row, size in numbers:
        yield (*row, payload[at : at + size])
        at += size


def _sorted_out(rows: Iterable[tuple], key: Callable[[tuple], tuple]) -> dict[tuple, list[tuple]]:
    out: dict[tuple, list[tuple]] = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def _routed(parts: dict[tuple, list[tuple]]) -> pa.Table:
    """A row for each (to, by) of rows that travel together."""
    keys = list(zip(*parts, strict=True)) if parts else [(), ()]
    return pa.table({"x": pa.array(keys[0], pa.int32()), "y": pa.array(keys[1], pa.int32()), "payload": pa.array([enclose(r) for r in parts.values()], pa.binary())})


def _disclosed(table: pa.Table) -> Iterator[tuple]:
    for payload in table.column("payload").to_pylist():
        yield from disclose(payload)


ROUTED = "x int, y int, payload binary"


def route(sent: pa.Table, fan: int) -> pa.Table:
    """What a group sends, one row for each FAN buckets."""
    rows = zip(*(sent.column(c).to_pylist() for c in ("b", "g", "n", "payload")), strict=True)
    return _routed(_sorted_out(rows, lambda r: (r[0] // fan, r[1] // fan)))


def exchange(sent: DataFrame, answer: Callable[[pa.Table], pa.Table], fan: int) -> DataFrame:
    """Messages that buckets return to packed rows; with a fan these are routed ones."""
    if fan == 1:
        return sent.groupBy("b").applyInArrow(answer, MESSAGE)

    def to_buckets(table: pa.Table) -> pa.Table:
        return _routed(_sorted_out(_disclosed(table), lambda r: (r[0], 0)))

    def answered(table: pa.Table) -> pa.Table:
        b, g, n, payload = zip(*_disclosed(table), strict=True)
        found = answer(pa.table([pa.array(b, pa.int32()), pa.array(g, pa.int32()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], schema=PACKED_SCHEMA))
        rows = zip(*(found.column(c).to_pylist() for c in ("g", "kind", "b", "n", "payload")), strict=True)
        return _routed(_sorted_out(rows, lambda r: (r[0] // fan, r[2] // fan)))

    def to_groups(table: pa.Table) -> pa.Table:
        parts = _sorted_out(_disclosed(table), lambda r: (r[0],))
        return answer_table(RELAYED, [(g, rows[0][2], len(rows), enclose(rows)) for (g,), rows in parts.items()])

    turned = sent.groupBy("x", "y").applyInArrow(to_buckets, ROUTED)
    return turned.groupBy("x").applyInArrow(answered, ROUTED).groupBy("x", "y").applyInArrow(to_groups, MESSAGE)


def _taken_out(messages: pa.Table) -> pa.Table:
    """Messages with relayed ones in the place of what held them."""
    kinds = messages.column("kind").to_pylist()
    if RELAYED not in kinds:
        return messages
    held = [r for kind, payload in zip(kinds, messages.column("payload").to_pylist(), strict=True) if kind == RELAYED for r in disclose(payload)]
    g, kind, b, n, payload = zip(*held, strict=True)
    own = messages.filter(pa.array([k != RELAYED for k in kinds])).select(["kind", "b", "n", "payload", "ids"])
    more = pa.table([pa.array(kind, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.nulls(len(g), pa.list_(pa.int64()))], schema=pa.schema(list(MESSAGE_SCHEMA)[1:]))
    return pa.concat_tables([own.cast(more.schema), more])


def _addressed(messages: DataFrame):
    return messages.withColumnRenamed("g", "to").groupBy("to")


def ask(texts: DataFrame, messages: DataFrame, send: Callable[[pa.Table, pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], fan: int = 1) -> DataFrame:
    """Messages that buckets return to what groups sent."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        sent = send(table, _taken_out(told))
        return sent if fan == 1 else route(sent, fan)

    sent = texts.groupBy("g").cogroup(_addressed(messages)).applyInArrow(run, PACKED if fan == 1 else ROUTED)
    return exchange(sent, answer, fan)


def conclude(texts: DataFrame, messages: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        return finish(table, _taken_out(told))

    return texts.groupBy("g").cogroup(_addressed(messages)).applyInArrow(run, schema)
