"""Byte-level BPE: segment trees over byte positions.

Each pre-token has a segment tree whose leaves are byte positions; a leaf holds the rank of
the pair that begins there together with its position, so the root is the leftmost pair of
least rank.  A merge rewrites the leaves of the merged pair and of its two live neighbours and
their ancestors: a logarithmic number of nodes.  Short pre-tokens are merged in lockstep,
one tree a row of a matrix; a long one has a tree of its own.

Defined results: a null text counts as empty and has no tokens; of equal ranks the leftmost pair is
merged first; repeated rows are encoded as
rows of their own; a text of any length is encoded whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import spread

NONE = np.int32(2**31 - 1)
LOCKSTEP_BYTES = 64  # longer pre-tokens get a tree of their own
LOCKSTEP_ROWS = 1 << 15
CACHE_PIECES = 400_000  # distinct pre-tokens that a worker remembers before it starts anew
BATCH_CHARS = 1 << 20


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _ranges(name: str) -> str:
    """The members of a class such as \\p{L} or \\s among the characters of the basic plane, as ranges."""
    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    runs = (m[0] for m in regex.finditer(name + "+", plane))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function of a text that finds all matches of ``pattern``, as ``regex`` finds them.

    Where the pattern consists of literals, groups, look-aheads and the classes \\p{..} and \\s, these
    are written out as ranges and ``re`` searches for them, in half the time; texts with
    characters beyond the basic plane, and all other patterns, are left to ``regex``.
    """
    whole = regex.compile(pattern).findall
    if re.search(r"\\(?!p\{\w+\}|[sS])|\(\?[^!=:]|\[[^]]*(\\S|\[)|\[\^?\]", pattern):
        return whole

    def write_out(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(r"\\p\{\w+\}|\\s", lambda c: _ranges(c[0]), m[0])
        return f"[^{_ranges(chr(92) + 's')}]" if m[0] == r"\S" else f"[{_ranges(m[0])}]"

    quick = re.compile(re.sub(r"\[[^]]*\]|\\p\{\w+\}|\\[sS]", write_out, pattern)).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: whole(text) if beyond(text) else quick(text)


class PairTable:
    """(left id, right id) -> rank of their concatenation, in an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = dict(zip(keys, values, strict=True))
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left_keys, left_values = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(left_keys)
        while len(left_keys):  # each free slot takes the first key that wants it, the others move on
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.values[at[first]] = left_keys[first], left_values[first]
            rest = np.ones(len(left_keys), bool)
            rest[first] = False
            left_keys, left_values, at = left_keys[rest], left_values[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            going = ~hit & (found != -1)
            todo, at = todo[going], at[going]
        return out


class Codec:
    def __init__(self, data: bytes, pattern: str):
        ranks = parse_ranks(data)
        self.ranks, self.table, self.split = ranks, PairTable(ranks), splitter(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.digits = [str(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        """Empty the cache: ``index`` numbers known pre-tokens, whose tokens lie one after another in ``pool``."""
        self.index: dict[str, int] = {}
        self.pool, self.begin = np.empty(1 << 12, np.int32), np.zeros(1 << 10, np.int64)

    def remember(self, pieces: Sequence[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known, at = len(self.index), int(self.begin[len(self.index)])
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(at + 2 * len(ids), np.int32)])
        if known + len(pieces) >= len(self.begin):
            self.begin = np.concatenate([self.begin[: known + 1], np.zeros(known + 2 * len(pieces), np.int64)])
        self.pool[at : at + len(ids)] = ids
        self.begin[known + 1 : known + 1 + len(pieces)] = at + np.cumsum(counts)
        self.index.update(zip(pieces, range(known, known + len(pieces)), strict=True))

    def merge_one(self, piece: bytes) -> list[int]:
        """Merges with a segment tree in plain Python, for a long pre-token."""
        n, pairs = len(piece), self.table.pairs
        width = 1 << max(0, (n - 1).bit_length())
        none = (1 << 62, 0)
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree: list[tuple[int, int]] = [none] * (2 * width)

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            rank = pairs.get(ids[i] << 32 | ids[j]) if j < n else None
            return none if rank is None else (rank, i)

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while n > 1 and tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_rows(self, words: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number for each) of pre-tokens of at most ``width`` bytes (a power of two), merged all at once."""
        rows = len(words)
        length = np.fromiter(map(len, words), np.int64, rows)
        raw = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(rows), length)
        col = np.arange(len(raw)) - np.repeat(np.cumsum(length) - length, length)
        ids = np.zeros((rows, width + 1), np.int32)
        ids[row, col] = self.single[raw]
        live = np.zeros((rows, width + 1), bool)
        live[row, col] = True
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (rows, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (rows, width + 1)).copy()
        tree = np.full((rows, 2 * width), NONE, np.int32)
        pair = col + 1 < length[row]
        r, c = row[pair], col[pair]
        rank = self.table.ranks(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(rank == NONE, NONE, rank * width + c)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        shift, low = width.bit_length() - 1, np.int32(width - 1)
        # flat views: a row's positions begin at ``own``, its tree at ``top``
        ids_at, after_at, before_at, live_at, tree_at = (x.ravel() for x in (ids, after, before, live, tree))
        rows_left = np.arange(rows if width > 1 else 0)
        own, top, size = rows_left * (width + 1), rows_left * (2 * width), length[rows_left]
        while len(own):
            best = tree_at.take(top + 1)
            going = best != NONE
            if not going.all():
                own, top, size, best = own[going], top[going], size[going], best[going]
                if not len(own):
                    break
            i = best & low
            j = after_at.take(own + i)
            nxt, prv = after_at.take(own + j), before_at.take(own + i)
            edge = np.minimum(nxt, width)
            ids_at[own + i] = best >> shift
            live_at[own + j] = False
            after_at[own + i] = nxt
            before_at[own + edge] = i
            # new pairs: the merged one with its right neighbour, and its left neighbour with it
            has = np.flatnonzero(prv >= 0)
            first = np.concatenate([ids_at.take(own + i), ids_at.take(own[has] + prv[has])])
            second = np.concatenate([ids_at.take(own + edge), ids_at.take(own[has] + i[has])])
            rank = self.table.ranks(first, second)
            rank[: len(own)][nxt >= size] = NONE
            place = np.concatenate([i, prv[has]])
            leaf = np.where(rank == NONE, NONE, (rank << np.int32(shift)) + place)
            base = np.concatenate([top, top[has], top])
            node = np.concatenate([width + place, width + j])
            tree_at[base + node] = np.concatenate([leaf, np.full(len(own), NONE)])
            for _ in range(shift):
                node >>= 1
                pair = base + 2 * node
                tree_at[base + node] = np.minimum(tree_at.take(pair), tree_at.take(pair + 1))
        return ids[live], live.sum(axis=1)

    def learn(self, found: Sequence[str]) -> None:
        """Put the tokens of pre-tokens that are not yet known into the cache."""
        raw = [text.encode() for text in found]
        ranks = np.fromiter((-1 if (r := self.ranks.get(x)) is None else r for x in raw), np.int64, len(raw))
        whole = np.flatnonzero(ranks >= 0)
        self.remember([found[k] for k in whole], ranks[whole].astype(np.int32), np.ones(len(whole), np.int64))
        rest = np.flatnonzero(ranks < 0)
        size = np.fromiter((len(raw[k]) for k in rest), np.int64, len(rest))
        for k in rest[size > LOCKSTEP_BYTES]:
            ids = self.merge_one(raw[k])
            self.remember([found[k]], np.array(ids, np.int32), np.array([len(ids)]))
        width = 1
        while width <= LOCKSTEP_BYTES:
            mine = rest[(size > width // 2) & (size <= width)]
            for lo in range(0, len(mine), LOCKSTEP_ROWS):
                part = mine[lo : lo + LOCKSTEP_ROWS]
                self.remember([found[k] for k in part], *self.merge_rows([raw[k] for k in part], width))
            width *= 2

    def encode_batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, offsets of each text's)."""
        split = [self.split(t) for t in texts]
        if len(self.index) > CACHE_PIECES:
            self.forget()
        pieces = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(at < 0).tolist()
        self.learn(list({flat[k] for k in new}))
        at[new] = [self.index[flat[k]] for k in new]
        begin = self.begin[at]
        count = self.begin[at + 1] - begin
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(pieces)])]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec a Python worker and vocabulary."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def text_batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    lo, size, part = 0, 0, []
    for i, text in enumerate(column):
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= BATCH_CHARS:
            yield lo, part
            lo, size, part = i + 1, 0, []
    if part:
        yield lo, part


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of each whole text.

    The vocabulary file (under a MB) is read on the driver and broadcast; with ``keep_ids`` the
    ids themselves are returned too.  A map without a shuffle.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for lo, texts in text_batches(batch.column(1)):
                flat, offsets = own.encode_batch(texts)
                tokens, cuts = flat.tolist(), offsets.tolist()
                rows = [tokens[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [
                    batch.column(0).slice(lo, len(texts)),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(" ".join(map(own.digits.__getitem__, ids)).encode()).hexdigest() for ids in rows], pa.string()),
                    pa.array([hashlib.sha256(own.decode(ids)).hexdigest() for ids in rows], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = SCHEMA + (", ids array<int>" if keep_ids else "")
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)
