"""N-gram Jaccard join with a prefix tree: components and numbers of links.

A document's set is its distinct SHINGLE-word shingles (A-Z lower-cased), hashed to 64 bits.
Two documents link when 100 * |intersection| >= PERCENT * |union|.

1. Exact copies of a text are set aside; each stands for its first copy.
2. Whatever order is put on all shingles, linked sets share k of their first
   n - ceil(PERCENT% n) + k.  With the order of the hashes and k a tenth of the set, groups
   ask which of these shingles occur in several documents; a document with fewer than k such
   has no link.
3. Among the rest, equal sets are set aside in the same way, shingles are counted, and sets
   are put in the order (frequency class, hash): rare first.  Sets whose prefix consists of
   shingles of their own have no link.
4. Sets that share a prefix shingle lie in one coarse component, which therefore holds
   all links of its members.
5. In each coarse component, sets go into a prefix tree in the global order (``trie``), which
   all of them walk as queries: overlaps of common beginnings are counted once, subtrees are
   left by length bounds, and every link of every set is found.  A coarse component of over
   BLOCK_SETS sets is dealt into length classes and, by the rarest shingle, into blocks; every
   two blocks of the same or adjoining classes that have a prefix shingle in common meet in a
   task of their own, one as the tree and one as queries.
6. A set's links are counted by the rows that have each set, copies included.

Defined results: a null or blank text has an empty set and links with nothing; a text of
fewer than SHINGLE words has one shingle, the whole sequence; every row is a vertex of its
own, also where ids are null or repeated, and ``n_links`` counts the other rows that it links
with; a component's id is the least of its rows', a null id first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups as G
from .components import components, follow
from .hashing import Words, ngrams, within
from .store import materialize
from .trie import PrefixTree, Sets, spread

SHINGLE, PERCENT = 5, 75
BLOCK_SETS = 256
SHARED, CLASSES = 1, 2  # kinds of answers


def prefix_length(n, percent: int):
    """How many of a set's first shingles a linked set must meet."""
    return n - (percent * n + 99) // 100 + 1


def met_length(n, percent: int):
    """How many shared shingles the first stage asks for: a tenth of the set, one at least."""
    return np.minimum(1 + n // 10, (percent * n + 99) // 100)


class _Group(G.Texts):
    """sets: the sorted distinct shingles of each text."""

    def __init__(self, table: pa.Table, messages: pa.Table, size: int):
        super().__init__(table, messages)
        words = Words(self.buf, self.offsets)
        hashes, first = words.hashes(fold=True), words.first
        grams = ngrams(hashes, size)
        count = np.diff(first)
        short = {k: ngrams(hashes, k) for k in range(1, size)}
        self.sets = []
        for d in range(len(self)):
            n = int(count[d])
            if n >= size:
                self.sets.append(np.unique(grams[first[d] : first[d] + n - size + 1]))
            elif n:
                self.sets.append(short[n][first[d] : first[d] + 1])
            else:
                self.sets.append(np.empty(0, np.uint64))
        self.n = np.array([len(s) for s in self.sets], np.int64)

    def prefixes(self, percent: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, owner) of the prefix shingles, in the order of the hashes."""
        live = np.flatnonzero(~self.copy & (self.n > 0))
        take = prefix_length(self.n[live], percent) + met_length(self.n[live], percent) - 1
        hashes = np.concatenate([np.empty(0, np.uint64), *(self.sets[d][:k] for d, k in zip(live, take, strict=True))])
        return G.packed_keys(hashes, buckets), np.repeat(live, take)


def _send_prefixes(size: int, percent: int, buckets: int):
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        own = _Group(table, messages, size)
        keys, counts = np.unique(own.prefixes(percent, buckets)[0], return_counts=True)
        rows = []
        for b, at in G.by_bucket(keys >> np.uint64(32)):
            part = keys[at]
            rows.append((b, len(part), part.astype(np.uint32).tobytes() + np.packbits(counts[at] > 1).tobytes()))
        return G.packed_table(own.g, rows)

    return run


BASE = "row_id long, doc_id long, text_md5 string, g int, n long, digest binary, tokens binary"


def _keep_sets(size: int, percent: int, buckets: int):
    """All rows with a number of their own and their set's size and digest; the sets of those that may have a link."""

    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        own = _Group(table, messages, size)
        keys, owner = own.prefixes(percent, buckets)
        distinct = np.unique(keys)
        repeated = [np.empty(0, np.uint64)]
        found = G.answers(messages, SHARED)
        for b, at in G.by_bucket(distinct >> np.uint64(32)):
            n, payload = found[b]
            repeated.append(distinct[at][np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)])
        met = np.bincount(owner[np.isin(keys, np.concatenate(repeated))], minlength=len(own))
        hit = (own.n > 0) & (met >= met_length(own.n, percent))
        tokens = [own.sets[d].tobytes() if hit[d] else None for d in range(len(own))]
        md5 = lambda raw: hashlib.md5(raw, usedforsecurity=False)
        digests = [md5(own.sets[d].tobytes()).digest() if own.n[d] else None for d in range(len(own))]
        texts = [md5(own.text(d)).hexdigest() for d in range(len(own))]
        columns = {"row_id": (np.int64(own.g) << np.int64(32)) + np.arange(len(own)), "doc_id": own.ids, "text_md5": pa.array(texts, pa.string()), "g": pa.array([own.g] * len(own), pa.int32())}
        return pa.table(columns | {"n": own.n, "digest": pa.array(digests, pa.binary()), "tokens": pa.array(tokens, pa.binary())})

    return run


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens, number in each row)."""
    raw = table.column("tokens").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.array([len(r) // 8 for r in raw], np.int64)


def _send_tokens(buckets: int, fan: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(G.packed_keys(_joined(table)[0], buckets), return_counts=True)
        rows = []
        for b, at in G.by_bucket(keys >> np.uint64(32)):
            rows.append((b, at.stop - at.start, keys[at].astype(np.uint32).tobytes() + np.minimum(counts[at], 2**16 - 1).astype(np.uint16).tobytes()))
        sent = G.packed_table(table.column("g")[0].as_py() if table.num_rows else -1, rows)
        return sent if fan == 1 else G.route(sent, fan)

    return run


def _answer_classes(table: pa.Table) -> pa.Table:
    """Frequency classes: 0 for one document, then eight to a doubling."""
    b = table.column("b")[0].as_py()
    rows = [(g, n, *G.unpack(payload, n, "<u4", "<u2")[:2]) for g, n, payload in G.packed_rows(table)]
    prints = np.concatenate([r[2] for r in rows])
    _, cls = np.unique(prints, return_inverse=True)
    total = np.bincount(cls, weights=np.concatenate([r[3] for r in rows]))
    grade = np.minimum(np.ceil(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)[cls]
    out, at = [], 0
    for g, n, *_ in rows:
        out.append((g, b, n, grade[at : at + n].tobytes()))
        at += n
    return G.answer_table(CLASSES, out)


SUSPECTS = "doc_id long, n long, k long, prefix int, tokens binary, grades binary"


def _order_sets(percent: int, buckets: int):
    """Sets in the order (class, hash) without shingles of their own; those that may have a link."""

    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        tokens, size = _joined(table)
        keys = G.packed_keys(tokens, buckets)
        distinct = np.unique(keys)
        grade = np.zeros(len(distinct), np.uint8)
        found = G.answers(messages, CLASSES)
        for b, at in G.by_bucket(distinct >> np.uint64(32)):
            n, payload = found[b]
            grade[at] = np.frombuffer(payload, np.uint8, n)
        grade = grade[np.searchsorted(distinct, keys)]
        rows, at = [], 0
        for doc, n, k, count in zip(*(table.column(c).to_pylist() for c in ("doc_id", "n", "k")), size, strict=True):
            own, cls = tokens[at : at + count], grade[at : at + count]
            at += count
            prefix = int(prefix_length(n, percent)) - int((cls == 0).sum())
            if prefix > 0:
                order = np.lexsort((own, cls))[int((cls == 0).sum()) :]
                if len(order):
                    rows.append((doc, n, k, min(prefix, len(order)), own[order].tobytes(), cls[order].tobytes()))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "k", "prefix", "tokens", "grades"])

    return run


def _send_postings(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t.as_py(), np.uint64)[:k] for t, k in zip(batch.column("tokens"), batch.column("prefix").to_pylist(), strict=True)]
            if not tokens:
                continue
            doc = np.repeat(batch.column("doc_id").to_numpy(), [len(t) for t in tokens])
            token = np.concatenate(tokens)
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            # of the documents of a batch that share a shingle, the first meets the others' batches for all
            again = np.flatnonzero(token[1:] == token[:-1]) + 1
            begin = np.append(True, token[1:] != token[:-1])
            lead = doc[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
            pairs = np.unique(np.stack([lead[again], doc[again]], axis=1), axis=0) if len(again) else np.empty((0, 2), np.int64)
            token, doc = token[begin], doc[begin]
            bucket = (token >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows = [(b, at.stop - at.start, token[order[at]].tobytes() + doc[order[at]].tobytes()) for b, at in G.by_bucket(bucket[order])]
            if len(pairs):  # as postings of a token that only these pairs have
                rows.append((int(pairs[0, 0]) % buckets, -len(pairs), pairs.tobytes()))
            yield from G.packed_table(0, rows).to_batches()

    return run


def forest(pairs: np.ndarray) -> np.ndarray:
    """(least id, id) for all other members of each component of the pairs."""
    ids, index = np.unique(pairs, return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in index.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(x) for x in range(len(ids))], np.int64)
    other = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[root[other]], ids[other]], axis=1) if len(other) else np.empty((0, 2), np.int64)


def _coarse_edges(table: pa.Table) -> pa.Table:
    pairs, tokens, docs = [np.empty((0, 2), np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, n, payload in G.packed_rows(table):
        if n < 0:
            pairs.append(np.frombuffer(payload, np.int64).reshape(-1, 2))
        else:
            token, doc, _ = G.unpack(payload, n, "<u8", "<i8")
            tokens.append(token)
            docs.append(doc)
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    if len(token):
        begin = np.append(True, token[1:] != token[:-1])
        lead = doc[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
        pairs.append(np.unique(np.stack([lead[~begin], doc[~begin]], axis=1), axis=0))
    found = forest(np.concatenate(pairs))
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def joined(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the least row of their component, -1 for none."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for r in range(len(rows)):
        front = np.array([r])
        while len(front) and (front[0] != r or rows[r] < 0):
            rows[front] = r
            met = np.flatnonzero(linked[front].any(axis=0) & (columns < 0))
            columns[met] = r
            front = np.flatnonzero(linked[:, met].any(axis=1) & (rows < 0))
    return rows, columns


LINKS = "a long, b long, links long"


def _pair_links(percent: int):
    """(a, b, links): for each set b that has a link here, a set of its component and the rows it links with.

    Sets of side 0 are compared with those of side 1, or with each other where there is no side 1.
    """

    def run(table: pa.Table) -> pa.Table:
        tokens, size = _joined(table)
        # ranks in the global order: a token's class and hash
        grades = np.frombuffer(b"".join(table.column("grades").to_pylist()), np.uint8)
        order = np.lexsort((tokens, grades))
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.cumsum(np.append(False, tokens[order][1:] != tokens[order][:-1]))
        universe = int(rank.max(initial=-1)) + 1
        ids, n, k, side = (table.column(c).to_numpy() for c in ("doc_id", "n", "k", "side"))

        def sets(of: int) -> Sets:
            at = np.flatnonzero(side == of)
            at = at[np.argsort(ids[at])]
            return Sets(ids[at], n[at], k[at], rank[spread((np.cumsum(size) - size)[at], size[at])], size[at])

        one = sets(0)
        two = sets(1) if side.any() else one
        if table.column("paired")[0].as_py() and two is one or not len(one):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})
        linked = PrefixTree(two).linked(one, universe, percent)
        if two is one:
            np.fill_diagonal(linked, False)
        links = [linked.astype(np.int64) @ two.k, one.k @ linked]
        if two is one:
            np.fill_diagonal(linked, True)
        roots = joined(linked)
        out = []
        for s, root, count in zip((one, two), roots, links, strict=True):
            at = np.flatnonzero(count)
            out.append((one.ids[root[at]], s.ids[at], count[at]))
            if two is one:
                break
        return pa.table(dict(zip(("a", "b", "links"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


EDGES = "a long, b long"


def _dealt(sets: DataFrame, block_sets: int) -> DataFrame:
    """Adds the block ``i`` of each set: by its rarest shingle, and where too many have that, by its number too."""
    cells = sets.groupBy("part", "c").agg(F.ceil(F.count("*") / block_sets).alias("cells"))
    celled = sets.join(cells, ["part", "c"]).withColumn("cell", F.pmod(F.xxhash64(F.substring("tokens", 1, 8)), F.col("cells"))).drop("cells")
    shares = celled.groupBy("part", "c", "cell").agg(F.ceil(F.count("*") / block_sets).alias("shares"))
    share = F.pmod(F.xxhash64("doc_id"), F.col("shares"))
    return celled.join(shares, ["part", "c", "cell"]).withColumn("i", F.shiftleft("cell", 31) + share).drop("cell", "shares")


def _links(suspects: DataFrame, coarse: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """(a, b, links) of all sets that have a link, a row for each task that found some."""
    sizes = coarse.groupBy("label").agg(F.count("*").alias("size")).select(F.col("label").alias("part"), "size")
    parts = follow(coarse.select(F.col("id").alias("doc_id"), F.col("label").alias("part")), "part", sizes)
    # linked sets' lengths differ by a factor of 100 / percent at most, so by one class at most
    width = max(-math.log(percent / 100), 0.01) + 1e-9
    large = F.col("size") > block_sets
    placed = suspects.join(parts, "doc_id").withColumn("c", F.when(large, F.floor(F.log("n") / width)).otherwise(F.lit(0)).cast("int"))
    held = ("doc_id", "n", "k", "tokens", "grades")
    placed = materialize(placed.withColumn("large", large).select("part", "c", "large", "prefix", *held), "placed")
    columns = ("part", "c", "i", "c2", "j", "side", "paired", *held)
    none = F.lit(0).cast("long")
    work = placed.where("NOT large").withColumns({"i": none, "c2": F.lit(0), "j": none, "side": F.lit(0), "paired": F.lit(False)}).select(*columns)
    dealt = placed.where("large")
    if not dealt.isEmpty():
        dealt = materialize(_dealt(dealt, block_sets), "dealt")
        # blocks that have a prefix shingle in common; others have no link
        met = dealt.select("part", "c", "i", F.explode(F.expr("transform(sequence(0, prefix - 1), x -> substring(tokens, 8 * x + 1, 8))")).alias("token")).distinct()
        two = met.select("part", "token", F.col("c").alias("c2"), F.col("i").alias("j"))
        pairs = met.join(two, ["part", "token"]).where("(c2 = c AND i <= j) OR c2 = c + 1").select("part", "c", "i", "c2", "j").distinct()
        pairs = materialize(pairs.withColumn("paired", F.expr("c2 <> c OR i <> j")), "pairs")
        left = dealt.join(pairs, ["part", "c", "i"]).withColumn("side", F.lit(0))
        onward = pairs.where("paired").select("part", F.col("c").alias("c1"), F.col("i").alias("i1"), F.col("c2").alias("c"), F.col("j").alias("i"), "paired")
        right = dealt.join(onward, ["part", "c", "i"]).withColumn("side", F.lit(1)).withColumn("c2", F.col("c")).withColumn("j", F.col("i")).withColumn("c", F.col("c1")).withColumn("i", F.col("i1"))
        work = work.unionByName(left.select(*columns)).unionByName(right.select(*columns))
    return materialize(work.groupBy("part", "c", "i", "c2", "j").applyInArrow(_pair_links(percent), LINKS), "links")


def linked_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(id, text_md5, n, vertex, component, links) of each row.

    ``id`` is NULL_ID where the input has none, ``vertex`` the same number for all rows of a
    component and for no others, ``component`` the least id of these.
    """
    texts, plan = G.grouped(docs)
    buckets = plan.buckets
    copies = G.copies(texts)
    shared = G.ask(texts, copies, _send_prefixes(size, percent, buckets), G.answer_repeated(SHARED), plan.fan)
    base = materialize(G.conclude(texts, copies.unionByName(shared), _keep_sets(size, percent, buckets), BASE), "sets")

    # rows of equal sets are one vertex, named by the first that has the set with it
    held = F.min(F.when(F.col("tokens").isNotNull(), F.col("row_id")))
    same = base.where("n > 0").groupBy("digest").agg(F.coalesce(held, F.min("row_id")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("k"))
    same = materialize(same, "classes")
    own = base.where("tokens IS NOT NULL").select(F.col("row_id").alias("doc_id"), "g", "n", "tokens")
    sets = own.join(same.select(F.col("rep").alias("doc_id"), "k"), "doc_id")
    sent = sets.groupBy("g").applyInArrow(_send_tokens(buckets, plan.fan), G.PACKED if plan.fan == 1 else G.ROUTED)
    classes = G.exchange(sent, _answer_classes, plan.fan)
    suspects = materialize(G.conclude(sets, classes, _order_sets(percent, buckets), SUSPECTS), "suspects")
    postings = suspects.mapInArrow(_send_postings(buckets), G.PACKED)
    coarse = components(postings.groupBy("b").applyInArrow(_coarse_edges, EDGES))
    found = _links(suspects, coarse, percent, block_sets)

    counts = found.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("links"))
    linked = same.select("rep", "least").join(components(found).select(F.col("id").alias("rep"), "label"), "rep").join(counts, "rep")
    linked = materialize(linked, "linked")
    leasts = linked.groupBy("label").agg(F.min("least").alias("component"))
    known = same.select("digest", "rep", "least", "k").join(follow(linked, "label", leasts).select("rep", "label", "component", "links"), "rep", "left")
    known = known.select("digest", F.coalesce("label", "rep").alias("vertex"), F.coalesce("component", "least").alias("component"), (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    # rows meet their class by digest and group: one that a third of all rows are in is one row a group before
    known = base.where("n > 0").select("digest", "g").distinct().join(known, "digest")
    return base.select("row_id", "doc_id", "text_md5", "g", "n", "digest").join(known, ["digest", "g"], "left").select(
        F.col("doc_id").alias("id"), "text_md5", "n", F.coalesce("vertex", "row_id").alias("vertex"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )


def jaccard_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each document."""
    real = lambda c: F.when(F.col(c) != F.lit(int(G.NULL_ID)), F.col(c))
    found = linked_rows(docs, size, percent, block_sets)
    return found.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), F.col("links").alias("n_links"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    return jaccard_links(docs, size, percent, block_sets).drop("n_links")
