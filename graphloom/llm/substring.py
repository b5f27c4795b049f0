"""Substring dedup with difference-cover anchors.

A window is WINDOW consecutive words.  Anchors are ANCHOR words long and start at positions
whose remainder modulo PERIOD lies in a perfect difference cover, so whatever two places a
window occurs at, some shift below PERIOD puts both on cover positions: two equal windows
share an aligned anchor.  Only anchors are hashed (96 bits).  An anchor that occurs again goes
to its bucket with the words around it, up to PERIOD - 1 on either side, and there the match is
extended word by word: occurrences that agree on s words before the anchor and on PERIOD - 1 - s
after it have the window in common that starts s words before; its first place, by (doc_id,
start), stays, and all others are later ones.

Steps: later exact copies are set aside; groups ask which anchors repeat; groups send these with
their surroundings, each distinct surrounding once, and learn which of its windows are later
ones; each text drops the words of its later windows.

Defined results: a null or blank text has no words; a text of fewer than WINDOW words loses
nothing; a very long text is worked on whole, in memory proportional to its length; equal
(doc_id, start) places of repeated rows do not remove each other; a null id comes first; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import groups as G
from .hashing import Words, mix, ngrams, within

WINDOW, PERIOD, COVER = 20, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
SIDE = PERIOD - 1  # words that a window may have on one side of an anchor
ANCHORS, LATER = 1, 2  # kinds of answers
IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Group(G.Texts):
    def __init__(self, table: pa.Table, messages: pa.Table, buckets: int):
        super().__init__(table, messages)
        self.buckets = buckets
        self.words = Words(self.buf, self.offsets)
        self.hashes = self.words.hashes()
        self.first, self.owner = self.words.first, self.words.owners()
        self.live = ~self.copy[self.owner]
        nth = np.arange(len(self.words)) - self.first[self.owner]
        inside = within(len(self.words), self.first, ANCHOR)
        self.at = np.flatnonzero(inside & IN_COVER[nth[: len(inside)] % PERIOD] & self.live[: len(inside)])
        self.keys = G.packed_keys(ngrams(self.hashes, ANCHOR)[self.at], buckets) if len(self.at) else np.empty(0, np.uint64)

    def occurrences(self, messages: pa.Table) -> None:
        """Repeated anchors, the classes of those with equal surroundings, and the first place of each class."""
        distinct = np.unique(self.keys)
        repeated = [np.empty(0, np.uint64)]
        found = G.answers(messages, ANCHORS)
        for b, where in G.by_bucket(distinct >> np.uint64(32)):
            n, payload = found[b]
            repeated.append(distinct[where][np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)])
        at = self.at[np.isin(self.keys, np.concatenate(repeated))]
        low, high = self.first[self.owner[at]], self.first[self.owner[at] + 1]
        codes = mix(self.hashes) >> np.uint64(16) | np.uint64(1)  # 0 is no word
        around = np.zeros((2 * SIDE, len(at)), np.uint64)
        for k in range(SIDE):
            there = at - k - 1 >= low
            around[k, there] = codes[at[there] - k - 1]
            there = at + ANCHOR + k < high
            around[SIDE + k, there] = codes[at[there] + ANCHOR + k]
        self.before, self.after = np.minimum(at - low, SIDE), np.minimum(high - at - ANCHOR, SIDE)
        one = ngrams(self.hashes, ANCHOR)[at] if len(at) else np.empty(0, np.uint64)
        two = (ngrams(mix(self.hashes ^ np.uint64(0x2545F4914F6CDD1D)), ANCHOR)[at] if len(at) else one).astype(np.uint32)
        whole = one
        for row in around:
            whole = mix(whole ^ row)
        doc, place = self.ids[self.owner[at]], (at - low).astype(np.int32)
        order = np.lexsort((place, doc, two, whole))
        begins = np.ones(len(at), bool)
        begins[1:] = (whole[order][1:] != whole[order][:-1]) | (two[order][1:] != two[order][:-1])
        lead = order[begins]
        bucket = (one[lead] >> np.uint64(33)) % np.uint64(self.buckets)
        by = np.argsort(bucket, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        self.start, self.cls = at, np.empty(len(at), np.int64)
        self.cls[order] = number[np.cumsum(begins) - 1]
        lead = lead[by]
        self.bucket, self.one, self.two, self.around = bucket[by], one[lead], two[lead], around[:, lead]
        self.doc, self.place = doc[lead], place[lead]
        self.again = (doc != self.doc[self.cls]) | (place != self.place[self.cls])


def _send_anchors(buckets: int):
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        own = _Group(table, messages, buckets)
        keys, counts = np.unique(own.keys, return_counts=True)
        rows = []
        for b, at in G.by_bucket(keys >> np.uint64(32)):
            part = keys[at]
            rows.append((b, len(part), part.astype(np.uint32).tobytes() + np.packbits(counts[at] > 1).tobytes()))
        return G.packed_table(own.g, rows)

    return run


def _send_occurrences(buckets: int):
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        own = _Group(table, messages, buckets)
        own.occurrences(messages)
        rows = []
        for b, at in G.by_bucket(own.bucket):
            near = own.around[:, at]
            parts = (own.one[at], own.doc[at], own.two[at], own.place[at], (near >> np.uint64(16)).astype(np.uint32), near.astype(np.uint16))
            rows.append((b, at.stop - at.start, b"".join(x.tobytes() for x in parts)))
        return G.packed_table(own.g, rows)

    return run


def refined(cls: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Classes of equal (class, code)."""
    order = np.lexsort((code, cls))
    out = np.empty(len(cls), np.int64)
    out[order] = np.cumsum(np.append(False, (cls[order][1:] != cls[order][:-1]) | (code[order][1:] != code[order][:-1]))[: len(cls)])
    return out


def later_windows(cls: np.ndarray, around: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For occurrences of anchors (``cls``) a bit for each shift: whether the window that starts so many words before has an earlier place."""
    left, right = [cls], [cls]
    for k in range(SIDE):
        left.append(refined(left[-1], around[k]))
        right.append(refined(right[-1], around[SIDE + k]))
    out = np.zeros(len(cls), np.uint8)
    for s in range(PERIOD):
        there = np.ones(len(cls), bool)
        if s:
            there &= around[s - 1] != 0
        if s < SIDE:
            there &= around[2 * SIDE - 1 - s] != 0
        at = np.flatnonzero(there)
        one, two = left[s][at], right[SIDE - s][at]
        order = np.lexsort((place[at], doc[at], two, one))
        begins = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(at)]
        at = at[order]
        lead = at[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        out[at] |= ((doc[at] != doc[lead]) | (place[at] != place[lead])).astype(np.uint8) << np.uint8(s)
    return out


def _answer_occurrences(table: pa.Table) -> pa.Table:
    b = table.column("b")[0].as_py()
    wide = 2 * SIDE
    rows = [(g, n, *G.unpack(payload[: 24 * n], n, "<u8", "<i8", "<u4", "<i4")[:4], payload[24 * n :]) for g, n, payload in G.packed_rows(table)]
    one, doc, two, place = (np.concatenate([r[k] for r in rows]) for k in (2, 3, 4, 5))
    high, low = (
        np.concatenate([np.frombuffer(r[6], kind, wide * r[1], at * wide * r[1]).reshape(wide, r[1]) for r in rows], axis=1) for kind, at in (("<u4", 0), ("<u2", 4))
    )
    cls = refined(refined(np.zeros(len(one), np.int64), one), two)
    several = np.flatnonzero((np.bincount(cls) > 1)[cls])
    mask = np.zeros(len(one), np.uint8)
    around = high[:, several].astype(np.uint64) << np.uint64(16) | low[:, several]
    mask[several] = later_windows(cls[several], around, doc[several], place[several])
    out, at = [], 0
    for g, n, *_ in rows:
        out.append((g, b, n, mask[at : at + n].tobytes()))
        at += n
    return G.answer_table(LATER, out)


def _finish(buckets: int, keep_text: bool):
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        own = _Group(table, messages, buckets)
        own.occurrences(messages)
        mask = np.zeros(len(own.one), np.uint8)
        found = G.answers(messages, LATER)
        for b, at in G.by_bucket(own.bucket):
            n, payload = found[b]
            mask[at] = np.frombuffer(payload, np.uint8, n)
        bits = np.where(own.again, np.uint8(255), mask[own.cls])
        steps = np.zeros(len(own.words) + 1, np.int32)
        for s in range(PERIOD):
            window = (own.before >= s) & (own.after >= SIDE - s) & ((bits >> np.uint8(s)) & np.uint8(1)).astype(bool)
            np.add.at(steps, own.start[window] - s, 1)
            np.add.at(steps, own.start[window] - s + WINDOW, -1)
        removed = np.cumsum(steps[:-1]) > 0
        n_words = np.diff(own.first)
        removed |= own.copy[own.owner] & (n_words[own.owner] >= WINDOW)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[own.first])
        digests, kept = [], []
        for d in range(len(own)):
            if n_removed[d] == n_words[d]:
                text = b""
            else:
                words = own.text(d).split()
                text = b" ".join(words if not n_removed[d] else compress(words, (~removed[own.first[d] : own.first[d + 1]]).tolist()))
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if keep_text else "")
        columns = {"doc_id": G.id_array(own.ids), "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if keep_text else {}))

    return run


def dedup_substrings(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each text."""
    texts, plan = G.grouped(docs)
    buckets = plan.buckets
    copies = G.copies(texts)
    anchors = G.ask(texts, copies, _send_anchors(buckets), G.answer_repeated(ANCHORS), plan.fan)
    known = copies.unionByName(anchors)
    later = G.ask(texts, known, _send_occurrences(buckets), _answer_occurrences, plan.fan)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return G.conclude(texts, known.unionByName(later), _finish(buckets, keep_text), schema)
