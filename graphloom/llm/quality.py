"""Quality rules from repetition coverage.

Rolling hashes over bytes and words find duplicated lines and duplicated word n-grams of
several lengths inside each text; the verdict compares the characters that they cover with
the characters of all words.

Defined results: a null, empty or blank text has zero counts and fails the base rules;
repeated rows are judged one by one; an empty table gives an empty result; other columns are
ignored.  A text is worked on as a whole, in memory proportional to its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import spread
from .hashing import WORD_POWERS, Words, column_bytes, mix, ngrams, pieces, prefix_sums, slice_hashes, slices, within
from .store import carried_schema, whole_row

BASE_GRAM = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DUP_LINE_PERCENT = 20
#: Percent of word characters that duplicated n-grams of each length may cover.
MAX_GRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
GRAMS = tuple(sorted(MAX_GRAM_PERCENT))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in GRAMS))
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurred before."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each of some adjoining texts."""
    docs = len(offsets) - 1
    words = Words(buf, offsets)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    size = points[words.end] - points[words.start]
    by_doc = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[words.first])
    out = {"n_words": np.diff(words.first), "word_chars": by_doc(size)}
    out["n_symbols"] = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[buf])])[offsets])

    owner = words.owners()
    salt = mix(owner.astype(np.uint64) + np.uint64(1))
    hashes = words.hashes()
    inside = within(len(words), words.first, BASE_GRAM)
    at = np.flatnonzero(inside)
    keys = ngrams(hashes, BASE_GRAM)[at] ^ salt[at] if len(at) else np.empty(0, np.uint64)
    at = at[_repeated(keys)]
    out["n_repeat_words"] = by_doc(_covered(at, BASE_GRAM, len(words)))
    sums = prefix_sums(hashes, WORD_POWERS) if len(at) else None
    for n in range(BASE_GRAM + 1, GRAMS[-1] + 1):
        # a repeated n-gram begins with a repeated (n-1)-gram, and so does its second word
        if len(at):
            at = at[:-1][np.diff(at) == 1]
            at = at[at + n <= words.first[owner[at] + 1]]
            at = at[_repeated(slice_hashes(sums, at, at + n, WORD_POWERS) ^ salt[at])]
        if n in MAX_GRAM_PERCENT:
            out[f"dup_chars_{n}"] = by_doc(np.where(_covered(at, n, len(words)), size, 0)) if len(at) else np.zeros(docs, np.int64)

    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    ends = ends - (buf[ends - 1] == 10) if len(ends) else ends
    lo, hi = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    real = hi > lo
    starts, ends, lo, hi = starts[real], ends[real], lo[real], hi[real]
    line_doc = owner[lo]
    dup = _again(slices(buf, starts, ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=docs)
    totals = np.concatenate([[0], np.cumsum(size)])
    out["dup_line_chars"] = np.bincount(line_doc[dup], weights=(totals[hi] - totals[lo])[dup], minlength=docs).astype(np.int64)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each row; columns after the text are passed on."""
    for batch in batches:
        buf, offsets = column_bytes(batch.column(1))
        for lo, hi in pieces(offsets):
            found = measure(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rest = [batch.column(k).slice(lo, hi - lo) for k in range(2, batch.num_columns)]
            columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(np.asarray(found[c], np.int64)) for c in COUNTS), *rest]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *batch.schema.names[2:]])


def quality_rules(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each text; a map without a shuffle.

    With ``carry`` the whole input row comes along as a struct ``row``.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([whole_row(docs)] if carry else []))
    counts = spread(source).mapInArrow(_measured, carried_schema(SCHEMA, source) if carry else SCHEMA)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within_limits = 100 * F.col("dup_line_chars") <= MAX_DUP_LINE_PERCENT * F.col("word_chars")
    for n, most in MAX_GRAM_PERCENT.items():
        within_limits &= 100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars")
    return counts.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & within_limits)
