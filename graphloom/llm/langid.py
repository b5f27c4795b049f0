"""Language identification by cross-parsing.

A suffix automaton is built for each language from labelled text.  A text is parsed greedily
into the longest phrases that occur in a language's sample; the language that needs the
fewest phrases a symbol wins.

Text is lower-cased; runs of ASCII non-letters become one blank; other scripts are compared
as UTF-8 bytes.  All blocks of BLOCK symbols of a batch walk all automata in lockstep, each
from the root; then each block is walked again from the state in which the one before it
ended, beside its first walk, until both are in one state (a few phrases), which gives the
counts of one unbroken parse of the whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text when no labelled row exists; more than MOST_LANGUAGES labels are learned and
compared in blocks of so many, each with a bounded model of its own; a text of any length is parsed whole; ties go to the language that sorts first; repeated
rows are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import spread
from .hashing import column_bytes, pieces
from .store import carried_schema, whole_row

BLOCK = 512
#: Bounds of the labelled sample: rows of a language, symbols of a row (a stretch from a place
#: that a hash of the id chooses), symbols of a language, rows and symbols of all languages of a
#: block together (shared alike once there are many), languages of a block.
SAMPLE_ROWS, ROW_SYMBOLS, SAMPLE_SYMBOLS = 64, 1024, 20_000
ALL_ROWS, ALL_SYMBOLS, MOST_LANGUAGES = 2048, 160_000, 1024
UNKNOWN = "und"
FLAG_BIT = 30
FLAG = np.int32(1 << FLAG_BIT)

KEEP = np.zeros(256, bool)
KEEP[ord("a") : ord("z") + 1] = True
KEEP[128:] = True


class Model(NamedTuple):
    """table[state + symbol] is the next state, plus FLAG where a phrase begins."""

    languages: list[str]
    symbol: np.ndarray  # of each byte; 0 is none of the samples'
    table: np.ndarray
    roots: np.ndarray


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with one blank for each run of ASCII non-letters, none at a text's start."""
    letter = KEEP[buf]
    take = letter.copy()
    take[1:] |= letter[:-1]  # the first non-letter after a letter stays, as a blank
    starts = offsets[:-1][offsets[:-1] < len(buf)]
    take[starts] = letter[starts]
    where = np.concatenate([[0], np.cumsum(take)])
    return np.where(letter, buf, np.uint8(32))[take], where[offsets]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def build(samples: Mapping[str, bytes]) -> Model:
    """A model from normalised sample text of each language."""
    languages = sorted(samples)
    symbol = np.zeros(256, np.uint8)
    seen = sorted({b for s in samples.values() for b in s})
    symbol[seen] = np.arange(1, len(seen) + 1, dtype=np.uint8) if len(seen) < 256 else np.arange(256, dtype=np.uint8)
    width = len(seen) + 1
    parts, roots, base = [], [], 0
    for name in languages:
        steps = suffix_automaton(symbol[np.frombuffer(samples[name], np.uint8)].tolist())
        state = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
        sym = np.fromiter((c for s in steps for c in s), np.int64, len(state))
        to = np.fromiter((t for s in steps for t in s.values()), np.int64, len(state))
        first = np.full(width, base * width, np.int32)  # an unknown symbol is a phrase, and the root is next
        first[sym[state == 0]] = (base + to[state == 0]) * width
        table = np.tile(first | FLAG, (len(steps), 1))
        inner = state != 0
        table[state[inner], sym[inner]] = (base + to[inner]) * width
        parts.append(table.ravel())
        roots.append(base * width)
        base += len(steps)
    return Model(languages, symbol, np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(roots, np.int32))


def phrases(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text (columns) in each language (rows); ``buf`` is normalised."""
    symbols = model.symbol[buf]
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[doc] + nth * BLOCK
    length = np.minimum(size[doc] - nth * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")
    counts = np.zeros((len(model.languages), len(doc)), np.int64)
    state = np.broadcast_to(model.roots[:, None], counts.shape).copy()
    lanes = np.searchsorted(-length[order], -np.arange(BLOCK), "left") if len(doc) else np.zeros(BLOCK, int)  # blocks longer than t
    first = start[order]
    for t in range(int(length.max(initial=0))):
        n = lanes[t]
        got = model.table.take(state[:, :n] + symbols[first[:n] + t], mode="clip")
        counts[:, :n] += got >> FLAG_BIT
        state[:, :n] = got & (FLAG - 1)
    by_first = np.empty_like(state)
    by_first[:, order] = state
    ends = by_first.copy()
    out = np.zeros((len(model.languages), len(size)), np.int64)
    for k in range(len(model.languages)):
        out[k] = np.bincount(doc[order], weights=counts[k], minlength=len(size))
    # blocks after a text's first go on where the one before ended
    change = np.zeros(counts.shape, np.int64)
    after = np.flatnonzero(nth > 0)
    k, j = (x.ravel() for x in np.meshgrid(np.arange(len(model.languages)), after, indexing="ij"))
    while len(j):
        change[k, j], end = _rejoin(model, symbols, start[j], length[j], model.roots[k], ends[k, j - 1], by_first[k, j])
        moved = (end != ends[k, j]) & (j + 1 < len(doc))
        ends[k, j] = end
        k, j = k[moved], j[moved] + 1
        inner = nth[j] > 0
        k, j = k[inner], j[inner]
    for k in range(len(model.languages)):
        out[k] += np.bincount(doc, weights=change[k], minlength=len(size)).astype(np.int64)
    return out


def _rejoin(model: Model, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, root: np.ndarray, state: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how many phrases blocks differ when they begin in ``state`` and not at the root, and how they end."""
    change, end = np.zeros(len(start), np.int64), end.copy()
    lane = np.flatnonzero(state != root)
    one, two = state[lane], root[lane]
    for t in range(BLOCK):
        over = length[lane] <= t
        if over.any():
            end[lane[over]] = one[over]
            lane, one, two = lane[~over], one[~over], two[~over]
        if not len(lane):
            break
        symbol = symbols[start[lane] + t]
        a, b = model.table.take(one + symbol, mode="clip"), model.table.take(two + symbol, mode="clip")
        change[lane] += (a >> FLAG_BIT) - (b >> FLAG_BIT)
        one, two = a & (FLAG - 1), b & (FLAG - 1)
        apart = one != two
        lane, one, two = lane[apart], one[apart], two[apart]
    end[lane] = one
    return change, end


def lettered() -> Column:
    """Whether the text has a letter; a null text has none."""
    return F.coalesce(F.lower("text").rlike(r"\p{L}"), F.lit(False))


def lowered(docs: DataFrame, carry: bool = False) -> DataFrame:
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), lettered().alias("letters")]
    return docs.select(*own, *([whole_row(docs)] if carry else []))


def train(docs: DataFrame, eligible: Column, most_languages: int = MOST_LANGUAGES) -> list[Model]:
    """Models, one for each ``most_languages`` labels in their order, of at most SAMPLE_ROWS rows of each language.

    Rows are the first by a hash of the id.  Only ids and labels are ranked, and the ranking keeps
    its rows of a task and language before it shuffles; texts are read for the chosen ids alone.
    With many labels each has an equal share of ALL_ROWS and ALL_SYMBOLS, so neither what the
    driver gets at a time nor a model grows.
    """
    labelled = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    models, after = [], None
    while True:
        rest = labelled if after is None else labelled.where(F.col("lang") > after)
        labels = [r.lang for r in rest.select("lang").distinct().orderBy("lang").limit(most_languages).collect()]
        if not labels:
            return models
        models.append(_model(rest.where(F.col("lang") <= labels[-1]), len(labels)))
        after = labels[-1]


def _model(labelled: DataFrame, labels: int) -> Model:
    share = min(SAMPLE_ROWS, max(1, ALL_ROWS // labels))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("lang", "doc_id").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= share)
    chosen = sorted({r.doc_id for r in ids.select("doc_id").collect()})
    most = 16 * ROW_SYMBOLS  # enough raw text for a row's symbols; it bounds what the driver gets
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - ROW_SYMBOLS + 1, F.lit(1))).cast("int")
    stretch = F.substring(F.lower("text"), place + 1, F.lit(most))
    # one stretch an id, the least: rows that repeat an id add nothing to what the driver gets
    rows = labelled.where(F.col("doc_id").isin(chosen)).groupBy("lang", "doc_id", F.xxhash64("doc_id").alias("h")).agg(F.min(stretch).alias("t")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.doc_id, r.t)):
        raw = np.frombuffer(r.t.encode(), np.uint8)
        samples.setdefault(r.lang, []).append(normalise(raw, np.array([0, len(raw)]))[0][:ROW_SYMBOLS].tobytes())
    return build({k: b" ".join(v)[: min(SAMPLE_SYMBOLS, ALL_SYMBOLS // labels)] for k, v in samples.items()})


SCHEMA = "doc_id long, lang_pred string, score double, n_symbols long, n_phrases long"


NONE = np.iinfo(np.int64).max  # no language yet


def _parsed(shared, known: bool, last: bool, carry: bool):
    """Compares texts with one model's languages; ``known``: with what earlier models found, ``last``: for the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            buf, offsets = column_bytes(batch.column(1))
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for lo, hi in pieces(offsets, 4 << 20):
                part = batch.slice(lo, hi - lo)
                norm, off = normalise(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.diff(off)
                found = phrases(own, norm, off)
                ranked = np.sort(found, axis=0)
                name, least = names[found.argmin(axis=0)], ranked[0]
                other = ranked[1] if len(ranked) > 1 else np.full(hi - lo, NONE)
                if known:  # labels of earlier models sort first, so these keep ties
                    before, one, two = (part.column(c).to_numpy(zero_copy_only=False) for c in ("best", "least", "other"))
                    name = np.where(least < one, name, before)
                    other = np.where(least < one, np.minimum(one, other), np.minimum(two, least))
                    least = np.minimum(least, one)
                columns = {"doc_id": part.column(0)}
                if last:
                    judged = letters[lo:hi] & (size > 0)
                    score = np.where(judged, 1 - least / np.maximum(np.where(other == NONE, size, other), 1), 0.0)
                    columns |= {"lang_pred": pa.array(np.where(judged, name, UNKNOWN), pa.string()), "score": pa.array(np.clip(score, 0, 1)), "n_symbols": pa.array(size), "n_phrases": pa.array(np.where(judged, least, 0))}
                else:
                    columns |= {"text": part.column(1), "letters": part.column(2), "best": pa.array(name, pa.string()), "least": pa.array(least), "other": pa.array(other)}
                if carry:
                    columns["row"] = part.column("row")
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def predict(docs: DataFrame, models: Sequence[Model], carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, n_symbols, n_phrases) from the text alone; a map for each model, without a shuffle.

    score: by how much the winner undercuts the next language, 1 - fewest / next fewest
    phrases; with one language, 1 - phrases / symbols.  With ``carry`` the whole input row
    comes along as a struct ``row``.
    """
    models = models or [build({UNKNOWN: b""})]
    rows = source = spread(lowered(docs, carry))
    for k, model in enumerate(models):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's
        last = k == len(models) - 1
        schema = SCHEMA if last else "doc_id long, text string, letters boolean, best string, least long, other long"
        rows = rows.mapInArrow(_parsed(shared, k > 0, last, carry), carried_schema(schema, source) if carry else schema)
    return rows if models[0].languages != [UNKNOWN] else rows.withColumns({"score": F.lit(0.0), "n_phrases": F.lit(0).cast("long")})


def fold() -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """Train on the folds that are not 0 and predict every row."""
    models = train(docs, F.coalesce(fold() != 0, F.lit(False)))
    return predict(docs, models).withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "n_symbols", "n_phrases")
