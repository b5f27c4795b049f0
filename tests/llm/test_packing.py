import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bpe, packing

from . import corpus


def brute_pack(lengths, capacities):
    """The same rules by plain scans over all bins and all pieces to come."""
    bins = []  # [opened capacity, contents]
    place = []
    price = lambda c: packing.OVERHEAD + c + c * c / packing.ATTENTION
    for i, n in enumerate(lengths):
        rooms = [(c - sum(held), b) for b, (c, held) in enumerate(bins) if c - sum(held) >= n]
        if rooms:
            b = min(rooms)[1]
        else:
            choices = []
            for c in sorted(capacities):
                if c >= n:
                    filled = n
                    for m in lengths[i + 1 :]:
                        if filled + m <= c:
                            filled += m
                    choices.append((price(min(x for x in capacities if x >= filled)) / filled, c))
            b = len(bins)
            bins.append([min(choices)[1], []])
        place.append((b, sum(bins[b][1])))
        bins[b][1].append(n)
    return [b for b, _ in place], [o for _, o in place], [min(c for c in capacities if c >= sum(held)) for _, held in bins]


@pytest.mark.parametrize("seed", range(12))
def test_pack_equals_brute_force(seed):
    rng = random.Random(seed)
    capacities = rng.choice([packing.CAPACITIES, (16, 40, 100), (7, 64), (50,)])
    top = max(capacities)
    kinds = [lambda: rng.randint(1, top), lambda: rng.randint(1, max(1, top // 9)), lambda: rng.choice([top // 3, top // 2 or 1, top])]
    kind = rng.choice(kinds)
    lengths = sorted((kind() for _ in range(rng.randint(0, 160))), reverse=True)
    assert packing.pack(lengths, capacities) == brute_pack(lengths, capacities)


def test_all_sizes_compete():
    mix = lambda lengths: {c: packing.pack(sorted(lengths, reverse=True))[2].count(c) for c in packing.CAPACITIES}
    only = lambda c, n: {k: n if k == c else 0 for k in packing.CAPACITIES}
    assert mix([500] * 300) == only(1024, 150)  # longer bins would be as full but cost more a token
    assert mix([340] * 300) == only(1024, 100)
    assert mix([682] * 300) == only(2048, 100)  # one leaves a third of 1024, three fill 2048
    assert mix([1300] * 30) == only(4096, 10)
    assert mix([1400] * 30) == only(2048, 30)  # two leave a third of 4096
    rng = random.Random(3)
    short = mix([rng.randint(50, 300) for _ in range(3000)])
    assert short[1024] > short[2048] and short[512] > 0 and not short[4096]
    spread = mix([min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(3000)])
    assert min(spread[c] for c in (1024, 2048, 4096)) > 100


def test_pack_never_overfills_and_downsizes():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 4096) for _ in range(500)), reverse=True)
    bins, offsets, capacity = packing.pack(lengths)
    used = np.bincount(bins, weights=lengths)
    for b, c in enumerate(capacity):
        assert used[b] <= c and not any(used[b] <= small < c for small in packing.CAPACITIES)
    spans = sorted((b, o, o + n) for b, o, n in zip(bins, offsets, lengths, strict=True))
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(spans, spans[1:], strict=False))
    assert sum(lengths) / sum(capacity) > 0.95


def test_pack_takes_the_tightest_bin():
    bins, _, capacity = packing.pack([60, 45, 40, 30, 10], capacities=[100])
    assert bins == [0, 1, 0, 1, 1] and capacity == [100, 100]
    assert packing.pack([], [8]) == ([], [], [])


def dealt(rows, cuts):
    """(id, salt, piece) of rows that come in batches cut at some places."""
    path, pattern = bpe.vocabulary()
    data = open(path, "rb").read()
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    batches = [b for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True) for b in table.slice(lo, hi - lo).combine_chunks().to_batches()]
    run = packing._tokenise(SimpleNamespace(value=data), pattern, 16, packing.SEPARATOR, packing.id_kind(data, packing.SEPARATOR))
    return Counter((i, s, p, x) for b in run(iter(batches)) for i, s, p, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "salt", "piece", "ids")), strict=True))


def test_a_repeated_task_deals_alike(monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2]), rng.choice(["same words", "others", "many " * 40, "", None])) for _ in range(60)]
    first = dealt(rows, [])
    for cuts in ([10, 33], [1, 2, 3]):
        rng.shuffle(rows)
        monkeypatch.setattr(bpe, "BATCH_CHARS", rng.choice([30, 1000]))
        assert dealt(rows, cuts) == first
    same = {s for i, s, p, _ in first if i is None and p == 0}
    assert len(same) == sum(i is None and bool(t) for i, t in rows)  # equal rows spread


def test_sequences_hold_every_token(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 3000)  # texts longer than a batch, and batches of several texts
    docs = corpus.frame(spark)
    path, pattern = bpe.vocabulary()
    expected = sorted(
        ((r.doc_id is None, r.doc_id or 0), [*r.ids, packing.SEPARATOR]) for r in bpe.encode_documents(docs, path, pattern, keep_ids=True).collect() if r.ids
    )
    found = packing.pack_documents(docs, path, pattern, capacities=(64, 128, 512), shard_bytes=2000).collect()
    assert len({r.bin_id for r in found}) == len(found) > 5
    pieces = []
    for r in found:
        assert len(r.input_ids) == r.n_tokens == sum(p.n_tokens for p in r.pieces) and [p.doc_id for p in r.pieces] == r.doc_ids
        assert r.capacity == min(c for c in (64, 128, 512) if c >= r.n_tokens)
        at = 0
        for p in r.pieces:
            assert p.bin_offset == at and p.token_offset == 512 * p.piece
            pieces.append(((p.doc_id is None, p.doc_id or 0), p.piece, r.input_ids[at : at + p.n_tokens]))
            at += p.n_tokens
    single = {}
    for i, k, ids in sorted(pieces):
        single.setdefault(i, []).append((k, ids))
    rebuilt = []
    for i, parts in single.items():
        copies = sum(k == 0 for k, _ in parts)
        if copies == 1:
            rebuilt.append((i, [x for _, ids in parts for x in ids]))
        else:  # repeated rows of one piece each
            rebuilt += [(i, ids) for _, ids in parts]
    assert sorted(rebuilt) == expected


def test_nothing_to_pack(spark):
    vocabulary = bpe.vocabulary()
    assert packing.pack_documents(corpus.frame(spark, [(1, None), (2, "")]), *vocabulary).collect() == []
    assert packing.pack_documents(corpus.frame(spark, []), *vocabulary).collect() == []
    again = packing.pack_documents(corpus.frame(spark, [(None, "same words")] * 5 + [(3, " ")]), *vocabulary).collect()
    assert sum(len(r.doc_ids) for r in again) == 6


def test_null_ids_spread_over_shards(spark):
    docs = corpus.frame(spark, [(None, f"text {k} of many") for k in range(400)])
    found = packing.pack_documents(docs.coalesce(1), *bpe.vocabulary(), shard_bytes=200).collect()
    assert len({r.bin_id.split("-")[0] for r in found}) > 3
