import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import histpack
from graphloom.llm.histpack import pack_texts, shortest_pack_first, vocabulary

from .corpus import frame, rows


def library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    own.encode_special_tokens = True
    return [e.ids for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packs_of(plan):
    packs, items = defaultdict(list), defaultdict(list)
    for size, start, rank, count, length, sequence, offset in zip(*(x.tolist() for x in plan), strict=True):
        for k in range(count):
            packs[sequence + k].append((offset, length))
            items[size, rank + k].append((start, length))
    return packs, items


def whole(spans):
    at = 0
    for start, length in sorted(spans):
        assert start == at and length > 0
        at += length
    return at


def test_plans_place_every_token_once():
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.choice([8, 16, 64, 256])
        histogram = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 10))}
        packs, items = packs_of(shortest_pack_first(histogram, capacity))
        assert len(items) == sum(histogram.values())
        assert all(whole(spans) == size for (size, _), spans in items.items())
        filled = [whole(spans) for spans in packs.values()]
        assert all(x == capacity or x & (x - 1) == 0 for x in filled)
        assert sum(x != capacity for x in filled) <= capacity.bit_length()


def one_by_one(histogram, capacity, full):
    """Each length alone into the pack with most room, as long as lengths fit or packs may be opened."""
    rooms = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if best is None or rooms[best] < size:
                assert len(rooms) < full
                rooms.append(capacity)
                best = len(rooms) - 1
            rooms[best] -= size
    return rooms


def test_runs_are_placed_as_one_by_one():
    histogram = {60: 3, 33: 4, 31: 4, 12: 9, 4: 30, 1: 40}  # nothing needs a cut
    total = sum(s * n for s, n in histogram.items())
    assert total % 64 == 0
    packs, items = packs_of(shortest_pack_first(histogram, 64))
    assert all(len(spans) == 1 for spans in items.values())
    assert sorted(one_by_one(histogram, 64, total // 64)) == [0] * len(packs)


def test_a_plan_does_not_grow_with_the_counts():
    rng = random.Random(2)
    histogram = {k: rng.randint(1, 50) for k in rng.sample(range(1, 4097), 900)}
    small = shortest_pack_first(histogram)
    large = shortest_pack_first({k: n * 10**9 + 7 for k, n in histogram.items()})
    assert len(large.size) < 2 * len(small.size) + 4096


def check(found, data, capacity):
    expected = defaultdict(list)
    for (doc_id, _), ids in zip(data, library([t for _, t in data]), strict=True):
        expected[doc_id].append(np.array([*ids, 2], "<u4"))
    by_doc, packs = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) // 4
        by_doc[r.doc_id].append((r.doc_tokens, r.start, bytes(r.ids)))
        packs[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == expected.keys()
    for doc_id, texts in expected.items():
        # pieces of rows of one id are told apart by tokens only: together they are the same tokens
        assert sum(len(x) for x in texts) == sum(len(ids) // 4 for _, _, ids in by_doc[doc_id])
        if len(texts) == 1:
            spans = sorted(by_doc[doc_id], key=lambda p: p[1])
            assert whole([(s, len(ids) // 4) for _, s, ids in spans]) == len(texts[0]) == spans[0][0]
            assert b"".join(ids for *_, ids in spans) == texts[0].tobytes()
    filled = [whole(spans) for spans in packs.values()]
    assert all(x == capacity or (x < capacity and x & (x - 1) == 0) for x in filled)


@pytest.mark.parametrize("limits", [{}, {"plan_bytes": 0, "base_rows": 0}])
def test_texts_come_back_from_their_pieces(spark, limits):
    data = rows()
    check(pack_texts(frame(spark, data), vocabulary(), 256, **limits).collect(), data, 256)


def test_empty_table_and_plain_query_columns(spark):
    assert pack_texts(frame(spark, []), vocabulary()).collect() == []
    found = pack_texts(frame(spark, [(1, None), (None, "")]), vocabulary()).collect()
    assert sorted((r.doc_id is None, r.start, r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens) for r in found) == [(False, 0, 1, zlib.crc32(b"\2\0\0\0"), 1), (True, 0, 1, zlib.crc32(b"\2\0\0\0"), 1)]
    assert sorted((r.sequence_id, r.offset) for r in found) == [(0, 0), (0, 1)]


def test_encoder_agrees_with_the_library():
    rng = random.Random(11)
    alphabet = [*"abzABZ019 .,;:!?'\"-_\t\n\x0b\x0c\r\x01\x1c\x85  ̸́̊̇ÀéßſıİΣςWw=<日本ａ٣‍😀", "'s", "'LL", "<|endoftext|>", "</w>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "", "Σ Σ. ΑΣ", "W̊", "å.,", "x" * 5000]
    own = histpack.WordEncoder(open(vocabulary(), "rb").read())
    for lo in range(0, len(texts), 37):  # batches with and without marks
        part = texts[lo : lo + 37]
        ids, offsets = own.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library(part)
    own.forget()
    ids, _ = own.encode(pa.array(texts, pa.string()).slice(3, 50))
    assert ids.tolist() == [i for x in library(texts[3:53]) for i in x]
