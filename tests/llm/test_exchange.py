"""Groups and buckets without Spark: many small corpora, shrunken chunks, repeated ids."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from graphloom.llm import groups as G
from graphloom.llm import hashing, substring, suffix

from . import corpus

NOTHING = pa.table({"kind": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "payload": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int64()))})


class Exchange:
    def __init__(self, data, groups):
        dealt = [[] for _ in range(groups)]
        for i, text in data:
            dealt[random.Random(f"{i}{text}").randrange(groups)].append((corpus.order(i), text or ""))
        self.groups = {}
        for g, rows in enumerate(dealt):
            if rows:
                ids, texts = zip(*rows, strict=True)
                self.groups[g] = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "g": pa.array([g] * len(ids), pa.int32())})
        self.messages = dict.fromkeys(self.groups, NOTHING)

    def ask(self, send, answer):
        sent = pa.concat_tables([send(table, self.messages[g]) for g, table in self.groups.items()])
        for b in pc.unique(sent.column("b")).to_pylist():
            found = answer(sent.filter(pc.equal(sent.column("b"), b)))
            for g in pc.unique(found.column("g")).to_pylist():
                own = found.filter(pc.equal(found.column("g"), g)).select(NOTHING.column_names)
                self.messages[g] = pa.concat_tables([self.messages[g], own])

    def conclude(self, finish):
        return [tuple(r.values()) for g, table in self.groups.items() for r in finish(table, self.messages[g]).to_pylist()]


def made(rng, separator):
    words = [f"w{k}" for k in range(rng.choice([2, 3, 8, 50]))]
    data = []
    for i in range(rng.randint(1, 14)):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if data and rng.random() < 0.6:
            old = rng.choice(data)[1].split(separator)
            a = rng.randint(0, len(old))
            text = text[: rng.randint(0, len(text))] + old[a : rng.randint(a, len(old))] + text[:5]
        data.append((rng.choice([i, i, i, rng.randint(0, 6), None]), separator.join(text)))
    return data


@pytest.mark.parametrize("seed", range(40))
def test_substring_groups(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(hashing, "CHUNK", rng.choice([40, 1 << 20]))
    data, buckets = made(rng, " "), rng.choice([1, 3])
    own = Exchange(data, rng.choice([1, 2, 5]))
    own.ask(substring._send_anchors(buckets), G.answer_repeated(substring.ANCHORS))
    own.ask(substring._send_occurrences(buckets), substring._answer_occurrences)
    assert corpus.same(own.conclude(substring._finish(buckets, False)), corpus.substring(data))


@pytest.mark.parametrize("seed", range(40))
def test_suffix_groups(monkeypatch, seed):
    rng = random.Random(seed)
    chunk = rng.choice([64, 97, 333, 1 << 20])
    monkeypatch.setattr(hashing, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    data, buckets = made(rng, rng.choice([" ", "é"])), rng.choice([1, 3])
    own = Exchange(data, rng.choice([1, 2, 5]))
    own.ask(suffix._send_minimizers(buckets), suffix._answer_minimizers(rng.choice([2, 2000])))
    own.ask(suffix._send_fragments(buckets), suffix._answer_fragments)
    assert corpus.same(own.conclude(suffix._finish(buckets, False, False)), corpus.suffix(data))
