import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import phrases
from graphloom.llm.phrases import Bitmap, Buckets, Grams, collocations

from .corpus import FOLD

PIECES, WORD = re.compile(rb"[.,;:!?\x0a-\x0d]"), re.compile(rb"[^\x20\x09]+")
SCHEMA = "doc_id long, text string, lang string, n int, phrase string, part int, key string, `row` int"


def frame(spark, data):
    return spark.createDataFrame([(i, t, x, 1, "p", 2, "k", 3) for i, (t, x) in enumerate(data)], SCHEMA)


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" if k % 3 else f"É{k}" for k in range(25)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["New", "york", "city", "Hall"], ["a"] * rng.randint(1, 6), [rng.choice(vocabulary)], [rng.choice(vocabulary[:4])], ["x", "y"], ["p", "q", "r", "s", "t", "u"]])
            words[-1] += rng.choice(["", "", "", "", ".", ",", "\n", "\x0b", "\t"])
        out.append((" ".join(words), rng.choice(["en", "de", None, "und", ""])))
    odd = [None, "", " \t ", ".,;:!?\n\r", "one", "..a..a..", "long " * 5000, "  x y \x1cz"]
    return out + [(t, "en") for t in odd] + out[:5]


def brute(data, longest=5, least=100, first=2000):
    """By language: counts of everything, then the contract word by word."""
    counts, totals = Counter(), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        for piece in PIECES.split((text or "").encode().translate(FOLD)):
            words = WORD.findall(piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = lang, words[i : i + size]
                held[key] = max(held[key], a)
    found = []
    for (lang, words), a in candidates.items():
        if 100 * held[lang, words] >= 100 * a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, -score, -a, b" ".join(words), counts[lang, words[:k]], counts[lang, words[k:]], totals[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= first:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


@pytest.mark.parametrize(("longest", "least", "first", "bits"), [(5, 8, 2000, 26), (5, 3, 40, 16), (3, 1, 10, 16), (2, 300, 5, 16)])
def test_equals_brute_force(spark, longest, least, first, bits):
    data = corpus()
    found = collocations(frame(spark, data), longest, least, first, bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(brute(data, longest, least, first))


def test_bitmaps_of_little_room_cost_work_only(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    data = corpus(9, 60)
    assert sorted(map(tuple, collocations(frame(spark, data), 4, 5, 100, 6).collect())) == sorted(brute(data, 4, 5, 100))


def test_empty_tables_and_texts(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(None, None), ("", "en")])).collect() == []


def test_products_pass_64_bits(spark):
    many = 9 * 10**14
    rows = spark.createDataFrame([("en", "a b", 2, many), ("en", "a", 1, many + 7), ("en", "b", 1, many + 13)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 5 * 10**15)], "lang string, n long")
    original = phrases.counted_phrases
    try:
        phrases.counted_phrases = lambda *_: (rows, totals)
        found = collocations(rows).first()
    finally:
        phrases.counted_phrases = original
    assert found.score == 1000 * many * 5 * 10**15 // ((many + 7) * (many + 13))


def test_buckets_give_the_same_bits_however_they_are_dealt():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**64, 5000, np.uint64) >> np.uint64(52) << np.uint64(52)
    whole = Counter((hashes >> np.uint64(54)).tolist())
    for parts in (1, 4, 16):
        rows = {k: [] for k in range(parts)}
        for some in np.array_split(hashes, 7):
            own = Buckets(10, 9, parts)
            own.add(some)
            for k, payload in own.rows():
                rows[k].append(payload)
        own = Buckets(10, 9, parts)
        bits = Bitmap(10, b"".join(own.total(rows[k]) for k in range(parts)))
        assert bits.holds(np.arange(1024, dtype=np.uint64) << np.uint64(54)).tolist() == [whole[k] >= 9 for k in range(1024)]


def test_a_long_gram_keys_by_whole_numbers():
    words = " ".join(f"word{k}" for k in range(3000)) + " " + " ".join(f"word{k}" for k in range(3000))
    data = np.frombuffer(words.encode(), np.uint8)
    grams = Grams(data, np.array([0, len(data)]), pa.array(["en"]))
    found = grams.counted(np.flatnonzero(grams.inside(6)), 6)
    assert Counter(found.column(2).to_pylist()) == Counter({2: 2995, 1: 5})
