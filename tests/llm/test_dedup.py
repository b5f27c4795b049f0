import random

import numpy as np
import pytest

from graphloom.llm import groups, jaccard, substring, suffix
from graphloom.llm.bwt import CollectionBWT
from graphloom.llm.components import components

from . import corpus

EMPTY = []


@pytest.fixture(params=[(1 << 19, 2 << 20, 1, 1 << 40), (400, 600, 1, 1 << 40), (400, 600, 1 << 40, 900)], ids=["one group", "many groups", "relayed"])
def sizes(request, monkeypatch):
    for name, value in zip(("GROUP_BYTES", "BUCKET_BYTES", "MESSAGE_BYTES", "MOST_BYTES"), request.param, strict=True):
        monkeypatch.setattr(groups, name, value)


def test_groups_and_messages_are_bounded_at_any_size():
    for size in (10**5, 10**9, 3 * 10**10, 10**11, 10**13, 10**15):
        n, b, fan = groups.layout(size)
        assert size / n <= groups.MOST_BYTES and size / b <= groups.MOST_BYTES
        assert n * (b // fan) <= 2 * size / groups.MESSAGE_BYTES + 1 and (fan > 1) == (size > 2 * 10**11)


def test_rows_travel_in_one_payload():
    rows = [(1, -(2**40), b""), (2, 3, b"abc"), (1, 1, b"x" * 1000)]
    assert list(groups.disclose(groups.enclose(rows))) == rows


def stored(spark, tmp_path, data):
    path = f"file://{tmp_path}/docs"
    corpus.frame(spark, data).write.parquet(path)
    return spark.read.parquet(path)


def test_substring_equals_brute_force(spark, tmp_path, sizes):
    docs = stored(spark, tmp_path, corpus.rows())
    found = substring.dedup_substrings(docs)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert corpus.same(found.collect(), corpus.substring(corpus.rows()))


def test_difference_cover_aligns_any_two_places():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + s) % substring.PERIOD in substring.COVER and (j + s) % substring.PERIOD in substring.COVER for s in range(substring.PERIOD))


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_equals_brute_force(spark, tmp_path, sizes, hot):
    docs = stored(spark, tmp_path, corpus.rows())
    found = suffix.dedup_bytes(docs, hot_docs=hot)
    assert corpus.same(found.collect(), corpus.suffix(corpus.rows()))


def test_suffix_keeps_characters_whole_and_carries_columns(spark):
    passage = "é" * 25  # 50 bytes
    docs = corpus.frame(spark, [(1, "a" + passage), (2, "b" + passage + "tail"), (3, None)])
    found = {r.doc_id: r for r in suffix.dedup_bytes(docs, keep_text=True, carry=True).collect()}
    assert found[1].kept_text == "a" + passage and found[2].kept_text == "btail" and found[3].kept_text == ""
    assert found[2].row.label == "l" and found[2].row.doc_id == 2


@pytest.mark.parametrize("block_sets", [2048, 3])
def test_jaccard_equals_brute_force(spark, tmp_path, sizes, block_sets):
    docs = stored(spark, tmp_path, corpus.rows())
    found = jaccard.jaccard_components(docs, block_sets=block_sets)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert corpus.same(found.collect(), corpus.jaccard(corpus.rows()))


def test_jaccard_large_group_over_blocks(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    data = []
    for i in range(60):
        near = list(base)
        near[rng.randrange(80)] = f"x{i}"
        data.append((i, " ".join(near)))
    data += [(100 + i, " ".join(base[:40]) + f" q{i} " + " ".join(f"y{i}-{k}" for k in range(3))) for i in range(20)]
    found = jaccard.jaccard_components(corpus.frame(spark, data), block_sets=8)
    assert corpus.same(found.collect(), corpus.jaccard(data))


def test_jaccard_threshold_is_inclusive(spark):
    a = [f"t{k}" for k in range(11)]  # 7 shingles
    data = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join(a[:8])), (4, " ".join([*a[:8], "z"]))]
    assert corpus.same(jaccard.jaccard_components(corpus.frame(spark, data)).collect(), corpus.jaccard(data))


@pytest.mark.parametrize("run", [substring.dedup_substrings, suffix.dedup_bytes, jaccard.jaccard_components])
def test_empty_table(spark, run):
    assert run(corpus.frame(spark, EMPTY)).collect() == []


@pytest.mark.parametrize("run", [substring.dedup_substrings, suffix.dedup_bytes, jaccard.jaccard_components])
def test_only_null_and_blank_texts(spark, run):
    assert len(run(corpus.frame(spark, [(1, None), (2, ""), (3, " \n"), (None, None)])).collect()) == 4


def _sorted_suffixes(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    found = [([b + 1 for b in t[o:]] + [i - len(texts)], int(offsets[i]) + o, t[o:]) for i, t in enumerate(texts) for o in range(len(t) + 1)]
    found.sort(key=lambda x: x[0])
    common = [0]
    for (_, _, a), (_, _, b) in zip(found, found[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        common.append(n)
    return [s for _, s, _ in found], common


@pytest.mark.parametrize("block", [3, 16, 1 << 16])
def test_column_wise_transform(block):
    rng = random.Random(block)
    for trial in range(40):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdef") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 10))]
        texts += texts[:2] if trial % 3 == 0 else []
        with CollectionBWT(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), block=block) as built:
            parts = list(built.blocks())
        starts, common = _sorted_suffixes(texts)
        assert np.concatenate([a for a, _ in parts]).tolist() == starts
        assert np.concatenate([b for _, b in parts]).tolist() == common


@pytest.mark.parametrize("small", [8 << 20, -1], ids=["broadcast", "salted"])
def test_components_of_paths_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr("graphloom.llm.components.BROADCAST_BYTES", small)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(500, 400), (7, 7)]
    found = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 130)) and found[500] == found[400] == 400


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
