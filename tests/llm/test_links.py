"""Numbers of links, and rows without an id of their own, against brute force."""

import collections
import random

import numpy as np
import pytest

from graphloom.llm import groups, jaccard, substring, suffix, trie

from . import corpus


def links(data, percent=75):
    """(doc_id, n_shingles, component_id, n_links) of each row; every row is a vertex."""
    sets = [corpus.shingles(t) for _, t in data]
    count = collections.Counter()
    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                count.update((a, b))
    return [(*row, count[k]) for k, row in enumerate(corpus.jaccard(data, percent))]


def near_copies(rng, n, tag, words=60):
    base = [f"{tag}{k}" for k in range(words)]
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(1, 2)):
            text[rng.randrange(words)] = f"{tag}-{i}"
        yield " ".join(text[: rng.randint(words - 8, words)])


@pytest.mark.parametrize("seed", range(6))
def test_tree_links_equal_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(trie, "EDGE", rng.choice([1, 3, 32]))
    monkeypatch.setattr(trie, "LOOKUPS", 64)
    monkeypatch.setattr(trie, "MARKS", rng.choice([100, 1 << 20]))
    percent = rng.choice([40, 75])
    bases = [rng.sample(range(90), 30) for _ in range(3)]
    made = [sorted({x for x in rng.choice(bases) if rng.random() < 0.9} | {rng.randrange(90)}) for _ in range(60)]
    made += made[:3] + [made[4][:2]]
    extra = [rng.randint(0, 4) for _ in made]  # members that no other set has

    def sets(at):
        size = np.array([len(made[x]) for x in at])
        return trie.Sets(np.array(at), size + np.array([extra[x] for x in at]), np.ones(len(at), int), np.concatenate([made[x] for x in at]), size)

    def linked(a, b):
        both = len({*made[a]} & {*made[b]})
        return 100 * both >= percent * (len(made[a]) + extra[a] + len(made[b]) + extra[b] - both)

    one, two = list(range(25)), list(range(25, len(made)))
    for left, right in ((one, two), (two, two)):
        found = trie.PrefixTree(sets(right)).linked(sets(left), 90, percent)
        assert found.tolist() == [[linked(a, b) for b in right] for a in left] and found.any()


@pytest.mark.parametrize("block_sets", [2048, 7])
def test_every_link_is_counted(spark, block_sets):
    rng = random.Random(5)
    texts = [*near_copies(rng, 40, "a"), *near_copies(rng, 9, "b", 200), *near_copies(rng, 3, "c", 30)]
    texts += [texts[0]] * 4 + [texts[1].upper()] * 2 + ["one", "one", "", None, "alone in the world today"]
    data = list(enumerate(texts))
    found = jaccard.jaccard_links(corpus.frame(spark, data), block_sets=block_sets)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    expected = links(data)
    assert max(r[3] for r in expected) > 20
    assert corpus.same(found.collect(), expected)


@pytest.mark.parametrize("block_sets", [2048, 3])
def test_corpus_links(spark, block_sets):
    found = jaccard.jaccard_links(corpus.frame(spark), block_sets=block_sets)
    assert corpus.same(found.collect(), links(corpus.rows()))


def test_null_and_repeated_ids_link_by_text_alone(spark):
    rng = random.Random(8)
    prose = ["".join(f"{rng.choice('abc')}{rng.randrange(10**6)} " for _ in range(30)) for _ in range(8)]
    data = [(None, prose[0]), (None, prose[1]), (5, prose[1]), (7, prose[2]), (7, prose[3]), (3, prose[2]), (9, prose[4]), (None, prose[5])]
    assert corpus.same(jaccard.jaccard_links(corpus.frame(spark, data)).collect(), links(data))


def test_near_duplicate_stage_keeps_unlinked_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    rng = random.Random(9)
    x, y, z, v, w, u = ("".join(f"{rng.choice('abc')}{rng.randrange(10**6)} " for _ in range(60)) for _ in range(6))
    near = z + "more"
    data = [(None, x), (None, y), (5, y), (None, w), (None, w), (3, z), (7, near), (7, v), (7, v), (8, u), (8, u + "tail")]
    found = P.near_duplicate_stage(spark, corpus.frame(spark, data), "")
    assert found.columns == corpus.frame(spark, data).columns
    kept = [(r.doc_id, r.text) for r in found.collect()]
    assert len(kept) == 6 and set(kept) <= set(data)
    assert {(None, x), (None, y), (None, w), (3, z), (7, v)} <= set(kept)


def test_null_ids_are_dealt_over_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(groups, "GROUP_BYTES", 400)
    monkeypatch.setattr(groups, "BUCKET_BYTES", 600)
    monkeypatch.setattr(groups, "MESSAGE_BYTES", 1)
    data = [(None if i is not None and i % 3 == 0 else i, t) for i, t in corpus.rows()]
    corpus.frame(spark, data).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    assert groups.grouped(docs)[0].where("doc_id < 0").select("g").distinct().count() > 3
    assert corpus.same(suffix.dedup_bytes(docs).collect(), corpus.suffix(data))
    assert corpus.same(substring.dedup_substrings(docs).collect(), corpus.substring(data))
    assert corpus.same(jaccard.jaccard_links(docs).collect(), links(data))
