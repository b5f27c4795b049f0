import random
from collections import deque

import pytest

from graphloom.operators import walks
from graphloom.operators.walks import numbered, walk_importers

EDGE = "repositoryId string, kind string, fromFileId string, toFileId string"


def breadth_first(pairs, seed, most):
    importers = {}
    for source, target in pairs:
        importers.setdefault(target, set()).add(source)
    found, queue = {}, deque([(seed, 0)])
    while queue:
        node, depth = queue.popleft()
        for other in importers.get(node, ()):
            if depth < most and other not in found:
                found[other] = depth + 1
                queue.append((other, depth + 1))
    return found


@pytest.fixture
def cut(tmp_path):
    made = []

    def write(df, name):
        made.append((name, len(df._jdf.queryExecution().optimizedPlan().toString())))
        df.write.parquet(f"file://{tmp_path}/{len(made)}")
        return df.sparkSession.read.schema(df.schema).parquet(f"file://{tmp_path}/{len(made)}")

    write.made = made
    return write


def walk(spark, cut, pairs, seeds, depth):
    rows = [("r", "IMPORTS", a, b) for a, b in pairs] + [("r", "CALLS", "x", "y"), ("s", "IMPORTS", "z", pairs[0][1] if pairs else "z"), ("r", "IMPORTS", None, "q"), ("r", "IMPORTS", "q", None)]
    found = walk_importers(spark.createDataFrame(rows, EDGE), "r", spark.createDataFrame([(s,) for s in seeds], "id string"), depth, cut).collect()
    out = {s: {} for s in seeds if s is not None}
    for r in found:
        assert r.fileId not in out[r.seed]
        out[r.seed][r.fileId] = r.depth
    return out


@pytest.mark.parametrize(("few", "depth"), [(10_000, 30), (0, 5), (4, 7)])
def test_equals_breadth_first(spark, cut, monkeypatch, few, depth):
    monkeypatch.setattr(walks, "FEW", few)
    monkeypatch.setattr(walks, "LEVELS", 3)
    rng = random.Random(few)
    pairs = [(f"f{rng.randrange(40)}", f"f{rng.randrange(40)}") for _ in range(60)] + [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c12", "c0")]
    seeds = ["f1", "f2", "c5", "nowhere", "f1", None]
    assert walk(spark, cut, pairs, seeds, depth) == {s: breadth_first(pairs, s, depth) for s in seeds if s is not None}


def test_a_plan_does_not_grow_with_the_depth(spark, cut):
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(60)]
    assert walk(spark, cut, pairs, ["n60"], 50) == {"n60": {f"n{60 - d}": d for d in range(1, 51)}}
    sizes = [n for name, n in cut.made if name == "level"]
    assert len(sizes) == 7 and max(sizes) < 1.3 * sizes[1]


def test_nothing_to_walk(spark, cut):
    assert walk(spark, cut, [], ["a"], 4) == {"a": {}}
    assert walk(spark, cut, [("a", "b")], [], 4) == {}


def test_numbers_have_no_gaps(spark):
    nodes = spark.range(1000).selectExpr("cast(id % 700 AS string) AS node")
    assert sorted(r.number for r in numbered(nodes).collect()) == list(range(700))
