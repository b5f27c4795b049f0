import random
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.operators import keyed
from graphloom.operators.keyed import KeyedTable
from graphloom.sources.versions import Conflict, Folder, Versions

ROW = "id long, v string, n int"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/a table"


def rows(spark, *made):
    return spark.createDataFrame(list(made), ROW)


def content(table):
    return {r.id: (r.v, r.n) for r in table.snapshot().collect()}


def stored_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_one_of_several_writers_puts_a_version(spark, folder):
    for number in range(1, 6):
        won = []
        line = threading.Barrier(6)

        def write(k, number=number, won=won, line=line):
            own = Versions(spark, folder)
            line.wait()
            if own.commit(number, [k]):
                won.append(k)

        threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and Versions(spark, folder).latest() == (number, won)
    assert not [n for n in Folder(spark, f"{folder}/_versions").names() if not n.startswith("v")]


def test_updates_run_again_where_others_were_first(spark, folder):
    versions = Versions(spark, folder)
    assert versions.latest() == (0, None)

    def add(times):
        for _ in range(times):
            Versions(spark, folder).update(lambda m: [(m or [0])[0] + 1], attempts=200)

    threads = [threading.Thread(target=add, args=(8,)) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert versions.latest() == (32, [32]) and len(versions.numbers()) <= 16
    assert versions.update(lambda m: None) == (32, [32])

    def always_late(m):
        versions.commit(versions.latest()[0] + 1, m)
        return m

    with pytest.raises(Conflict):
        versions.update(always_late, attempts=3)


def test_batches_merge_in_levels_and_can_be_repeated(spark, folder):
    rng, table, expected, most = random.Random(1), KeyedTable(spark, folder, ROW, ["id"], fan=3), {}, 0
    for k in range(13):
        batch = {rng.choice([None, *range(40)]): (f"v{k}", k) for _ in range(8)}
        for attempt in range(1 + (k % 5 == 0)):
            made = batch if attempt else batch | {1000 + k: ("lost", 0)} if k % 5 == 0 else batch
            segments = table.put(rows(spark, *((i, *x) for i, x in made.items())), k)
        expected |= batch
        most = max(most, len(segments))
    assert content(table) == expected and most <= 2 * 3 + 2
    asked = spark.createDataFrame([(i,) for i in (3, 7, 999, None)], "id long")
    assert {r.id: (r.v, r.n) for r in table.rows_of(asked).collect()} == {i: expected[i] for i in (3, 7, None) if i in expected}
    assert table.snapshot(table.segments(before=0)).count() == 0
    with pytest.raises(ValueError, match="later"):
        table.put(rows(spark, (1, "x", 1)), 3)
    assert table.vacuum() and content(table) == expected


def test_a_lookup_opens_a_bounded_number_of_segments(spark, folder):
    """Many batches of new ids: live segments grow with the logarithm, and new ids open hardly any."""
    table, opened = KeyedTable(spark, folder, "id long", ["id"], fan=3), []
    for k in range(16):
        new = spark.range(100 * k, 100 * k + 100)
        live = table.segments(before=k)
        opened.append(len(table.opened(new, live)[0]))
        assert len(live) <= 2 * 3 + 2
        table.put(new, k)
    assert sum(opened) <= 16
    files, _ = table.opened(spark.range(5, 6), table.segments())
    assert 1 <= len(files) <= 2 and table.rows_of(spark.range(1595, 1605)).count() == 5


def test_ranges_are_read_alone(spark, folder, monkeypatch):
    monkeypatch.setattr(keyed, "RANGE_WORDS", 64)
    table = KeyedTable(spark, folder, "id long, v string, n int", ["id"])
    table.put(spark.range(4000).select("id", F.lit("v").alias("v"), F.lit(1).alias("n")), 0)
    (segment,) = table.segments()
    found, ranges = table.opened(spark.range(17, 18), [segment])
    assert segment.words == 1024 and len(ranges[0]) == 1 and found
    files = lambda named: table._rows(segment, named).select(F.input_file_name()).distinct().count()
    assert (files(ranges[0]), files(None)) == (1, 16)
    assert table.rows_of(spark.range(3990, 4010)).count() == 10
    monkeypatch.setattr(keyed, "MOST_RANGES", 2)
    assert table.opened(spark.range(4000), [segment])[1] == {} and table.rows_of(spark.range(3990, 4010)).count() == 10


def test_a_small_change_writes_little(spark, folder, tmp_path):
    table = KeyedTable(spark, folder, "id long, v string, n int", ["id"])
    table.put(spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("n")), 0)
    before = stored_bytes(tmp_path)
    assert table.upsert(spark.range(49_750, 50_250).select("id", F.lit("new").alias("v"), F.lit(2).alias("n")), ["v"]) == 500
    assert stored_bytes(tmp_path) - before < before / 50
    found = {r.id: (r.v, r.n) for r in table.rows_of(spark.createDataFrame([(49_999,), (50_000,)], "id long")).collect()}
    assert found == {49_999: ("new", 1), 50_000: ("new", 2)} and table.snapshot().count() == 50_250


def test_changes_by_guard_key_and_replacement(spark, folder):
    table = KeyedTable(spark, folder, ROW, ["id"])
    assert table.upsert(rows(spark, *((i, "a", i) for i in range(10))), ["v", "n"]) == 10
    assert table.guarded_update(F.col("n") > 7, {"v": F.lit("b")}) == 2 and table.guarded_update(F.col("n") > 70, {"v": F.lit("b")}) == 0
    assert table.update_from(spark.createDataFrame([(1, "c"), (77, "c")], "id long, v string"), ["v"]) == 1
    assert table.delete(F.col("id") < 1) == 1
    assert content(table) == {i: ("c" if i == 1 else "b" if i > 7 else "a", i) for i in range(1, 10)}
    number = table.versions.latest()[0]
    assert table.replace(F.col("id") < 5, rows(spark, (2, "d", 0), (4, "d", 1))) == 4
    assert table.versions.latest()[0] == number + 1
    assert content(table) == {2: ("d", 0), 4: ("d", 1)} | {i: ("b" if i > 7 else "a", i) for i in range(5, 10)}
    assert table.change(lambda _: None) == 0


def test_a_lock_is_claimed_once(spark, folder):
    schema = "id long, indexStatus string"
    KeyedTable(spark, folder, schema, ["id"]).upsert(spark.createDataFrame([(i, "PENDING" if i else "INDEXING") for i in range(3)], schema), ["indexStatus"])
    counts, line = [], threading.Barrier(3)

    def claim():
        own = KeyedTable(spark, folder, schema, ["id"])
        line.wait()
        counts.append(own.acquire_lock(F.col("id") == 1))

    threads = [threading.Thread(target=claim) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = KeyedTable(spark, folder, schema, ["id"])
    assert sorted(counts) == [0, 0, 1] and {r.id: r.indexStatus for r in table.snapshot().collect()} == {0: "INDEXING", 1: "INDEXING", 2: "PENDING"}
    assert table.acquire_lock(F.col("id") == 0) == 0
