import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import graph, pages
from graphloom.operators.search import SearchIndex

T0 = datetime(2024, 1, 1)


def test_search_equals_a_scan(spark, tmp_path):
    made = random.Random(3)
    texts = [(k, "".join(made.choice("abAB Ü") for _ in range(made.randrange(12)))) for k in range(300)] + [(300, None), (301, ""), (302, "ab" * 5000)]
    patterns = [(n, "".join(made.choice("abABü ") for _ in range(made.randrange(6)))) for n in range(60)] + [(60, None), (61, ""), (61, "ABA"), (62, "nowhere")]
    rows = spark.createDataFrame(texts, "id long, name string")
    index = SearchIndex(spark, f"file://{tmp_path}/s", "id", "name", folders=4)
    index.build(rows)
    found = index.search(rows, spark.createDataFrame(patterns, "patternId long, pattern string"))
    expected = sorted((n, k) for n, p in patterns if p is not None for k, t in texts if t is not None and p.lower() in t.lower())
    assert sorted((r.patternId, r.id) for r in found.collect()) == expected


def test_search_of_nothing(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/s", "id", "name")
    none = spark.createDataFrame([], "id long, name string")
    index.build(none)
    some = spark.createDataFrame([(1, "abc")], "patternId long, pattern string")
    assert index.search(none, some).collect() == []
    assert index.search(none, some.limit(0)).collect() == []


@pytest.mark.parametrize("size", [5, 40])
def test_pages_in_turn_are_the_table(spark, tmp_path, size):
    rows = spark.createDataFrame([(k, T0 + timedelta(days=k * 7919 % 13)) for k in range(300)], "id long, createdAt timestamp_ntz")
    folder = f"file://{tmp_path}/p"
    pages.write_pages(rows, folder, files=6)
    cursor, seen = None, []
    while True:
        page = pages.read_page(spark, folder, rows.schema, size, cursor).collect()
        if len(seen) % 3 == 0:
            assert page == graph.keyset_page(rows, size, cursor).collect()
        assert len(pages.files_of(spark, folder, size, cursor)) <= 3
        seen += page[:size]
        if len(page) <= size:
            break
        cursor = (page[size - 1].createdAt, page[size - 1].id)
        if size == 5 and len(seen) == 30:
            return
    assert [(r.createdAt, r.id) for r in seen] == sorted(((r.createdAt, r.id) for r in rows.collect()), reverse=True)


def test_small_files_and_odd_cursors(spark, tmp_path):
    rows = spark.createDataFrame([(k, T0 + timedelta(days=k)) for k in range(9)], "id long, createdAt timestamp_ntz")
    folder = f"file://{tmp_path}/p"
    pages.write_pages(rows, folder, files=9)
    assert len(pages.files_of(spark, folder, 3, (T0 + timedelta(days=5), 5))) >= 4  # a page over several files
    for cursor in (None, (T0 + timedelta(days=5, hours=3), 0), (T0, 0), (T0 + timedelta(days=99), 0), (T0 - timedelta(days=1), 0)):
        assert pages.read_page(spark, folder, rows.schema, 3, cursor).collect() == graph.keyset_page(rows, 3, cursor).collect()
    pages.write_pages(rows.limit(0), f"file://{tmp_path}/none")
    assert pages.read_page(spark, f"file://{tmp_path}/none", rows.schema).collect() == []
    with pytest.raises(Exception, match="not null"):
        pages.write_pages(spark.createDataFrame([(None, T0)], rows.schema), f"file://{tmp_path}/bad")
