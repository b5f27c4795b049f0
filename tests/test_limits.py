import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import ledger, limits

NOW = datetime(2024, 5, 1, 12, 0, 0)
SCHEMA = "repositoryId string, requestedAt timestamp, requestId long, part string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    limits.require_rocks(spark)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def rows(spark, *made):
    return spark.createDataFrame([(r, NOW + timedelta(seconds=s), i, "p") for r, s, i in made], SCHEMA)


def run(spark, tmp_path, operator, wanted):
    """Until the output has some rows; a query with processing-time timers has no end of its own."""
    source = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    query = operator(source).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(processingTime="1 second").start()
    found, until = {}, time.time() + 60
    try:
        while len(found) < wanted and time.time() < until:
            time.sleep(1)
            assert query.exception() is None, str(query.exception())
            if (tmp_path / "out" / "_spark_metadata").exists():
                found = {r.requestId: (r.nth, r.allowed, r.retryAfter) for r in spark.read.schema("requestId long, nth long, allowed boolean, retryAfter long").parquet(out).collect()}
    finally:
        query.stop()
    assert len(found) == wanted
    return found


def test_hourly_limit_goes_on_after_a_restart(rocks, tmp_path):
    add = lambda *made: rows(rocks, *made).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    first = [("a", k, k) for k in range(7)] + [(None, 5, 100), ("b", 0, 101)]
    add(*first)
    assert {k: n for k, (n, *_) in run(rocks, tmp_path, limits.limit_index_triggers, 9).items()} == {**{k: k + 1 for k in range(7)}, 100: 1, 101: 1}
    second = [("a", 100 + k, 10 + k) for k in range(5)] + [("a", 3600, 50), (None, 6, 102)]
    add(*second)
    found = run(rocks, tmp_path, limits.limit_index_triggers, 16)
    batch = rows(rocks, *second)
    earlier = ledger.fixed_window(rows(rocks, *first), ["repositoryId"], "requestedAt", ["requestId"], 3600, 10).groupBy("repositoryId", "bucket").agg(F.count("*").alias("n"))
    expected = ledger.fixed_window(batch, ["repositoryId"], "requestedAt", ["requestId"], 3600, 10, earlier)
    assert {k: v for k, v in found.items() if k in {i for *_, i in second}} == {r.requestId: (r.nth, r.allowed, r.retryAfter) for r in expected.collect()}
    assert [found[k][1] for k in (12, 13, 14)] == [True, False, False] and found[13][2] == 3600 - 103 and found[50] == (1, True, 0)


def test_quiet_windows_leave_the_state(rocks, tmp_path):
    operator = lambda s: limits.limit_stream(s, ["repositoryId"], "requestedAt", ["requestId"], 60, 2, quiet_seconds=1)
    add = lambda *made: rows(rocks, *made).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    state = lambda: rocks.read.format("statestore").option("stateVarName", "seen").load(f"{tmp_path}/ck").count()
    add(("a", 0, 1), ("a", 70, 2), ("b", 0, 3))
    run(rocks, tmp_path, operator, 3)
    add(("c", 0, 4))
    time.sleep(2)
    run(rocks, tmp_path, operator, 4)
    assert state() <= 1
    add(("a", 1, 5))
    assert run(rocks, tmp_path, operator, 5)[5] == (1, True, 0)
