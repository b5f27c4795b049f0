import time
from datetime import datetime, timedelta

import pytest

from graphloom.streaming import ledger, outbox

NOW = datetime(2024, 5, 1, 12, 0, 0)


def events(spark, *made):
    return spark.createDataFrame([(k, d, "r", "p", None) for k, d in made], outbox.EVENT)


def sent(spark, folder):
    return sorted(((r.prKey, r.deliveryId) for r in outbox.outbox(spark, folder).snapshot().collect()), key=str)


def test_events_are_sent_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    table = outbox.outbox(spark, folder)
    outbox.send(events(spark, ("a", "2"), ("a", "1"), ("b", "3"), (None, "4")), table, 0)
    outbox.send(events(spark, ("b", "9"), ("c", "5"), (None, "6")), table, 1)
    once = [("a", "1"), ("b", "3"), ("c", "5"), (None, "4")]
    assert sent(spark, folder) == once
    outbox.send(events(spark, ("b", "9"), ("c", "5"), (None, "6")), table, 1)
    outbox.send(events(spark), table, 2)
    assert sent(spark, folder) == once


def test_a_failed_batch_leaves_no_event(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    table = outbox.outbox(spark, folder)
    outbox.send(events(spark, ("a", "1")), table, 0)
    monkeypatch.setattr(table.versions, "update", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        outbox.send(events(spark, ("b", "2")), table, 1)  # its segment is written, and nothing names it
    assert sent(spark, folder) == [("a", "1")]
    monkeypatch.undo()
    outbox.send(events(spark, ("b", "2")), table, 1)
    assert sent(spark, folder) == [("a", "1"), ("b", "2")]


def test_a_stream_of_events(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for made in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]):
        events(spark, *made).coalesce(1).write.mode("append").parquet(source)
        outbox.send_stream(spark.readStream.schema(outbox.EVENT).parquet(source), folder, f"file://{tmp_path}/ck").awaitTermination()
    assert sent(spark, folder) == [("a", "1"), ("b", "2"), ("c", "4")]


def pending(spark, *made):
    good = '[{"prKey": "%s", "repositoryId": "r", "projectId": "p"}]'
    return spark.createDataFrame([(i, status, NOW - timedelta(seconds=age), good % key if key else "[]") for i, status, age, key in made], outbox.WAITING)


def test_sweeps_take_the_oldest_and_can_be_repeated(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    held = outbox.waiting(spark, folder)
    outbox.follow(pending(spark, ("a", "PENDING", 300, "k1"), ("b", "PENDING", 200, None), ("c", "PENDING", 100, "k1"), ("young", "PENDING", 5, "k2"), ("done", "IGNORED", 400, None)), held)
    outbox.follow(pending(spark, ("late", "PENDING", 250, "k3"), ("late", "FAILED", 250, "k3")), held)
    take = lambda n, **k: {(r.deliveryId, r.sweep) for r in outbox.sweep(spark, folder, NOW, n, **k).collect()}

    with monkeypatch.context() as broken:  # lost after events were sent: the same rows are taken again
        broken.setattr(outbox.KeyedTable, "change", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            take(0, limit=2)
    assert take(0, limit=2) == take(0, limit=2) == {("a", "REPLAY"), ("b", "FAILED")}
    assert take(1, limit=2) == {("c", "REPLAY")} and take(2) == set()
    assert sent(spark, folder) == [("k1", "a")]
    assert [r.deliveryId for r in held.snapshot().collect()] == ["young"]
    rows = pending(spark, ("a", "PENDING", 300, "k1"), ("b", "PENDING", 200, None)).selectExpr("deliveryId", "status", "dispatchPayload", "cast(null as timestamp) dispatchedAt", "cast(null as string) error")
    after = ledger.apply_transitions(rows, spark.read.parquet(f"{folder}/transitions").drop("part"))
    assert {(r.deliveryId, r.status, r.dispatchedAt) for r in after.collect()} == {("a", "DISPATCHED", NOW), ("b", "FAILED", None)}


def test_follows_the_ledger(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for n, made in enumerate(([("a", "PENDING", 100, "k")], [("b", "IGNORED", 100, None), ("c", "PENDING", 100, "k")])):
        pending(spark, *made).coalesce(1).write.parquet(f"{folder}/ledger/part={n}")
        outbox.follow_ledger(spark, folder, f"{folder}/ck").awaitTermination()
    assert sorted(r.deliveryId for r in outbox.waiting(spark, folder).snapshot().collect()) == ["a", "c"]


def test_the_clock_sweeps(spark, tmp_path):
    folder = f"file://{tmp_path}"
    outbox.follow(pending(spark, ("a", "PENDING", 300, "k1")), outbox.waiting(spark, folder))
    projects = spark.createDataFrame([("r", "p", "PENDING", datetime(2020, 1, 1)), ("s", "p", "INDEXED", datetime(2020, 1, 1))], "id string, projectId string, indexStatus string, updatedAt timestamp")
    clocks = [outbox.sweep_on_clock(spark, folder, f"{folder}/ck", "1 second"), outbox.stale_on_clock(spark, lambda: projects, folder, f"{folder}/ck2", "1 second")]
    until = time.time() + 60
    try:
        while time.time() < until and not (sent(spark, folder) and (tmp_path / "index_requests").exists() and list((tmp_path / "index_requests").glob("*/_SUCCESS"))):
            assert all(c.exception() is None for c in clocks)
            time.sleep(1)
    finally:
        for c in clocks:
            c.stop()
    assert sent(spark, folder) == [("k1", "a")]
    assert {(r.repositoryId, r.reason) for r in spark.read.parquet(f"{folder}/index_requests").collect()} == {("r", "sweep")}
