import base64
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import logs


def line(i, body=b"{}"):
    return json.dumps({"deliveryId": i, "eventType": "ping", "body": base64.b64encode(body).decode(), "receivedAt": "2024-05-01T00:00:00Z"}).encode() + b"\n"


def run(spark, tmp_path, **options):
    """The positions read so far, after one more run from the checkpoint."""
    out = f"file://{tmp_path}/out"
    frame = logs.read_lines(spark, f"file://{tmp_path}/log", **options)
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.file, r.position, bytes(r.line)) for r in spark.read.schema(logs.SCHEMA).parquet(out).collect())


@pytest.mark.parametrize("seed", range(30))
def test_ranges_share_out_the_lines(seed):
    made = random.Random(seed)
    whole = b"".join(bytes(made.choice(b"ab\r") for _ in range(made.randrange(6))) + b"\n" for _ in range(20)) + b"x" * made.randrange(3)
    expected, at = [], 0
    for part in whole.split(b"\n"):
        if part.rstrip(b"\r"):
            expected.append((at, part.rstrip(b"\r")))
        at += len(part) + 1
    step = made.randrange(1, 9)
    found = [x for k in range(0, len(whole), step) for x in logs.lines_of(io.BytesIO(whole), k, min(k + step, len(whole)))]
    assert found == expected


def test_goes_on_from_its_offsets(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    assert run(spark, tmp_path) == []
    (folder / "a-1.log").write_bytes(line("1") + line("2")[:20])
    (folder / "notes.txt").write_text("none")
    assert [p for _, p, _ in run(spark, tmp_path)] == [0]  # the second line is still being written
    with open(folder / "a-1.log", "ab") as out:
        out.write(line("2")[20:] + line("3")[:-1])
    (folder / "b-7.log").write_bytes(b"\n\nno json\n")
    found = run(spark, tmp_path)
    assert [(f, json.loads(x)["deliveryId"]) for f, _, x in found if f == "a-1.log"] == [("a-1.log", "1"), ("a-1.log", "2")] and found[-1] == ("b-7.log", 2, b"no json")
    (folder / "a-2.log").write_bytes(line("4"))
    (folder / "a-10.log").write_bytes(line("5") + line("6"))  # by number, not by name
    found = run(spark, tmp_path, range_bytes=10)
    assert [(f, json.loads(x)["deliveryId"]) for f, _, x in found if f.startswith("a")] == [("a-1.log", "1"), ("a-1.log", "2"), ("a-1.log", "3"), ("a-10.log", "5"), ("a-10.log", "6"), ("a-2.log", "4")]
    assert run(spark, tmp_path) == found


def test_offset_holds_a_place_a_shard(tmp_path):
    for k in range(1, 40):
        (tmp_path / f"a-{k}.log").write_bytes(line(str(k)))
    reader = logs.LogReader({"path": str(tmp_path)})
    assert reader.latestOffset() == {"a": [39, len(line("39"))]}
    assert logs.LogReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_last_whole_line_is_found_far_back(tmp_path):
    (tmp_path / "a-1.log").write_bytes(b"first\n" + b"x" * (3 * logs.TAIL))
    assert logs.LogReader({"path": str(tmp_path)}).latestOffset() == {"a": [1, 6]}


def test_deliveries_keep_the_bytes_of_bodies(spark):
    rows = spark.createDataFrame([("f", 0, bytearray(line("1", b"\xff\x00"))), ("f", 1, bytearray(b"\xffno json")), ("f", 2, bytearray(b'{"deliveryId": "2", "body": "%%%"}')), ("f", 3, None)], logs.SCHEMA)
    found = logs.deliveries(rows).select("deliveryId", "body", F.unix_seconds("receivedAt").alias("at")).collect()
    assert [(r.deliveryId, r.body and bytes(r.body), r.at) for r in found] == [("1", b"\xff\x00", 1714521600), (None, None, None), ("2", None, None), (None, None, None)]
