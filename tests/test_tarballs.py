import gzip
import hashlib
import io
import resource
import tarfile

import pytest
from pyarrow import fs

from graphloom.sources import archives, tarballs


def put(folder, name, *entries, damage=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for path, body in entries:
            info = tarfile.TarInfo(path)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(out.getvalue()[:damage])


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "a.tar.gz", ("t/one", b"x" * 25), ("t/none", b""), ("t/one", b"y"), ("lone", b"z"))
    put(tmp_path, "deep/b.tar.gz", ("t/ok", b"1"), ("t/../../out", b"2"))
    put(tmp_path, "c.tar.gz", *((f"t/{k}", bytes(range(256)) * 40) for k in range(9)), damage=200)
    put(tmp_path, "empty.tar.gz")
    (tmp_path / "other.txt").write_text("no archive")
    return f"file://{tmp_path}"


def test_entries_in_chunks(spark, folder):
    rows = tarballs.stream_archives(spark, folder, chunk_bytes=10, tasks=2).collect()
    good = [(r.entry, r.path, r.kind, r.size, r.chunk, bytes(r.content) if r.content is not None else None, r.skipReason) for r in rows if r.archive == "a.tar.gz"]
    assert good == [
        (0, "one", "file", 25, 0, b"x" * 10, None), (0, "one", "file", 25, 1, b"x" * 10, None), (0, "one", "file", 25, 2, b"x" * 5, None),
        (1, "none", "file", 0, 0, b"", None), (2, "one", "file", 1, 0, b"y", None), (3, "lone", "skipped", 1, None, None, "NO_TOP_LEVEL_PREFIX"),
    ]
    assert {r.hash for r in rows if r.entry == 0} == {hashlib.sha256(b"x" * 25).hexdigest()}
    refused = {r.archive: (r.kind, r.path, r.error.split(":")[0]) for r in rows if r.archive not in ("a.tar.gz",)}
    assert refused == {k: ("refused", None, "UNSAFE_ARCHIVE") for k in ("b.tar.gz", "c.tar.gz")}  # and no row of what came before the fault


def test_small_files_equal_the_exploded_ones(spark, folder):
    by_path = tarballs.small_files(tarballs.stream_archives(spark, folder, chunk_bytes=7), 1 << 20)
    exploded = archives.explode_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.gz").load(folder))
    told = lambda df: sorted((r.path, r.kind, r.size, bytes(r.content) if r.content is not None else None, r.skipReason) for r in df.collect())
    assert told(by_path.where("kind <> 'refused'")) == told(archives.accepted(exploded, ("file", "skipped")))
    cut = {(r.path, r.size): r.content for r in tarballs.small_files(tarballs.stream_archives(spark, folder, chunk_bytes=7), 3).where("kind = 'file'").collect()}
    assert cut[("one", 25)] is None and bytes(cut[("one", 1)]) == b"y"


@pytest.mark.parametrize(("limits", "code"), [({"most_files": 3}, "REPO_TOO_LARGE: the archive exceeds its file"), ({"most_bytes": 10239}, "REPO_TOO_LARGE: the archive exceeds its byte"), ({"most_bytes": 24}, "REPO_TOO_LARGE"), ({"most_bytes": 10240, "most_files": 4}, None)])
def test_limits_count_the_whole_stream(spark, tmp_path, limits, code):
    put(tmp_path, "a.tar.gz", ("t/one", b"x" * 25), ("t/none", b""), ("t/one", b"y"), ("t/z", b"z"))
    errors = {(r.error or "")[: len(code or "")] or None for r in tarballs.stream_archives(spark, str(tmp_path), **limits).collect()}
    assert errors == {code}


def test_no_archives(spark, tmp_path):
    found = tarballs.stream_archives(spark, str(tmp_path))
    assert found.collect() == [] and found.columns == [x.split()[0] for x in tarballs.SCHEMA.split(", ")]


def test_more_than_two_gigabytes_in_bounded_memory(tmp_path):
    """One entry of 2.2 GB: what is held is a chunk."""
    size, block = 2200 << 20, bytes(1 << 20)
    with gzip.open(tmp_path / "big.tar.gz", "wb", compresslevel=1) as out:
        info = tarfile.TarInfo("t/big")
        info.size = size
        out.write(info.tobuf(tarfile.GNU_FORMAT))
        for _ in range(2200):
            out.write(block)
        out.write(bytes(10240))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    system, path = fs.FileSystem.from_uri(str(tmp_path / "big.tar.gz"))
    total = chunks = 0
    for row in tarballs.stream_entries(system, path, 4 << 30, 10, 1 << 20):
        assert row[3] == "file" and row[4] == size
        total, chunks = total + len(row[7]), chunks + 1
    assert total == size and chunks == 2200
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10  # in KB
