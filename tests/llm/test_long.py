"""Texts longer than what operators take at a time, with the sizes shrunken; no Spark."""

import io
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bpe, hashing, langid, media, packing, quality

from . import corpus

TEXTS = [t for _, t in corpus.rows()] + ["é" * 5000 + " word " * 3000]


def columns(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


@pytest.mark.parametrize("chars", [1, 700, 10**9])
def test_batches_of_texts(monkeypatch, chars):
    monkeypatch.setattr(bpe, "BATCH_CHARS", chars)
    parts = list(bpe.text_batches(columns(TEXTS).column(1)))
    assert [t for _, part in parts for t in part] == [t or "" for t in TEXTS]
    assert [lo for lo, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()


def test_packing_cuts_and_joins_over_batches(monkeypatch):
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        shared = SimpleNamespace(value=f.read())
    kind = packing.id_kind(shared.value, packing.SEPARATOR)
    found = {}
    for chars in (300, 10**9):
        monkeypatch.setattr(bpe, "BATCH_CHARS", chars)
        made = pa.Table.from_batches(packing._tokenise(shared, pattern, 64, packing.SEPARATOR, kind)(iter([columns(TEXTS)])))
        raw = [np.frombuffer(x, kind).tolist() for x in made.column("ids").to_pylist()]
        assert [len(x) for x in raw] == made.column("n_tokens").to_pylist() and max(map(len, raw)) == 64
        found[chars] = sorted(zip(made.column("doc_id").to_pylist(), made.column("piece").to_pylist(), raw, strict=True))
    assert found[300] == found[10**9]
    codec = bpe.Codec(shared.value, pattern)
    whole = {}
    for doc, _, ids in found[300]:
        whole.setdefault(doc, []).extend(ids)
    assert all(codec.decode(ids[:-1]).decode() == TEXTS[doc] and ids[-1] == packing.SEPARATOR for doc, ids in whole.items())
    assert set(whole) == {k for k, t in enumerate(TEXTS) if t}


@pytest.mark.parametrize("chunk", [37, 500])
def test_hashes_do_not_depend_on_chunks(monkeypatch, chunk):
    buf, offsets = hashing.column_bytes(columns(TEXTS).column(1))
    whole = quality.measure(buf, offsets)
    monkeypatch.setattr(hashing, "CHUNK", chunk)
    cut = quality.measure(buf, offsets)
    assert all((whole[c] == cut[c]).all() for c in quality.COUNTS)
    alone = [quality.measure(buf[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert all([int(x[c][0]) for x in alone] == whole[c].tolist() for c in quality.COUNTS)


@pytest.mark.parametrize("most", [1, 50, 10**9])
def test_pieces_cover_every_text_once(most):
    offsets = np.cumsum([0, 3, 0, 0, 120, 7, 49, 1, 0])
    parts = list(hashing.pieces(offsets, most))
    assert [k for lo, hi in parts for k in range(lo, hi)] == list(range(8))
    assert all(hi - lo == 1 or offsets[hi] - offsets[lo] <= most for lo, hi in parts)


def test_phrases_of_a_very_long_text():
    rng = random.Random(2)
    samples = {"x": bytes(rng.choice(b"abc ") for _ in range(3000)), "y": bytes(rng.choice(b"bcd ") for _ in range(3000))}
    model = langid.build(samples)
    text = bytes(rng.choice(b"abcd ") for _ in range(60_000))
    found = langid.phrases(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[:, 0]
    for k, name in enumerate(model.languages):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in samples[name]:
                j += 1
            n, i = n + 1, j
        assert found[k] == n


@pytest.mark.parametrize(("archive", "span", "batch"), [(2000, 700, 100), (10**9, 3000, 10**9)])
def test_media_over_ranges_and_batches(monkeypatch, tmp_path, archive, span, batch):
    import zipfile

    monkeypatch.setattr(media, "BATCH_BYTES", batch)
    members = [(k, media.payload_of(t)[0]) for k, t in enumerate(TEXTS)]
    at, parts = 0, []
    for k, payload in members:
        if at % archive == 0 or at > archive:
            parts.append([])
            at = 0
        parts[-1].append((k, payload))
        at += len(payload)
    for n, part in enumerate(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for k, payload in part:
                z.writestr(zipfile.ZipInfo(str(k)), media.to_png(payload))
        (tmp_path / f"{n}.zip").write_bytes(out.getvalue())
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "rangebytes": str(span)})
    ranges = reader.partitions()
    assert len(ranges) > len(parts)
    rows = [(r["name"], media.from_png(r["media"])) for p in ranges for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == sorted((str(k), payload) for k, payload in members)
