import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, langid, media, quality, queries, sql, urls

from . import corpus


def oracle(name_to_frame, text):
    con = duckdb.connect()
    for name, df in name_to_frame.items():
        con.register(name, df.toArrow())
    return con.execute(text).fetchall()


# BPE


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        return bpe.Codec(f.read(), pattern)


def test_bpe_equals_tiktoken(codec):
    tiktoken = pytest.importorskip("tiktoken")
    _, pattern = bpe.vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "a" * 1000, "thethethe" * 30, " " * 300 + "a", "日本語テスト" * 40, *(t or "" for _, t in corpus.rows())]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x3100), rng.randint(0x10000, 0x1F9FF)])) for _ in range(60)) for _ in range(200)]
    ids, offsets = codec.encode_batch(texts)
    for k, text in enumerate(texts):
        mine = ids[offsets[k] : offsets[k + 1]].tolist()
        assert mine == theirs.encode_ordinary(text)
        assert codec.decode(mine).decode() == text


def test_bpe_lockstep_and_single_trees_agree(codec):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"theraning ") for _ in range(rng.randint(1, 64))) for _ in range(300)]
    ids, counts = codec.merge_rows(pieces, 64)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [codec.merge_one(p) for p in pieces]


def test_bpe_cache_starts_anew(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    texts = [t or "" for _, t in corpus.rows()]
    whole, cuts = codec.encode_batch(texts)
    for k, text in enumerate(texts):
        assert codec.encode_batch([text])[0].tolist() == whole[cuts[k] : cuts[k + 1]].tolist()
        assert len(codec.index) < 20 + len(codec.split(text)) + 1 or k == 0
    assert codec.encode_batch([])[0].tolist() == [] and codec.encode_batch(["", ""])[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("pattern", [None, r" ?[^\s\p{L}]+|\p{Lu}\p{L}*(?=\s)|\S", r"[^\S\n]+|x", r"(?i:'s)|\p{L}++|\d", "[]a]+"])
def test_split_equals_regex(pattern):
    pattern = pattern or bpe.vocabulary()[1]
    split, rng = bpe.splitter(pattern), random.Random(5)
    odd = [chr(c) for c in (*range(256), 0x300, 0x660, 0x2028, 0x2160, 0x3000, 0x4E00, 0x180E, 0x200B, 0xFEFF, 0xFFFF)]
    texts = ["", *("".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(2000))]
    texts += [t + chr(0x1F600) + "\U00010400 \U0001d7d8" for t in texts[:200]]
    texts.append("".join(f" {chr(c)}{chr(c)} x{chr(c)}7" for c in range(0x10000) if not 0xD800 <= c < 0xE000))
    for text in texts:
        assert split(text) == regex.findall(pattern, text)


def test_bpe_query_columns(spark, codec):
    docs = corpus.frame(spark)
    found = bpe.encode_documents(docs, *bpe.vocabulary(), keep_ids=True).collect()
    assert len(found) == docs.count()
    texts = {}
    for i, t in corpus.rows():
        texts.setdefault(i, (t or "").encode())
    for r in found:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()
    assert bpe.encode_documents(corpus.frame(spark, []), *bpe.vocabulary()).collect() == []


# Quality


def test_quality_equals_sql(spark):
    docs = corpus.frame(spark)
    found = quality.quality_rules(docs)
    expected = oracle({"documents": docs}, sql.op2())
    assert corpus.same(found.collect(), expected)
    assert quality.quality_rules(corpus.frame(spark, [])).collect() == []


def test_quality_verdicts(spark):
    rng = random.Random(5)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    lines = "\n".join(" ".join(f"w{k}{j}" for j in range(10)) for k in [*range(12), *range(4)])
    phrase = " ".join(f"p{k}" for k in range(12))
    mixed = " ".join(f"{clean[k * 70 : k * 70 + 68]} {phrase}" for k in range(4))
    mixed += ' ' + ' '.join(''.join(rng.choice('stuvwxyz') for _ in range(6)) for _ in range(100))
    found = {r.doc_id: r for r in quality.quality_rules(corpus.frame(spark, [(1, clean), (2, lines), (3, mixed), (4, "too short")])).collect()}
    assert found[1].kept and not found[1].base_failed
    assert not found[2].kept and found[2].n_dup_lines == 4
    assert not found[3].kept and not found[3].base_failed
    assert found[4].base_failed and not found[4].kept


# Media features


def test_media_feature_is_exact():
    rng = np.random.default_rng(1)
    for size in (192, 192 * 300, 192 * 400):
        payload = rng.integers(0, 256, size, np.uint8).tobytes()
        total, squares = sum(payload), sum(x * x for x in payload)
        cuts = [k * size // 64 for k in range(65)]
        bits = [int(sum(payload[a:b]) * size > total * (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert media.feature_of(payload) == f"m{100 * total // size}-v{squares // size}-h{int(''.join(map(str, bits)), 2):016x}"


# URLs


def test_urls_equal_sql(spark):
    made = [
        None, "", "no scheme", "http://", "http://com", "https://COM/en/", "http://a.b.Example.com/en/71?x#y", "http://example.com/en/8",
        "http://xexample.com/en/7", "http://x.example.net/de/8", "http://net/de/7#/es", "http://q.org?/es/", "http://q.org/es/", "http://q.org/ES/",
        "ftp://É.Org/es/é", "http://..com/en/1", "http://q.org/es/", "a://b://c.com/en/", "http://com:80/en/", "x://com/en/\n",
    ]
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(made)] + [(None, "http://com/en/", "h", "x", 1)], "page_id long, url string, host string, rule string, rank int")
    found = urls.filter_urls(pages, queries.URL_RULES)
    assert corpus.same(found.collect(), oracle({"pages": pages}, sql.OP5))
    assert urls.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0
    assert urls.filter_urls(pages.limit(0), queries.URL_RULES).collect() == []


def test_url_rules_as_a_table_ties_and_long_urls(spark):
    rules = [urls.Rule("block", "com", "/a"), urls.Rule("allow", "com", "/a"), urls.Rule("allow", "x.com", "/"), urls.Rule("block", "com", "/" + "p" * 3000), *queries.URL_RULES]
    made = ["http://com/abc", "http://x.com/abc", "http://y.com/" + "p" * 100_000, "http://example.com/en/7", None, "http://" + "a." * 5000 + "com/a"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)] * 2, "page_id long, url string")
    table = urls.rule_table(spark, rules)
    found = urls.filter_urls(pages, table).collect()
    assert corpus.same(found, urls.filter_urls(pages, rules).collect())
    assert {r.page_id: r.verdict for r in found} == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block"}
    assert {r.page_id: r.rule for r in found if r.page_id < 2} == {0: "com/a", 1: "x.com/"}
    assert urls.filter_urls(pages, table.limit(0)).where("rule IS NOT NULL").count() == 0


def test_more_shapes_than_are_listed(spark):
    rules = [urls.Rule("block", ".".join(["a"] * n), "/" + "p" * k) for n in range(1, 6) for k in range(1000)] + list(queries.URL_RULES)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    made = ["http://x.a.a/ppp", "http://a/" + "p" * 5000, "http://a.a.a.a.a.a/p?q", "http://b/p", "http://a", None, "nothing", "http://example.com/en/7", "http:///p"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)] * 2, "page_id long, url string")
    found = urls.filter_urls(pages, table).collect()
    assert {r.page_id: r.rule for r in found} == {0: "a.a/ppp", 1: "a/" + "p" * 999, 2: "a.a.a.a.a/p", 3: None, 4: None, 5: None, 6: None, 7: "example.com/en/7", 8: None}
    assert len(found) == 2 * len(made)


@pytest.mark.parametrize("most", [0, 4096])
def test_listed_and_met_shapes_agree(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_SHAPES", most)
    pages = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in ("example.com", "a.example.net", "org", "") for p in ("en/", "en/7", "de/8x", "es/", ""))], "page_id long, url string")
    expected = urls.filter_urls(pages, queries.URL_RULES).collect()
    assert corpus.same(urls.filter_urls(pages, urls.rule_table(spark, queries.URL_RULES)).collect(), expected)


def test_url_rule_text_is_quoted(spark):
    rule = urls.Rule("block", "a'b\\.com", "/x'\\")
    pages = spark.createDataFrame([(1, "http://a'b\\.com/x'\\y")], "page_id long, url string")
    assert urls.filter_urls(pages, [rule]).first().verdict == "block"


def test_url_query_follows_each_rule_of_its_contract(spark, tmp_path):
    """Block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/; else the default."""
    made = {
        "http://com/en/": ("com/en/", "block"), "http://a.com/en/7": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.Example.com/en/71": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://a.example.net/de/7?q": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.EXAMPLE.NET/de/80": ("example.net/de/8", "block"), "http://xexample.net/de/8": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"), "http://a.org/es/7": ("org/es/", "block"), "http://a.org/de/": (None, "allow"), "http://a.net/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(made)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op5_url_filters(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == dict(enumerate(made.values()))


# Languages


def speech(rng, letters, k):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(k))


def test_languages_are_told_apart(spark):
    rng = random.Random(9)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "öüéñx"}
    data = [(i, speech(rng, letters[k], rng.randint(20, 60)), k) for i in range(150) for k in [sorted(letters)[i % 3]]]
    data += [(1000, None, "aa"), (1001, "123 -- 456", "aa"), (1002, "", None), (None, speech(rng, "abcde", 30), "aa"), (5, data[5][1], data[5][2])]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in data], "doc_id long, text string, lang string, score string, letters int, `row` int")
    found = langid.identify(docs).collect()
    assert len(found) == len(data)
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    held = [(r, k) for i, _, k in data[:150] for r in [by[i]] if r.held_out]
    assert held and np.mean([r.lang_pred == k for r, k in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]
    assert langid.identify(docs.limit(0)).collect() == []


def test_automaton_holds_all_substrings():
    rng = random.Random(3)
    text = [rng.randint(1, 3) for _ in range(60)]
    steps = langid.suffix_automaton(text)

    def inside(part):
        at = 0
        for c in part:
            if c not in steps[at]:
                return False
            at = steps[at][c]
        return True

    have = {tuple(text[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(500):
        part = tuple(rng.randint(1, 3) for _ in range(rng.randint(0, 9)))
        assert inside(part) == (part in have)


@pytest.mark.parametrize("block", [512, 7, 2])
def test_phrases_equal_one_unbroken_greedy_parse(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(8)
    samples = {"x": bytes(rng.choice(b"abc ") for _ in range(80)) + b"abab" * 400, "y": bytes(rng.choice(b"bcd ") for _ in range(80))}
    model = langid.build(samples)
    texts = [bytes(rng.choice(b"abcdz ") for _ in range(rng.randint(0, 1300))) for _ in range(12)] + [b"c" + b"abab" * 380]
    found = langid.phrases(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for k, name in enumerate(model.languages):
        for d, text in enumerate(texts):
            n = i = 0
            while i < len(text):
                j = i + 1
                while j < len(text) and text[i:j] in samples[name] and text[i : j + 1] in samples[name]:
                    j += 1
                n, i = n + 1, j
            assert found[k][d] == n


def test_many_languages_share_one_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} of many words", f"l{i % 6}") for i in range(60)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "ALL_SYMBOLS", 60)
    models = langid.train(docs, F.lit(True))
    assert len(models) == 1 and len(models[0].table) <= 2 * 60 * 30
    assert [m.languages for m in langid.train(docs, F.lit(True), 5)] == [[f"l{k}" for k in range(5)], ["l5"]]


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_of_languages_decide_as_one_model(spark, block):
    """Models of blocks with the same samples: the least phrases over all blocks, ties to the first label."""
    samples = {f"l{k}": normalised(t) for k, t in enumerate([b"the cat sat on the mat", b"der hund und die katze", b"the cat sat on the mat", b"le chat est dans la maison", b"el gato"])}
    docs = corpus.frame(spark, [(1, "the cat"), (2, "die katze"), (3, "la maison"), (4, None), (5, ""), (6, "12"), (7, "gato el cat"), (8, "zzz"), (None, "chat und hund")])
    names = sorted(samples)
    parts = [langid.build({k: samples[k] for k in names[lo : lo + block]}) for lo in range(0, len(names), block)]
    whole = langid.predict(docs, [langid.build(samples)]).collect()
    assert corpus.same(langid.predict(docs, parts).collect(), whole)
    assert corpus.same([r.asDict()["lang_pred"] for r in langid.predict(docs, parts, carry=True).collect()], [r.lang_pred for r in whole])
    assert {r.doc_id: r.lang_pred for r in whole}[1] == "l0"


def normalised(text):
    return langid.normalise(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()


def test_more_labels_than_a_model_holds(spark):
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(1100)]
    docs = spark.createDataFrame([(k, f"{w}{w} {w} q{w}", f"l{k:04}") for k, w in enumerate(words)], "doc_id long, text string, lang string")
    models = langid.train(docs, F.lit(True))
    assert [len(m.languages) for m in models] == [1024, 76]
    asked = docs.where("doc_id IN (3, 1030, 1099)")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, models).collect()} == {3: "l0003", 1030: "l1030", 1099: "l1099"}


def test_the_sample_is_not_a_prefix(spark):
    docs = spark.createDataFrame([(k, "x" * 40_000 + "y" * 40_000, "l") for k in range(40)], "doc_id long, text string, lang string")
    (model,) = langid.train(docs, F.lit(True))
    assert model.symbol[ord("x")] and model.symbol[ord("y")]


# Media


def test_media_round_trip(spark):
    docs = corpus.frame(spark)
    found = media.media_columns(docs).collect()
    assert len(found) == docs.count()
    texts = {}
    for i, t in corpus.rows():
        texts.setdefault(i, (t or "").encode())
    seen = {}
    for r in found:
        raw = texts[r.doc_id]
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
        assert seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.media_columns(corpus.frame(spark, [])).collect() == []


def test_media_ranges_and_archives(spark, tmp_path):
    docs = corpus.frame(spark, [(i, "text %d " % i * 50) for i in range(40)])
    folder = f"file://{tmp_path}/store"
    media.write_archives(docs, folder, archive_bytes=1500)
    found = media.read_archives(spark, folder, rangebytes="700").select("name", "attempts", "error").collect()
    assert sorted(int(r.name.split("/")[1]) for r in found) == list(range(40))
    assert {r.attempts for r in found} == {1}


def test_media_member_is_retried_by_offset(tmp_path):
    import struct

    data = b"payload"
    head = b"PK\x03\x04" + bytes(22) + struct.pack("<HH", 0, 0)
    (tmp_path / "a").write_bytes(b"junk" + head + data)
    faults = iter([True, True, False])

    class Flaky:
        def __init__(self):
            self.f = open(tmp_path / "a", "rb")  # noqa: SIM115

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            if next(faults, False):
                raise OSError("lost")
            return self.f.read(n)

    assert media.read_member(lambda again: Flaky(), 4, len(data), zlib.crc32(data), 3, wait=0)[:2] == (data, 3)
    got = media.read_member(lambda again: Flaky(), 4, len(data), 1, 1, wait=0)
    assert got[0] is None and got[1] == 2 and "damaged" in got[2]


def test_media_damage_is_noticed():
    image = bytearray(media.to_png(b"x" * 192))
    assert media.from_png(bytes(image)) == b"x" * 192
    image[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))


# Chat


@pytest.mark.parametrize("stretch", [1024, 2])
def test_chat_equals_sql(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes?\nno"), (1, 2, "user", None), (1, 2, "user", "tie"), (1, 2, "user", "tie"), (2, 0, "system", "only"),
        (3, None, None, "é日"), (3, 1, "bob", ""), (None, 0, "ann", "x"), (None, 1, "system", "rules"), (4, 0, "system", "s"), (4, 1, "cat", "c"),
    ]
    talks = spark.createDataFrame([(*r, "p", 1) for r in data], "conv_id long, turn long, role string, text string, perspective string, seq int")
    found = chat.rotate_perspectives(talks)
    assert corpus.same(found.collect(), oracle({"conversations": talks}, sql.OP8))
    assert chat.rotate_perspectives(talks.limit(0)).collect() == []


def test_chat_masks_cover_the_speaker(spark):
    talks = spark.createDataFrame([(1, k, "ab"[k % 2], f"t{k}") for k in range(7)], "conv_id long, turn long, role string, text string")
    for r in chat.rotate_perspectives(talks, part_turns=3).collect():
        shown = [r.rendered[int(a) - r.offset : int(b) - r.offset] for a, b in (s.split("-") for s in r.spans.split(",") if s)]
        mine = [f"t{k}<|im_end|>\n" for k in range(7) if k // 3 == r.part and "ab"[k % 2] == r.perspective]
        assert shown == mine and r.loss_chars == sum(map(len, mine))
