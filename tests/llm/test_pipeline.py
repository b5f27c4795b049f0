import random

from pyspark.sql import functions as F

from . import corpus


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from graphloom.llm import bpe

    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    prose = lambda k: " ".join(word("abcdefghij") for _ in range(k))
    passage = prose(20)
    data = [(i, prose(90) + (" " + passage if i % 4 == 0 else ""), "xx") for i in range(40)]
    data += [(100 + i, data[i][1].replace(data[i][1].split(" ")[3], "new"), "xx") for i in range(8)]
    data += [(200, "1234 !!", "xx"), (201, None, "xx"), (202, "short", "xx"), (203, ("same line here\n") * 40, "xx"), (204, data[0][1], None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")

    texts = {i: t for i, t, _ in data}
    lettered = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    one = P.STAGES[0][1](spark, docs, "")
    assert one.schema == docs.schema and {r.doc_id for r in one.collect()} == lettered
    kept = {i for i in lettered if corpus.quality_kept(texts[i])}
    two = P.STAGES[1][1](spark, one, "")
    assert two.schema == docs.schema and {r.doc_id for r in two.collect()} == kept == lettered - {202, 203}
    groups = corpus.jaccard([(i, texts[i]) for i in sorted(kept)])
    three = P.STAGES[2][1](spark, two, "")
    left = {i for i, _, c in groups if i == c}
    assert {r.doc_id for r in three.collect()} == left and len(left) < len(kept)
    four = P.STAGES[3][1](spark, three, "")
    assert four.schema == docs.schema
    cut = {r.doc_id: r for r in four.collect()}
    for i, n, gone, _, _ in corpus.suffix([(i, texts[i]) for i in sorted(left)]):
        assert len(cut[i].text.encode()) == n - gone and cut[i].n_chars == len(cut[i].text)
    assert sum(passage in r.text for r in cut.values()) == 1
    packed = P.run(spark, f"file://{tmp_path}").collect()
    assert {i for r in packed for i in r.doc_ids} == left
    _, pattern = bpe.vocabulary()
    with open(bpe.vocabulary()[0], "rb") as f:
        codec = bpe.Codec(f.read(), pattern)
    rebuilt = {}
    for r in packed:
        for p in r.pieces:
            rebuilt.setdefault(p.doc_id, {})[p.piece] = r.input_ids[p.bin_offset : p.bin_offset + p.n_tokens]
    for i, r in cut.items():
        tokens = [x for _, part in sorted(rebuilt[i].items()) for x in part]
        assert tokens[-1] == 50256 and codec.decode(tokens[:-1]).decode() == r.text


def test_stages_carry_odd_rows(spark):
    import corpus_pipeline as P

    prose = ["".join(f"{random.Random(k).choice('abc')}{random.Random(k * 1000 + j).randrange(10**6)} " for j in range(90)) for k in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (1, prose[2]), (1, prose[2]), (1, prose[3]), (2, None), (3, ""), (None, None), (4, prose[4] * 1), (5, prose[5] + " tail")]
    docs = corpus.frame(spark, rows).withColumn("n_chars", F.lit(1).cast("long")).withColumnRenamed("lang", "source").withColumn("lang", F.lit("xx"))
    for name, stage in P.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").collect() == []
        kept = sorted((str(r.doc_id), r.text or "") for r in found.collect())
        full = sorted((str(i), t) for i, t in rows if t)
        if name == "near duplicates":
            assert kept == sorted({*full, ("2", ""), ("3", ""), ("None", "")})
        elif name == "shared passages":
            assert kept == sorted([*full, ("2", ""), ("3", ""), ("None", "")])
        else:
            assert kept == full, name
    assert sorted(str(i) for r in P.packing_stage(spark, docs, "").collect() for i in r.doc_ids) == sorted(str(i) for i, t in rows if t)


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(5, text), (5, text), (6, text), (7, None), (7, None), (None, text)], "doc_id long, text string")
    assert sorted((str(r.doc_id) for r in P.near_duplicate_stage(spark, docs, "").collect())) == ["7", "None"]


def test_empty_input(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert P.run(spark, f"file://{tmp_path}").collect() == []
