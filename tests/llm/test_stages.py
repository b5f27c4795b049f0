"""The language stage without a model; scratch folders by application."""

from graphloom.llm import store


def test_language_stage_without_labels_drops_texts_without_a_letter(spark):
    import corpus_pipeline as P

    texts = ["words here", None, "", "12 34 !! " * 60, "\u00e9t\u00e9", "1 \u65e5"]
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = P.language_stage(spark, docs, "")
    assert found.schema == docs.schema and sorted(r.doc_id for r in found.collect()) == [0, 4, 5]


def test_cleanup_leaves_other_applications(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    other = tmp_path / "graphloom" / "app-other" / "kept"
    other.mkdir(parents=True)
    kept = store.materialize(spark.range(3), "mine")
    assert kept.count() == 3 and len(list((tmp_path / "graphloom").iterdir())) == 2
    store.cleanup(spark)
    assert other.is_dir() and [x.name for x in (tmp_path / "graphloom").iterdir()] == ["app-other"]
