"""Document features are read from the texts once, whatever reads them."""

from xcomm.plans import q_models


def test_texts_are_read_once(spark, tmp_path):
    docs = [(i, "Ab c1\n" * (i + 1), "s" + str(i % 3), "en", 6 * (i + 1)) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    f = q_models.doc_features(spark, str(tmp_path))
    assert {(r.doc_id, r.n_words, r.n_lines, r.n_upper, r.n_digits) for r in f.collect()} == {(i, 2 * i + 2, i + 2, i + 1, i + 1) for i in range(1, 6)}
    assert not any("documents.parquet" in name for name in f.inputFiles())
