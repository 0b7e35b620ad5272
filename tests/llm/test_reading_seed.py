from spanloom.llm.queries import p9_found

EASY = "The cat sat. The dog ran. We go in. It is hot. "
HARD = "Notwithstanding considerable institutional heterogeneity, epistemological presuppositions fundamentally predetermine contemporary interpretations of constitutional jurisprudence and administrative accountability. "


def test_without_labels_the_formula_seeds_the_levels(spark, tmp_path):
    spark.createDataFrame([(i, (HARD if i % 2 else EASY) * 3) for i in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "doc_id long, reading_level int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    assert {r.doc_id for r in p9_found(spark, str(tmp_path)).collect()} == {1, 3, 5, 7}
