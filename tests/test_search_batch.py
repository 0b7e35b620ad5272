from spanloom.operators.search import vector_top_k_batch
from spanloom.queries import tables


def test_each_query_has_its_own_list_over_several_blocks(spark, rows):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, [3.0, 0.0]), (7, None)], "id int, v array<double>")
    found = vector_top_k_batch(vectors, vectors.filter("id in (1, 3, 5)"), "id", "v", 2, block=2)
    assert rows(found.selectExpr("query_id", "id", "round(score, 4)")) == [(1, 1, 1.0), (1, 6, 1.0), (3, 2, 0.7071), (3, 3, 1.0)]


def test_every_hundredth_vector_is_a_query(spark, tmp_path):
    spark.range(0, 250).selectExpr("id as vec_id", "array(float(1), float(id)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = tables.vector_topk_batch(spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {0: 8, 100: 8, 200: 8}
