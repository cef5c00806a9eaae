from stacksift.llm import topk


def test_queries_are_never_broadcast(spark):
    """Every bucket of chunks has its copy of the queries; a broadcast would bring all copies to the driver."""
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = topk.search(topk.build_index(vectors, 64), vectors.filter("vec_id % 50 = 0"))
    assert got.count() == 30
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
