from loomtrace.operators import coverage as C


def test_chain_of_more_than_64_dependencies(spark):
    n = 67
    deps = spark.createDataFrame([(f"r{i}", f"r{i - 1}") for i in range(1, n)], "req_id string, dep string").coalesce(1)
    got = {r["req_id"]: r["round"] for r in C.inferred(deps, spark.createDataFrame([("r0",)], "req_id string").coalesce(1)).collect()}
    assert got == {f"r{i}": i for i in range(n)}
