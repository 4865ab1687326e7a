import datetime as dt

from pyspark.sql import functions as F

from loomtrace.operators import orphans as O

T = lambda d, m=1: dt.datetime(2025, m, d)


def test_kinds(spark):
    edges = spark.createDataFrame([
        ("ok", "ok", None, T(5)), ("late", "gone", "", T(5)), ("late", "back", "nope", T(9)), ("late", "ghost", "ok", T(5, 2)), ("OK", "ok", "ok ", T(5)), ("notime", "ok", "ok", None), ("nope", "ok", None, None),
    ], "src_id string, dst_id string, evidence_chunk_id string, created_at timestamp_ntz").withColumn("key", F.lit("clash"))
    nodes = spark.createDataFrame([("ok", T(1)), ("late", T(7)), ("late", T(8)), ("gone", T(1)), ("back", T(1)), ("back", T(4)), ("notime", None)], "node_id string, created_at timestamp_ntz")
    dele = spark.createDataFrame([("nodes", "gone", T(3)), ("nodes", "back", T(2)), ("nodes", "ghost", T(2)), ("requirements", "ok", T(9)), ("nodes", None, T(1)), ("nodes", "ok", None)], "table_name string, record_id string, deleted_at timestamp_ntz")
    crus = spark.createDataFrame([("r", T(5)), ("", T(5)), (None, T(5)), ("x", T(5))], "parent_requirement_id string, loaded_at timestamp_ntz")
    req = spark.createDataFrame([("r", T(6)), ("r", T(7))], "req_id string, loaded_at timestamp_ntz")
    got = {tuple(r) for r in O.orphans(edges, crus, nodes, req, dele).drop("n_refs").collect()}
    j, f = "2025-01", "2025-02"
    assert got == {
        ("edges", "src_id", "late", j, "late"), ("edges", "dst_id", "gone", j, "deleted"), ("edges", "dst_id", "ghost", f, "deleted"), ("edges", "evidence_chunk_id", "nope", j, "missing"),
        ("edges", "src_id", "OK", j, "missing"), ("edges", "evidence_chunk_id", "ok ", j, "missing"), ("edges", "src_id", "nope", None, "missing"), ("crus", "parent_requirement_id", "r", j, "late"), ("crus", "parent_requirement_id", "x", j, "missing"),
    }


def test_heavy_key_equals_plain(spark):
    refs = spark.range(6000).select(F.lit("t").alias("table_name"), F.lit("f").alias("field_name"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("ref_key"),
                                    F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 3600).cast("timestamp_ntz").alias("ref_at"))
    assert O.heavy_keys(refs) == ["hot"]
    status = spark.createDataFrame([("k1", 1, T(1), T(1), None)], "key string, n_rows long, first_at timestamp_ntz, last_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {(r["ref_key"], r["orphan_kind"]): r["n_refs"] for r in O.orphan_counts(refs, status).groupBy("ref_key", "orphan_kind").agg(F.sum("n_refs").alias("n_refs")).collect()}
    assert got["hot", "missing"] == 2000 and ("k1", "missing") not in got and sum(got.values()) == 6000 - refs.where("ref_key = 'k1'").count()


def test_empty(spark):
    e = spark.createDataFrame([], "src_id string, dst_id string, evidence_chunk_id string, created_at timestamp_ntz")
    c = spark.createDataFrame([], "parent_requirement_id string, loaded_at timestamp_ntz")
    n, r = spark.createDataFrame([], "node_id string, created_at timestamp_ntz"), spark.createDataFrame([], "req_id string, loaded_at timestamp_ntz")
    d = spark.createDataFrame([], "table_name string, record_id string, deleted_at timestamp_ntz")
    assert O.orphan_report(O.orphans(e, c, n, r, d)).count() == 0
