import json

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import drift as D

FIELDS = [("CRU", f, t, True) for f, t in [("cru_id", "string"), ("parent_requirement_id", "string"), ("dependencies", "array"), ("traceability.page", "number"), ("traceability.doc_id", "string"),
          ("traceability.doc_type", "string"), ("invalid", "boolean"), ("actor", "string"), ("title", "string"), ("confidence", "string"), ("constraint", "string"), ("acceptance_criteria", "string")]]


@pytest.mark.parametrize(("name", "field"), [
    ("cruId", "cru_id"), ("cruid", "cru_id"), ("reqid", "parent_requirement_id"), ("parent_req", "parent_requirement_id"), ("depends_on", "dependencies"), ("deps", "dependencies"), ("is_invalid", "invalid"),
    ("actor_name", "actor"), ("heading", "title"), ("conf", "confidence"), ("constraints", "constraint"), ("criteria", "acceptance_criteria"), ("traceability.page_no", "traceability.page"),
    ("traceability.docid", "traceability.doc_id"), ("traceability.doctype", "traceability.doc_type"), ("page", "page"), ("risk_level", "risk_level"), ("owner_team", "owner_team"), ("tags", "tags"),
])
def test_names(name, field):
    assert D.resolve_name(name, [f for _, f, _, _ in FIELDS]) == field


def frame(spark, rows):
    return spark.createDataFrame([(f, "CRU", n, s, None, None, i, p) for i, (f, n, s, p) in enumerate(rows)],
                                 "feed_id string, record_kind string, file_name string, file_seq int, written_at timestamp_ntz, received_at timestamp_ntz, line_no int, payload string").withColumn("field", F.lit("clash"))


def catalog(spark):
    return spark.createDataFrame(FIELDS, "record_kind string, field_name string, json_type string, is_required boolean")


def test_changes(spark):
    rows = [
        ("f", "a1", 1, '{"cru_id": "1", "dependencies": ["x"], "traceability": {"page": 1}, "invalid": null}'), ("f", "a1", 1, '{"cru_id": "1", "dependencies": ["x"], "traceability": {"page": 1}, "invalid": null}'), ("f", "a1", 1, '{"cut'),
        ("f", "a3", 3, '{"cruid": "1", "depends_on": "x, y", "traceability": {"page": "2"}, "invalid": true, "extra": 1}'), ("f", "a3", 3, None),
        ("f", "a4", 4, '{"cruid": "1", "extra": [], "empty": {}}'), ("f", "a5", 5, '{"bad'), ("g", "b1", 1, '{"title": "t"}'), ("g", "b2", 2, '[1]'),
    ]
    got = {tuple(r) for r in D.changes(frame(spark, rows), catalog(spark)).collect()}
    assert got == {
        ("a3", "cruid", "renamed"), ("a3", "depends_on", "renamed"), ("a3", "depends_on", "retyped"), ("a3", "traceability.page", "retyped"), ("a3", "extra", "added"),
        ("a4", "extra", "retyped"), ("a4", "depends_on", "removed"), ("a4", "traceability.page", "removed"), ("a4", "invalid", "removed"),
    }


def test_table_and_casts(spark):
    rows = [("f", "a", 1, '{"cruId": "1", "deps": ["x", "y"], "traceability": {"page": "7"}, "invalid": "false"}'), ("f", "a", 1, '{"cru_id": 5, "dependencies": "x", "traceability": {"page": "vii", "doc_id": null}}'), ("f", "a", 1, "{")]
    df = frame(spark, rows)
    t = sorted(D.consistent_table(df, catalog(spark), "CRU").collect(), key=lambda r: r["line_no"])
    assert [(r["cru_id"], r["dependencies"], r["traceability__page"], r["invalid"], r["title"]) for r in t] == [("1", ["x", "y"], 7.0, False, None), ("5", None, None, None, None)]
    assert {(r["field_name"], r["raw_type"], r["raw_value"]) for r in D.failed_casts(df, catalog(spark), "CRU").collect()} == {("dependencies", "string", '"x"'), ("traceability.page", "string", '"vii"')}


def test_shapes():
    shape = "OBJECT<`a b`: BIGINT, c: OBJECT<`d.e`: ARRAY<OBJECT<x: VOID, y: ARRAY<STRING>>>, f: OBJECT<g: OBJECT<h: DECIMAL(2,1)>>>, n: VOID, o: OBJECT<>, `we``ird`: BOOLEAN, `x:y<z>,`: STRING>"
    assert D.shape_fields(shape) == [("a b", "number"), ("c.d.e", "array"), ("c.f.g.h", "number"), ("n", "null"), ("we`ird", "boolean"), ("x:y<z>,", "string")]
    assert D.shape_fields("OBJECT<>") == [] and D.shape_fields("ARRAY<BIGINT>") == []


def test_deep_nesting(spark):
    deep = lambda leaf: '{"a": {"b": {"c": {"d": {"e": %s}}}}}' % leaf
    rows = [("f", "a1", 1, deep("1")), ("f", "a2", 2, deep('"1"')), ("f", "a3", 3, '{"a": {"b": {"c": {"d": {}}}}}')]
    assert {tuple(r) for r in D.changes(frame(spark, rows), catalog(spark)).collect()} == {("a2", "a.b.c.d.e", "retyped"), ("a3", "a.b.c.d.e", "removed")}


def test_other_fields(spark):
    """What the catalogue does not know is kept."""
    rows = [("f", "a", 1, '{"cru_id": "1", "x": [1], "traceability": {"page": 2, "note": "n", "deep": {"er": 1}}}'), ("f", "a", 1, '{"title": "t", "traceability": "none"}'), ("f", "a", 1, '{"title": "t", "traceability": {"page": 1}}')]
    got = {r["line_no"]: r["other_fields"] and json.loads(r["other_fields"]) for r in D.consistent_table(frame(spark, rows), catalog(spark), "CRU").collect()}
    assert got == {0: {"x": [1], "traceability.note": "n", "traceability.deep": {"er": 1}}, 1: {"traceability": "none"}, 2: None}


def test_empty(spark):
    df = frame(spark, [("f", "a", 1, None)]).where("1 = 0")
    assert D.changes(df, catalog(spark)).count() == 0 and D.consistent_table(df, catalog(spark), "CRU").count() == 0
