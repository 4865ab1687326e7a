import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.operators import nested as N

SCHEMA = """chunk_id string, chunk_type string, crus array<struct<cru_id:string,actor:string,action_text:string,constraint_text:string,confidence:string,title:string,
 acceptance_criteria:array<struct<criterion:string,evidence:array<struct<page:int,para:int>>>>>>, traceability struct<source_requirements:array<string>,sections:array<string>,
 doc_ids:array<string>,source_locators:array<struct<page:int,para:int>>>, created_at timestamp_ntz"""


def rebuild(triples):
    """Leaf values with their places, from the tree that json.loads builds."""
    return sorted((p, tuple(o), k, v) for p, o, k, v in triples)


def walk(x, path="$", ords=()):
    if isinstance(x, dict):
        yield path, ords, "object", None
        for k, v in x.items():
            yield from walk(v, f"{path}.{k}", ords)
    elif isinstance(x, list):
        yield path, ords, "array", None
        for i, v in enumerate(x):
            yield from walk(v, path + "[]", (*ords, i))
    elif x is None:
        yield path, ords, "null", None
    elif isinstance(x, bool):
        yield path, ords, "boolean", str(x).lower()
    elif isinstance(x, str):
        yield path, ords, "string", x
    else:
        yield path, ords, "number", json.dumps(x)


leaves = st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=8)
trees = st.recursive(leaves, lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text("abc", min_size=1, max_size=3), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(trees, st.sampled_from([None, 1]))
def test_stream_equals_tree(tree, indent):
    text = json.dumps(tree, indent=indent)
    got = [(p, tuple(o), k, v) for p, o, k, v in N.stream_triples(text)]
    assert got == list(walk(tree))


@pytest.mark.parametrize("text", ['{"a": 1', "[1,]", '{"a" 1}', "[1 2]", "{1: 2}", "nope", "[1] 2", "[}", '{"a": }'])
def test_malformed(text):
    with pytest.raises(ValueError):
        list(N.stream_triples(text))


def test_map_keys():
    t = list(N.stream_triples('{"1": {"title": "a"}, "1.2": null, "title": 3}', re.compile(N.SECTION_KEYS)))
    assert ("${}.@key", [0], "string", "1") in t and ("${}.title", [0], "string", "a") in t
    assert ("${}.@key", [1], "string", "1.2") in t and ("$.title", [], "number", "3") in t


def test_chunks(spark):
    rows = [
        ("c1", "x", [(None, "a", None, None, None, None, None), None, ("u2", None, None, None, None, None, [(None, [(1, None), None]), None, ("k", [])])], (["r", None, "r"], [], None, [(None, 2), None]), None),
        ("c2", "x", None, None, None),
        ("c3", "x", [], (None, None, None, None), None),
    ]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    sk = spark.createDataFrame([], "doc_id string, document_skeleton string, generated_at timestamp_ntz")
    got = {tuple(r) for r in N.nested_found(df, sk).collect()}
    assert got == {
        ("chunk_crus", "c1", 0, ""), ("chunk_crus", "c1", 2, "u2"), ("cru_criteria", "c1/2", 0, ""), ("cru_criteria", "c1/2", 2, "k"), ("criterion_evidence", "c1/2/0", 0, "1:"),
        ("chunk_requirements", "c1", 0, "r"), ("chunk_requirements", "c1", 2, "r"), ("chunk_locators", "c1", 0, ":2"),
    }
    crus = N.group_table(N.chunk_elements(df), "$.crus[]", {"cru_id": "cru_id", "actor": "actor"}).collect()
    assert {(r["rec_key"], r["pos"], r["cru_id"], r["actor"]) for r in crus} == {("c1", 0, None, "a"), ("c1", 2, "u2", None)}


@settings(max_examples=200, deadline=None)
@given(trees)
def test_elements_in_the_stream(tree):
    """The pivot in the stream against a grouping of all triples by ancestor and place."""
    want = {}
    for path, ords, kind, value in walk(tree):
        ancestor, leaf = N.split_path(path)
        e = want.setdefault((ancestor, ords), [True, {}])
        if leaf == "" and kind == "null":
            e[0] = False
        elif kind not in ("object", "array"):
            e[1][leaf] = value
    got = [((a, tuple(o)), [p, v]) for a, o, p, v in N.stream_elements(N.stream_triples(json.dumps(tree)))]
    assert len(got) == len(want) and dict(got) == want


def test_typed_elements_equal_parsed_ones(spark):
    """Columns nested by type, against the same records as JSON."""
    kind = "k string, a array<struct<x:int,y:array<array<string>>,z:struct<u:boolean,v:array<struct<w:string>>>>>, b struct<c:string,d:array<int>>, m map<string,struct<p:array<int>,q:string>>"
    rows = [("1", [(1, [["p", None], None, []], (True, [("w",), None])), None, (None, None, None)], ("c", [1, None]), {"3.1": ([4], "q"), "4": None}), ("2", None, None, None), ("3", [], (None, []), {})]
    df = spark.createDataFrame(rows, kind)
    typed = N.typed_elements(df, "k", {"a": "a", "b": "b", "m": "m"})
    parsed = N.elements(df.select("k", F.to_json(F.struct("a", "b", "m"), {"ignoreNullFields": "false"}).alias("j")), "k", "j", r"[\d.]+")
    # Nulls in place of objects are leaves of their own in JSON, and absent ones of its columns by type.
    seen = lambda d: sorted((r["rec_key"], r["ancestor"], tuple(r["ords"]), r["present"], tuple(sorted((k, v) for k, v in r["values"].items() if v is not None))) for r in d.collect())
    assert seen(typed) == seen(parsed)


def test_tables_from_the_data(spark):
    df = spark.createDataFrame([("1", '{"rows": [{"a": 1, "b c": "x", "pos": 7}, null, {"d": {"e": true}}]}'), ("2", '{"rows": [{"a": 2}], "t": 1}'), ("3", "[1")], "k string, j string")
    e = N.elements(df, "k", "j")
    t = N.group_table(e, "$.rows[]")
    assert t.columns == ["rec_key", "parent_ords", "pos", "a", "b_c", "d_e", "pos_"]
    assert sorted(tuple(r) for r in t.collect()) == [("1", "", 0, "1", "x", None, "7"), ("1", "", 2, None, None, "true", None), ("2", "", 0, "2", None, None, None)]
    assert {(r["ancestor"], r["leaf"], r["n_elements"], r["n_values"]) for r in N.inventory(e).collect()} >= {("$.rows[]", "a", 2, 2), ("$", "t", 1, 1)}
    assert e.where("ancestor = '$error'").count() == 1


def test_large_records_are_streamed(monkeypatch):
    monkeypatch.setattr(N, "LARGE", 10)
    assert list(N.whole('{"a": [1, 2', None)) == [("$error", [], "error", '{"a": [1, 2')]
    assert [t[0] for t in N.whole('{"a": [1, 2]}', None)] == ["$", "$.a", "$.a[]", "$.a[]"]


def test_skeletons(spark):
    flat = '{"1": {"title": "a", "page": "3"}, "1.1": {"page": 4}}'
    deep = '{"2": {"subsections": {"2.1": {"title": "t", "subsections": {"2.1.1": {}}}}}}'
    listed = '{"sections": [{"section_path": "A", "children": [{"section_path": "A.1"}, null, {"title": "no path"}]}]}'
    import datetime as dt

    t = dt.datetime
    rows = [("a", "old", t(2024, 1, 1)), ("a", flat, t(2024, 1, 2)), ("b", deep, None), ("c", listed, None), ("d", flat, t(2024, 1, 1)), ("d", None, t(2024, 1, 2)), ("e", "{", None), ("f", "", None), ("a", flat, t(2024, 1, 2))]
    df = spark.createDataFrame(rows, "doc_id string, document_skeleton string, generated_at timestamp_ntz").withColumn("path", F.lit("clash"))
    got = {(r["doc_id"], r["section_path"], r["depth"], r["parent_path"], r["page"]) for r in N.skeleton_sections(df).collect()}
    assert got == {("a", "1", 1, "", 3), ("a", "1.1", 2, "1", 4), ("b", "2", 1, "", None), ("b", "2.1", 2, "2", None), ("b", "2.1.1", 3, "2.1", None), ("c", "A", 1, "", None), ("c", "A.1", 2, "A", None)}


def test_long_and_bad_records(spark):
    big = json.dumps({"a": ["x" * 200_000] * 3})
    df = spark.createDataFrame([("1", big), ("2", '{"a": [1,'), ("3", None), (None, '{"a": []}')], "k string, j string")
    got = N.shred(df, "k", "j").groupBy("rec_key").agg(F.count("*").alias("n"), F.max("path").alias("p")).collect()
    assert {(r["rec_key"], r["n"], r["p"]) for r in got} == {("1", 5, "$.a[]"), ("2", 1, "$error"), (None, 2, "$.a")}
    assert {(r["ancestor"], r["leaf"]) for r in N.path_groups(N.shred(df, "k", "j")).collect()} >= {("$.a[]", ""), ("$", "a")}
