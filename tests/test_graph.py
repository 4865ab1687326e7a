import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.operators import graph as G

T = lambda d: dt.datetime(2025, 1, d)
EDGE = "src_id string, src_type string, rel_type string, dst_id string, dst_type string, confidence double, evidence_chunk_id string, extra_json string, created_at timestamp_ntz"
NODE = "node_id string, node_type string, title string, text string, module string, version string, doc_id string, doc_type string, section_path string, source_locator_json string, extra_json string, created_at timestamp_ntz"
WHY = '{"confidence_reason": "x"}'


def edge(s, r, d, c=1.0, extra=WHY, at=1):
    return (s, "A", r, d, "B", c, None, extra, T(at))


def node(i, kind="CHUNK", sub="child", title="t", at=1, module="m"):
    return (i, kind, title, "text", module, "1", "d", "SRS", "1", None, f'{{"chunk_type": "{sub}"}}' if sub else None, T(at))


def test_upserts(spark):
    n = spark.createDataFrame([node("a", title="old"), node("a", title="new", at=2), node("a", title="new", at=2), node("b", title=None)], NODE)
    assert {(r["node_id"], r["title"]) for r in G.node_versions(n).collect()} == {("a", "new"), ("b", None)}
    e = spark.createDataFrame([
        edge("a", "X", "b", 0.5), edge("a", "X", "b", 0.9, at=2), edge("a", "X", "c", extra=None), edge("a", "X", "d", extra="{}"), edge("a", "X", "e", extra="note"), edge("a", "INFERRED_SUPPORTED_BY", "f"), edge(None, "X", "g"), edge("a", "X", "h", None),
    ], EDGE)
    assert {(r["dst_id"], r["confidence"]) for r in G.edge_versions(e).collect()} == {("b", 0.5), ("e", 1.0)}
    assert G.admissible_edges(e, allow_inferred=True).where("dst_id = 'f'").count() == 1
    t, u = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, at int, v string"), spark.createDataFrame([("b", 9, None), ("c", 3, "z")], "k string, at int, v string")
    assert {tuple(r) for r in G.merge_upsert(t, u, ["k"], keep=["at"]).collect()} == {("a", 1, "x"), ("b", 2, None), ("c", 3, "z")}


def test_integrity(spark):
    n = spark.createDataFrame([node("r", "CRU", None), node("q", "CRU", None), node("c"), node("lone"), node("p", sub="parent")], NODE)
    e = spark.createDataFrame([edge("r", "SUPPORTED_BY", "c", 1.2), edge("p", "PARENT_OF", "c", 0.9999999), edge("p", "PARENT_OF", "x", 0.9), edge("r", "SUPPORTED_BY", "p", extra="{}"), edge("r", "INFERRED_SUPPORTED_BY", "c")], EDGE)
    got = {(r["code"], r["ref"]) for r in G.integrity(n, e).collect()}
    assert got == {
        ("ORPHAN_REQ", "q"), ("ORPHAN_CHUNK_CHILD", "lone"), ("CONFIDENCE_RANGE", "r|SUPPORTED_BY|c"), ("CONFIDENCE_REASON_MISSING", "r|SUPPORTED_BY|p"), ("FORBIDDEN_INFERRED_EDGE", "r|INFERRED_SUPPORTED_BY|c"),
        ("PARENT_OF_CONFIDENCE", "p|PARENT_OF|x"), ("PARENT_SUPPORTED_BY", "r|SUPPORTED_BY|p"),
    }
    s = G.integrity_summary(G.integrity(n, e)).first()
    assert (s["errors"], s["warnings"], s["passed"]) == (4, 3, False) and G.integrity_summary(G.integrity(n.where("1 = 0"), e.where("1 = 0"))).first()["passed"]
    kept = G.drop_edges_to_parents(e, n)
    assert {r["dst_id"] for r in kept.where("rel_type = 'SUPPORTED_BY'").collect()} == {"c"}
    patched = {r["dst_id"]: r["extra_json"] for r in G.add_missing_reason(e).collect()}
    assert patched["p"] == '{"confidence_reason":"migrated_default"}' and patched["x"] == WHY


def test_lookups(spark):
    e = spark.createDataFrame([edge("a", "X", "b"), edge("b", "Y", "c"), edge("c", "X", "d"), edge("d", "X", "e")], EDGE)
    ids = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert G.edges_from(e, ids).count() == 2 and G.edges_from(e, ids, ["X"]).count() == 1 and G.edges_from(e, ids, []).count() == 0 and G.edges_to(e, ids).count() == 1
    hood = G.neighbourhood(e.select("src_id", "rel_type", "dst_id"), ids.where("node_id = 'a'"))
    assert {(r["src_id"], r["dst_id"]) for r in hood.collect()} == {("a", "b"), ("b", "c")}


def walk(anchor, edges, task):
    """Best arrival per node and depth, one edge at a time."""
    rel, level, out = R.TASK_RELATIONS[task], {anchor: 1.0}, {}
    for depth in (1, 2):
        nxt = {}
        for at, conf in level.items():
            for s, r, d, c in edges:
                for here, to, ok in ((s, d, r in rel["forward"]), (d, s, r in rel["reverse"])):
                    if ok and here == at and to != anchor:
                        nxt[to] = max(nxt.get(to, 0), conf * c)
        out |= {(anchor, to, depth): round(c * R.HOP_PENALTY**depth, 6) for to, c in nxt.items()}
        level = nxt
    return out


def test_traverse(spark):
    import random

    r = random.Random(5)
    rels = ["SUPPORTED_BY", "PARENT_OF", "TESTS", "EVIDENCE_FOR"]
    rows = list({(f"n{r.randrange(12)}", r.choice(rels), f"n{r.randrange(12)}"): None for _ in range(60)})
    rows = [(*k, round(r.uniform(0.4, 1), 2)) for k in rows]
    e = spark.createDataFrame([edge(*x) for x in rows], EDGE)
    anchors = spark.createDataFrame([("n0",), ("n1",), ("n1",), ("nowhere",)], "node_id string")
    got = G.traverse(anchors, e, "test_generation")
    assert {(x["anchor"], x["node_id"], x["depth"]): x["score"] for x in got.collect()} == pytest.approx(walk("n0", rows, "test_generation") | walk("n1", rows, "test_generation"))
    one = spark.createDataFrame([edge("q", "SUPPORTED_BY", "c", 0.95)], EDGE)
    assert G.traverse(spark.createDataFrame([("q",)], "node_id string"), one, "debug").first()["score"] == 0.855
    n = spark.createDataFrame([node("c", module="AUDIT"), node("q", "CRU", None)], NODE)
    ev = G.evidence(G.traverse(spark.createDataFrame([("q",)], "node_id string"), one, "debug"), n, boosts={"module": ("AUDIT", R.BOOST_MODULE)}).first()
    assert (ev["node_id"], round(ev["score"], 6), ev["rank"]) == ("c", round(0.855 * 1.2, 6), 1)
    gate = G.fallback_gate(G.traverse(spark.createDataFrame([("q",)], "node_id string"), one, "debug")).first()
    assert gate["fallback"] and gate["n"] == 1


def test_fuse_and_parents(spark):
    g = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.2)], "anchor string, node_id string, score double")
    v = spark.createDataFrame([("q", "a", 0.99), ("q", "c", 0.6), ("q", "d", 0.7)], "anchor string, node_id string, score double")
    got = [(r["node_id"], round(r["score"], 6), r["provenance"], r["needs_confirmation"]) for r in G.fuse(g, v, 3).orderBy("rank").collect()]
    assert got == [("a", 0.8, "graph", False), ("d", 0.7, "vector", False), ("c", 0.6, "vector", True)]
    e = spark.createDataFrame([edge(f"p{i}", "PARENT_OF", "c", c) for i, c in enumerate((0.5, 0.9, 0.9, 0.1))], EDGE)
    assert [r["parent"] for r in G.parent_context(spark.createDataFrame([("c",)], "node_id string"), e, 3).orderBy("rank").collect()] == ["p1", "p2", "p0"]


def test_builders(spark):
    n = spark.createDataFrame([node(x, k, None) for x, k in (("t", "TEST"), ("u", "CRU"), ("run", "RUN"), ("bug", "DEFECT"))] + [node("c")], NODE)
    tests = spark.createDataFrame([("t", "u"), ("t", "gone"), ("gone", "u"), ("t", None), ("t", "u")], "test_id string, requirement_id string")
    ev = spark.createDataFrame([("u", "c"), ("u", "gone")], "cru_id string, chunk_id string")
    assert {tuple(r) for r in G.test_edges(tests, n, ev).collect()} == {("t", "TESTS", "u", 1.0), ("t", "EVIDENCE_FOR", "c", 0.8)}
    runs = spark.createDataFrame([("run", "t", ["bug", "gone", None]), ("run2", "t", None)], "run_id string, test_id string, defect_ids array<string>")
    assert {tuple(r) for r in G.execution_edges(runs, n).collect()} == {("t", "EXECUTED_AS", "run", 1.0), ("run", "RAISED_AS", "bug", 1.0)}
    assert {tuple(r) for r in G.affects_edges(spark.createDataFrame([("bug", ["u", "gone"])], "defect_id string, linked_req_ids array<string>"), n).collect()} == {("bug", "AFFECTS", "u", 0.85)}


def test_ids(spark):
    import hashlib

    from loomtrace.functions import text as X

    r = spark.createDataFrame([("DOC", "3.1", "CRU-1", " The Clause ")], "d string, s string, c string, t string").select(X.parent_chunk_id("d", "s"), X.child_chunk_id("d", "s", "c", "t")).first()
    assert r[0] == "P_" + hashlib.sha256(b"DOC3.1").hexdigest() and r[1] == "CH_" + hashlib.sha256(b"DOC3.1CRU-1the clause").hexdigest()
    assert spark.range(1).select(F.lit(None).cast("string").alias("d")).select(X.parent_chunk_id("d", "d")).first()[0].startswith("P_")
