"""The queries that start from units start from all of them: brute force over a small graph with ids of every ending."""

import random

import pytest

from loomtrace.functions import rules as R
from loomtrace.plans import graph as P
from tests.test_graph import EDGE, NODE, edge, node, walk

UNITS = [f"CRU-FR0000000{i}-0{j}" for i in range(3) for j in (1, 2, 3)] + ["CRU-X-11", "CRU-X-40"]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    r, d = random.Random(7), str(tmp_path_factory.mktemp("graph"))
    chunks, parents, tests = [f"c{i}" for i in range(14)], [f"p{i}" for i in range(4)], [f"t{i}" for i in range(6)]
    keys = {(u, "SUPPORTED_BY", r.choice(chunks)) for u in UNITS[:-1] for _ in range(3)} | {(r.choice(parents), "PARENT_OF", c) for c in chunks for _ in range(2)}
    keys |= {(t, "TESTS", r.choice(UNITS[:-1])) for t in tests for _ in range(2)} | {(c, "PARENT_OF", r.choice(chunks)) for c in chunks[:5]} | {(a, "DECOMPOSED_TO", b) for a, b in zip(UNITS, UNITS[1:-1])}
    rows = [(*k, round(r.uniform(0.4, 1), 2)) for k in sorted(keys) if k[0] != k[2]]
    nodes = [node(u, "CRU", None) for u in UNITS] + [node(c) for c in chunks] + [node(p, sub="parent") for p in parents] + [node(t, "TEST", None) for t in tests]
    spark.createDataFrame([edge(*x) for x in rows], EDGE).write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame(nodes, NODE).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(u,) for u in [*UNITS, *UNITS, None]], "cru_id string").write.parquet(f"{d}/crus.parquet")
    return d, rows, {n[0]: ("child" if n[0] in chunks else n[1]) for n in nodes}


def run(spark, d, name, *cols):
    return {tuple(x[c] for c in cols) for x in P.QUERIES[name](spark, d).collect()}


def brute(rows):
    return {k: v for u in UNITS for k, v in walk(u, rows, "test_generation").items()}


def top(kind, arrivals, u, k=8):
    best = {}
    for (a, to, _), s in arrivals.items():
        if a == u and kind.get(to) == "child":
            best[to] = max(best.get(to, 0), s)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_lookups_of_all_units(spark, graph):
    d, rows, _ = graph
    assert run(spark, d, "s9_nodes_by_id", "node_id") == {(u,) for u in UNITS}
    assert run(spark, d, "s10_edges_from", "src_id", "rel_type", "dst_id", "confidence") == {x for x in rows if x[0] in UNITS and x[1] in ("SUPPORTED_BY", "TESTS")}
    assert run(spark, d, "s11_edges_to", "src_id", "rel_type", "dst_id", "confidence") == {x for x in rows if x[2] in UNITS}
    ends = {x[2] for x in rows if x[0] in UNITS} | {x[0] for x in rows if x[2] in UNITS} | set(UNITS)
    near = [x[1] for x in rows if x[0] in ends or x[2] in ends]
    assert run(spark, d, "j9_neighbourhood", "rel_type", "n") == {(t, near.count(t)) for t in near}


def test_traversal_from_all_units(spark, graph):
    d, rows, kind = graph
    want = brute(rows)
    got = {(r["anchor"], r["node_id"], r["depth"]): r["score"] for r in P.g4_two_hop(spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert run(spark, d, "o1_evidence", "anchor", "node_id", "rank") == {(u, c, i + 1) for u in UNITS for i, (c, _) in enumerate(top(kind, want, u))}
    steps = {(r["anchor"], r["node_id"], r["depth"], r["step"]): r for r in P.g5_trace_paths(spark, d).collect()}
    assert set(steps) == {(*k, n) for k in want for n in range(k[2])}  # as many steps as hops, the last of which arrives
    edges = {(x[0], x[1], x[2]) for x in rows}
    for (u, node, depth, n), r in steps.items():
        at = u if n == 0 else steps[u, node, depth, 0]["to_id"]
        assert r["to_id"] == node or n < depth - 1
        assert ((at, r["rel_type"], r["to_id"]) if r["direction"] == "forward" else (r["to_id"], r["rel_type"], at)) in edges
    kinds = {u: [("CHUNK" if kind[n] in ("child", "CHUNK") else kind[n]) for n in {k[1] for k in want if k[0] == u}] for u in UNITS}
    assert run(spark, d, "g6_related_nodes", "anchor", "node_type", "n") == {(u, t, kinds[u].count(t)) for u in UNITS for t in kinds[u]}


def test_gate_warnings_and_packs_of_all_units(spark, graph):
    d, rows, kind = graph
    want = brute(rows)
    n = {u: sum(k[0] == u for k in want) for u in UNITS}
    mean = {u: sum(s / R.HOP_PENALTY ** k[2] for k, s in want.items() if k[0] == u) / max(1, n[u]) for u in UNITS}
    supported = {u: any(x[1] == "SUPPORTED_BY" and x[0] == u for x in rows) for u in UNITS}
    fallback = {u for u in UNITS if n[u] and (n[u] < 3 or mean[u] < 0.65 or not supported[u])}
    assert run(spark, d, "a17_fallback_gate", "anchor", "n", "fallback") == {(u, n[u], u in fallback) for u in UNITS if n[u]}
    notes = {u: {("MISSING_FIELD:source_locator_json", c) for c, _ in top(kind, want, u)} or {("MISSING_EVIDENCE", None)} for u in UNITS}
    for u in fallback:
        if top(kind, want, u):
            notes[u].add(("VECTOR_FALLBACK_TRIGGERED", None))
    assert run(spark, d, "f12_warnings", "anchor", "code", "ref") == {(u, *x) for u in UNITS for x in notes[u]}
    up = lambda c: [p for _, p in sorted((-x[3], x[0]) for x in rows if x[1] == "PARENT_OF" and x[2] == c)[:3]]
    packs = set()
    for u in UNITS:
        ev = top(kind, want, u)
        packs.add((u, len(ev), len({p for c, _ in ev for p in up(c)}), min(20, n[u]), len(notes[u]), ev[0][0] if ev else None))
    assert run(spark, d, "g10_context_pack", "anchor", "n_evidence", "n_parents", "n_related", "n_warnings", "best") == packs
