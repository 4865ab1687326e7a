"""The traceability graph: upserts, integrity, lookups, builders and scored traversal, all as set operations.

Rows are nodes(node_id, ...), edges(src_id, rel_type, dst_id, ...). Where the reader's tables hold several
versions of a key, a version order is part of the call and complete, so results never depend on file order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X

# --- writes -----------------------------------------------------------------------------------------


def _pick(df: DataFrame, keys: list[str], order: list[Column], best) -> DataFrame:
    """One row per key by the extreme of ``order`` and then of the row itself.

    An aggregate, not a window: partial aggregation drops repeats before the shuffle, also of a hot key.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(best(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("m"))
    return picked.select(*keys, "m.row.*").select(*df.columns)


def upsert_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins."""
    return _pick(df, keys, order, F.max)


def insert_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First write wins."""
    return _pick(df, keys, order, F.min)


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The target after an upsert of unique ``updates``; columns in ``keep`` stay as first written."""
    u = updates.select(*keys, *[F.col(c).alias(f"u_{c}") for c in target.columns if c not in keys], F.lit(True).alias("u_hit"))
    j = target.withColumn("t_hit", F.lit(True)).join(u, keys, "full_outer")
    pick = lambda c: F.when(F.col("u_hit") & (F.lit(c not in keep) | F.col("t_hit").isNull()), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(*keys, *[pick(c) for c in target.columns if c not in keys]).select(*target.columns)


def admissible_edges(edges: DataFrame, allow_inferred: bool = False) -> DataFrame:
    """Edges with all keys and a reason for their confidence; inferred ones only on request.

    A text in extra_json that is no JSON object slips through; null does not.
    """
    reason = F.get_json_object("extra_json", "$.confidence_reason")
    is_object = F.trim("extra_json").startswith("{")
    e = edges.where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull() & F.col("rel_type").isNotNull() & F.col("confidence").isNotNull())
    e = e.where(F.col("extra_json").isNotNull() & (reason.isNotNull() | ~is_object))
    return e if allow_inferred else e.where(F.col("rel_type") != "INFERRED_SUPPORTED_BY")


def node_versions(nodes: DataFrame) -> DataFrame:
    """The current row of each node."""
    return upsert_last(nodes, ["node_id"], [F.col("created_at"), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))])


def edge_versions(edges: DataFrame) -> DataFrame:
    """The first admissible row of each edge."""
    order = [F.col("created_at"), F.col("confidence"), F.coalesce("evidence_chunk_id", F.lit("")), F.coalesce("extra_json", F.lit(""))]
    return insert_first(admissible_edges(edges), ["src_id", "rel_type", "dst_id"], order)


def embedding_versions(emb: DataFrame) -> DataFrame:
    """Upsert of three columns only: bytes, model and doc_type of the last row, all else of the first.

    Per node one aggregate of ordered structs; of equal times the smaller hash of the bytes is earlier.
    """
    order = [F.col("created_at"), F.md5(F.coalesce("embedding_bytes", F.lit(b"")))]
    fixed, moving = ["node_type", "module", "version", "section_path"], ["doc_type", "embedding_model", "embedding_bytes"]
    o = [x.alias(f"o{i}") for i, x in enumerate(order)]
    g = emb.groupBy("node_id").agg(F.min(F.struct(*o, F.struct(*fixed).alias("r"))).alias("a"), F.max(F.struct(*o, F.struct(*moving).alias("r"))).alias("z"))
    return g.select("node_id", "a.r.*", "z.r.*")


def drop_edges_to_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Migration: SUPPORTED_BY edges must not lead to parent chunks."""
    parents = nodes.where((F.col("node_type") == "CHUNK") & (F.get_json_object("extra_json", "$.chunk_type") == "parent")).select("node_id").distinct()
    bad = (F.col("rel_type") == "SUPPORTED_BY")
    kept = edges.where(~bad)
    return kept.unionByName(edges.where(bad).join(parents, F.col("dst_id") == F.col("node_id"), "left_anti"))


def add_missing_reason(edges: DataFrame, reason: str = "migrated_default") -> DataFrame:
    """Migration: JSON patch that adds confidence_reason where it is absent; other keys stay."""
    m = F.from_json(F.coalesce("extra_json", F.lit("{}")), "map<string,string>")
    m = F.coalesce(m, F.create_map().cast("map<string,string>"))
    patched = F.to_json(F.map_concat(m, F.create_map(F.lit("confidence_reason"), F.lit(reason))))
    has = F.get_json_object("extra_json", "$.confidence_reason").isNotNull()
    return edges.withColumn("extra_json", F.when(has, F.col("extra_json")).otherwise(patched))


# --- reads -------------------------------------------------------------------------------------------


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups in bulk: a semi-join."""
    return nodes.join(ids, "node_id", "left_semi")


def edges_from(edges: DataFrame, ids: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Edges out of the given nodes. None means all relations; an empty list means none."""
    e = edges if relations is None else edges.where(F.col("rel_type").isin(relations))
    return e.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi")


def edges_to(edges: DataFrame, ids: DataFrame, relations: list[str] | None = None) -> DataFrame:
    e = edges if relations is None else edges.where(F.col("rel_type").isin(relations))
    return e.join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")


def embedding_scan(emb: DataFrame, node_types: list[str] | None = None, **equal: str | None) -> DataFrame:
    """Metadata filter before any vector is touched; a blank filter is none."""
    df = emb if not node_types else emb.where(F.col("node_type").isin(node_types))
    for c, v in equal.items():
        if v:
            df = df.where(F.col(c) == v)
    return df


def statistics(nodes: DataFrame, edges: DataFrame, emb: DataFrame) -> DataFrame:
    """(kind, name, n): node counts by type, edge counts by relation, embeddings in total."""
    return (
        nodes.groupBy(F.lit("nodes").alias("kind"), F.col("node_type").alias("name")).agg(F.count("*").alias("n"))
        .unionByName(edges.groupBy(F.lit("edges").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))
        .unionByName(emb.agg(F.count("*").alias("n")).select(F.lit("embeddings").alias("kind"), F.lit("total").alias("name"), "n"))
    )


# --- integrity ---------------------------------------------------------------------------------------


def _issue(df: DataFrame, code: str, severity: str, ref: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), ref.alias("ref"))


def _edge_ref() -> Column:
    return F.concat_ws("|", "src_id", "rel_type", "dst_id")


def orphan_requirements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("rel_type = 'SUPPORTED_BY'").select(F.col("src_id").alias("node_id"))
    return _issue(nodes.where("node_type = 'CRU'").join(e, "node_id", "left_anti"), "ORPHAN_REQ", "warning", F.col("node_id"))


def _chunk_kind(kind: str) -> Column:
    return (F.col("node_type") == "CHUNK") & (F.get_json_object("extra_json", "$.chunk_type") == kind)


def orphan_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("rel_type in ('SUPPORTED_BY', 'PARENT_OF')").select(F.col("dst_id").alias("node_id"))
    return _issue(nodes.where(_chunk_kind("child")).join(e, "node_id", "left_anti"), "ORPHAN_CHUNK_CHILD", "warning", F.col("node_id"))


def confidence_range(edges: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    return _issue(edges.where((F.col("confidence") < lo) | (F.col("confidence") > hi)), "CONFIDENCE_RANGE", "error", _edge_ref())


def confidence_reason_missing(edges: DataFrame) -> DataFrame:
    return _issue(edges.where(F.get_json_object("extra_json", "$.confidence_reason").isNull()), "CONFIDENCE_REASON_MISSING", "error", _edge_ref())


def forbidden_inferred(edges: DataFrame) -> DataFrame:
    return _issue(edges.where("rel_type = 'INFERRED_SUPPORTED_BY'"), "FORBIDDEN_INFERRED_EDGE", "error", _edge_ref())


def parent_of_confidence(edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    return _issue(edges.where((F.col("rel_type") == "PARENT_OF") & (F.abs(F.col("confidence") - 1) > tolerance)), "PARENT_OF_CONFIDENCE", "warning", _edge_ref())


def contract_breaches(edges: DataFrame, contract: DataFrame) -> DataFrame:
    """(src_id, rel_type, dst_id, breach): edges of unknown relations, below their relation's least confidence, or without a needed reason.

    ``contract`` (rel_type, least, needs_reason) holds one row per relation: schema, not data.
    """
    c = F.broadcast(contract.withColumn("__known", F.lit(True)))
    j = edges.select("src_id", "rel_type", "dst_id", "confidence", "extra_json").join(c, "rel_type", "left")
    known = F.col("__known").isNotNull()
    breaches = F.array_compact(F.array(
        F.when(~known, "unknown_relation"), F.when(known & (F.col("confidence").isNull() | (F.col("confidence") < F.col("least"))), "confidence"),
        F.when(F.col("needs_reason") & F.get_json_object("extra_json", "$.confidence_reason").isNull(), "reason"),
    ))
    return j.select("src_id", "rel_type", "dst_id", F.explode(breaches).alias("breach"))


def parent_supported_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parents = nodes.where(_chunk_kind("parent")).select(F.col("node_id").alias("dst_id"))
    return _issue(edges.where("rel_type = 'SUPPORTED_BY'").join(parents, "dst_id", "left_semi"), "PARENT_SUPPORTED_BY", "error", _edge_ref())


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, severity, ref): all seven checks."""
    return reduce(DataFrame.unionByName, [
        orphan_requirements(nodes, edges), orphan_children(nodes, edges), confidence_range(edges), confidence_reason_missing(edges),
        forbidden_inferred(edges), parent_of_confidence(edges), parent_supported_by(nodes, edges),
    ])


def integrity_summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings and whether there is no error."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn(
        "passed", F.col("errors") == 0
    )


# --- builders ----------------------------------------------------------------------------------------


def cru_nodes(crus: DataFrame) -> DataFrame:
    """CRU nodes; the text is the clause, else the description."""
    t = F.col("traceability")
    clause = X.clause("actor", "action_text", "constraint_text")
    return crus.where(F.col("cru_id").isNotNull()).select(
        F.col("cru_id").alias("node_id"), F.lit("CRU").alias("node_type"), "title",
        F.when(clause != "", clause).otherwise(F.col("description")).alias("text"),
        t["module"].alias("module"), t["version"].alias("version"), t["doc_id"].alias("doc_id"), F.coalesce(t["doc_type"], F.lit("SRS")).alias("doc_type"),
        t["section_path"].alias("section_path"), F.to_json(t["source_locator"]).alias("source_locator_json"),
        F.to_json(F.struct("cru_type", "parent_requirement_id", "confidence"), {"ignoreNullFields": "false"}).alias("extra_json"),
    )


def chunk_parts(chunks: DataFrame, crus: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, section_path, cru_id, parent_id, child_id, text): one row per CRU inside a chunk."""
    c = chunks.select("chunk_id", F.posexplode("crus").alias("pos", "c")).where("c.cru_id is not null").select(
        "chunk_id", "pos", F.col("c.cru_id").alias("cru_id"), X.clause("c.actor", "c.action_text", "c.constraint_text").alias("text")
    ).distinct()
    t = crus.where("cru_id is not null").groupBy("cru_id").agg(
        F.min(F.struct("loaded_at", F.col("traceability.doc_id").alias("doc_id"), F.col("traceability.section_path").alias("section_path"))).alias("m")
    ).select("cru_id", "m.doc_id", "m.section_path")
    return c.join(t, "cru_id").select(
        "chunk_id", "pos", "cru_id", "doc_id", "section_path", "text", X.parent_chunk_id("doc_id", "section_path").alias("parent_id"),
        X.child_chunk_id("doc_id", "section_path", "cru_id", "text").alias("child_id"),
    )


def supported_by_edges(parts: DataFrame, crus: DataFrame) -> DataFrame:
    """CRU -> child chunk, with the CRU's own confidence, at most 0.95."""
    conf = crus.where("cru_id is not null").groupBy("cru_id").agg(F.min(F.struct("loaded_at", "confidence"))["confidence"].alias("w"))
    return parts.select("cru_id", "child_id").distinct().join(conf, "cru_id").select(
        F.col("cru_id").alias("src_id"), F.lit("SUPPORTED_BY").alias("rel_type"), F.col("child_id").alias("dst_id"), X.clamp(X.confidence_value("w"), 0.0, 0.95).alias("confidence")
    )


def parent_of_edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("parent_id").alias("src_id"), F.lit("PARENT_OF").alias("rel_type"), F.col("child_id").alias("dst_id"), F.lit(1.0).alias("confidence")).distinct()


def test_edges(tests: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """TESTS to the CRU a test names and EVIDENCE_FOR to its chunks, only where both ends exist.

    ``evidence`` holds (cru_id, chunk_id) from SUPPORTED_BY. Existence is two semi-joins on one distinct id column.
    """
    ids = nodes.select("node_id").distinct()
    t = tests.select(F.col("test_id").alias("src_id"), F.col("requirement_id").alias("dst_id")).where("src_id is not null and dst_id is not null").distinct()
    t = t.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    e = t.join(evidence, t["dst_id"] == evidence["cru_id"]).select("src_id", F.col("chunk_id").alias("dst_id"))
    e = e.join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").distinct()
    return t.select("src_id", F.lit("TESTS").alias("rel_type"), "dst_id", F.lit(1.0).alias("confidence")).unionByName(
        e.select("src_id", F.lit("EVIDENCE_FOR").alias("rel_type"), "dst_id", F.lit(0.8).alias("confidence"))
    )


def execution_edges(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, test_id, defect_ids): TEST -EXECUTED_AS-> RUN -RAISED_AS-> DEFECT where both ends exist."""
    ids = nodes.select("node_id").distinct()
    a = runs.select(F.col("test_id").alias("src_id"), F.lit("EXECUTED_AS").alias("rel_type"), F.col("run_id").alias("dst_id"), F.lit(1.0).alias("confidence"))
    b = runs.select(F.col("run_id").alias("src_id"), F.lit("RAISED_AS").alias("rel_type"), F.explode("defect_ids").alias("dst_id"), F.lit(1.0).alias("confidence"))
    e = a.unionByName(b).where("src_id is not null and dst_id is not null").distinct()
    return e.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select(a.columns)


def affects_edges(defects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(defect_id, linked_req_ids): DEFECT -AFFECTS-> CRU where both ends exist."""
    ids = nodes.select("node_id").distinct()
    e = defects.select(F.col("defect_id").alias("src_id"), F.lit("AFFECTS").alias("rel_type"), F.explode("linked_req_ids").alias("dst_id"), F.lit(0.85).alias("confidence")).distinct()
    return e.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select("src_id", "rel_type", "dst_id", "confidence")


# --- traversal ---------------------------------------------------------------------------------------


def traverse(anchors: DataFrame, edges: DataFrame, task: str, hops: int = 2) -> DataFrame:
    """All arrivals within ``hops`` for every anchor at once: (anchor, node_id, depth, score, confidence, path).

    Forward over the task's relations, and backwards over its reverse ones from a path's end; the score is
    the product of confidences times the hop penalty per hop. A node keeps its best arrival per anchor and
    depth, so the frontier holds at most one row per anchor and node. Each hop is one equi-join.
    """
    rel = R.TASK_RELATIONS[task]
    f = edges.where(F.col("rel_type").isin(rel["forward"])).select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"), "rel_type", "confidence", F.lit("forward").alias("direction"))
    r = edges.where(F.col("rel_type").isin(rel["reverse"])).select(F.col("dst_id").alias("at"), F.col("src_id").alias("to"), "rel_type", "confidence", F.lit("reverse").alias("direction"))
    steps = f.unionByName(r)
    level = anchors.select(F.col("node_id").alias("anchor"), F.col("node_id").alias("at"), F.lit(1.0).alias("conf"), F.array().cast("array<string>").alias("path")).distinct()
    out = None
    for depth in range(1, hops + 1):
        arrived = level.join(steps, "at").where(F.col("to") != F.col("anchor")).select(
            "anchor", "to", (F.col("conf") * F.col("confidence")).alias("conf"), F.concat("path", F.array(F.concat_ws(" ", "rel_type", "direction", "to"))).alias("path")
        )
        best = arrived.groupBy("anchor", "to").agg(F.max(F.struct("conf", F.array_join("path", "|").alias("text"), "path")).alias("m"))
        found = best.select("anchor", F.col("to").alias("node_id"), F.lit(depth).alias("depth"), F.round(F.col("m.conf") * R.HOP_PENALTY**depth, 6).alias("score"), F.col("m.conf").alias("confidence"), F.col("m.text").alias("path"))
        out = found if out is None else out.unionByName(found)
        level = best.select("anchor", F.col("to").alias("at"), F.col("m.conf").alias("conf"), F.col("m.path").alias("path"))
    return out


def evidence(arrivals: DataFrame, nodes: DataFrame, k: int = 8, boosts: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """The k best child chunks per anchor: (anchor, node_id, score, depth, rank); boosts multiply the score of equal metadata."""
    chunks = nodes.where(_chunk_kind("child")).select("node_id", *(boosts or {}))
    best = arrivals.groupBy("anchor", "node_id").agg(F.max("score").alias("score"), F.min("depth").alias("depth")).join(chunks, "node_id")
    for c, (v, factor) in (boosts or {}).items():
        best = best.withColumn("score", F.when(F.col(c) == v, F.col("score") * factor).otherwise(F.col("score")))
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "node_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("anchor", "node_id", "score", "depth", "rank")


def parent_context(children: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The k parents of each child chunk by confidence: (child, parent, confidence, rank)."""
    p = edges.where("rel_type = 'PARENT_OF'").join(children, edges["dst_id"] == children["node_id"])
    w = Window.partitionBy("dst_id").orderBy(F.desc("confidence"), "src_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("dst_id").alias("child"), F.col("src_id").alias("parent"), "confidence", "rank")


def fallback_gate(arrivals: DataFrame, min_rows: int = 3, min_confidence: float = 0.65) -> DataFrame:
    """Per anchor, whether the graph's evidence is too thin: too few rows, low confidence, or no SUPPORTED_BY on any path."""
    g = arrivals.groupBy("anchor").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.bool_or(F.col("path").contains("SUPPORTED_BY")).alias("supported"))
    return g.select("anchor", "n", F.round("mean", 6).alias("mean_confidence"), ((F.col("n") < min_rows) | (F.col("mean") < min_confidence) | ~F.col("supported")).alias("fallback"))


def fuse(graph_hits: DataFrame, vector_hits: DataFrame, k: int = 8) -> DataFrame:
    """Graph first: graph scores get a bias, vector hits only fill in what the graph has not; k best per anchor.

    Both sides hold (anchor, node_id, score). Result adds provenance, needs_confirmation and rank.
    """
    v = vector_hits.join(graph_hits.select("anchor", "node_id"), ["anchor", "node_id"], "left_anti")
    g = graph_hits.select("anchor", "node_id", (F.col("score") + R.GRAPH_BIAS).alias("score"), F.lit("graph").alias("provenance"), F.lit(False).alias("needs_confirmation"))
    both = g.unionByName(v.select("anchor", "node_id", "score", F.lit("vector").alias("provenance"), (F.col("score") < R.MIN_SIMILARITY).alias("needs_confirmation")))
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "node_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbourhood(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges within two hops of the given nodes: the ends of the first hop are the starts of the second."""
    ends = edges_from(edges, ids).select(F.col("dst_id").alias("node_id")).union(edges_to(edges, ids).select(F.col("src_id").alias("node_id"))).union(ids).distinct()
    return edges_from(edges, ends).unionByName(edges_to(edges, ends)).distinct()


def route(queries: DataFrame) -> DataFrame:
    """Requests (task, req_id, query_text) with defaults of their sizes and what is wrong with them, null for nothing: errors are rows, not aborts."""
    error = X.first_match([
        (F.coalesce("task", F.lit("")) == "", "task is required"), (~F.col("task").isin(list(R.TASK_RELATIONS)), "unsupported task"),
        ((F.coalesce("req_id", F.lit("")) == "") & (F.coalesce("query_text", F.lit("")) == ""), "req_id or query_text is required"),
    ], F.lit(None).cast("string"))
    defaults = {k: F.coalesce(k, F.lit(v)) if k in queries.columns else F.lit(v) for k, v in R.TASK_DEFAULTS.items()}
    return queries.withColumns({**defaults, "error": error})


def anchors(candidates: DataFrame, k: int = 5, preferred: str = "CRU") -> DataFrame:
    """The k anchors of each query among candidates (query_id, id, node_type, score): the preferred type first, then by score."""
    w = Window.partitionBy("query_id").orderBy((F.col("node_type") != preferred).cast("int"), F.desc("score"), "id")
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "id", "node_type", "score", "place")
