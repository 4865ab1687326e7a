"""Queries over the traceability graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.operators import context as C
from loomtrace.operators import graph as G
from loomtrace.session import materialize, table


def _n(spark, d):
    return G.node_versions(table(spark, d, "nodes"))


def _e(spark, d):
    return G.edge_versions(table(spark, d, "edges"))


def _ids(spark, d):
    """Anchors: every CRU of the table."""
    return table(spark, d, "crus").where("cru_id is not null").select(F.col("cru_id").alias("node_id")).distinct()


def w1_upsert_nodes(spark, d):
    return _n(spark, d).select("node_id", "node_type", "title", "module", "version", "created_at")


def w1_merge_upsert(spark, d):
    """A second load merged into the first: created_at stays as first written."""
    n = table(spark, d, "nodes")
    first, second = n.where("created_at < timestamp_ntz '2025-06-01'"), n.where("created_at >= timestamp_ntz '2025-06-01'")
    cols = ["node_id", "title", "created_at"]
    return G.merge_upsert(G.node_versions(first).select(cols), G.node_versions(second).select(cols), ["node_id"], keep=["created_at"])


def w2_insert_edges(spark, d):
    return _e(spark, d).select("src_id", "rel_type", "dst_id", "confidence", "created_at")


def w3_upsert_embeddings(spark, d):
    e = G.embedding_versions(table(spark, d, "node_embeddings"))
    return e.select("node_id", "node_type", "module", "version", "section_path", "doc_type", "embedding_model", F.md5("embedding_bytes").alias("bytes_md5"))


def w4_drop_edges_to_parents(spark, d):
    return G.drop_edges_to_parents(_e(spark, d), _n(spark, d)).groupBy("rel_type").agg(F.count("*").alias("n"))


def w4_add_missing_reason(spark, d):
    e = G.add_missing_reason(table(spark, d, "edges"))
    return e.groupBy("rel_type", F.get_json_object("extra_json", "$.confidence_reason").alias("reason")).agg(F.count("*").alias("n"))


def a1_statistics(spark, d):
    return G.statistics(_n(spark, d), _e(spark, d), table(spark, d, "node_embeddings"))


def s9_nodes_by_id(spark, d):
    return G.nodes_by_id(_n(spark, d), _ids(spark, d)).select("node_id", "title", "module")


def s10_edges_from(spark, d):
    return G.edges_from(_e(spark, d), _ids(spark, d), ["SUPPORTED_BY", "TESTS"]).select("src_id", "rel_type", "dst_id", "confidence")


def s11_edges_to(spark, d):
    return G.edges_to(_e(spark, d), _ids(spark, d)).select("src_id", "rel_type", "dst_id", "confidence")


def s12_embedding_scan(spark, d):
    e = G.embedding_scan(table(spark, d, "node_embeddings"), ["CRU", "CHUNK"], module="AUDIT", doc_type="SRS", version="")
    return e.select("node_id", "node_type", "version", "created_at").distinct()


def i1_orphan_requirements(spark, d):
    return G.orphan_requirements(_n(spark, d), _e(spark, d))


def i2_orphan_children(spark, d):
    return G.orphan_children(_n(spark, d), _e(spark, d))


def i3_confidence_range(spark, d):
    return G.confidence_range(table(spark, d, "edges"))


def i4_confidence_reason_missing(spark, d):
    return G.confidence_reason_missing(table(spark, d, "edges"))


def i5_forbidden_inferred(spark, d):
    return G.forbidden_inferred(table(spark, d, "edges"))


def i6_parent_of_confidence(spark, d):
    return G.parent_of_confidence(table(spark, d, "edges"))


def i7_parent_supported_by(spark, d):
    return G.parent_supported_by(_n(spark, d), table(spark, d, "edges"))


def i8_strict_range(spark, d):
    """The stricter contract: confidence within 0.40 and 1."""
    return G.confidence_range(table(spark, d, "edges"), 0.4, 1.0)


def i8_strict_contract(spark, d):
    """All of the stricter contract: the range, orphan requirements as errors, PARENT_OF of exactly 1."""
    e = table(spark, d, "edges")
    orphans = G.orphan_requirements(_n(spark, d), e).withColumn("severity", F.lit("error"))
    return G.confidence_range(e, 0.4, 1.0).unionByName(orphans).unionByName(G.parent_of_confidence(e, 0.0))


def i10_contract(spark, d):
    """Edges against a contract that is data: least confidence per relation, and whether a reason is required."""
    contract = spark.createDataFrame([("SUPPORTED_BY", 0.4, True), ("PARENT_OF", 1.0, True), ("TESTS", 0.4, False), ("EVIDENCE_FOR", 0.4, True)], "rel_type string, least double, needs_reason boolean")
    return G.contract_breaches(table(spark, d, "edges"), contract).groupBy("rel_type", "breach").agg(F.count("*").alias("n"))


def u7_integrity(spark, d):
    return G.integrity(_n(spark, d), table(spark, d, "edges")).groupBy("code", "severity").agg(F.count("*").alias("n"))


def a22_integrity_summary(spark, d):
    return G.integrity_summary(G.integrity(_n(spark, d), table(spark, d, "edges")))


def proj5_cru_nodes(spark, d):
    crus = table(spark, d, "crus")
    one = G.insert_first(crus, ["cru_id"], [F.col("loaded_at"), F.coalesce("parent_requirement_id", F.lit(""))])
    return G.cru_nodes(one).select("node_id", "title", "text", "module", "doc_id", "doc_type", "section_path")


def _parts(spark, d):
    return G.chunk_parts(table(spark, d, "chunks"), table(spark, d, "crus"))


def g13_chunk_nodes(spark, d):
    return _parts(spark, d).select("chunk_id", "cru_id", "parent_id", "child_id").distinct()


def g13_supported_by(spark, d):
    return G.supported_by_edges(_parts(spark, d), table(spark, d, "crus"))


def g13_parent_of(spark, d):
    return G.parent_of_edges(_parts(spark, d))


def j10_existing_children(spark, d):
    """Computed child ids that exist as nodes."""
    return _parts(spark, d).select("cru_id", F.col("child_id").alias("node_id")).distinct().join(_n(spark, d).select("node_id"), "node_id", "left_semi")


def j11_test_edges(spark, d):
    sup = _e(spark, d).where("rel_type = 'SUPPORTED_BY'").select(F.col("src_id").alias("cru_id"), F.col("dst_id").alias("chunk_id"))
    return G.test_edges(table(spark, d, "test_cases"), _n(spark, d), sup)


def j14_not_embedded(spark, d):
    emb = table(spark, d, "node_embeddings").select("node_id")
    n = _n(spark, d).where("node_type in ('CRU', 'CHUNK', 'TEST') and text is not null and trim(text) <> ''")
    return n.join(emb, "node_id", "left_anti").groupBy("node_type", "module").agg(F.count("*").alias("n"))


def f8_embeddable(spark, d):
    n = _n(spark, d).where("node_type in ('CRU', 'CHUNK', 'TEST') and text is not null and length(trim(text)) > 0")
    return n.groupBy("node_type", "doc_type").agg(F.count("*").alias("n"))


def j6_tests_of_requirement(spark, d):
    n, e = _n(spark, d).where("node_type = 'TEST'"), _e(spark, d).where("rel_type = 'TESTS'")
    return n.join(e.select("src_id", F.col("dst_id").alias("requirement")), F.col("node_id") == F.col("src_id")).select("requirement", "node_id", "title")


def j7_last_evidence(spark, d):
    e = table(spark, d, "edges").where("rel_type = 'EVIDENCE_FOR'").select("src_id", "dst_id", "confidence", "created_at")
    return G.upsert_last(e, ["src_id"], [F.col("created_at"), F.col("dst_id")]).drop("created_at")


def j8_top_parents(spark, d):
    children = _e(spark, d).where("rel_type = 'SUPPORTED_BY'").select(F.col("dst_id").alias("node_id")).distinct()
    return G.parent_context(children, _e(spark, d), 3)


def j9_neighbourhood(spark, d):
    return G.neighbourhood(_e(spark, d).select("src_id", "rel_type", "dst_id"), _ids(spark, d)).groupBy("rel_type").agg(F.count("*").alias("n"))


def _arrivals(spark, d):
    return G.traverse(_ids(spark, d), _e(spark, d), "test_generation")


def g4_two_hop(spark, d):
    return _arrivals(spark, d).select("anchor", "node_id", "depth", "score")


def g2_all_tasks(spark, d):
    """Arrivals under the relation list of each task."""
    e, ids = materialize(_e(spark, d), "edges"), _ids(spark, d)
    parts = [G.traverse(ids, e, task).select(F.lit(task).alias("task"), "anchor", "node_id", "depth", "score") for task in R.TASK_RELATIONS]
    return reduce(DataFrame.unionByName, parts)


def g5_trace_paths(spark, d):
    """The steps of every path, as relation, direction and node, with the confidence of the whole."""
    a = _arrivals(spark, d)
    return a.select("anchor", "node_id", "depth", F.posexplode(F.split("path", r"\|")).alias("step", "s")).select(
        "anchor", "node_id", "depth", "step", F.split_part("s", F.lit(" "), F.lit(1)).alias("rel_type"), F.split_part("s", F.lit(" "), F.lit(2)).alias("direction"), F.split_part("s", F.lit(" "), F.lit(3)).alias("to_id")
    )


def o1_evidence(spark, d):
    return G.evidence(_arrivals(spark, d), _n(spark, d), 8)


def g6_related_nodes(spark, d):
    return _arrivals(spark, d).join(_n(spark, d).select("node_id", "node_type"), "node_id").groupBy("anchor", "node_type").agg(F.countDistinct("node_id").alias("n"))


def a17_fallback_gate(spark, d):
    return G.fallback_gate(_arrivals(spark, d))


def _pack_parts(spark, d):
    # Written once: evidence, gate, related nodes and warnings all read the arrivals.
    arr, n = materialize(_arrivals(spark, d), "arrivals"), _n(spark, d)
    ev = G.evidence(arr, n, 8).join(n.select("node_id", "doc_id", "section_path", "source_locator_json"), "node_id").withColumn("provenance", F.lit("graph"))
    anchors = _ids(spark, d).select(F.col("node_id").alias("anchor"))
    return anchors, ev, arr, C.warnings(anchors, ev, ["doc_id", "section_path", "source_locator_json"], G.fallback_gate(arr))


def f12_warnings(spark, d):
    return _pack_parts(spark, d)[3].distinct()


def g10_context_pack(spark, d):
    anchors, ev, arr, notes = _pack_parts(spark, d)
    parents = G.parent_context(ev.select("node_id").distinct(), _e(spark, d), 3)
    p = C.pack(anchors, ev, parents, notes, arr)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}")
    return p.select("anchor", n("evidence"), n("parents"), n("related"), n("warnings"), F.col("evidence")[0]["node_id"].alias("best"))


def o6_parents(spark, d):
    """Parents of each anchor's evidence: the k best of each child, each parent once, no more in all than there are children."""
    n, e = _n(spark, d), _e(spark, d)
    ev = G.evidence(_arrivals(spark, d), n, 8).select("anchor", F.col("node_id").alias("child"), F.col("rank").alias("child_rank"))
    return C.capped_parents(ev, G.parent_context(ev.select(F.col("child").alias("node_id")).distinct(), e, 3))


def proj4_context_pack(spark, d):
    """The pack itself, each list as one text in its own order."""
    anchors, ev, arr, notes = _pack_parts(spark, d)
    p = C.pack(anchors, ev, G.parent_context(ev.select("node_id").distinct(), _e(spark, d), 3), notes, arr)
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit("")).alias(c)
    return p.select(
        "anchor", joined("evidence", lambda x: F.concat_ws(":", x["rank"], x["node_id"])), joined("parents", lambda x: x), joined("related", lambda x: F.concat_ws(":", x["r"], x["node_id"])),
        joined("warnings", lambda x: F.concat_ws(":", x["code"], x["ref"])),
    )


def f13_citations(spark, d):
    """Tests against the evidence of the unit they name: citations are the chunks of their EVIDENCE_FOR edges."""
    e = _e(spark, d)
    ev = e.where("rel_type = 'SUPPORTED_BY'").select(F.col("src_id").alias("anchor"), F.col("dst_id").alias("node_id"))
    cited = e.where("rel_type = 'EVIDENCE_FOR'").groupBy(F.col("src_id").alias("test_id")).agg(F.collect_set("dst_id").alias("citations"))
    t = G.upsert_last(table(spark, d, "test_cases").where("test_id is not null"), ["test_id"], [F.col("loaded_at"), F.col("created_at"), F.coalesce("expected_result", F.lit("")), F.coalesce("priority", F.lit(""))])
    t = t.join(cited, "test_id", "left").withColumnRenamed("requirement_id", "anchor")
    return C.check_citations(t, ev).select("test_id", "n_steps", F.size("citations").alias("n_citations"), "code")


def j20_array_join(spark, d):
    """Array-containment join: units and the chunks whose list of unit ids names them."""
    ch = table(spark, d, "chunks").select("chunk_id", F.explode("cru_ids").alias("cru_id")).distinct()
    return table(spark, d, "crus").select("cru_id").distinct().join(ch, "cru_id").select("cru_id", "chunk_id")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and k[0].islower() and any(c.isdigit() for c in k[:5])}

N = """n as (select * exclude r from (select *, row_number() over (partition by node_id order by created_at desc, coalesce(title, '') desc, coalesce(text, '') desc, coalesce(module, '') desc, coalesce(version, '') desc) r from nodes) where r = 1)"""
E = """e as (select * exclude r from (select *, row_number() over (partition by src_id, rel_type, dst_id order by created_at, confidence, coalesce(evidence_chunk_id, ''), coalesce(extra_json, '')) r
  from edges where src_id is not null and dst_id is not null and rel_type is not null and confidence is not null and extra_json is not null
   and (not starts_with(trim(extra_json), '{') or json_extract_string(extra_json, '$.confidence_reason') is not null) and rel_type <> 'INFERRED_SUPPORTED_BY') where r = 1)"""
IDS = "ids as (select distinct cru_id node_id from crus where cru_id is not null)"
KIND = "node_type = 'CHUNK' and json_extract_string(extra_json, '$.chunk_type')"
REF = "concat_ws('|', src_id, rel_type, dst_id)"
ISSUES = {
    "ORPHAN_REQ": f"select 'ORPHAN_REQ' code, 'warning' severity, node_id ref from n where node_type = 'CRU' and node_id not in (select src_id from XX where rel_type = 'SUPPORTED_BY' and src_id is not null)",
    "ORPHAN_CHUNK_CHILD": f"select 'ORPHAN_CHUNK_CHILD' code, 'warning' severity, node_id ref from n where {KIND} = 'child' and node_id not in (select dst_id from XX where rel_type in ('SUPPORTED_BY', 'PARENT_OF') and dst_id is not null)",
    "CONFIDENCE_RANGE": f"select 'CONFIDENCE_RANGE' code, 'error' severity, {REF} ref from edges where confidence < 0 or confidence > 1",
    "CONFIDENCE_REASON_MISSING": f"select 'CONFIDENCE_REASON_MISSING' code, 'error' severity, {REF} ref from edges where json_extract_string(extra_json, '$.confidence_reason') is null",
    "FORBIDDEN_INFERRED_EDGE": f"select 'FORBIDDEN_INFERRED_EDGE' code, 'error' severity, {REF} ref from edges where rel_type = 'INFERRED_SUPPORTED_BY'",
    "PARENT_OF_CONFIDENCE": f"select 'PARENT_OF_CONFIDENCE' code, 'warning' severity, {REF} ref from edges where rel_type = 'PARENT_OF' and abs(confidence - 1) > 1e-6",
    "PARENT_SUPPORTED_BY": f"select 'PARENT_SUPPORTED_BY' code, 'error' severity, {REF} ref from edges where rel_type = 'SUPPORTED_BY' and dst_id in (select node_id from n where {KIND} = 'parent')",
}
ALL_ISSUES = " union all ".join(v.replace("XX", "edges") for v in ISSUES.values())
CLAUSE = "case when coalesce({k}, '') <> '' and not contains(trim(concat_ws(' ', {a}, {t})), coalesce({k}, '')) then concat_ws(' ', trim(concat_ws(' ', {a}, {t})), {k}) else trim(concat_ws(' ', {a}, {t})) end"
PARTS = f"""t as (select cru_id, arg_min(struct_pack(d := traceability.doc_id, s := traceability.section_path), loaded_at) m from crus where cru_id is not null group by 1),
 cc as (select distinct chunk_id, pos, c.cru_id cru_id, {CLAUSE.format(a='c.actor', t='c.action_text', k='c.constraint_text')} tx
   from (select chunk_id, unnest(crus) c, generate_subscripts(crus, 1) - 1 pos from chunks) where c.cru_id is not null),
 parts as (select chunk_id, pos, cru_id, m.d doc_id, m.s section_path, tx, 'P_' || sha256(coalesce(m.d, '') || coalesce(m.s, '')) parent_id,
   'CH_' || sha256(coalesce(m.d, '') || coalesce(m.s, '') || cru_id || lower(trim(tx))) child_id from cc join t using (cru_id))"""
def _arr(task: str) -> str:
    """Arrivals within two hops under the relations of a task, as common table expressions."""
    rel = {k: ", ".join(f"'{r}'" for r in v) for k, v in R.TASK_RELATIONS[task].items()}
    return f"""st as (select src_id a, dst_id b, rel_type, confidence c, 'forward' dir from e where rel_type in ({rel["forward"]})
   union all select dst_id, src_id, rel_type, confidence, 'reverse' from e where rel_type in ({rel["reverse"]})),
 a1 as (select i.node_id anchor, b node_id, max(struct_pack(c := c, p := concat_ws(' ', rel_type, dir, b))) m from ids i join st on st.a = i.node_id where b <> i.node_id group by 1, 2),
 a2 as (select anchor, b node_id, max(struct_pack(c := m.c * c, p := m.p || '|' || concat_ws(' ', rel_type, dir, b))) m from a1 join st on st.a = a1.node_id where b <> anchor group by 1, 2),
 arr as (select anchor, node_id, 1 depth, round(m.c * 0.9, 6) score, m.c confidence, m.p path from a1 union all select anchor, node_id, 2, round(m.c * (0.9 * 0.9), 6), m.c, m.p from a2)"""


ARR = f"with {E}, {IDS}, {_arr('test_generation')}"

ORACLE = {
    "w1_upsert_nodes": f"with {N} select node_id, node_type, title, module, version, created_at from n",
    "w1_merge_upsert": """with a as (select * from (select node_id, title, created_at, row_number() over (partition by node_id order by created_at desc, coalesce(title, '') desc, coalesce(text, '') desc) r from nodes where created_at < timestamp '2025-06-01') where r = 1),
      b as (select * from (select node_id, title, created_at, row_number() over (partition by node_id order by created_at desc, coalesce(title, '') desc, coalesce(text, '') desc) r from nodes where created_at >= timestamp '2025-06-01') where r = 1)
      select coalesce(a.node_id, b.node_id) node_id, case when b.node_id is not null then b.title else a.title end title, coalesce(a.created_at, b.created_at) created_at from a full join b on a.node_id = b.node_id""",
    "w2_insert_edges": f"with {E} select src_id, rel_type, dst_id, confidence, created_at from e",
    "w3_upsert_embeddings": """with o as (select *, row_number() over (partition by node_id order by created_at, md5(coalesce(embedding_bytes, ''::blob)), coalesce(node_type, '') , coalesce(module, ''), coalesce(version, ''), coalesce(section_path, '')) f,
        row_number() over (partition by node_id order by created_at desc, md5(coalesce(embedding_bytes, ''::blob)) desc, coalesce(doc_type, '') desc, coalesce(embedding_model, '') desc) l from node_embeddings)
      select a.node_id, a.node_type, a.module, a.version, a.section_path, z.doc_type, z.embedding_model, md5(z.embedding_bytes) bytes_md5 from o a join o z on a.node_id is not distinct from z.node_id where a.f = 1 and z.l = 1""",
    "w4_drop_edges_to_parents": f"with {N}, {E} select rel_type, count(*) n from e where not (rel_type = 'SUPPORTED_BY' and dst_id in (select node_id from n where {KIND} = 'parent')) group by 1",
    "w4_add_missing_reason": "select rel_type, coalesce(json_extract_string(extra_json, '$.confidence_reason'), 'migrated_default') reason, count(*) n from edges group by 1, 2",
    "a1_statistics": f"with {N}, {E} select 'nodes' kind, node_type name, count(*) n from n group by 2 union all select 'edges', rel_type, count(*) from e group by 2 union all select 'embeddings', 'total', count(*) from node_embeddings",
    "s9_nodes_by_id": f"with {N}, {IDS} select node_id, title, module from n where node_id in (select node_id from ids)",
    "s10_edges_from": f"with {E}, {IDS} select src_id, rel_type, dst_id, confidence from e where rel_type in ('SUPPORTED_BY', 'TESTS') and src_id in (select node_id from ids)",
    "s11_edges_to": f"with {E}, {IDS} select src_id, rel_type, dst_id, confidence from e where dst_id in (select node_id from ids)",
    "s12_embedding_scan": "select distinct node_id, node_type, version, created_at from node_embeddings where node_type in ('CRU', 'CHUNK') and module = 'AUDIT' and doc_type = 'SRS'",
    "i1_orphan_requirements": f"with {N}, {E} " + ISSUES["ORPHAN_REQ"].replace("XX", "e"),
    "i2_orphan_children": f"with {N}, {E} " + ISSUES["ORPHAN_CHUNK_CHILD"].replace("XX", "e"),
    "i3_confidence_range": ISSUES["CONFIDENCE_RANGE"],
    "i4_confidence_reason_missing": ISSUES["CONFIDENCE_REASON_MISSING"],
    "i5_forbidden_inferred": ISSUES["FORBIDDEN_INFERRED_EDGE"],
    "i6_parent_of_confidence": ISSUES["PARENT_OF_CONFIDENCE"],
    "i7_parent_supported_by": f"with {N} " + ISSUES["PARENT_SUPPORTED_BY"],
    "i8_strict_range": f"select 'CONFIDENCE_RANGE' code, 'error' severity, {REF} ref from edges where confidence < 0.4 or confidence > 1",
    "i8_strict_contract": f"with {N} select 'CONFIDENCE_RANGE' code, 'error' severity, {REF} ref from edges where confidence < 0.4 or confidence > 1 union all select code, 'error', ref from ("
    + ISSUES["ORPHAN_REQ"].replace("XX", "edges") + f") union all select 'PARENT_OF_CONFIDENCE', 'warning', {REF} from edges where rel_type = 'PARENT_OF' and confidence <> 1",
    "i10_contract": """with c(rel_type, least_c, needs) as (values ('SUPPORTED_BY', 0.4::double, true), ('PARENT_OF', 1.0::double, true), ('TESTS', 0.4::double, false), ('EVIDENCE_FOR', 0.4::double, true)),
      x as (select e.rel_type, 'unknown_relation' breach from edges e where not exists (select 1 from c where c.rel_type = e.rel_type)
        union all select e.rel_type, 'confidence' from edges e join c using (rel_type) where e.confidence is null or e.confidence < c.least_c
        union all select e.rel_type, 'reason' from edges e join c using (rel_type) where c.needs and json_extract_string(extra_json, '$.confidence_reason') is null)
      select rel_type, breach, count(*) n from x group by 1, 2""",
    "u7_integrity": f"with {N}, x as ({ALL_ISSUES}) select code, severity, count(*) n from x group by 1, 2",
    "a22_integrity_summary": f"with {N}, x as ({ALL_ISSUES}) select count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings, count(*) filter (severity = 'error') = 0 passed from x",
    "proj5_cru_nodes": f"""with o as (select *, row_number() over (partition by cru_id order by loaded_at, coalesce(parent_requirement_id, '')) r, {CLAUSE.format(a='actor', t='action_text', k='constraint_text')} cl from crus where cru_id is not null)
      select cru_id node_id, title, case when cl <> '' then cl else description end text, traceability.module module, traceability.doc_id doc_id, coalesce(traceability.doc_type, 'SRS') doc_type, traceability.section_path section_path from o where r = 1""",
    "g13_chunk_nodes": f"with {PARTS} select distinct chunk_id, cru_id, parent_id, child_id from parts",
    "g13_supported_by": f"""with {PARTS}, w as (select cru_id, arg_min(struct_pack(c := confidence), loaded_at).c c from crus where cru_id is not null group by 1)
      select distinct cru_id src_id, 'SUPPORTED_BY' rel_type, child_id dst_id, least(case when c is null or trim(c) = '' then 0.95 else case lower(trim(c)) when 'high' then 0.95 when 'medium' then 0.75 when 'low' then 0.5 else 0.75 end end, 0.95)::double confidence from parts join w using (cru_id)""",
    "g13_parent_of": f"with {PARTS} select distinct parent_id src_id, 'PARENT_OF' rel_type, child_id dst_id, 1.0::double confidence from parts",
    "j10_existing_children": f"with {PARTS}, {N} select distinct cru_id, child_id node_id from parts where child_id in (select node_id from n)",
    "j11_test_edges": f"""with {N}, {E}, t as (select distinct test_id src_id, requirement_id dst_id from test_cases where test_id in (select node_id from n) and requirement_id in (select node_id from n))
      select src_id, 'TESTS' rel_type, dst_id, 1.0::double confidence from t
      union all select distinct t.src_id, 'EVIDENCE_FOR', e.dst_id, 0.8::double from t join e on e.rel_type = 'SUPPORTED_BY' and e.src_id = t.dst_id where e.dst_id in (select node_id from n)""",
    "j14_not_embedded": f"with {N} select node_type, module, count(*) n from n where node_type in ('CRU', 'CHUNK', 'TEST') and text is not null and trim(text) <> '' and not exists (select 1 from node_embeddings m where m.node_id = n.node_id) group by 1, 2",
    "f8_embeddable": f"with {N} select node_type, doc_type, count(*) n from n where node_type in ('CRU', 'CHUNK', 'TEST') and text is not null and trim(text) <> '' group by 1, 2",
    "j6_tests_of_requirement": f"with {N}, {E} select e.dst_id requirement, n.node_id, n.title from n join e on e.src_id = n.node_id where e.rel_type = 'TESTS' and n.node_type = 'TEST'",
    "j7_last_evidence": "select src_id, dst_id, confidence from (select *, row_number() over (partition by src_id order by created_at desc, dst_id desc, confidence desc) r from edges where rel_type = 'EVIDENCE_FOR') where r = 1",
    "j8_top_parents": f"""with {E}, c as (select distinct dst_id from e where rel_type = 'SUPPORTED_BY')
      select dst_id child, src_id parent, confidence, cast(r as int) rank from (select *, row_number() over (partition by dst_id order by confidence desc, src_id) r from e where rel_type = 'PARENT_OF' and dst_id in (select dst_id from c)) where r <= 3""",
    "j9_neighbourhood": f"""with {E}, {IDS}, m as (select dst_id x from e where src_id in (select node_id from ids) union select src_id from e where dst_id in (select node_id from ids) union select node_id from ids)
      select rel_type, count(*) n from e where src_id in (select x from m) or dst_id in (select x from m) group by 1""",
    "g4_two_hop": ARR + " select anchor, node_id, depth, score from arr",
    "g2_all_tasks": " union all ".join(f"(with {E}, {IDS}, {_arr(t)} select '{t}' task, anchor, node_id, depth, score from arr)" for t in R.TASK_RELATIONS),
    "g5_trace_paths": ARR + """, s as (select anchor, node_id, depth, unnest(string_split(path, '|')) x, generate_subscripts(string_split(path, '|'), 1) - 1 step from arr)
      select anchor, node_id, depth, cast(step as int) step, split_part(x, ' ', 1) rel_type, split_part(x, ' ', 2) direction, split_part(x, ' ', 3) to_id from s""",
    "o1_evidence": ARR.replace("with e as", f"with {N}, e as", 1) + f""", b as (select anchor, node_id, max(score) score, min(depth) depth from arr group by 1, 2)
      select anchor, node_id, score, depth, cast(r as int) rank from (select b.*, row_number() over (partition by anchor order by score desc, b.node_id) r from b join n using (node_id) where {KIND} = 'child') where r <= 8""",
    "g6_related_nodes": ARR.replace("with e as", f"with {N}, e as", 1) + " select anchor, node_type, count(distinct node_id) n from arr join n using (node_id) group by 1, 2",
    "a17_fallback_gate": ARR + " select anchor, count(*) n, round(avg(confidence), 6) mean_confidence, (count(*) < 3 or avg(confidence) < 0.65 or not bool_or(contains(path, 'SUPPORTED_BY'))) fallback from arr group by 1",
    "j20_array_join": "select distinct c.cru_id, h.chunk_id from crus c join (select chunk_id, unnest(cru_ids) cru_id from chunks) h on h.cru_id = c.cru_id",
    "f13_citations": f"""with {E}, tc as (select * from (select *, row_number() over (partition by test_id order by loaded_at desc, created_at desc, coalesce(expected_result, '') desc, coalesce(priority, '') desc) r from test_cases where test_id is not null) where r = 1),
      k as (select tc.test_id, count(distinct s.dst_id) n from tc join e c on c.rel_type = 'EVIDENCE_FOR' and c.src_id = tc.test_id join e s on s.rel_type = 'SUPPORTED_BY' and s.src_id = tc.requirement_id and s.dst_id = c.dst_id group by 1)
      select tc.test_id, cast(coalesce(len(test_steps), 0) as int) n_steps, cast(coalesce(n, 0) as int) n_citations, case when coalesce(len(test_steps), 0) < 1 then 'no_steps' when trim(coalesce(expected_result, '')) = '' then 'no_expected_result' when coalesce(n, 0) = 0 then 'unresolved' end code
      from tc left join k using (test_id)""",
}
_EV = ARR.replace("with e as", f"with {N}, e as", 1) + f""", b as (select anchor, node_id, max(score) score from arr group by 1, 2), ev as (select anchor, node_id, score, r from (select b.*, row_number() over (partition by anchor order by score desc, b.node_id) r from b join n using (node_id) where {KIND} = 'child') where r <= 8),
 ex as (select ev.*, n.doc_id, n.section_path, n.source_locator_json from ev join n using (node_id)), fg as (select anchor from arr group by 1 having count(*) < 3 or avg(confidence) < 0.65 or not bool_or(contains(path, 'SUPPORTED_BY'))),
 nt as (select node_id anchor, 'MISSING_EVIDENCE' code, null::varchar as ref from ids where node_id not in (select anchor from ev) union select anchor, 'MISSING_FIELD:doc_id', node_id from ex where coalesce(doc_id, '') = ''
   union select anchor, 'MISSING_FIELD:section_path', node_id from ex where coalesce(section_path, '') = '' union select anchor, 'MISSING_FIELD:source_locator_json', node_id from ex where coalesce(source_locator_json, '') = ''
   union select anchor, 'VECTOR_FALLBACK_TRIGGERED', null from fg where anchor in (select anchor from ev))"""
ORACLE |= {
    "f12_warnings": _EV + " select * from nt",
    "g10_context_pack": _EV + """, pr as (select dst_id child, src_id parent from (select *, row_number() over (partition by dst_id order by confidence desc, src_id) r from e where rel_type = 'PARENT_OF' and dst_id in (select node_id from ev)) where r <= 3)
      select i.node_id anchor, cast((select count(*) from ev where anchor = i.node_id) as int) n_evidence, cast((select count(distinct parent) from ev join pr on pr.child = ev.node_id where anchor = i.node_id) as int) n_parents,
        cast(least(20, (select count(*) from arr where anchor = i.node_id)) as int) n_related, cast((select count(*) from nt where anchor = i.node_id) as int) n_warnings, (select node_id from ev where anchor = i.node_id and r = 1) best from ids i""",
    "o6_parents": _EV + """, pr as (select child, parent, rank from (select dst_id child, src_id parent, row_number() over (partition by dst_id order by confidence desc, src_id) rank from e where rel_type = 'PARENT_OF' and dst_id in (select node_id from ev)) where rank <= 3),
      j as (select anchor, parent, min((r, rank)) m from ev join pr on pr.child = ev.node_id group by 1, 2), k as (select *, row_number() over (partition by anchor order by m, parent) place from j), ch as (select anchor, count(*) children from ev group by 1)
      select anchor, parent, cast(place as int) place from k join ch using (anchor) where place <= children""",
    "proj4_context_pack": _EV + """, pr as (select dst_id child, src_id parent from (select *, row_number() over (partition by dst_id order by confidence desc, src_id) r from e where rel_type = 'PARENT_OF' and dst_id in (select node_id from ev)) where r <= 3),
      rl as (select * from (select anchor, node_id, row_number() over (partition by anchor order by depth, score desc, node_id) r from arr) where r <= 20),
      pa as (select anchor, string_agg(r || ':' || node_id, ',' order by r) t from ev group by 1), pb as (select anchor, string_agg(distinct parent, ',' order by parent) t from ev join pr on pr.child = ev.node_id group by 1),
      pc as (select anchor, string_agg(r || ':' || node_id, ',' order by r) t from rl group by 1), pw as (select anchor, string_agg(concat_ws(':', code, ref), ',' order by code, ref nulls first) t from nt group by 1)
      select i.node_id anchor, coalesce(pa.t, '') evidence, coalesce(pb.t, '') parents, coalesce(pc.t, '') related, coalesce(pw.t, '') warnings
      from ids i left join pa on pa.anchor = i.node_id left join pb on pb.anchor = i.node_id left join pc on pc.anchor = i.node_id left join pw on pw.anchor = i.node_id""",
}
