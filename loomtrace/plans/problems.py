"""Queries of the general data problems: nested records, drifting schemas, orphan references."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import drift, nested, orphans
from loomtrace.session import table


def p1_found(spark, d):
    return nested.nested_found(table(spark, d, "chunks"), table(spark, d, "raw_skeletons")).select(
        "child_table", "parent_key", F.col("pos").cast("int").alias("pos"), "child_key"
    )


def p1_chunk_crus(spark, d):
    e = nested.chunk_elements(table(spark, d, "chunks"))
    cols = {c: c for c in ("cru_id", "actor", "action_text", "constraint_text", "confidence", "title")}
    return nested.group_table(e, "$.crus[]", cols).withColumnRenamed("rec_key", "chunk_id").drop("parent_ords")


def p1_inventory(spark, d):
    """Which flat tables and columns the nested parts of chunks and outlines have."""
    e = nested.chunk_elements(table(spark, d, "chunks"))
    s = nested.skeleton_elements(table(spark, d, "raw_skeletons"))
    return nested.inventory(e).withColumn("source", F.lit("chunks")).unionByName(nested.inventory(s).withColumn("source", F.lit("raw_skeletons")))


def p1_criteria(spark, d):
    """The acceptance criteria of all units of all chunks as one table, with every column that occurs."""
    return nested.group_table(nested.chunk_elements(table(spark, d, "chunks")), "$.crus[].acceptance_criteria[]")


def p1_skeleton_sections(spark, d):
    return nested.skeleton_sections(table(spark, d, "raw_skeletons"))


def p5_found(spark, d):
    return drift.changes(table(spark, d, "raw_records"), table(spark, d, "field_catalog")).distinct()


def p5_cru_table(spark, d):
    return drift.consistent_table(table(spark, d, "raw_records"), table(spark, d, "field_catalog"), "CRU")


def p5_requirement_table(spark, d):
    return drift.consistent_table(table(spark, d, "raw_records"), table(spark, d, "field_catalog"), "requirement")


def p5_failed_casts(spark, d):
    r, c = table(spark, d, "raw_records"), table(spark, d, "field_catalog")
    return drift.failed_casts(r, c, "CRU").unionByName(drift.failed_casts(r, c, "requirement"))


def _orphans(spark, d):
    return orphans.orphans(*[table(spark, d, n) for n in ("edges", "crus", "nodes", "requirements", "deletions")])


def p6_found(spark, d):
    return _orphans(spark, d).drop("n_refs")


def p6_orphan_report(spark, d):
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("p") and k[1:2].isdigit()}

_P6 = """
with st as (
  select 'nodes' tn, node_id k, created_at at_, cast(null as timestamp) del from nodes
  union all select 'requirements', req_id, loaded_at, null from requirements
  union all select table_name, record_id, null, deleted_at from deletions),
s as (select tn, k, count(at_) n, min(at_) first_at, max(at_) last_at, max(del) deleted_at from st where k is not null group by 1, 2),
r as (
  select 'edges' table_name, 'src_id' field_name, src_id ref_key, created_at at_, 'nodes' tn from edges
  union all select 'edges', 'dst_id', dst_id, created_at, 'nodes' from edges
  union all select 'edges', 'evidence_chunk_id', evidence_chunk_id, created_at, 'nodes' from edges
  union all select 'crus', 'parent_requirement_id', parent_requirement_id, loaded_at, 'requirements' from crus),
m as (select table_name, field_name, ref_key, strftime(at_, '%Y-%m') ref_month, tn, count(*) n_refs, min(at_) first_ref
  from r where ref_key is not null and ref_key <> '' group by all),
o as (select m.*, case
    when s.deleted_at is not null and (coalesce(s.n, 0) = 0 or s.last_at <= s.deleted_at) then 'deleted'
    when coalesce(s.n, 0) = 0 then 'missing'
    when s.first_at > m.first_ref then 'late' end orphan_kind
  from m left join s on s.tn = m.tn and s.k = m.ref_key)
"""

ORACLE = {
    "p6_found": _P6 + "select table_name, field_name, ref_key, ref_month, orphan_kind from o where orphan_kind is not null",
    "p6_orphan_report": _P6
    + """select table_name, field_name, ref_month, orphan_kind, count(*) n_keys, cast(sum(n_refs) as bigint) n_refs
      from o where orphan_kind is not null group by all""",
    "p1_found": """
with c as (select distinct chunk_id, crus, traceability tr from chunks),
cr as (select chunk_id, unnest(crus) e, generate_subscripts(crus, 1) - 1 pos from c),
ac as (select chunk_id, pos cpos, unnest(e.acceptance_criteria) e, generate_subscripts(e.acceptance_criteria, 1) - 1 pos from cr where e is not null),
ev as (select chunk_id, cpos, pos apos, unnest(e.evidence) e, generate_subscripts(e.evidence, 1) - 1 pos from ac where e is not null),
rq as (select chunk_id, unnest(tr.source_requirements) e, generate_subscripts(tr.source_requirements, 1) - 1 pos from c),
se as (select chunk_id, unnest(tr.sections) e, generate_subscripts(tr.sections, 1) - 1 pos from c),
dc as (select chunk_id, unnest(tr.doc_ids) e, generate_subscripts(tr.doc_ids, 1) - 1 pos from c),
lo as (select chunk_id, unnest(tr.source_locators) e, generate_subscripts(tr.source_locators, 1) - 1 pos from c),
sk as (select doc_id, arg_max(struct_pack(s := document_skeleton), generated_at).s js from raw_skeletons group by 1),
jt as (select doc_id, je.key k, je.type t, je.value v, je.atom a, je.fullkey f from sk, json_tree(js) je where js is not null and js <> ''),
sp as (select doc_id, case when t = 'OBJECT' and f not like '%]' and k similar to '([0-9]+|[A-Z])(\\.[0-9]+)*' then k
         when k = 'section_path' then json_extract_string(a, '$') end p from jt)
select 'chunk_crus' child_table, chunk_id parent_key, cast(pos as int) pos, coalesce(e.cru_id, '') child_key from cr where e is not null
union all select 'cru_criteria', chunk_id || '/' || cpos, cast(pos as int), coalesce(e.criterion, '') from ac where e is not null
union all select 'criterion_evidence', chunk_id || '/' || cpos || '/' || apos, cast(pos as int), coalesce(cast(e.page as varchar), '') || ':' || coalesce(cast(e.para as varchar), '') from ev where e is not null
union all select 'chunk_requirements', chunk_id, cast(pos as int), e from rq where e is not null
union all select 'chunk_sections', chunk_id, cast(pos as int), e from se where e is not null
union all select 'chunk_docs', chunk_id, cast(pos as int), e from dc where e is not null
union all select 'chunk_locators', chunk_id, cast(pos as int), coalesce(cast(e.page as varchar), '') || ':' || coalesce(cast(e.para as varchar), '') from lo where e is not null
union all select distinct 'skeleton_sections', doc_id, len(string_split(p, '.')), p from sp where p is not null""",
}
_C = "with c as (select chunk_id, arg_max(struct_pack(u := crus), created_at).u crus from chunks group by 1), cr as (select chunk_id, unnest(crus) e, cast(generate_subscripts(crus, 1) - 1 as int) pos from c)"
ORACLE |= {
    "p1_chunk_crus": _C + " select chunk_id, pos, e.cru_id cru_id, e.actor actor, e.action_text action_text, e.constraint_text constraint_text, e.confidence confidence, e.title title from cr where e is not null",
    "p1_criteria": _C + """, a as (select chunk_id, pos p, unnest(e.acceptance_criteria) x, cast(generate_subscripts(e.acceptance_criteria, 1) - 1 as int) pos from cr where e is not null)
      select chunk_id rec_key, p::varchar parent_ords, pos, x.criterion criterion from a where x is not null""",
}
