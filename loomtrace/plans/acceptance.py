"""Queries over acceptance records and their coverage.

The test tables hold no acceptance runs, so requirements of one section of one document stand in for a record, and the confidence
of its weakest requirement for what the tester wrote. Records are also read from the test plans among the documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import acceptance as A
from loomtrace.operators import coverage as C
from loomtrace.operators import segment as S
from loomtrace.plans import units as PU
from loomtrace.session import materialize, table

SAID = {"low": "Failed - see remarks", "medium": "partial pass", "high": "Passed"}  # anything else: not tested
TEST_PLAN = r"^Test ([A-Z]+\d+-\d+)()$"
PLAN_LABELS = {**R.FIELD_LABELS, "expected": "expected_result"}


def _uat(spark, d):
    s = F.col("source_reference")
    word = F.lower(F.trim("confidence"))
    rank = X.first_match([(word == "low", 1), (word == "medium", 3), (word == "high", 4)], 2)
    r = table(spark, d, "requirements").where("req_id is not null and section_path is not null").where(s["doc_id"].isNotNull())
    g = r.groupBy(F.concat_ws("-", F.lit("UAT"), s["doc_id"], "section_path").alias("uat_id")).agg(F.array_sort(F.collect_set(F.upper(F.trim("req_id")))).alias("req_ids"), F.min(rank).alias("rank"))
    said = X.first_match([(F.col("rank") == 1, SAID["low"]), (F.col("rank") == 3, SAID["medium"]), (F.col("rank") == 4, SAID["high"])], "NOT TESTED - next release")
    return g.select("uat_id", "req_ids", X.status(said).alias("status"))


def _all_records(spark, d):
    """Records of runs and those that dependencies infer."""
    u = _uat(spark, d)
    return u.unionByName(A.inferred_records(g14_inferred_records(spark, d)).select(u.columns))


def x30_status(spark, d):
    return _uat(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def j1_records(spark, d):
    linked = A.link(_uat(spark, d), table(spark, d, "crus"), table(spark, d, "test_cases"))
    return linked.select("uat_id", "status", "cru_count", "test_count", F.array_join("unmatched", ",").alias("unmatched"))


def x34_classes(spark, d):
    c = A.classify(A.link(_uat(spark, d), table(spark, d, "crus"), table(spark, d, "test_cases")))
    return c.select("uat_id", "classification", "summary")


def j5_tested_ids(spark, d):
    return A.tested_ids(_uat(spark, d))


def g14_inferred_records(spark, d):
    """Requirements that passed (round 0) or all of whose dependencies did, transitively."""
    return C.inferred(C.dependencies(table(spark, d, "requirements")), A.tested_ids(_uat(spark, d)))


def a15_summary(spark, d):
    records = materialize(_all_records(spark, d), "records")
    return A.summary(A.classify(A.link(records, table(spark, d, "crus"), table(spark, d, "test_cases"))))


def a15_verdicts(spark, d):
    """Verdicts of the units of each status of a record."""
    ids = A._ids(_uat(spark, d)).join(_uat(spark, d).select("uat_id", "status"), "uat_id").select("req_id", "status").distinct()
    v = PU.x28_overlap(spark, d).join(A._units(table(spark, d, "crus")), "cru_id")
    return v.join(ids, "req_id").groupBy("status", "verdict").agg(F.count("*").alias("n"))


def j3_uncovered(spark, d):
    return A.uncovered_units(_uat(spark, d), table(spark, d, "crus"), g14_inferred_records(spark, d))


def j4_missing_ids(spark, d):
    return A.missing_ids(_uat(spark, d), table(spark, d, "crus"))


def x29_spec_evidence(spark, d):
    """The specification of each unit, and what its tests give as evidence."""
    spec = A.spec_text(["action_text", "description", "constraint_text", "acceptance_criteria"])
    t = PU._tests(spark, d).withColumn("none", F.lit(None).cast("string"))
    ev = t.select(F.col("requirement_id").alias("cru_id"), "test_id", A.evidence_text("none", "expected_result", "test_data", "description").alias("evidence"))
    return PU._crus(spark, d).select("cru_id", spec.alias("spec")).join(ev, "cru_id")


def x32_prefixes(spark, d):
    """Prefixes of requirement ids in all texts."""
    return A.id_prefixes(S.lines(table(spark, d, "documents")))


def n11_records(spark, d):
    """Records of the test plans among the documents."""
    r = A.records(S.lines(table(spark, d, "documents")), TEST_PLAN, PLAN_LABELS)
    return r.select("doc_id", "record_no", "uat_id", F.size("precondition").alias("n_preconditions"), F.size("test_steps").alias("n_steps"), F.md5(F.array_join("test_steps", "|")).alias("steps"), "expected_result")


def x56_labels(spark, d):
    """How often each label of a record occurs at the beginning of a line, and the field it fills."""
    pattern = rf"(?i)^\s*({'|'.join(PLAN_LABELS)})\s*(?::.*)?$"
    w = F.lower(F.regexp_extract("line", pattern, 1))
    fields = F.create_map(*[F.lit(x) for kv in PLAN_LABELS.items() for x in kv])
    return S.lines(table(spark, d, "documents")).select(w.alias("label")).where("label <> ''").groupBy("label", fields[F.col("label")].alias("field")).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and k[0].islower() and any(c.isdigit() for c in k[:4])}

UAT = """ua as (select 'UAT-' || source_reference.doc_id || '-' || section_path uat_id, list_sort(list_distinct(list(upper(trim(req_id))))) req_ids,
   case min(case lower(trim(confidence)) when 'low' then 1 when 'medium' then 3 when 'high' then 4 else 2 end) when 1 then 'FAIL' when 3 then 'PARTIAL' when 4 then 'PASS' else 'NOT_TESTED' end status
   from requirements where req_id is not null and section_path is not null and source_reference.doc_id is not null group by 1),
 ui as (select uat_id, unnest(req_ids) req_id, generate_subscripts(req_ids, 1) - 1 pos from ua),
 un as (select distinct upper(trim(parent_requirement_id)) req_id, cru_id from crus where cru_id is not null and trim(parent_requirement_id) <> '')"""
_LINK = """tn as (select requirement_id cru_id, count(distinct test_id) n from test_cases where test_id is not null group by 1),
 uc as (select req_id, count(*) n_crus, sum(coalesce(n, 0)) n_tests from un left join tn using (cru_id) group by 1),
 li as (select a.uat_id, a.status, cast(coalesce(sum(n_crus), 0) as bigint) cru_count, cast(coalesce(sum(n_tests), 0) as bigint) test_count, list_sort(list(i.req_id) filter (i.req_id is not null and uc.req_id is null)) um
   from {ua} a left join {ui} i on i.uat_id = a.uat_id left join uc on uc.req_id = i.req_id group by 1, 2),
 cl as (select *, case when cru_count = 0 then 'NO_CRU_MATCH' when test_count = 0 then 'NO_TEST_CASE' when status = 'FAIL' then 'FAILED_COVERAGE' when status = 'NOT_TESTED' then 'NOT_TESTED' when status = 'PARTIAL' then 'PARTIAL_COVERAGE'
   when status = 'INFERRED' then 'INFERRED_PARTIAL' else 'FULL_COVERAGE' end classification from li)"""
LINK = _LINK.format(ua="ua", ui="ui")
INFERRED = PU.inferred_sql("select distinct req_id from ui join ua using (uat_id) where status = 'PASS'")
_SOME = lambda c: f"nullif(trim({c}), '')"
_PLAN = "|".join(PLAN_LABELS)

ORACLE = {
    "g14_inferred_records": f"with recursive {UAT}, {INFERRED} select * from inf",
    "j3_uncovered": f"with recursive {UAT}, {INFERRED} select cru_id, req_id from un where req_id not in (select req_id from ui) and req_id not in (select req_id from inf)",
    "a15_summary": f"""with recursive {UAT}, {INFERRED}, ua2 as (select uat_id, status from ua union all select 'INFERRED-' || req_id, 'INFERRED' from inf where round > 0), ui2 as (select uat_id, req_id from ui union all select 'INFERRED-' || req_id, req_id from inf where round > 0),
      {_LINK.format(ua="ua2", ui="ui2")}, k(classification, covered) as (values {", ".join(f"('{c}', {str(c in R.COVERED_CLASSES).lower()})" for c in R.COVERAGE_CLASSES)})
      select k.classification, count(cl.uat_id) n, cast(coalesce(sum(cru_count), 0) as bigint) cru_count, cast(coalesce(sum(test_count), 0) as bigint) test_count, covered,
        (select round(100.0 * count(*) filter (classification in ('FULL_COVERAGE', 'INFERRED_PARTIAL')) / greatest(count(*), 1), 1) from cl) rate from k left join cl using (classification) group by 1, 5""",
    "x30_status": f"with {UAT} select status, count(*) n from ua group by 1",
    "j1_records": f"with {UAT}, {LINK} select uat_id, status, cru_count, test_count, coalesce(array_to_string(um, ','), '') unmatched from li",
    "x34_classes": f"""with {UAT}, {LINK} select uat_id, classification, concat_ws(' ', 'UAT ' || status || '.', case when cru_count > 0 then cru_count || ' CRU(s) and ' || test_count || ' test case(s) linked.' else 'No CRUs matched.' end,
      case when len(um) > 0 then 'Unmatched req_ids: ' || array_to_string(um, ', ') || '.' end) summary from cl""",
    "j5_tested_ids": f"with {UAT} select distinct req_id from ui join ua using (uat_id) where status = 'PASS'",
    "j4_missing_ids": f"with {UAT} select req_id, arg_min(uat_id, (uat_id, pos)) first_uat, count(distinct uat_id) n from ui where req_id not in (select req_id from un) group by 1",
    "a15_verdicts": f"with {UAT}, {PU.OVER}, si as (select distinct req_id, status from ui join ua using (uat_id)) select status, verdict, count(*) n from ov join un using (cru_id) join si using (req_id) group by 1, 2",
    "x29_spec_evidence": f"""with {PU.CR}, {PU.TC} select cr.cru_id, coalesce({_SOME('action_text')}, {_SOME('cr.description')}, {_SOME('constraint_text')}, {_SOME('acceptance_criteria')}, '') spec, test_id, concat_ws(' ', {_SOME('expected_result')}, {_SOME('test_data')}, {_SOME('tc.description')}) evidence
      from cr join tc on tc.requirement_id = cr.cru_id""",
    "x56_labels": "with ln as (select unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) line from documents where text is not null), m(label, field) as (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in PLAN_LABELS.items())
    + f"), w as (select lower(regexp_extract(line, '(?i)^\\s*({_PLAN})\\s*(?::.*)?$', 1)) label from ln) select label, field, count(*) n from w join m using (label) group by 1, 2",
    "x32_prefixes": "with ln as (select unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) line from documents where text is not null), "
    + f"x as (select unnest(regexp_extract_all(line, '{R.REQ_ID}')) id, regexp_extract_all(regexp_extract(line, '(?i)(?:{'|'.join(k for k, v in R.FIELD_LABELS.items() if v == 'req_ids')})\\s*:?\\s*(.+)', 1), '{R.REQ_ID}') ids from ln), "
    + "g as (select regexp_extract(id, '^[A-Z]+') prefix, count(*) n, count(*) filter (list_contains(ids, id)) nn from x group by 1), r as (select *, row_number() over (order by n desc, prefix) r, max(n) over () top, max(nn) over () > 0 named from g) "
    + "select prefix, case when named then nn else n end n from r where (named and nn > 0) or (not named and n >= 0.1 * top and r <= 10)",
}
