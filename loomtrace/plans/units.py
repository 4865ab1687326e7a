"""Queries over requirement units, coverage and test quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import coverage as C
from loomtrace.operators import graph as G
from loomtrace.operators import nested
from loomtrace.operators import quality as Q
from loomtrace.operators import units as U
from loomtrace.session import table


def _crus(spark, d):
    """The first version of each unit."""
    o = [F.col("loaded_at"), F.coalesce("parent_requirement_id", F.lit("")), F.coalesce("actor", F.lit("")), F.coalesce("confidence", F.lit(""))]
    return G.insert_first(table(spark, d, "crus").where("cru_id is not null"), ["cru_id"], o)


def _tests(spark, d):
    o = [F.col("loaded_at"), F.col("created_at"), F.coalesce("expected_result", F.lit("")), F.coalesce("priority", F.lit(""))]
    return G.upsert_last(table(spark, d, "test_cases").where("test_id is not null"), ["test_id"], o)


def x21_explode_actions(spark, d):
    r = table(spark, d, "requirements")
    one = G.upsert_last(r.where("req_id is not null"), ["req_id"], [F.col("loaded_at"), F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))])
    return U.explode_actions(one)


def i9_validate(spark, d):
    return U.validate(table(spark, d, "crus").where("cru_id is not null"), table(spark, d, "requirements"), nested.skeleton_sections(table(spark, d, "raw_skeletons"))).distinct()


def a13_duplicate_ids(spark, d):
    return table(spark, d, "crus").groupBy("cru_id").agg(F.count("*").alias("n")).where("n > 1")


def a14_validity(spark, d):
    c = table(spark, d, "crus")
    return c.agg(F.count("*").alias("total"), F.count_if("invalid").alias("invalid"), F.count_if(~F.coalesce("invalid", F.lit(False))).alias("clean"))


def a7_units_per_requirement(spark, d):
    p = F.coalesce(F.nullif("parent_requirement_id", F.lit("")), F.lit("UNKNOWN"))
    return table(spark, d, "crus").groupBy(p.alias("parent")).agg(F.count("*").alias("n"), F.countDistinct("cru_id").alias("n_ids"))


def n7_chunk(spark, d):
    return U.chunk(_crus(spark, d)).select("chunk_no", "parent", "slice", "pos", "cru_id")


def a8_chunk_types(spark, d):
    return U.chunk_types(U.chunk(_crus(spark, d)))


def a11_chunk_report(spark, d):
    return U.chunk_report(U.chunk(_crus(spark, d)))


def _tags(spark, d):
    ch = U.chunk(_crus(spark, d)).select("chunk_no", "cru_id", "pos")
    u = ch.join(_crus(spark, d).select("cru_id", "action_text", "title", "cru_type"), "cru_id")
    return U.capability_tags(u, "chunk_no", F.concat_ws(" ", "action_text", "title", "cru_type"), "cru_type")


def a9_tags(spark, d):
    return _tags(spark, d).withColumnRenamed("key", "chunk_no")


def a12_tag_distribution(spark, d):
    return _tags(spark, d).groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("n_first"))


def a12_declared_tags(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.explode("capability_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


def a10_traceability(spark, d):
    return U.traceability_sets(table(spark, d, "chunks"))


def m6_confidence(spark, d):
    return table(spark, d, "crus").groupBy(F.coalesce("confidence", F.lit("-")).alias("word"), X.confidence_value("confidence").alias("value")).agg(F.count("*").alias("n"))


def x23_clause(spark, d):
    return _crus(spark, d).select("cru_id", X.clause("actor", "action_text", "constraint_text").alias("clause"))


def j1_link(spark, d):
    return C.link(table(spark, d, "requirements"), table(spark, d, "crus"), table(spark, d, "test_cases"))


def x34_classify(spark, d):
    return C.classify(j1_link(spark, d)).groupBy("classification").agg(F.count("*").alias("n"), F.sum("n_tests").alias("tests"))


def a15_coverage_summary(spark, d):
    return C.coverage_summary(C.classify(j1_link(spark, d)))


def j3_uncovered_units(spark, d):
    return C.uncovered_units(table(spark, d, "crus"), table(spark, d, "test_cases"))


def j4_missing_parents(spark, d):
    return C.missing_parents(table(spark, d, "crus"), table(spark, d, "requirements"))


def j5_covered_requirements(spark, d):
    """Requirements with at least one test of high priority: a semi-join."""
    t = table(spark, d, "test_cases").where("lower(trim(priority)) = 'high'").select(F.col("requirement_id").alias("cru_id"))
    c = table(spark, d, "crus").join(t, "cru_id", "left_semi").select(F.col("parent_requirement_id").alias("req_id"))
    return table(spark, d, "requirements").select("req_id").distinct().join(c, "req_id", "left_semi")


def a16_dependencies(spark, d):
    return C.dependencies(table(spark, d, "requirements"))


def g14_inferred(spark, d):
    r = table(spark, d, "requirements")
    ok = j5_covered_requirements(spark, d).select(F.upper(F.trim("req_id")).alias("req_id"))
    return C.inferred(C.dependencies(r), ok)


def x28_overlap(spark, d):
    """Each unit's action against the steps and expected results of its tests."""
    t = _tests(spark, d).select(F.col("requirement_id").alias("cru_id"), "test_id", F.concat_ws(" ", F.array_join("test_steps", " "), "expected_result").alias("text"))
    spec = _crus(spark, d).select("cru_id", F.coalesce("action_text", "description").alias("text"))
    return C.overlap(t, spec, t, "cru_id", "test_id")


def x25_stem(spark, d):
    w = table(spark, d, "documents").select(F.explode(X.words("text")).alias("w"))
    return C.stem_table(w, "w")


def f11_reject_reason(spark, d):
    t = Q.reject_reason(_tests(spark, d))
    return t.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason"), "test_type").agg(F.count("*").alias("n"))


def _scored(spark, d):
    return Q.confidence(Q.contribution(Q.consistency(_tests(spark, d))))


def x48_consistency(spark, d):
    return Q.consistency(_tests(spark, d)).select("test_id", "consistency")


def x49_contribution(spark, d):
    return Q.contribution(_tests(spark, d)).select("test_id", "contribution")


def x50_confidence(spark, d):
    return _scored(spark, d).select("test_id", "confidence", "level")


def a33_confidence_levels(spark, d):
    return _scored(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def j22_uniqueness(spark, d):
    return Q.uniqueness(_tests(spark, d))


def w11_least_unique(spark, d):
    return Q.uniqueness(_tests(spark, d)).where("uniqueness < 0.7").orderBy("uniqueness", "test_id")


def a21_test_totals(spark, d):
    t = table(spark, d, "test_cases")
    return t.groupBy("generation_phase", "test_type", "priority").agg(
        F.count("*").alias("n"), F.countDistinct("test_id").alias("n_ids"), F.countDistinct("requirement_id").alias("n_units"), F.count_if(F.size("preconditions") > 0).alias("with_preconditions"),
    )


def a21_overlap(spark, d):
    """Units tested in each phase, and the share of those of any phase that this one covers, in per cent."""
    t = table(spark, d, "test_cases").where("requirement_id is not null and generation_phase is not null").select("generation_phase", "requirement_id").distinct()
    per = t.groupBy("generation_phase").agg(F.count("*").alias("n_units"))
    whole = t.agg(F.countDistinct("requirement_id").alias("whole"))
    shared = t.groupBy("requirement_id").agg(F.count("*").alias("phases")).agg(F.count_if(F.col("phases") > 1).alias("shared"))
    return per.join(whole).join(shared).select("generation_phase", "n_units", F.round(100.0 * F.col("n_units") / F.col("whole"), 1).alias("share"), F.round(100.0 * F.col("shared") / F.col("whole"), 1).alias("overlap"))


TYPES = ["positive", "negative", "edge", "security", "performance", "usability"]


def w8_count_by_type(spark, d):
    """Counts for a fixed list of types: types that do not occur keep their zero."""
    fixed = spark.createDataFrame([(t,) for t in TYPES], "test_type string")
    n = table(spark, d, "test_cases").groupBy("test_type").agg(F.count("*").alias("n"))
    return fixed.join(n, "test_type", "left").select("test_type", F.coalesce("n", F.lit(0)).alias("n"))


def n13_first_units(spark, d):
    """Each unit once, with the first chunk that holds it."""
    c = table(spark, d, "chunks").select("chunk_id", "created_at", F.posexplode("crus").alias("pos", "c")).where("c.cru_id is not null")
    return c.select(F.col("c.cru_id").alias("cru_id"), "chunk_id", "pos").groupBy("cru_id").agg(F.min(F.struct("chunk_id", "pos")).alias("m")).select("cru_id", "m.chunk_id", "m.pos")


def n12_priority_units(spark, d):
    """Critical units: those whose text is specific, then those with dependencies, then the first ones; the best 20, each once."""
    specific = X.clause("actor", "action_text", "constraint_text").rlike(R.SPECIFIC)
    c = _crus(spark, d).select("cru_id", X.first_match([(specific, 1), (F.size(F.coalesce("dependencies", F.array().cast("array<string>"))) > 0, 2)], 3).alias("priority"))
    return c.orderBy("priority", "cru_id").limit(20)


def a29_scenario_scores(spark, d):
    return Q.scenario_scores(x28_overlap(spark, d).select(F.col("cru_id").alias("scenario"), F.col("verdict").alias("classification")))


def j23_requirement_usage(spark, d):
    c = x28_overlap(spark, d).join(_crus(spark, d).select("cru_id", F.col("parent_requirement_id").alias("req_id")), "cru_id")
    return Q.requirement_usage(table(spark, d, "requirements").where("req_id is not null"), c.select("req_id", F.col("verdict").alias("classification")))


def a31_usage_totals(spark, d):
    u = j23_requirement_usage(spark, d)
    return u.groupBy("status").agg(F.count("*").alias("n"), F.sum("usage").alias("usage"))


def a25_weighted_confidence(spark, d):
    rows = _crus(spark, d).where("parent_requirement_id <> ''").select("parent_requirement_id", X.confidence_value("confidence").alias("score"), (F.col("extraction_method") == "deterministic").alias("strict"))
    return Q.weighted_confidence(rows, "parent_requirement_id", "score", "strict")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and k[0].islower() and any(c.isdigit() for c in k[:4])}

CR = """cr as (select * exclude r from (select *, row_number() over (partition by cru_id order by loaded_at, coalesce(parent_requirement_id, ''), coalesce(actor, ''), coalesce(confidence, '')) r from crus where cru_id is not null) where r = 1)"""
TC = """tc as (select * exclude r from (select *, row_number() over (partition by test_id order by loaded_at desc, created_at desc, coalesce(expected_result, '') desc, coalesce(priority, '') desc) r from test_cases where test_id is not null) where r = 1)"""
CLAUSE = "case when coalesce(constraint_text, '') <> '' and not contains(trim(concat_ws(' ', actor, action_text)), coalesce(constraint_text, '')) then concat_ws(' ', trim(concat_ws(' ', actor, action_text)), constraint_text) else trim(concat_ws(' ', actor, action_text)) end"
CONF = "case when confidence is null or trim(confidence) = '' then 0.95 else case lower(trim(confidence)) when 'high' then 0.95 when 'medium' then 0.75 when 'low' then 0.5 else 0.75 end end"
CHUNKED = f"""{CR}, pl as (select coalesce(nullif(parent_requirement_id, ''), 'UNKNOWN') parent, cru_id, cru_type, traceability.section_path sec, action_text, title from cr),
 rn as (select *, row_number() over (partition by parent order by coalesce(sec, ''), cru_id) - 1 k from pl),
 gr as (select parent, max(k // 4) + 1 s from rn group by 1), bf as (select parent, coalesce(sum(s) over (order by parent rows between unbounded preceding and 1 preceding), 0) b from gr),
 ch as (select cast(b + k // 4 + 1 as bigint) chunk_no, rn.parent, cast(k // 4 as int) slice, cast(k % 4 as int) pos, cru_id, cru_type, action_text, title from rn join bf using (parent))"""
_HIT = " union all ".join(
    f"select chunk_no, '{t}' tag, {i} at_, pos from ch where " + " or ".join(f"contains(lower(concat_ws(' ', action_text, title, cru_type)), '{w}')" for w in ws) for i, (t, ws) in enumerate(R.CAPABILITIES.items())
)
_BONUS = " union all ".join(f"select distinct chunk_no, '{b}' tag, 2::bigint score, {1_000_000_000 + i} first from ch where cru_type = '{a}'" for i, (a, b) in enumerate(U.BONUS.items()))
TAGS = f"""{CHUNKED}, hit as ({_HIT}), sc0 as (select chunk_no, tag, count(*) score, min(pos * 100 + at_) first from hit group by 1, 2 union all {_BONUS}),
 sc as (select chunk_no, tag, sum(score) score, min(first) first from sc0 group by 1, 2),
 tg as (select chunk_no, tag, cast(score as bigint) score, cast(r as int) rank from (select *, row_number() over (partition by chunk_no order by score desc, first) r from sc) where r <= 3
   union all select distinct chunk_no, 'Generic', 0::bigint, 1 from ch where chunk_no not in (select chunk_no from sc))"""
LINK = """rq as (select distinct upper(trim(req_id)) req_id from requirements where req_id is not null),
 cc as (select distinct upper(trim(parent_requirement_id)) req_id, cru_id from crus where cru_id is not null), tt as (select requirement_id cru_id, count(distinct test_id) n from test_cases where test_id is not null group by 1),
 lk as (select rq.req_id, count(cc.cru_id) n_crus, cast(coalesce(sum(tt.n), 0) as bigint) n_tests from rq left join cc on cc.req_id = rq.req_id left join tt on tt.cru_id = cc.cru_id group by 1),
 cl as (select *, case when n_crus = 0 then 'NO_CRU_MATCH' when n_tests = 0 then 'NO_TEST_CASE' else 'FULL_COVERAGE' end classification from lk)"""
_BAD = lambda c: "(" + " or ".join(f"contains({c}, '{p}')" for p in R.FORBIDDEN) + ")"
STEPS = "lower(array_to_string(list_filter(coalesce(test_steps, []), lambda x: x is not null), ' '))"
EXP = "lower(coalesce(expected_result, ''))"
SCORED = f"""{TC}, oth as (select requirement_id, test_type, count(distinct test_id) n from tc group by 1, 2),
 sc as (select tc.test_id, tc.test_type, round(greatest(0, least(1, 1.0 - ((case when {_BAD(STEPS)} or {_BAD(EXP)} then 0.3 else 0 end)::double + (case when test_steps is null or len(test_steps) < 4 then 0.2 else 0 end)::double
   + (case when length({EXP}) < 30 then 0.2 else 0 end)::double + (case when trim(coalesce(test_data, '')) in ('', '{{}}') then 0.1 else 0 end)::double + (case when tc.test_type = 'negative' and not contains({STEPS}, 'invalid') then 0.1 else 0 end)::double))), 6) consistency,
   round(least(1, 0.5::double + case when coalesce(tc.test_type in ('positive', 'negative', 'edge'), false) then 0.2::double + case when oth.n <= 1 then 0.2::double else 0 end else case when oth.n <= 1 then 0.15::double else 0 end end), 6) contribution,
   case when {_BAD(STEPS)} or {_BAD(EXP)} then 0.0 else 1.0 end::double clean
   from tc left join oth on tc.requirement_id is not distinct from oth.requirement_id and tc.test_type is not distinct from oth.test_type),
 cf as (select *, round(0.4::double * consistency + 0.2::double + 0.3::double * contribution + 0.1::double * clean, 6) confidence from sc),
 lv as (select *, case when confidence >= 0.8 then 'HIGH' when confidence >= 0.6 then 'MEDIUM' when confidence >= 0.4 then 'LOW' else 'REVIEW_REQUIRED' end level from cf)"""


def _stem_sql(w: str) -> str:
    """A CASE over the suffix rules, in DuckDB's own string functions."""
    whens = " ".join(
        f"when suffix({w}, '{s}') and length({w}) - {len(s)} + {len(r)} >= {n} then left({w}, length({w}) - {len(s)}) || '{r}'" for s, r, n in R.SUFFIXES
    )
    return f"case {whens} else {w} end"


def _words_sql(text: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + "]"
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+')), lambda x: length(x) > 1 and not list_contains({stop}, x))"


NEG = "|".join(f"({p})" for p in R.NEGATIONS)
OVER = f"""{CR}, {TC}, pr as (select cr.cru_id, tc.test_id, coalesce(action_text, cr.description) spec, concat_ws(' ', array_to_string(list_filter(test_steps, lambda x: x is not null), ' '), expected_result) ev from cr join tc on tc.requirement_id = cr.cru_id),
 st as (select cru_id, test_id, list_distinct(list_transform({_words_sql('spec')}, lambda w: {_stem_sql('w')})) ss, list_distinct(list_transform({_words_sql('ev')}, lambda w: {_stem_sql('w')})) es, regexp_matches(lower(coalesce(ev, '')), '{NEG}') neg from pr),
 pf as (select *, list_distinct(list_transform(ss, lambda w: left(w, 4))) sp, list_distinct(list_transform(es, lambda w: left(w, 4))) ep from st),
 rt as (select *, len(list_intersect(ss, es))::double / greatest(len(ss), 1) o, len(list_intersect(sp, ep))::double / greatest(len(sp), 1) p from pf),
 ov as (select cru_id, test_id, cast(len(ss) as int) spec_words, round(o, 6) overlap_ratio, round(p, 6) prefix_ratio, round((1 - 0.3::double) * o + 0.3::double * p, 6) blended,
   case when len(ss) = 0 or len(es) = 0 then 'MISSING' when neg and (1 - 0.3::double) * o + 0.3::double * p >= 0.1 then 'CONFLICT' when (1 - 0.3::double) * o + 0.3::double * p >= 0.3 then 'MATCH' when (1 - 0.3::double) * o + 0.3::double * p >= 0.1 then 'PARTIAL' else 'MISSING' end verdict from rt)"""
DEPS = "dp as (select distinct * from (select upper(trim(req_id)) req_id, upper(trim(unnest(dependencies))) dep from requirements where req_id is not null) where dep is not null and dep not in ('', 'NONE', 'N/A', 'NA') and dep <> req_id)"
J5 = "select distinct req_id from requirements where req_id in (select parent_requirement_id from crus where cru_id in (select requirement_id from test_cases where lower(trim(priority)) = 'high'))"


def inferred_sql(ok: str) -> str:
    """The fixpoint as expressions of a recursive WITH: whatever cannot reach, over requirements that are not satisfied themselves, one
    without dependencies or a cycle, is inferred; its round is the length of the longest chain from a satisfied one."""
    return f"""{DEPS}, ok as ({ok}), nd as (select * from dp where req_id not in (select req_id from ok) and dep not in (select req_id from ok)),
 rc as (select req_id x, dep y from nd union select rc.x, nd.dep from rc join nd on nd.req_id = rc.y),
 bad as (select dep y from nd where dep not in (select req_id from dp) union select x from rc where x = y),
 uns as (select req_id from dp where req_id in (select y from bad) union select x from rc where y in (select y from bad)),
 sat as (select distinct req_id from dp where req_id not in (select req_id from ok) and req_id not in (select req_id from uns)),
 rd as (select req_id, 0 round from ok union select dp.req_id, rd.round + 1 from rd join dp on dp.dep = rd.req_id where dp.req_id in (select req_id from sat)),
 inf as (select req_id, max(round) round from rd group by 1)"""


STATE = " or ".join(f"""regexp_matches(lower(trim(a)), '{p.replace("'", "''")}')""" for p in R.PRECONDITIONS)
USE = f"""{OVER}, us as (select cr.parent_requirement_id req_id, count(*) usage, count(*) filter (verdict = 'MATCH') m, count(*) filter (verdict = 'PARTIAL') p from ov join cr using (cru_id) group by 1),
 ru as (select r.req_id, coalesce(usage, 0) usage, coalesce(m, 0) matches, coalesce(p, 0) partials, case when m > 0 then 'VALIDATED' when p > 0 then 'WEAKLY_VALIDATED' else 'UNUSED_REQUIREMENT' end status
   from (select distinct req_id from requirements where req_id is not null) r left join us using (req_id))"""

ORACLE = {
    "x21_explode_actions": f"""with r as (select * from (select *, row_number() over (partition by req_id order by loaded_at desc, coalesce(title, '') desc, coalesce(description, '') desc) q from requirements where req_id is not null) where q = 1),
      a as (select req_id, input_format, unnest(actions) a, generate_subscripts(actions, 1) - 1 p from r), k as (select distinct req_id, p, a from a where a is not null and not (coalesce(input_format = 'gherkin', false) and ({STATE}))),
      u as (select * from k union all select req_id, 0, null from r where req_id not in (select req_id from k)), n as (select *, row_number() over (partition by req_id order by p, coalesce(a, '')) n from u)
      select req_id, 'CRU-' || req_id || '-' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') cru_id, cast(n - 1 as int) pos, a action from n""",
    "i9_validate": f"""with c as (select *, count(*) over (partition by cru_id) copies, traceability.section_path path from crus where cru_id is not null),
      sk as (select doc_id, arg_max(struct_pack(s := document_skeleton), generated_at).s js from raw_skeletons group by 1),
      jt as (select je.key k, je.type t, je.atom a, je.fullkey f from sk, json_tree(js) je where js is not null and js <> ''),
      sp as (select distinct case when t = 'OBJECT' and f not like '%]' and k similar to '([0-9]+|[A-Z])(\\.[0-9]+)*' then k when k = 'section_path' then json_extract_string(a, '$') end p from jt), o as (select * from c where copies = 1)
      select distinct cru_id, 'ERR-DUPLICATE-CRU-ID' code from c where copies > 1
      union all select cru_id, 'ERR-UNKNOWN-PARENT-REQ-ID' from o where not exists (select 1 from requirements r where r.req_id = o.parent_requirement_id)
      union all select cru_id, 'ERR-MISSING-ACTOR' from o where trim(coalesce(actor, '')) = ''
      union all select cru_id, 'ERR-UNEXPECTED-NULL-ACTION' from o where action_text is null
      union all select cru_id, 'ERR-INVALID-CONFIDENCE' from o where confidence is null or confidence not in ('high', 'medium', 'low')
      union all select cru_id, case when coalesce(path, '') = '' then 'ERR-MISSING-TRACEABILITY' when not regexp_matches(path, '^\\d+(\\.\\d+)*$') then 'ERR-MALFORMED-SECTION-PATH' else 'ERR-SECTION-PATH-NOT-IN-SKELETON' end from o
        where coalesce(path, '') = '' or not regexp_matches(path, '^\\d+(\\.\\d+)*$') or path not in (select p from sp where p is not null)
      union all select cru_id, 'ERR-INVALID-CRU-TYPE' from o where cru_type is null or cru_type not in ({', '.join(repr(t) for t in U.VALID_TYPES)})""",
    "a13_duplicate_ids": "select cru_id, count(*) n from crus group by 1 having count(*) > 1",
    "a14_validity": "select count(*) total, count(*) filter (invalid) invalid, count(*) filter (not coalesce(invalid, false)) clean from crus",
    "a7_units_per_requirement": "select coalesce(nullif(parent_requirement_id, ''), 'UNKNOWN') parent, count(*) n, count(distinct cru_id) n_ids from crus group by 1",
    "n7_chunk": f"with {CHUNKED} select chunk_no, parent, slice, pos, cru_id from ch",
    "a8_chunk_types": f"with {CHUNKED} select chunk_no, case when min(cru_type) = max(cru_type) then min(cru_type) else 'mixed' end chunk_type, count(*) n from ch group by 1",
    "a11_chunk_report": f"with {CHUNKED}, g as (select chunk_no, count(*) n from ch group by 1) select count(*) chunks, cast(sum(n) as bigint) units, min(n) smallest, max(n) largest, round(avg(n), 2) mean, bool_and(n <= 4) within_limit, (select count(distinct cru_id) from ch) unique_units, sum(n) > (select count(distinct cru_id) from ch) duplicates from g",
    "a9_tags": f"with {TAGS} select * from tg",
    "a12_tag_distribution": f"with {TAGS} select tag, count(*) n, count(*) filter (rank = 1) n_first from tg group by 1",
    "a12_declared_tags": "select tag, count(*) n, count(distinct chunk_id) n_chunks from (select chunk_id, unnest(capability_tags) tag from chunks) group by 1",
    "a10_traceability": "select distinct chunk_id, " + ", ".join(
        f"array_to_string(list_sort(list_distinct(list_filter(traceability.{f}, lambda x: x is not null))), ',') {n}" for f, n in (("source_requirements", "requirements"), ("sections", "sections"), ("doc_ids", "docs"))
    ) + " from chunks",
    "m6_confidence": f"select coalesce(confidence, '-') word, ({CONF})::double as value, count(*) n from crus group by 1, 2",
    "x23_clause": f"with {CR} select cru_id, {CLAUSE} clause from cr",
    "j1_link": f"with {LINK} select * from lk",
    "x34_classify": f"with {LINK} select classification, count(*) n, cast(sum(n_tests) as bigint) tests from cl group by 1",
    "a15_coverage_summary": f"with {LINK} select count(*) total, count(*) filter (classification = 'FULL_COVERAGE') covered, cast(sum(n_crus) as bigint) crus, cast(sum(n_tests) as bigint) tests, round(100.0 * count(*) filter (classification = 'FULL_COVERAGE') / greatest(count(*), 1), 1) rate from cl",
    "j3_uncovered_units": "select distinct cru_id from crus where cru_id is not null and cru_id not in (select requirement_id from test_cases where requirement_id is not null)",
    "j4_missing_parents": "select parent_requirement_id req_id, arg_min(cru_id, (loaded_at, cru_id)) first_cru, count(*) n from crus where parent_requirement_id <> '' and parent_requirement_id not in (select req_id from requirements where req_id is not null) group by 1",
    "j5_covered_requirements": J5,
    "a16_dependencies": f"with {DEPS} select * from dp",
    "x25_stem": f"select distinct w word, {_stem_sql('w')} stem from (select unnest({_words_sql('text')}) w from documents)",
    "x28_overlap": f"with {OVER} select * from ov",
    "f11_reject_reason": f"""with {TC} select case when trim(coalesce(test_title, '')) = '' then 'no_title' when test_steps is null or len(test_steps) < 1 then 'no_steps' when {_BAD(STEPS)} then 'forbidden_phrase' when {_BAD(EXP)} then 'generic_expected'
      when len(test_steps) < 3 then 'few_steps' when length(coalesce(expected_result, '')) < 30 then 'short_expected' else 'ok' end reason, test_type, count(*) n from tc group by 1, 2""",
    "x48_consistency": f"with {SCORED} select test_id, consistency from lv",
    "x49_contribution": f"with {SCORED} select test_id, contribution from lv",
    "x50_confidence": f"with {SCORED} select test_id, confidence, level from lv",
    "a33_confidence_levels": f"with {SCORED} select level, count(*) n, round(avg(confidence), 6) mean from lv group by 1",
    "a21_test_totals": "select generation_phase, test_type, priority, count(*) n, count(distinct test_id) n_ids, count(distinct requirement_id) n_units, count(*) filter (len(preconditions) > 0) with_preconditions from test_cases group by 1, 2, 3",
    "a21_overlap": """with t as (select distinct generation_phase, requirement_id from test_cases where requirement_id is not null and generation_phase is not null), s as (select requirement_id, count(*) c from t group by 1)
      select generation_phase, count(*) n_units, round(100.0 * count(*) / (select count(*) from s), 1) as share, round(100.0 * (select count(*) from s where c > 1) / (select count(*) from s), 1) overlap from t group by 1""",
    "w8_count_by_type": "select t test_type, (select count(*) from test_cases where test_type = t) n from (select unnest(['positive', 'negative', 'edge', 'security', 'performance', 'usability']) t)",
    "n13_first_units": "select cru_id, m.c chunk_id, cast(m.p as int) pos from (select c.cru_id cru_id, min(struct_pack(c := chunk_id, p := pos)) m from (select chunk_id, unnest(crus) c, generate_subscripts(crus, 1) - 1 pos from chunks) where c.cru_id is not null group by 1)",
    "n12_priority_units": f"with {CR} select cru_id, case when regexp_matches({CLAUSE}, '{R.SPECIFIC}') then 1 when len(dependencies) > 0 then 2 else 3 end priority from cr order by 2, 1 limit 20",
    "a29_scenario_scores": f"""with {OVER}, s as (select cru_id scenario, count(*) n, round(greatest(0, least(1, sum(case verdict when 'MATCH' then 1.0::double when 'PARTIAL' then 0.5::double when 'CONFLICT' then -1.0::double else 0.0::double end) / count(*))), 6) score from ov group by 1)
      select *, case when score >= 0.75 then 'LOW_RISK' when score >= 0.5 then 'MEDIUM_RISK' else 'HIGH_RISK' end risk from s""",
    "j23_requirement_usage": f"with {USE} select * from ru",
    "a31_usage_totals": f"with {USE} select status, count(*) n, cast(sum(usage) as bigint) usage from ru group by 1",
    "a25_weighted_confidence": f"""with {CR}, r as (select parent_requirement_id, ({CONF})::double s, case when extraction_method = 'deterministic' then 1.0::double else 0.5::double end w from cr where parent_requirement_id <> ''),
      g as (select parent_requirement_id, round(greatest(0.01, least(0.99, sum(s * w) / sum(w))), 4) confidence from r group by 1) select *, case when confidence >= 0.75 then 'HIGH' when confidence >= 0.45 then 'MEDIUM' else 'LOW' end grade from g""",
    "g14_inferred": f"with recursive {inferred_sql(f'select distinct upper(trim(req_id)) req_id from ({J5})')} select * from inf",
}
