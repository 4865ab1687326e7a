"""Further queries: projections, reports, ordered rules and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import segment as S
from loomtrace.plans import graph as PG
from loomtrace.plans import text as PT
from loomtrace.plans import units as PU
from loomtrace.session import table


PAYLOAD = ["cru_id", "actor", "action_text", "constraint_text", "confidence", "title", "acceptance_criteria"]


def proj1_payload(spark, d):
    """The seven fields of a unit that chunks carry, as one JSON text."""
    c = PU._crus(spark, d)
    return c.select("cru_id", F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"}).alias("payload"))


def proj2_traceability(spark, d):
    """The traceability of a requirement's units: its section under two names, and its source."""
    s = F.col("source_reference")
    return table(spark, d, "requirements").select(
        "req_id", F.col("section_path").alias("section"), "section_path", s["page"].alias("page"), s["para"].alias("para"), s["doc_id"].alias("doc_id"), s["module"].alias("module"), s["version"].alias("version")
    ).distinct()


def proj3_source_reference(spark, d):
    s = F.col("source_reference")
    return table(spark, d, "requirements").select("req_id", *[s[f].alias(f) for f in ("doc_id", "module", "version", "page", "para")]).distinct()


def proj6_normalised(spark, d):
    """Requirements with their fields renamed, the source rebuilt as one reference and hints of what is missing or may be split."""
    s = F.col("source_reference")
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in ("title", "actor", "description", "acceptance_criteria")]))
    return table(spark, d, "requirements").select(
        F.col("req_id").alias("requirement_id"), F.col("description").alias("statement"), F.concat(F.coalesce(s["doc_id"], F.lit("")), F.lit("#p"), F.coalesce(s["page"].cast("string"), F.lit("?")), F.lit("."), F.coalesce(s["para"].cast("string"), F.lit("?"))).alias("source_ref"),
        X.may_split("description").alias("split_hint"), F.array_join(missing, ",").alias("missing"),
    ).distinct()


def proj7_candidates(spark, d):
    """Tests with the text of the unit they name: candidates for a comparison."""
    text = F.concat_ws(" ", "title", X.clause("actor", "action_text", "constraint_text"))
    return PU._tests(spark, d).select("test_id", F.col("requirement_id").alias("cru_id")).join(PU._crus(spark, d).select("cru_id", text.alias("cru_text")), "cru_id", "left").select("test_id", "cru_id", F.coalesce("cru_text", F.lit("")).alias("cru_text"))


def proj5_test_nodes(spark, d):
    t = PU._tests(spark, d)
    return t.select(F.col("test_id").alias("node_id"), F.lit("TEST").alias("node_type"), F.col("test_title").alias("title"), F.concat_ws(" ", F.array_join("test_steps", " "), "expected_result").alias("text"),
                    F.col("traceability.doc_id").alias("doc_id"), F.coalesce(F.col("traceability.section_path"), F.col("srs_section")).alias("section_path"))


def g12_impact_report(spark, d):
    """Per requirement unit: tests that would have to run again and chunks that support it."""
    e = PG._e(spark, d)
    t = e.where("rel_type = 'TESTS'").groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("n_tests"))
    s = e.where("rel_type = 'SUPPORTED_BY'").groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("n_chunks"), F.round(F.avg("confidence"), 6).alias("support"))
    return t.join(s, "node_id", "full_outer").select("node_id", F.coalesce("n_tests", F.lit(0)).alias("n_tests"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "support")


def g12_debug_report(spark, d):
    """Tests without evidence, by relation that is missing."""
    n, e = PG._n(spark, d).where("node_type = 'TEST'").select("node_id"), PG._e(spark, d)
    miss = lambda r: n.join(e.where(F.col("rel_type") == r).select(F.col("src_id").alias("node_id")), "node_id", "left_anti").select("node_id", F.lit(r).alias("missing"))
    return miss("TESTS").unionByName(miss("EVIDENCE_FOR"))


def a5_distinct_under_parent(spark, d):
    """Requirements per section and, rolled up by its ancestors, below each; a warning where rows and ids differ by more than one."""
    r = table(spark, d, "requirements").where("section_path is not null").select("req_id", F.explode(F.concat(X.ancestors("section_path"), F.array("section_path"))).alias("path"))
    g = r.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("req_id").alias("n_ids"))
    return g.withColumn("warning", F.abs(F.col("n") - F.col("n_ids")) > 1)


def a38_audit(spark, d):
    """Missing fields of requirements by kind of document input."""
    r = table(spark, d, "requirements")
    miss = lambda c: F.count_if(F.col(c).isNull()).alias(f"no_{c}")
    return r.groupBy("input_format").agg(F.count("*").alias("n"), *[miss(c) for c in ("title", "actor", "actions", "description", "dependencies", "acceptance_criteria", "scenarios")], (F.count("*") == F.countDistinct("req_id")).alias("unique_ids"))


def a26_slot_text(spark, d):
    """Ordered text of a requirement from its units: titles once, actions in the order of their ids."""
    c = PU._crus(spark, d).where("parent_requirement_id <> ''")
    parts = F.array_sort(F.collect_list(F.when(F.col("action_text").isNotNull(), F.struct("cru_id", "action_text"))))
    return c.groupBy("parent_requirement_id").agg(F.array_join(F.transform(parts, lambda x: x["action_text"]), "; ").alias("actions"), F.min("title").alias("title"), F.min("traceability.source_locator.page").alias("first_page"), F.max("traceability.source_locator.page").alias("last_page"))


def a34_capability_ratio(spark, d):
    """Share of a chunk's units whose action holds a word of a tag; at least 0.5 counts."""
    u = table(spark, d, "chunks").select("chunk_id", F.explode("crus").alias("c")).select("chunk_id", F.lower(F.coalesce(F.col("c.action_text"), F.lit(""))).alias("t")).where("t <> ''")
    tags = list(R.CAPABILITIES)
    g = u.groupBy("chunk_id").agg(*[F.avg(F.col("t").rlike("|".join(R.CAPABILITIES[t])).cast("double")).alias(f"s{i}") for i, t in enumerate(tags)])
    s = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.round(f"s{i}", 6).alias("share")) for i, t in enumerate(tags)]))
    return g.select("chunk_id", s.alias("s")).select("chunk_id", "s.tag", "s.share").where("share >= 0.5")


def n18_dense_ids(spark, d):
    """Dense numbers for the requirements of a document."""
    w = Window.partitionBy("doc_id").orderBy("req_id")
    return table(spark, d, "requirements").where("req_id is not null").select(F.col("source_reference.doc_id").alias("doc_id"), "req_id").distinct().withColumn("no", F.dense_rank().over(w))


def n19_next_header(spark, d):
    """Lines outside any section are attached to the next heading of their text."""
    ln = PT._lines(spark, d)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("line").rlike(S.HEADING), F.col("pos")), ignorenulls=True).over(w)
    return ln.withColumn("next_heading", nxt).groupBy("doc_id").agg(F.count_if(F.col("next_heading").isNull()).alias("after_last"), F.min("next_heading").alias("first_heading"))


def n20_scenario_steps(spark, d):
    """Steps of the scenarios of requirements, in order, with their kind."""
    r = table(spark, d, "requirements").select("req_id", F.posexplode("scenarios").alias("no", "s")).where("s is not null")
    steps = F.array(F.struct(F.lit("precondition").alias("kind"), F.col("s.given").alias("t")), F.struct(F.lit("action").alias("kind"), F.col("s.when_text").alias("t")), F.struct(F.lit("outcome").alias("kind"), F.col("s.then_text").alias("t")))
    return r.select("req_id", "no", F.posexplode(steps).alias("step", "x")).where("x.t is not null").select("req_id", "no", "step", "x.kind", F.col("x.t").alias("text")).distinct()


def n22_step_numbers(spark, d):
    """Preconditions, steps and the expected result of a test as one numbered list."""
    t = PU._tests(spark, d)
    empty = F.array().cast("array<string>")
    all_ = F.filter(F.concat(F.coalesce("preconditions", empty), F.coalesce("test_steps", empty), F.array("expected_result")), lambda x: x.isNotNull())
    return t.select("test_id", F.posexplode(all_).alias("pos", "text")).select("test_id", (F.col("pos") + 1).alias("no"), F.md5("text").alias("h"))


def x33_alias_ids(spark, d):
    """Parent names by a table of aliases: every spelling of a requirement id, without case, blanks and punctuation, stands for that id."""
    bare = lambda c: F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")
    aliases = table(spark, d, "requirements").where("req_id is not null").groupBy(bare("req_id").alias("alias")).agg(F.min(F.upper(F.trim("req_id"))).alias("canonical"))
    c = table(spark, d, "crus").select("cru_id", F.upper(F.trim("parent_requirement_id")).alias("raw")).distinct()
    return c.withColumn("alias", bare("raw")).join(aliases, "alias", "left").select("cru_id", F.coalesce("canonical", "raw").alias("parent"), F.col("canonical").isNotNull().alias("known"))


def x36_page_kind(spark, d):
    """Kind of a text by its lines: contents, cover or body."""
    h = PT._lines(spark, d).where("trim(line) <> ''").select("doc_id", F.trim("line").alias("t"), X.heading("line").alias("h"))
    num = F.col("t").rlike(r"^\d+(?:\.\d+)*")
    g = h.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.lower("t").contains("table of contents")).alias("toc"), F.count_if(F.col("h.method") == "numeric").alias("heads"), F.count_if(~num & (F.length("t") > 40)).alias("body"))
    kind = X.first_match([(F.col("toc") > 0, "toc"), ((F.col("heads") >= 10) & (F.col("body") <= 3), "toc"), ((F.col("n") <= 12) & (F.col("heads") == 0), "cover")], "body")
    return g.select("doc_id", kind.alias("kind"))


def x43_split_hint(spark, d):
    """Lines and titles that may hold several behaviours."""
    t = table(spark, d, "nodes").select(F.concat_ws("\n", "title", "text").alias("t"))
    return t.groupBy(X.may_split("t").alias("split")).agg(F.count("*").alias("n"))


def w2_attempts(spark, d):
    """Attempted and stored edges per relation: both numbers, since they differ."""
    a = table(spark, d, "edges").groupBy("rel_type").agg(F.count("*").alias("attempted"))
    return a.join(PG._e(spark, d).groupBy("rel_type").agg(F.count("*").alias("stored")), "rel_type", "left").select("rel_type", "attempted", F.coalesce("stored", F.lit(0)).alias("stored"))


def j2_missing_verdicts(spark, d):
    """Units that tests name, with their metadata; a unit that is not there gives MISSING."""
    t = table(spark, d, "test_cases").where("requirement_id is not null").select(F.col("requirement_id").alias("cru_id")).distinct()
    return t.join(PU._crus(spark, d).select("cru_id", "cru_type", F.lit(True).alias("hit")), "cru_id", "left").select("cru_id", "cru_type", F.when(F.col("hit"), "FOUND").otherwise("MISSING").alias("state"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and k[0].islower() and any(c.isdigit() for c in k[:5])}

_A34 = " union all ".join(f"select chunk_id, '{t}' tag, round(avg(case when regexp_matches(t, '{'|'.join(R.CAPABILITIES[t])}') then 1.0::double else 0.0::double end), 6) share from u group by 1" for t in R.CAPABILITIES)
ORACLE = {
    "proj1_payload": f"with {PU.CR} select cru_id, to_json(struct_pack({', '.join(f'{c} := {c}' for c in PAYLOAD)}))::varchar payload from cr",
    "proj2_traceability": "select distinct req_id, section_path section, section_path, source_reference.page page, source_reference.para para, source_reference.doc_id doc_id, source_reference.module module, source_reference.version as version from requirements",
    "proj3_source_reference": "select distinct req_id, source_reference.doc_id doc_id, source_reference.module module, source_reference.version as version, source_reference.page page, source_reference.para para from requirements",
    "proj6_normalised": f"""select distinct req_id requirement_id, description statement, coalesce(source_reference.doc_id, '') || '#p' || coalesce(source_reference.page::varchar, '?') || '.' || coalesce(source_reference.para::varchar, '?') source_ref,
      length(trim(coalesce(description, ''))) >= 10 and (regexp_matches(coalesce(description, ''), '{R.FOR_CLAUSE}') or len(regexp_extract_all(coalesce(description, ''), '{R.IMPERATIVES}')) >= 2) split_hint,
      concat_ws(',', {", ".join(f"case when trim(coalesce({c}, '')) = '' then '{c}' end" for c in ("title", "actor", "description", "acceptance_criteria"))}) missing from requirements""",
    "proj7_candidates": f"with {PU.CR}, {PU.TC} select test_id, requirement_id cru_id, coalesce(concat_ws(' ', cr.title, {PU.CLAUSE.replace('actor', 'cr.actor')}), '') cru_text from tc left join cr on cr.cru_id = tc.requirement_id",
    "proj5_test_nodes": f"with {PU.TC} select test_id node_id, 'TEST' node_type, test_title title, concat_ws(' ', array_to_string(list_filter(test_steps, lambda x: x is not null), ' '), expected_result) text, traceability.doc_id doc_id, coalesce(traceability.section_path, srs_section) section_path from tc",
    "g12_impact_report": f"with {PG.E}, t as (select dst_id node_id, count(*) n from e where rel_type = 'TESTS' group by 1), s as (select src_id node_id, count(*) n, round(avg(confidence), 6) c from e where rel_type = 'SUPPORTED_BY' group by 1) select coalesce(t.node_id, s.node_id) node_id, coalesce(t.n, 0) n_tests, coalesce(s.n, 0) n_chunks, s.c support from t full join s on s.node_id = t.node_id",
    "g12_debug_report": f"with {PG.N}, {PG.E} select node_id, r missing from n, (select unnest(['TESTS', 'EVIDENCE_FOR']) r) where node_type = 'TEST' and not exists (select 1 from e where e.src_id = n.node_id and e.rel_type = r)",
    "a5_distinct_under_parent": """with r as (select req_id, section_path, string_split(section_path, '.') p from requirements where section_path is not null), x as (select req_id, array_to_string(p[1:k], '.') path from r, unnest(range(1, len(p) + 1)) u(k))
      select path, count(*) n, count(distinct req_id) n_ids, abs(count(*) - count(distinct req_id)) > 1 warning from x group by 1""",
    "a38_audit": "select input_format, count(*) n, " + ", ".join(f"count(*) filter ({c} is null) no_{c}" for c in ("title", "actor", "actions", "description", "dependencies", "acceptance_criteria", "scenarios")) + ", count(*) = count(distinct req_id) unique_ids from requirements group by 1",
    "a26_slot_text": f"with {PU.CR} select parent_requirement_id, coalesce(string_agg(action_text, '; ' order by cru_id) filter (action_text is not null), '') actions, min(title) title, min(traceability.source_locator.page) first_page, max(traceability.source_locator.page) last_page from cr where parent_requirement_id <> '' group by 1",
    "a34_capability_ratio": f"with u as (select chunk_id, lower(coalesce(c.action_text, '')) t from (select chunk_id, unnest(crus) c from chunks) where coalesce(c.action_text, '') <> ''), g as ({_A34}) select * from g where share >= 0.5",
    "n18_dense_ids": "select doc_id, req_id, cast(dense_rank() over (partition by doc_id order by req_id) as int) no from (select distinct source_reference.doc_id doc_id, req_id from requirements where req_id is not null)",
    "n19_next_header": f"with {PT.LN}, m as (select doc_id, max(case when {PT.HEAD} then pos end) last_h, min(case when {PT.HEAD} then pos end) first_h from ln group by 1) select doc_id, count(*) filter (last_h is null or pos > last_h) after_last, cast(min(first_h) as int) first_heading from ln join m using (doc_id) group by 1",
    "n20_scenario_steps": """with r as (select req_id, unnest(scenarios) s, generate_subscripts(scenarios, 1) - 1 no from requirements), x as (select req_id, no, 0 step, 'precondition' kind, s.given t from r where s is not null union all select req_id, no, 1, 'action', s.when_text from r where s is not null union all select req_id, no, 2, 'outcome', s.then_text from r where s is not null)
      select distinct req_id, cast(no as int) no, step, kind, t text from x where t is not null""",
    "n22_step_numbers": f"with {PU.TC}, x as (select test_id, list_filter(list_concat(coalesce(preconditions, []), coalesce(test_steps, []), [expected_result]), lambda x: x is not null) l from tc) select test_id, cast(no as int) no, md5(t) h from (select test_id, unnest(l) t, generate_subscripts(l, 1) no from x)",
    "x33_alias_ids": """with a as (select regexp_replace(upper(trim(req_id)), '[^A-Z0-9]', '', 'g') alias, min(upper(trim(req_id))) canonical from requirements where req_id is not null group by 1),
      c as (select distinct cru_id, upper(trim(parent_requirement_id)) raw from crus)
      select c.cru_id, coalesce(canonical, c.raw) parent, canonical is not null known from c left join a on a.alias = regexp_replace(c.raw, '[^A-Z0-9]', '', 'g')""",
    "x36_page_kind": f"""with {PT.HEADS}, g as (select doc_id, count(*) n, count(*) filter (contains(lower(line), 'table of contents')) toc, count(*) filter (method = 'numeric') heads, count(*) filter (not {PT._NUM} and length(trim(line)) > 40) body from hl where trim(line) <> '' group by 1)
      select doc_id, case when toc > 0 or (heads >= 10 and body <= 3) then 'toc' when n <= 12 and heads = 0 then 'cover' else 'body' end kind from g""",
    "w2_attempts": f"with {PG.E} select a.rel_type, a.n attempted, coalesce(s.n, 0) stored from (select rel_type, count(*) n from edges group by 1) a left join (select rel_type, count(*) n from e group by 1) s using (rel_type)",
    "j2_missing_verdicts": f"with {PU.CR} select t.cru_id, cr.cru_type, case when cr.cru_id is null then 'MISSING' else 'FOUND' end state from (select distinct requirement_id cru_id from test_cases where requirement_id is not null) t left join cr on cr.cru_id = t.cru_id",
    "x43_split_hint": f"with t as (select concat_ws(chr(10), title, text) t from nodes) select length(trim(t)) >= 10 and (regexp_matches(t, '{R.FOR_CLAUSE}') or len(regexp_extract_all(t, '{R.IMPERATIVES}')) >= 2) split, count(*) n from t group by 1",
}
