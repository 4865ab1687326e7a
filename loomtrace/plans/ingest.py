"""Queries over ingested text: contents, paragraphs, tables, stories, boxes, document metadata, prompts and files."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import graph as G
from loomtrace.operators import nested
from loomtrace.operators import segment as S
from loomtrace.plans import graph as PG
from loomtrace.plans import more as PM
from loomtrace.plans import text as PT
from loomtrace.plans import units as PU
from loomtrace.session import shared_dir, table
from loomtrace.sources import readers, sinks

NOISE_WORDS = ["none", "n/a", "na", "nil"]
PAGE_LINES = 40  # lines of a text that stand in for a page


def _blocks(spark, d):
    b = S.sections(PT._lines(spark, d)).withColumn("role", X.structural_role(F.trim("line"))).withColumn("kind", X.section_type("section_path", F.lit(None).cast("string")))
    return b.withColumn("skip", X.skip_block("section_path", "kind", "role", "line", F.lit(False)))


def f2_processable(spark, d):
    return _blocks(spark, d).where(~F.col("skip") & F.col("kind").isin(R.REQUIREMENT_SECTIONS)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def f3_named_groups(spark, d):
    return table(spark, d, "documents").where("req_id is not null").groupBy("srs_doc_id", "req_id").agg(F.count("*").alias("n"))


def f4_long_enough(spark, d):
    return PT._lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("line")) >= 3).alias("kept"))


def f15_acceptance_units(spark, d):
    return PT._lines(spark, d).where(X.acceptance_unit("line")).groupBy("doc_id").agg(F.count("*").alias("n"))


def f16_eligible(spark, d):
    """Lines that are prose of a section, in texts that are no table of contents."""
    ln = S.sections(PT._lines(spark, d)).join(PM.x36_page_kind(spark, d).where("kind <> 'toc'").select("doc_id"), "doc_id", "left_semi")
    ok = (F.trim("line") != "") & X.heading("line")["level"].isNull() & (F.col("section_path") != "PREAMBLE")
    return ln.where(ok).groupBy("doc_id", "section_path").agg(F.count("*").alias("n"))


def f19_floor(spark, d):
    return PT.o2_top_k(spark, d).where(F.col("cosine") >= R.MIN_SIMILARITY)


def n14_paragraphs(spark, d):
    return S.paragraphs_of_lines(PT._lines(spark, d)).select("doc_id", "para", "first", "n", "is_heading", F.md5("text").alias("h"))


def n15_heading_stack(spark, d):
    h = PT._lines(spark, d).withColumn("h", X.heading("line")).where("h.level is not null").select("doc_id", "pos", F.col("h.level").alias("level"), F.trim("line").alias("title"))
    return S.heading_stack(h, ["doc_id"]).select("doc_id", "pos", "level", F.md5("section_path").alias("h"))


def n16_anchor_groups(spark, d):
    """Lines that state a requirement, with the lines that belong to them."""
    t = F.lower("line")
    rows = PT._lines(spark, d).where("trim(line) <> ''").select(
        "doc_id", "pos", (t.rlike(R.MODALS) & t.rlike(R.BEHAVIOUR)).alias("strict"), (X.heading("line")["level"].isNotNull()).alias("narrative"), t.rlike(R.CONSTRAINTS).alias("attachable"),
        F.when(t.rlike(R.MODALS), 0.5).otherwise(0.0).alias("score"),
    )
    return S.anchor_groups(rows, ["doc_id"]).groupBy("doc_id", "grp").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def n17_story_units(spark, d):
    return S.story_units(PT._lines(spark, d)).groupBy("doc_id", "kind").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("n"))


def x12_table_text(spark, d):
    return S.pipe_tables(PT._lines(spark, d)).select("doc_id", "table_no", "n_rows", "n_cols", F.md5("text").alias("h"))


def f18_real_tables(spark, d):
    return S.pipe_tables(PT._lines(spark, d)).where("n_rows >= 2 and n_cols >= 2").groupBy("doc_id").agg(F.count("*").alias("n"))


def x16_key_values(spark, d):
    """The first two cells of each row of a table as a key and its value."""
    r = S.pipe_rows(PT._lines(spark, d))
    return r.select("doc_id", "pos", X.clean_text(F.col("cells")[0]).alias("key"), X.clean_text(F.try_element_at("cells", F.lit(2))).alias("value"))


def _toc_lines(spark, d):
    """Sections with a page as lines of a table of contents."""
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons")).where("page is not null and title is not null").select("doc_id", "section_path", "title", "page").distinct()
    return s.select("doc_id", "section_path", F.concat_ws(" ", "section_path", "title", F.lit("....."), F.col("page").cast("string")).alias("line"))


def x7_toc_entries(spark, d):
    e = X.toc_entry("line")
    return _toc_lines(spark, d).select("doc_id", e["number"].alias("number"), e["title"].alias("title"), e["page"].alias("page"))


def o9_first_entries(spark, d):
    e = X.toc_entry("line")
    w = Window.partitionBy("doc_id").orderBy("page", "number", "title")
    return _toc_lines(spark, d).select("doc_id", e["number"].alias("number"), e["title"].alias("title"), e["page"].alias("page")).withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


def s1_toc_pages(spark, d):
    """Among the first ten pages of a text, the first with at least three lines of contents and those after it that have one."""
    ln = PT._lines(spark, d).withColumn("page", F.floor(F.col("pos") / PAGE_LINES))
    return S.toc_run(ln.where("page < 10").groupBy("doc_id", "page").agg(F.count_if(X.toc_entry("line").isNotNull()).alias("n")))


def _words(spark, d):
    """Words on pages with their boxes, from order lines."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("page"), F.col("l_linestatus").alias("text"), F.col("l_linenumber").cast("double").alias("x0"), (F.col("l_linenumber") + F.col("l_quantity") / 100).cast("double").alias("x1"),
        (F.col("l_partkey") % 700).cast("double").alias("top"), (F.col("l_partkey") % 700 + 10).cast("double").alias("bottom"),
    ).distinct()


def n1_word_lines(spark, d):
    w = S.word_lines(_words(spark, d))
    return w.select("page", "y", F.md5("text").alias("h"), "x0", "top", "bottom")


def n2_line_paragraphs(spark, d):
    w = S.word_lines(_words(spark, d)).select("page", "text", F.col("y").alias("top"), (F.col("y") + 1).alias("bottom"))
    return S.paragraphs(w, 3.0).select("page", "para", "top", "bottom")


def f6_inside_tables(spark, d):
    w = _words(spark, d)
    t = spark.range(500).select(F.col("id").alias("page"), F.lit(1.0).alias("x0"), (F.col("id") % 300).cast("double").alias("top"), F.lit(4.0).alias("x1"), (F.col("id") % 300 + 200).cast("double").alias("bottom"))
    return S.inside_box(w, t).groupBy("page").agg(F.count("*").alias("n"))


def f5_pictures(spark, d):
    w, h = F.col("l_quantity").cast("double") * 10, (F.col("l_partkey") % 400).cast("double")
    return table(spark, d, "lineitem").groupBy(X.keep_picture(w, h, F.lit(480_000.0)).alias("keep")).agg(F.count("*").alias("n"))


def x3_roman(spark, d):
    w = F.explode(F.split(F.upper(F.concat_ws(" ", "title", "lang")), r"\s+"))
    return table(spark, d, "documents").select(w.alias("word")).where("word <> ''").union(spark.createDataFrame([(x,) for x in ROMANS], "word string")).distinct().select("word", X.roman_value("word").alias("value"))


ROMANS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "IIV", "IC", "A", "b", "3", "3.2.1"]


def x4_section_paths(spark, d):
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons")).select(F.col("section_path").alias("raw")).union(spark.createDataFrame([(x,) for x in ROMANS], "raw string")).distinct()
    return s.select("raw", X.section_path("raw").alias("path"))


def x18_tags(spark, d):
    p = X.tag_parts("title")
    return table(spark, d, "requirements").where("title is not null").select("title", p["id"].alias("id"), p["title"].alias("rest")).distinct()


def x17_dependencies(spark, d):
    """Dependencies as they are delivered, a list or one text, without noise words."""
    raw = F.get_json_object("payload", "$.dependencies")
    parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"[,\s]+"))
    r = table(spark, d, "raw_records").where(F.expr("try_parse_json(payload)").isNotNull()).select("file_name", "line_no", F.explode(parts).alias("dep"))
    return r.select("file_name", "line_no", F.trim("dep").alias("dep")).where(F.col("dep") != "").where(~F.lower("dep").isin(NOISE_WORDS)).distinct()


def x20_list_text(spark, d):
    """Optional lists as one text, blank entries dropped."""
    kept = F.filter(F.transform("actions", lambda a: F.trim(a)), lambda a: a != "")
    return table(spark, d, "requirements").select("req_id", F.array_join(kept, "; ").alias("actions"), F.size("scenarios").alias("n_scenarios")).distinct()


def x31_actors(spark, d):
    """The actor that one of the first ten lines of a text names."""
    t = F.trim("line")
    named = F.lower(t).contains("actor") & t.rlike("[:-]")
    a = F.when(t.rlike(R.ACTOR_BLOCK), F.trim(F.regexp_extract(t, R.ACTOR_BLOCK, 1))).when(named, F.trim(F.regexp_extract(t, "^[^:-]*[:-](.*)$", 1)))
    return PT._lines(spark, d).where("pos < 10").select("doc_id", "pos", a.alias("actor")).where("actor is not null").groupBy("doc_id").agg(F.min_by("actor", "pos").alias("actor"))


def x37_document_kind(spark, d):
    t = F.lower("text")
    kind = X.first_match([(t.rlike("|".join(w)), k) for k, w in R.DOC_TYPES.items()], "OTHER")
    v = F.regexp_extract("text", R.VERSION, 1)
    return table(spark, d, "documents").where("text is not null").select("doc_id", kind.alias("doc_type"), F.when(v != "", v).otherwise("unknown").alias("version"), F.coalesce("lang", F.lit("unknown")).alias("language"))


def x37_titles(spark, d):
    """The first of a text's first 20 lines that looks like a title."""
    t = F.trim("line")
    ok = t.rlike(r"^[A-Z][A-Za-z0-9\s\-:]{10,120}$") & (F.size(F.split(t, r"\s+")) >= 3)
    return PT._lines(spark, d).where("pos < 20").where(ok).groupBy("doc_id").agg(F.min_by(t, "pos").alias("title"))


def x38_sub_types(spark, d):
    t = F.trim("line")
    kind = X.first_match([(t.rlike(r"(?i)^Description:\s*"), "requirement_statement"), *[(t.rlike(p), k) for k, p in R.SUB_LABELS.items()]], "body")
    return PT._lines(spark, d).groupBy(kind.alias("sub_type")).agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace(t, r"(?i)^Description:\s*", ""))).alias("chars"))


def x44_source_types(spark, d):
    t = F.trim("line")
    kind = X.first_match([(t.rlike(p), k) for p, k in R.SOURCE_TYPES], "note")
    return PT._lines(spark, d).where("trim(line) <> ''").groupBy(kind.alias("source_type"), t.rlike(r"(?i)^(Scenario|Scenario Outline|Acceptance Scenario):").alias("is_header")).agg(F.count("*").alias("n"))


def x46_unit_text(spark, d):
    k = F.coalesce("constraint_text", F.lit(""))
    return PU._crus(spark, d).select("cru_id", F.concat_ws(" ", F.nullif("actor", F.lit("")), F.nullif("action_text", F.lit("")), F.when(k != "", F.concat(F.lit("with constraint: "), k))).alias("text"))


def x51_confidence(spark, d):
    """Confidence of a comparison from its ratio and what its verdict is worth."""
    worth = X.first_match([(F.col("verdict") == v, w) for v, w in R.VERDICT_WORTH.items()], 0.5)
    o = PU.x28_overlap(spark, d).join(PU._crus(spark, d).select("cru_id", F.length(F.coalesce("action_text", F.lit(""))).alias("n")), "cru_id")
    worth = F.when(F.col("n") > 50, F.least(F.lit(1.0), worth + 0.1)).otherwise(worth)
    return o.select("cru_id", "test_id", F.round(X.clamp(0.7 * F.col("blended") + 0.3 * worth), 4).alias("confidence"))


def a36_comparison(spark, d):
    return x51_confidence(spark, d).join(PU.x28_overlap(spark, d).select("cru_id", "test_id", "verdict"), ["cru_id", "test_id"]).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


def x52_modules(spark, d):
    p = F.upper("req_id")
    return table(spark, d, "requirements").where("req_id is not null").groupBy(X.first_match([(p.startswith(a), b) for a, b in R.MODULE_PREFIXES], "unknown").alias("module")).agg(F.count("*").alias("n"), F.countDistinct("req_id").alias("n_ids"))


def _template(spark):
    """Prompt templates are data: (name, template) with one place for the unit and one for its evidence."""
    return "Unit {unit}: {text}\nEvidence:\n{evidence}"


def x53_prompt(spark, d):
    """The prompt of each unit: its clause and the first five pieces of evidence, 180 characters of each."""
    n = PG._n(spark, d)
    ev = G.evidence(PG._arrivals(spark, d), n, 5).join(n.select("node_id", "text"), "node_id").groupBy(F.col("anchor").alias("cru_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "node_id", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 180)).alias("t")))), lambda x: x["t"]), "\n").alias("evidence"))
    u = PU._crus(spark, d).select("cru_id", X.clause("actor", "action_text", "constraint_text").alias("text")).join(ev, "cru_id", "left")
    before, rest = _template(spark).split("{unit}")
    middle, last = rest.split("{text}")
    last, end = last.split("{evidence}")
    return u.select("cru_id", F.md5(F.concat(F.lit(before), "cru_id", F.lit(middle), "text", F.lit(last), F.coalesce("evidence", F.lit("none")), F.lit(end))).alias("prompt"))


def j24_vector_rows(spark, d):
    """From the position of a vector to its record."""
    e, n = table(spark, d, "embeddings"), table(spark, d, "documents")
    return e.select("vec_id", "label").join(n.select(F.col("doc_id").alias("vec_id"), "title", "lang"), "vec_id", "left")


def g3_vector_anchors(spark, d):
    """Anchors of each query vector: the five nearest, those of the preferred kind first, then by score."""
    kind = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "CRU").otherwise("CHUNK").alias("node_type"))
    return G.anchors(PT.o2_top_k(spark, d).select("query_id", "id", F.col("cosine").alias("score")).join(kind, "id"), 5)


def g1_routes(spark, d):
    """Each document as a request: what its kind asks for, and what is wrong with it."""
    task = F.create_map(*[F.lit(x) for kv in R.SOURCE_TASKS.items() for x in kv])[F.lower(F.trim("source"))]
    q = table(spark, d, "documents").select("doc_id", F.coalesce(task, F.lower(F.trim("source"))).alias("task"), "req_id", F.nullif(F.trim("title"), F.lit("")).alias("query_text"))
    return G.route(q).select("doc_id", "task", "k_evidence", "k_parent", "error")


def g16_one_hop(spark, d):
    """One hop around each unit, and whether it takes vectors to fill up."""
    e, ids = PG._e(spark, d), PG._ids(spark, d)
    out = G.edges_from(e, ids).select(F.col("src_id").alias("anchor"), F.col("dst_id").alias("node_id")).union(G.edges_to(e, ids).select("dst_id", "src_id")).distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    return ids.join(out, ids["node_id"] == out["anchor"], "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < 3).alias("extend"))


def g17_candidates(spark, d):
    """The five units of the same document that share most words with each scenario: an equi-join on document and word."""
    sc = F.col("s")
    r = table(spark, d, "requirements").select(F.col("source_reference.doc_id").alias("doc_id"), "req_id", F.posexplode("scenarios").alias("no", "s")).where("s is not null and doc_id is not null")
    q = r.select("doc_id", "req_id", "no", F.explode(X.words(F.concat_ws(" ", sc["name"], sc["given"], sc["when_text"], sc["then_text"]))).alias("word")).distinct()
    u = PU._crus(spark, d).select(F.col("traceability.doc_id").alias("doc_id"), "cru_id", F.explode(X.words(X.clause("actor", "action_text", "constraint_text"))).alias("word"))
    n = q.join(u, ["doc_id", "word"]).groupBy("req_id", "no", "cru_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("req_id", "no").orderBy(F.desc("n"), "cru_id")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def a6_warning_counts(spark, d):
    return PG.f12_warnings(spark, d).groupBy("code").agg(F.count("*").alias("n"))


def a19_snapshot(spark, d):
    """Evidence per unit with mean confidence and score, zero where there is none."""
    ev = PG.o1_evidence(spark, d)
    ids = PG._ids(spark, d).select(F.col("node_id").alias("anchor"))
    g = ev.groupBy("anchor").agg(F.count("*").alias("n"), F.avg("score").alias("s"))
    return ids.join(g, "anchor", "left").select("anchor", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("mean_score"))


def a32_gaps(spark, d):
    u = PU.j23_requirement_usage(spark, d)
    parts = [PU.a29_scenario_scores(spark, d).where("risk = 'HIGH_RISK'").select(F.lit("high_risk_scenarios").alias("gap"), F.col("scenario").alias("id")),
             u.where("status = 'UNUSED_REQUIREMENT'").select(F.lit("unused_requirements"), "req_id"), u.where("status = 'WEAKLY_VALIDATED'").select(F.lit("weakly_validated_requirements"), "req_id")]
    return reduce(DataFrame.union, parts)


def a37_index_metadata(spark, d):
    return table(spark, d, "nodes").groupBy("node_type", X.section_level("section_path").alias("level")).agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("n_ids"))


def a39_noise(spark, d):
    """Share of characters of a text that are no letters, digits or blanks."""
    visible = F.regexp_replace("text", r"[ \n]", "")
    noise = F.length(F.regexp_replace(visible, r"[\p{L}\p{N}]", "")) / F.length(visible)
    ratio = F.when(visible == "", 1.0).otherwise(F.round(noise, 3))
    return table(spark, d, "documents").where("text is not null").select("doc_id", ratio.alias("ratio"), F.when(ratio > 0.15, "low").otherwise("acceptable").alias("quality"))


def n21_best_tests(spark, d):
    """The most trusted test of each unit; of equal ones the first."""
    s = PU._scored(spark, d).where("requirement_id is not null")
    g = s.groupBy("requirement_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "test_id")).alias("m"))
    return g.select("requirement_id", (-F.col("m.c")).alias("confidence"), "m.test_id")


def n23_typed_slices(spark, d):
    """Slices of at most 5 units of a requirement: all of them together if they fit, else by type, leaving out single ones beside others."""
    c = PU._crus(spark, d).select(F.coalesce(F.nullif("parent_requirement_id", F.lit("")), F.lit("UNKNOWN")).alias("parent"), F.coalesce("cru_type", F.lit("")).alias("kind"), "cru_id")
    per = c.groupBy("parent").agg(F.count("*").alias("all_units"))
    c = c.join(per, "parent").withColumn("kind", F.when(F.col("all_units") <= 5, "").otherwise(F.col("kind")))
    w = Window.partitionBy("parent", "kind").orderBy("cru_id")
    s = c.withColumn("slice", F.floor((F.row_number().over(w) - 1) / 5)).groupBy("parent", "kind", "slice").agg(F.count("*").alias("n"), F.min("cru_id").alias("first_unit"))
    of_kind = s.groupBy("parent", "kind").agg(F.sum("n").alias("m"))
    return s.join(of_kind, ["parent", "kind"]).where("n >= 2 or m = 1").select("parent", "kind", "slice", "n", "first_unit")


def u4_new_kinds(spark, d):
    """Kinds of nodes and relations of the whole snapshot that the earlier one lacks."""
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    kinds = lambda a, b: a.select(F.lit("node").alias("what"), F.col("node_type").alias("kind")).union(b.select(F.lit("relation"), "rel_type"))
    early = F.col("created_at") < F.expr("timestamp_ntz '2025-01-10'")
    return kinds(n, e).distinct().exceptAll(kinds(n.where(early), e.where(early)).distinct())


def u5_distinct_steps(spark, d):
    return PU._tests(spark, d).select("test_id", F.size("test_steps").alias("n"), F.array_join(F.array_distinct("test_steps"), "|").alias("steps")).select("test_id", "n", F.md5("steps").alias("h"))


def u6_merged(spark, d):
    """Two lists of tests with different fields as one."""
    a = table(spark, d, "test_cases").select("test_id", "test_type", "requirement_id")
    b = table(spark, d, "new_test_cases").select("test_id", "test_type", "module", "version")
    return a.unionByName(b, allowMissingColumns=True).distinct()


def k5_distinct_units(spark, d):
    """Units that differ in content, whatever their row order or load: typed structs in place of canonical JSON."""
    c = table(spark, d, "crus")
    cols = [x for x in c.columns if x != "loaded_at"]
    return c.groupBy("cru_id", F.sha2(F.to_json(F.struct(*cols)), 256).alias("h")).agg(F.count("*").alias("copies")).groupBy("cru_id").agg(F.count("*").alias("versions"), F.sum("copies").alias("n"))


def m7_similarity(spark, d):
    """Cosine from the Euclidean distance of unit vectors."""
    return PT.o2_top_k(spark, d).select("query_id", "id", F.round(1 - F.pow(F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))), 2) / 2, 4).alias("similarity"))


def j13_run_edges(spark, d):
    """Runs of tests and the defects they raise, with edges only where both ends are nodes."""
    t = PU._tests(spark, d)
    runs = t.select("test_id", F.concat(F.lit("RUN-"), "test_id").alias("run_id"), F.when(F.lower("priority") == "high", F.array(F.concat(F.lit("DEF-"), "requirement_id"))).otherwise(F.array().cast("array<string>")).alias("defect_ids"))
    defects = t.where("lower(priority) = 'high' and requirement_id is not null").select(F.concat(F.lit("DEF-"), "requirement_id").alias("defect_id"), F.array("requirement_id").alias("linked_req_ids")).distinct()
    nodes = PG._n(spark, d).select("node_id").union(runs.select("run_id")).union(defects.select("defect_id")).where("node_id is not null")
    return G.execution_edges(runs, nodes).unionByName(G.affects_edges(defects, nodes)).select("src_id", "rel_type", "dst_id", "confidence")


def x54_recovered(spark, d):
    """Arrays out of a model's answer with fences and chatter around them."""
    answer = F.concat(F.lit("Sure, here you are:\n```json\n"), F.to_json("actions"), F.lit("\n```\nAnything else?"))
    r = table(spark, d, "requirements").where("actions is not null").select("req_id", F.from_json(readers.first_json_array(answer), "array<string>").alias("a"))
    return r.select("req_id", F.md5(F.array_join("a", "|")).alias("h")).distinct()


def s7_load_status(spark, d):
    """An exit code for each delivered outline: 0, or 2 where it is missing, malformed or no object."""
    return readers.load_status(table(spark, d, "raw_skeletons"), "document_skeleton").groupBy("doc_type", "exit_code").agg(F.count("*").alias("n"))


def s5_json_rows(spark, d):
    """Requirements written as one JSON document per document and read back from under its wrapper key."""
    path = f"{shared_dir(spark)}/loomtrace/json-documents"
    r = table(spark, d, "requirements").where("req_id is not null").select("req_id", "title", "section_path").distinct()
    sinks.write_documents(r, path, F.substring("req_id", 1, 3), "requirements")
    return readers.read_json_rows(spark, path, ["requirements", "items"], "req_id string, title string, section_path string").select("req_id", "title", "section_path")


def w9_csv(spark, d):
    """A table written as CSV and read back."""
    path = f"{shared_dir(spark)}/loomtrace/csv"
    cols = ["test_id", "title", "description", "priority"]
    sinks.write_csv(table(spark, d, "new_test_cases").select(*cols).where("test_id is not null"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("test_id", *[F.coalesce(c, F.lit("")).alias(c) for c in cols[1:]])


def w7_sheets(spark, d):
    """One sheet of tests per generation phase, read back."""
    path = f"{shared_dir(spark)}/loomtrace/sheets"
    sinks.write_sheets(table(spark, d, "test_cases").select("test_id", "generation_phase"), path, "generation_phase")
    return spark.read.option("header", True).csv(path).groupBy("sheet").agg(F.count("*").alias("n"), F.countDistinct("test_id").alias("n_ids"))


def w5_rebuilt(spark, d):
    """Embeddings dropped and written anew."""
    path = f"{shared_dir(spark)}/loomtrace/embeddings"
    e = table(spark, d, "node_embeddings").select("node_id", "embedding_model")
    sinks.rebuild(e.where("node_id is null"), path)
    sinks.rebuild(e, path)
    return spark.read.parquet(path).groupBy("embedding_model").agg(F.count("*").alias("n"))


def _near_in_graph(spark, d):
    """Stand-in for arrivals: the next three ids of each query vector, with a confidence that falls with the distance."""
    e = table(spark, d, "embeddings").select("vec_id")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("anchor"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"))
    g = q.select("anchor", (F.col("anchor") + F.col("step")).alias("node_id"), F.round(F.pow(F.lit(R.HOP_PENALTY), "step"), 6).alias("score"))
    return g.join(e.select(F.col("vec_id").alias("node_id")), "node_id", "left_semi").select("anchor", "node_id", "score")


def f10_vector_hits(spark, d):
    """Vector hits that are child chunks and not in the graph's own results."""
    child = table(spark, d, "embeddings").where("label % 2 = 1").select(F.col("vec_id").alias("node_id"))
    v = PT.o2_top_k(spark, d).select(F.col("query_id").alias("anchor"), F.col("id").alias("node_id"), F.col("cosine").alias("score"))
    return v.join(child, "node_id", "left_semi").join(_near_in_graph(spark, d).select("anchor", "node_id"), ["anchor", "node_id"], "left_anti").select("anchor", "node_id", "score")


def g9_fused(spark, d):
    """Graph first, vectors fill in: the eight best of both."""
    v = PT.o2_top_k(spark, d).select(F.col("query_id").alias("anchor"), F.col("id").alias("node_id"), F.col("cosine").alias("score"))
    return G.fuse(_near_in_graph(spark, d), v, 8).select("anchor", "node_id", F.round("score", 4).alias("score"), "provenance", "needs_confirmation", "rank")


TEMPLATES = {"test_generation": "Unit {unit}: {text}\nEvidence:\n{evidence}", "verdict": "Does {evidence} show {text}?"}


def s15_templates(spark, d):
    """Prompt templates written as a JSON file and read back, with the places they leave open."""
    path = f"{shared_dir(spark)}/loomtrace/templates"
    spark.createDataFrame(list(TEMPLATES.items()), "name string, template string").coalesce(1).write.mode("overwrite").json(path)
    t = spark.read.schema("name string, template string").json(path)
    return t.select("name", F.explode(F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1)))).alias("place"))


def w12_log(spark, d):
    """Counts appended to a log twice."""
    path = f"{shared_dir(spark)}/loomtrace/log-{uuid.uuid4().hex}"
    n = table(spark, d, "test_cases").groupBy("test_type").agg(F.count("*").alias("n"))
    for _ in range(2):
        sinks.append_log(n, path)
    return spark.read.schema("test_type string, n long, logged_at timestamp").json(path).groupBy("test_type", "n").agg(F.count("logged_at").alias("times"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and k[0].islower() and any(c.isdigit() for c in k[:4]) and k != "reduce"}

_F1 = f"{PT.SECS}, b as (select *, null::varchar title, {PT.ROLE} rl from sc), k as (select *, {PT.TYPE} kind from b)"
_SKIP = f"(section_path = 'PREAMBLE' or kind = 'toc' or (length(trim(line)) < 8 and rl not in ({', '.join(repr(x) for x in R.LABEL_ROLES.values())})) or regexp_matches(trim(line), '^\\d+$'))"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_TABLES = rf"""{PT.LN}, pb as (select doc_id, pos, trim(line) t from ln where regexp_matches(trim(line), '^\|.*\|$')), po as (select *, case when pos - lag(pos) over (partition by doc_id order by pos) > 1 or lag(pos) over (partition by doc_id order by pos) is null then 1 else 0 end o from pb),
 pg as (select *, cast(sum(o) over (partition by doc_id order by pos rows unbounded preceding) as bigint) table_no from po),
 pr as (select doc_id, pos, table_no, list_transform(string_split(regexp_replace(t, '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) cells from pg where not regexp_matches(t, '^\|[\s\-:|]+\|$')),
 pt as (select doc_id, table_no, count(*) n_rows, cast(max(len(cells)) as int) n_cols, string_agg(array_to_string(cells, ' | '), chr(10) order by pos) tx from pr group by 1, 2)"""
_SKEL = r"""sk as (select doc_id, arg_max(struct_pack(s := document_skeleton), generated_at).s js from raw_skeletons group by 1),
 jt as (select doc_id, je.key k, je.type t, je.fullkey f, je.value v from sk, json_tree(js) je where js is not null and js <> ''),
 so as (select distinct doc_id, coalesce(json_extract_string(v, '$.section_path'), k) section_path, json_extract_string(v, '$.title') title, try_cast(json_extract_string(v, '$.page') as int) page from jt where t = 'OBJECT'
   and ((f not like '%]' and k similar to '([0-9]+|[A-Z])(\.[0-9]+)*') or json_extract_string(v, '$.section_path') is not null))"""
_TOCL = _SKEL + ", tl as (select doc_id, section_path, concat_ws(' ', section_path, title, '.....', page) line from so where page is not null and title is not null)"
_ENTRY = f"regexp_extract(trim(line), '{R.TOC_ENTRY}', ['a', 'n', 't', 'p'])"
_ROMAN = """with recursive rw as (select upper(trim({c})) w, {c} raw from {t}), ok as (select raw, w from rw where regexp_matches(w, '^[IVX]+$')),
 lt as (select raw, list_transform(string_split(w, ''), lambda x: case x when 'I' then 1 when 'V' then 5 else 10 end) v from ok), tt as (select raw, list_sum(list_transform(v, lambda x, i: case when coalesce(v[i + 1], 0) > x then -x else x end)) n from lt),
 rv as (select raw, cast(n as int) n from tt where n between 1 and 10)"""
_LIT = ", ".join(f"('{x}')" for x in ROMANS)
_WD = """wd as (select distinct l_orderkey % 500 page, l_linestatus tx, l_linenumber::double x0, (l_linenumber + l_quantity / 100)::double x1, (l_partkey % 700)::double top, (l_partkey % 700 + 10)::double bottom from lineitem),
 wl as (select page, round_even(top / 2, 0) * 2 y, string_agg(tx, ' ' order by x0, tx) tx, min(x0) x0, max(x1) x1, min(top) top, max(bottom) bottom from wd group by 1, 2)"""
_KIND = "case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{k}'" for k, ws in R.DOC_TYPES.items()) + " else 'OTHER' end"
_WORTH = "case verdict " + " ".join(f"when '{k}' then {v}::double" for k, v in R.VERDICT_WORTH.items()) + " else 0.5::double end"
_X51 = f"{PU.OVER}, xc as (select ov.*, case when length(coalesce(cr.action_text, '')) > 50 then least(1, {_WORTH} + 0.1::double) else {_WORTH} end w from ov join cr using (cru_id)), x51 as (select cru_id, test_id, verdict, round(greatest(0, least(1, 0.7::double * blended + 0.3::double * w)), 4) confidence from xc)"
_TASK = "coalesce(case lower(trim(source)) " + " ".join(f"when '{k}' then '{v}'" for k, v in R.SOURCE_TASKS.items()) + " end, lower(trim(source)))"
_STORY = f"""{PT.LN}, sk0 as (select doc_id, pos, trim(line) t, case when regexp_matches(trim(line), '(?i)^As an?\\b') then 'story' when regexp_matches(trim(line), '(?i)^(Acceptance )?Scenario( Outline)?:') then 'scenario'
   when regexp_matches(trim(line), '(?i)^(Given|When|Then|And|But)\\b') then 'step' when regexp_matches(trim(line), '^([-*•]|\\d+[.)])\\s') then 'bullet' else 'prose' end k from ln where trim(line) <> ''),
 sg as (select *, sum(case when k in ('story', 'scenario', 'bullet') then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) g from sk0),
 sx as (select *, first_value(k) over (partition by doc_id, g order by pos) op, coalesce(max(case when regexp_matches(t, '[.!?]$') then 1 else 0 end) over (partition by doc_id, g order by pos rows between unbounded preceding and 1 preceding), 0) e from sg),
 sy as (select *, case when k in ('story', 'scenario', 'bullet') then true when op = 'story' then e = 0 when op = 'scenario' then k = 'step' else false end i from sx),
 su as (select doc_id, pos, case when i then op when k = 'step' then 'step' else 'prose' end kind, case when i then 'g' || g else 'p' || pos end unit from sy)"""

_GRAPH = "gr as (select a.vec_id anchor, b.vec_id node_id, round(pow(0.9::double, b.vec_id - a.vec_id), 6) score from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.vec_id - a.vec_id between 1 and 3)"

ORACLE = {
    "f2_processable": f"with {_F1} select doc_id, kind, count(*) n from k where not {_SKIP} and kind in ({_IN(R.REQUIREMENT_SECTIONS)}) group by 1, 2",
    "f3_named_groups": "select srs_doc_id, req_id, count(*) n from documents where req_id is not null group by 1, 2",
    "f4_long_enough": f"with {PT.LN} select doc_id, count(*) n, count(*) filter (length(trim(line)) >= 3) kept from ln group by 1",
    "f15_acceptance_units": f"with {PT.LN}, t as (select doc_id, trim(line) t from ln) select doc_id, count(*) n from t where length(t) >= 6 and len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) >= 6 and regexp_matches(t, '{R.EXPECTATIONS}') and not regexp_matches(t, '{R.NO_UNIT}') group by 1",
    "f16_eligible": f"""with {PT.SECS}, hm as (select *, {PT.METHOD} method from sc), g as (select doc_id, count(*) n, count(*) filter (contains(lower(line), 'table of contents')) toc, count(*) filter (method = 'numeric') heads, count(*) filter (not {PT._NUM} and length(trim(line)) > 40) body from hm where trim(line) <> '' group by 1)
      select doc_id, section_path, count(*) n from hm where trim(line) <> '' and method not in ('numeric', 'allcaps', 'titlecase') and section_path <> 'PREAMBLE' and doc_id not in (select doc_id from g where toc > 0 or (heads >= 10 and body <= 3)) group by 1, 2""",
    "f19_floor": f"with {PT.TOP5} select * from t5 where cosine >= {R.MIN_SIMILARITY}",
    "n14_paragraphs": f"""with {PT.HEADS}, o as (select *, level is not null h, trim(line) <> '' and (level is not null or lag(level) over w is not null or trim(lag(line) over w) = '' or lag(line) over w is null) op from hl window w as (partition by doc_id order by pos)),
      g as (select *, cast(sum(case when op then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as bigint) para from o) select doc_id, para, cast(min(pos) as int) first, count(*) n, bool_or(h) is_heading, md5(string_agg(trim(line), chr(10) order by pos)) h from g where trim(line) <> '' group by 1, 2""",
    "n15_heading_stack": f"""with {PT.HEADS}, h as (select doc_id, pos, level, trim(line) title from hl where level is not null),
      a as (select h.doc_id, h.pos, h.level, x.level lv, x.title t from h join h x on x.doc_id = h.doc_id and x.pos <= h.pos and x.level <= h.level and not exists (select 1 from h b where b.doc_id = h.doc_id and b.pos > x.pos and b.pos <= h.pos and b.level <= x.level))
      select doc_id, cast(pos as int) pos, level, md5(string_agg(t, ' > ' order by lv)) h from a group by 1, 2, 3""",
    "n16_anchor_groups": f"""with {PT.HEADS}, r as (select doc_id, pos, {PT._M(R.MODALS)} and {PT._M(R.BEHAVIOUR)} strict, level is not null nar, {PT._M(R.CONSTRAINTS)} att, {PT._M(R.MODALS)} md from hl where trim(line) <> ''),
      g as (select *, sum(strict::int) over (partition by doc_id order by pos rows unbounded preceding) g from r), c as (select *, max((not strict and nar)::int) over (partition by doc_id, g order by pos rows unbounded preceding) = 1 cl from g),
      m as (select doc_id, pos, case when strict or (g > 0 and not cl and (att or md)) then g else 0 end grp from c) select doc_id, cast(grp as bigint) grp, count(*) n, cast(min(pos) as int) first from m group by 1, 2""",
    "n17_story_units": f"with {_STORY} select doc_id, kind, count(distinct unit) units, count(*) n from su group by 1, 2",
    "x12_table_text": f"with {_TABLES} select doc_id, table_no, n_rows, n_cols, md5(tx) h from pt",
    "f18_real_tables": f"with {_TABLES} select doc_id, count(*) n from pt where n_rows >= 2 and n_cols >= 2 group by 1",
    "x16_key_values": f"with {_TABLES} select doc_id, cast(pos as int) pos, cells[1] as key, cells[2] as value from pr",
    "x7_toc_entries": f"with {_TOCL}, e as (select doc_id, {_ENTRY} m from tl) select doc_id, m.n number, m.t title, try_cast(m.p as int) page from e",
    "o9_first_entries": f"with {_TOCL}, e as (select doc_id, {_ENTRY} m from tl) select doc_id, number, title, page from (select doc_id, m.n number, m.t title, try_cast(m.p as int) page, row_number() over (partition by doc_id order by try_cast(m.p as int), m.n, m.t) r from e) where r <= 3",
    "s1_toc_pages": f"""with {PT.LN}, p as (select doc_id, pos // {PAGE_LINES} page, count(*) filter (regexp_matches(trim(line), '{R.TOC_ENTRY}')) n from ln where pos // {PAGE_LINES} < 10 group by 1, 2),
      f as (select *, min(case when n >= 3 then page end) over (partition by doc_id) first_page from p), e as (select *, min(case when n < 1 then page end) over (partition by doc_id) e from f where page >= first_page)
      select doc_id, first_page, max(page) last_page from e where e is null or page < e group by 1, 2""",
    "n1_word_lines": f"with {_WD} select page, y, md5(tx) h, x0, top, bottom from wl",
    "n2_line_paragraphs": f"""with {_WD}, o as (select page, y top, y + 1 bottom, case when lag(y + 1) over (partition by page order by y) is null or y - lag(y + 1) over (partition by page order by y) > 3 then 1 else 0 end o from wl),
      g as (select *, cast(sum(o) over (partition by page order by top rows unbounded preceding) as bigint) para from o) select page, para, min(top) top, max(bottom) bottom from g group by 1, 2""",
    "f6_inside_tables": f"with {_WD} select page, count(*) n from wd where x0 >= 1 and top >= page % 300 and x1 <= 4 and bottom <= page % 300 + 200 group by 1",
    "f5_pictures": """with p as (select l_quantity::double * 10 w, (l_partkey % 400)::double h from lineitem) select coalesce(w >= 40 and h >= 40 and w * h >= 2000 and greatest(w, h) / nullif(least(w, h), 0) <= 20 and w * h / 480000 between 0.005 and 0.8, false) keep, count(*) n from p group by 1""",
    "x3_roman": _ROMAN.format(c="word", t=f"(select distinct word from (select unnest(string_split_regex(upper(concat_ws(' ', title, lang)), '\\s+')) word from documents union all select * from (values {_LIT})) where word <> '')")
    + " select rw.raw word, rv.n as value from rw left join rv using (raw)",
    "x4_section_paths": _ROMAN.format(c="raw", t=f"(select distinct raw from (select p raw from sp0 union all select * from (values {_LIT})))").replace("with recursive", "with " + _SKEL + ", sp0 as (select section_path p from so),", 1)
    + " select rw.raw, case when rw.raw is null then '' when regexp_matches(trim(rw.raw), '^\\d+(\\.\\d+)*$') then trim(rw.raw) when rv.n is not null then 'A.' || rv.n when regexp_matches(trim(rw.raw), '^[A-Za-z]$') then 'A.' || (ascii(upper(trim(rw.raw))) - 64) else rw.raw end path from rw left join rv using (raw)",
    "x18_tags": "with t as (select distinct title, trim(regexp_replace(title, '\\s+', ' ', 'g')) c from requirements where title is not null) select title, regexp_extract(c, '^(\\S+)', 1) id, case when trim(regexp_replace(c, '^\\S+', '')) = '' then regexp_extract(c, '^(\\S+)', 1) else trim(regexp_replace(c, '^\\S+', '')) end rest from t",
    "x17_dependencies": f"""with r as (select file_name, line_no, payload::json p from raw_records where json_valid(payload)), x as (select file_name, line_no, unnest(case when json_type(p, '$.dependencies') = 'ARRAY' then json_extract_string(p, '$.dependencies[*]') else string_split_regex(json_extract_string(p, '$.dependencies'), '[,\\s]+') end) dep from r)
      select distinct file_name, line_no, trim(dep) dep from x where trim(dep) <> '' and lower(trim(dep)) not in ({_IN(NOISE_WORDS)})""",
    "x20_list_text": "select distinct req_id, array_to_string(list_filter(list_transform(actions, lambda a: trim(a)), lambda a: a <> ''), '; ') actions, cast(len(scenarios) as int) n_scenarios from requirements",
    "x31_actors": f"""with {PT.LN}, a as (select doc_id, pos, case when regexp_matches(trim(line), '{R.ACTOR_BLOCK}') then trim(regexp_extract(trim(line), '{R.ACTOR_BLOCK}', 1)) when contains(lower(trim(line)), 'actor') and regexp_matches(trim(line), '[:-]') then trim(regexp_extract(trim(line), '^[^:-]*[:-](.*)$', 1)) end actor from ln where pos < 10)
      select doc_id, arg_min(actor, pos) actor from a where actor is not null group by 1""",
    "x37_document_kind": f"select doc_id, {_KIND} doc_type, case when regexp_extract(text, '{R.VERSION}', 1) <> '' then regexp_extract(text, '{R.VERSION}', 1) else 'unknown' end as version, coalesce(lang, 'unknown') as language from documents where text is not null",
    "x37_titles": f"with {PT.LN} select doc_id, arg_min(trim(line), pos) title from ln where pos < 20 and regexp_matches(trim(line), '^[A-Z][A-Za-z0-9\\s\\-:]{{10,120}}$') and len(string_split_regex(trim(line), '\\s+')) >= 3 group by 1",
    "x38_sub_types": f"with {PT.LN}, t as (select trim(line) t from ln) select case when regexp_matches(t, '(?i)^Description:\\s*') then 'requirement_statement' " + " ".join(f"when regexp_matches(t, '{p}') then '{k}'" for k, p in R.SUB_LABELS.items())
    + " else 'body' end sub_type, count(*) n, cast(sum(length(regexp_replace(t, '(?i)^Description:\\s*', ''))) as bigint) chars from t group by 1",
    "x44_source_types": f"with {PT.LN}, t as (select trim(line) t from ln where trim(line) <> '') select case " + " ".join(f"when regexp_matches(t, '{p}') then '{k}'" for p, k in R.SOURCE_TYPES) + " else 'note' end source_type, regexp_matches(t, '(?i)^(Scenario|Scenario Outline|Acceptance Scenario):') is_header, count(*) n from t group by 1, 2",
    "x46_unit_text": f"with {PU.CR} select cru_id, concat_ws(' ', nullif(actor, ''), nullif(action_text, ''), case when coalesce(constraint_text, '') <> '' then 'with constraint: ' || constraint_text end) as text from cr",
    "x51_confidence": f"with {_X51} select cru_id, test_id, confidence from x51",
    "a36_comparison": f"with {_X51} select verdict, count(*) n, round(avg(confidence), 4) mean from x51 group by 1",
    "x52_modules": "select case " + " ".join(f"when starts_with(upper(req_id), '{a}') then '{b}'" for a, b in R.MODULE_PREFIXES) + " else 'unknown' end module, count(*) n, count(distinct req_id) n_ids from requirements where req_id is not null group by 1",
    "x53_prompt": PG.ARR.replace("with e as", f"with {PG.N}, {PU.CR}, e as", 1) + f""", b as (select anchor, node_id, max(score) score from arr group by 1, 2), ev as (select * from (select b.*, n.text tx, row_number() over (partition by anchor order by score desc, b.node_id) r from b join n using (node_id) where {PG.KIND} = 'child') where r <= 5),
      t as (select anchor, string_agg('- ' || node_id || ': ' || substr(coalesce(tx, ''), 1, 180), chr(10) order by r) evidence from ev group by 1)
      select cru_id, md5('Unit ' || cru_id || ': ' || {PU.CLAUSE} || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, 'none')) prompt from cr left join t on t.anchor = cr.cru_id""",
    "j24_vector_rows": "select vec_id, label, title, lang from embeddings left join documents on doc_id = vec_id",
    "g3_vector_anchors": f"with {PT.TOP5}, k as (select query_id, t5.id, case when label % 2 = 0 then 'CRU' else 'CHUNK' end node_type, cosine score from t5 join embeddings e on e.vec_id = t5.id) select query_id, id, node_type, score, cast(row_number() over (partition by query_id order by node_type <> 'CRU', score desc, id) as int) place from k",
    "g1_routes": f"""with q as (select doc_id, {_TASK} task, req_id, nullif(trim(title), '') query_text from documents) select doc_id, task, 8 k_evidence, 3 k_parent, case when coalesce(task, '') = '' then 'task is required' when task not in ({_IN(R.TASK_RELATIONS)}) then 'unsupported task'
      when coalesce(req_id, '') = '' and coalesce(query_text, '') = '' then 'req_id or query_text is required' end error from q""",
    "g16_one_hop": f"with {PG.E}, {PG.IDS}, o as (select src_id a, dst_id b from e where src_id in (select node_id from ids) union select dst_id, src_id from e where dst_id in (select node_id from ids)), c as (select a, count(*) n from o group by 1) select node_id, coalesce(n, 0) n, coalesce(n, 0) < 3 extend from ids left join c on c.a = node_id",
    "g17_candidates": f"""with {PU.CR}, r as (select source_reference.doc_id doc_id, req_id, unnest(scenarios) s, generate_subscripts(scenarios, 1) - 1 no from requirements where source_reference.doc_id is not null),
      q as (select distinct doc_id, req_id, no, unnest({PU._words_sql("concat_ws(' ', s.name, s.given, s.when_text, s.then_text)")}) word from r where s is not null), u as (select traceability.doc_id doc_id, cru_id, unnest({PU._words_sql(PU.CLAUSE)}) word from cr),
      n as (select req_id, no, cru_id, count(*) n from q join u using (doc_id, word) group by 1, 2, 3) select req_id, cast(no as int) no, cru_id, n, cast(rank as int) rank from (select *, row_number() over (partition by req_id, no order by n desc, cru_id) rank from n) where rank <= 5""",
    "a6_warning_counts": PG._EV + " select code, count(*) n from nt group by 1",
    "a19_snapshot": PG._EV + ", g as (select anchor, count(*) n, avg(score) s from ev group by 1) select node_id anchor, coalesce(n, 0) n, round(coalesce(s, 0), 4) mean_score from ids left join g on g.anchor = node_id",
    "a32_gaps": f"select 'high_risk_scenarios' gap, scenario id from ({PU.ORACLE['a29_scenario_scores']}) where risk = 'HIGH_RISK' union all select case status when 'UNUSED_REQUIREMENT' then 'unused_requirements' else 'weakly_validated_requirements' end, req_id from ({PU.ORACLE['j23_requirement_usage']}) where status <> 'VALIDATED'",
    "a37_index_metadata": "select node_type, cast(len(string_split(section_path, '.')) as int) as level, count(*) n, count(distinct node_id) n_ids from nodes group by 1, 2",
    "a39_noise": """with t as (select doc_id, regexp_replace(text, '[ \\n]', '', 'g') v from documents where text is not null), r as (select doc_id, case when v = '' then 1.0 else round(length(regexp_replace(v, '[\\p{L}\\p{N}]', '', 'g'))::double / length(v), 3) end ratio from t)
      select doc_id, ratio::double ratio, case when ratio > 0.15 then 'low' else 'acceptable' end quality from r""",
    "n21_best_tests": f"with {PU.SCORED} select requirement_id, -m.c confidence, m.t test_id from (select tc.requirement_id, min(struct_pack(c := -lv.confidence, t := lv.test_id)) m from lv join tc using (test_id) where tc.requirement_id is not null group by 1)",
    "n23_typed_slices": f"""with {PU.CR}, c as (select coalesce(nullif(parent_requirement_id, ''), 'UNKNOWN') parent, coalesce(cru_type, '') kind, cru_id from cr), p as (select parent, count(*) a from c group by 1), k as (select parent, case when a <= 5 then '' else kind end kind, cru_id from c join p using (parent)),
      s as (select *, (row_number() over (partition by parent, kind order by cru_id) - 1) // 5 slice, count(*) over (partition by parent, kind) m from k) select parent, kind, slice, count(*) n, min(cru_id) first_unit from s group by parent, kind, slice, m having count(*) >= 2 or m = 1""",
    "u4_new_kinds": "select * from (select 'node' what, node_type kind from nodes union select 'relation', rel_type from edges) except select * from (select 'node', node_type from nodes where created_at < timestamp '2025-01-10' union select 'relation', rel_type from edges where created_at < timestamp '2025-01-10')",
    "u5_distinct_steps": f"with {PU.TC} select test_id, cast(len(test_steps) as int) n, md5(array_to_string(list_filter(test_steps, lambda x, i: x is not null and list_position(test_steps, x) = i), '|')) h from tc",
    "u6_merged": "select distinct * from (select test_id, test_type, requirement_id from test_cases union all by name select test_id, test_type, module, version from new_test_cases)",
    "k5_distinct_units": "select cru_id, count(*) versions, cast(sum(c) as bigint) n from (select * exclude loaded_at, count(*) c from crus group by all) group by 1",
    "m7_similarity": f"with {PT.TOP5} select query_id, id, round(1 - pow(sqrt(greatest(2 - 2 * cosine, 0)), 2) / 2, 4) similarity from t5",
    "j13_run_edges": f"""with {PG.N}, {PU.TC}, r as (select test_id, 'RUN-' || test_id run_id, requirement_id q, lower(priority) = 'high' hi from tc), df as (select distinct q from r where hi and q is not null)
      select distinct test_id src_id, 'EXECUTED_AS' rel_type, run_id dst_id, 1.0::double confidence from r where test_id in (select node_id from n where node_id is not null) union all select distinct run_id, 'RAISED_AS', 'DEF-' || q, 1.0::double from r where hi and q is not null
      union all select 'DEF-' || q, 'AFFECTS', q, 0.85::double from df where q in (select node_id from n where node_id is not null)""",
    "x54_recovered": "select distinct req_id, md5(array_to_string(list_filter(actions, lambda x: x is not null), '|')) h from requirements where actions is not null",
    "s7_load_status": "select doc_type, case when coalesce(json_valid(document_skeleton) and json_type(try_cast(document_skeleton as json)) = 'OBJECT', false) then 0 else 2 end exit_code, count(*) n from raw_skeletons group by 1, 2",
    "s5_json_rows": "select distinct req_id, title, section_path from requirements where req_id is not null",
    "w9_csv": "select test_id, coalesce(title, '') title, coalesce(description, '') description, coalesce(priority, '') priority from new_test_cases where test_id is not null",
    "w7_sheets": "select coalesce(generation_phase, 'none') sheet, count(*) n, count(distinct test_id) n_ids from test_cases group by 1",
    "w5_rebuilt": "select embedding_model, count(*) n from node_embeddings group by 1",
    "f10_vector_hits": f"with {PT.TOP5}, {_GRAPH} select query_id anchor, t5.id node_id, cosine score from t5 join embeddings e on e.vec_id = t5.id and e.label % 2 = 1 where not exists (select 1 from gr where gr.anchor = query_id and gr.node_id = t5.id)",
    "g9_fused": f"""with {PT.TOP5}, {_GRAPH}, b as (select anchor, node_id, score + 0.3::double score, 'graph' provenance, false needs from gr union all select query_id, id, cosine, 'vector', cosine < 0.65 from t5 where not exists (select 1 from gr where gr.anchor = query_id and gr.node_id = t5.id))
      select anchor, node_id, round(score, 4) score, provenance, needs needs_confirmation, cast(rank as int) rank from (select *, row_number() over (partition by anchor order by score desc, node_id) rank from b) where rank <= 8""",
    "s15_templates": "select * from (values " + ", ".join(f"('{k}', '{x}')" for k, v in TEMPLATES.items() for x in dict.fromkeys(re.findall(r"\{(\w+)\}", v))) + ") t(name, place)",
    "w12_log": "select test_type, count(*) n, 2::bigint times from test_cases group by 1",
}
