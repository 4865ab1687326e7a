"""Queries over ordered text, vectors, events and snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import diff as D
from loomtrace.operators import graph as G
from loomtrace.operators import nested
from loomtrace.operators import segment as S
from loomtrace.operators import similarity as V
from loomtrace.session import table


def _lines(spark, d):
    return S.lines(table(spark, d, "documents"))


def x1_clean_text(spark, d):
    return _lines(spark, d).select("doc_id", "pos", F.md5(X.clean_text("line")).alias("h"))


def x2_squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.squeeze("title")).alias("h"), F.length(X.squeeze("title")).alias("n"))


def x5_norm_title(spark, d):
    return table(spark, d, "nodes").select(X.norm_title("title").alias("t")).groupBy("t").agg(F.count("*").alias("n"))


def x6_section_level(spark, d):
    return table(spark, d, "nodes").groupBy(X.section_level("section_path").alias("level"), X.parent_path("section_path").alias("parent")).agg(F.count("*").alias("n"))


def x9_section_type(spark, d):
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons"))
    return s.select("doc_id", "section_path", X.section_type("section_path", "title").alias("kind")).distinct()


def a4_groups_by_type(spark, d):
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons"))
    return s.groupBy(X.section_type("section_path", "title").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def x10_structural_role(spark, d):
    return _lines(spark, d).groupBy(X.structural_role(F.trim("line")).alias("role")).agg(F.count("*").alias("n"))


def x8_list_items(spark, d):
    item = F.col("line").rlike(r"^\s*([-*•]|\d+[.)]|[a-z][.)])\s+")
    return _lines(spark, d).where("trim(line) <> ''").groupBy("doc_id").agg(F.count_if(item).alias("items"), F.count("*").alias("n"))


def x11_dependencies(spark, d):
    ids = F.regexp_extract_all("line", F.lit(r"\b(?:FR|NFR|UI|SEC|PERF)\d+\b"), F.lit(0))
    return _lines(spark, d).select("doc_id", F.explode(ids).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def x15_modal_sentences(spark, d):
    r = table(spark, d, "requirements").where("description is not null").select("req_id", "description").distinct()
    return r.select("req_id", "description", F.posexplode(X.modal_sentences("description")).alias("pos", "sentence"))


def x39_roles(spark, d):
    return _lines(spark, d).where("trim(line) <> ''").groupBy(F.array_join(X.roles("line"), ",").alias("roles")).agg(F.count("*").alias("n"))


def x40_paragraph_score(spark, d):
    t = F.lower("line")
    n = F.size(F.filter(X.roles("line"), lambda r: r != "narrative"))
    score = F.when(t.rlike(R.MODALS), 0.4).otherwise(0.0) + F.when(t.rlike(R.BEHAVIOUR), 0.3).otherwise(0.0) + F.lit(0.05) + F.least(n * 0.025, F.lit(0.1))
    return _lines(spark, d).where("trim(line) <> ''").groupBy(F.round(X.clamp(score, 0.01, 0.99), 4).alias("score")).agg(F.count("*").alias("n"))


def a24_section_kinds(spark, d):
    return S.roles_by_section(table(spark, d, "documents"))


def n3_sections(spark, d):
    s = S.sections(_lines(spark, d))
    return s.groupBy("doc_id", "section_path").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.max("section_no").alias("section_no"))


def n8_block_slices(spark, d):
    return S.block_slices(_lines(spark, d), F.col("line").rlike(S.HEADING))


def n10_fold_items(spark, d):
    return S.fold_items(_lines(spark, d)).select("doc_id", "item", F.length("text").alias("n"), F.md5("text").alias("h"))


def n5_labelled_values(spark, d):
    return S.labelled_values(_lines(spark, d), ["ID", "TITLE", "DESC", "RAT", "DEP", "Actor", "Status"], ["doc_id"])


def n20_step_categories(spark, d):
    s = S.step_categories(_lines(spark, d), ["doc_id"])
    return s.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def n4_positions(spark, d):
    w = Window.partitionBy("doc_id", "section_path").orderBy("section_no", "pos")
    s = S.sections(_lines(spark, d)).where("trim(line) <> ''").withColumn("para_index", F.row_number().over(w))
    return s.select("doc_id", "pos", "section_path", "para_index")


def j17_parent_titles(spark, d):
    """Each section with its parent's title: a self-join one level up."""
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons")).select("doc_id", "section_path", "title").distinct()
    p = s.select("doc_id", F.col("section_path").alias("up"), F.col("title").alias("parent_title")).groupBy("doc_id", "up").agg(F.min("parent_title").alias("parent_title"))
    return s.withColumn("up", X.parent_path("section_path")).join(p, ["doc_id", "up"], "left").select("doc_id", "section_path", "title", "parent_title")


def j18_ancestors(spark, d):
    """Descendants per section: ancestors are listed, so the prefix join is an equi-join."""
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons")).select("doc_id", "section_path").distinct()
    return s.select("doc_id", F.explode(X.ancestors("section_path")).alias("ancestor")).groupBy("doc_id", "ancestor").agg(F.count("*").alias("n"))


def a2_conditional_counts(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("no_text"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.col("n_chars") > 10000).alias("large"), F.sum("n_chars").alias("chars")
    )


def a3_histogram(spark, d):
    return table(spark, d, "requirements").groupBy(F.coalesce("section_semantic_type", F.lit("other")).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def a23_prefix_histogram(spark, d):
    """Prefixes of requirement ids in texts, those of at least a tenth of the most frequent, at most 10."""
    ref = F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,5})\d{3,}\b"), F.lit(1))
    n = table(spark, d, "documents").select(F.explode(ref).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.lit(1)))  # one row per prefix: a handful
    return n.withColumn("m", top).where("n * 10 >= m").drop("m").orderBy(F.desc("n"), "prefix").limit(10)


def x24_ids(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.concat(F.lit("PC-"), F.substring(F.sha1(F.concat_ws("|", "srs_doc_id", "req_id")), 1, 10)).alias("candidate"), X.parent_chunk_id("srs_doc_id", "title").alias("parent"))


def k2_json_fields(spark, d):
    return table(spark, d, "nodes").groupBy(
        "node_type", F.get_json_object("extra_json", "$.chunk_type").alias("kind"), F.get_json_object("source_locator_json", "$.page").isNotNull().alias("has_page")
    ).agg(F.count("*").alias("n"))


def k1_json_events(spark, d):
    return table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


def n2_event_sessions(spark, d):
    """Sessions of a user's events: a gap of more than 30 minutes opens one."""
    e = table(spark, d, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    s = S.gap_sessions(e.withColumn("rank", F.struct("t", "event_id")), ["user_id"], "rank", "t", "t", 1800.0)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def m3_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 5).alias("norm"), F.round(V.norm(V.normalize("embedding")), 5).alias("unit"))


def o2_top_k(spark, d):
    """The 5 nearest of all vectors for each stated query: every vector whose id is divisible by 20."""
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    r = V.top_k(base, base.where("id % 20 = 0"), 6).where("id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "id", F.round("cosine", 4).alias("cosine"), "rank")


def g7_filtered_search(spark, d):
    """The same over one label only: the filter comes before any vector is compared."""
    base = table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"), "embedding")
    return V.top_k(base, table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding"), 3).select("query_id", "id", F.round("cosine", 4).alias("cosine"), "rank")


def a35_mean_top1(spark, d):
    return o2_top_k(spark, d).where("rank = 1").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 3).alias("mean"))


def j15_new_tests(spark, d):
    return D.new_keys(table(spark, d, "test_cases"), table(spark, d, "new_test_cases"), "test_id")


def j16_stat_diff(spark, d):
    n = table(spark, d, "nodes")
    s = lambda df: df.groupBy(F.lit("nodes").alias("kind"), F.col("node_type").alias("name")).agg(F.countDistinct("node_id").alias("n"))
    return D.stat_diff(s(n.where("created_at < timestamp_ntz '2025-06-01'")), s(n))


def a20_test_summary(spark, d):
    return D.test_summary(table(spark, d, "new_test_cases"), ["positive", "negative", "edge", "security"])


def w7_flat_export(spark, d):
    f = D.flat_export(table(spark, d, "test_cases").select("test_id", "preconditions", "test_steps", "loaded_at", "priority"))
    return f.select("test_id", "preconditions", F.md5("test_steps").alias("steps_md5"), "loaded_at", "priority").distinct()


def u1_union(spark, d):
    t, n = table(spark, d, "test_cases"), table(spark, d, "new_test_cases")
    return t.select("test_id", "test_type", "priority").unionByName(n.select("test_id", "test_type", "priority")).groupBy("test_type", "priority").agg(F.count("*").alias("n"))


def u3_shared_words(spark, d):
    t = table(spark, d, "requirements").select("req_id", X.words("title").alias("a"), X.words("description").alias("b")).distinct()
    return t.select("req_id", F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_except("a", "b")).alias("only_title"), F.size("b").alias("n_description"))


def o8_sample(spark, d):
    """Three nodes per type, by a hash of their ids: a sample that repeats."""
    w = Window.partitionBy("node_type").orderBy(F.md5("node_id"), "node_id")
    return G.node_versions(table(spark, d, "nodes")).withColumn("r", F.row_number().over(w)).where("r <= 3").select("node_type", "node_id")


def f1_skip_blocks(spark, d):
    """How many lines of each section type are noise."""
    b = S.sections(_lines(spark, d)).withColumn("role", X.structural_role(F.trim("line"))).withColumn("kind", X.section_type("section_path", F.lit(None).cast("string")))
    return b.groupBy("kind", X.skip_block("section_path", "kind", "role", "line", F.lit(False)).alias("skip")).agg(F.count("*").alias("n"))


def x13_input_format(spark, d):
    """Format of each text from the roles of its lines."""
    b = _lines(spark, d).groupBy("doc_id").agg(F.collect_set(X.structural_role(F.trim("line"))).alias("roles"))
    return b.select("doc_id", X.input_format("roles").alias("format"))


def x14_actor(spark, d):
    return table(spark, d, "requirements").groupBy(X.actor(F.concat_ws(" ", "actor", "description")).alias("actor")).agg(F.count("*").alias("n"))


def x19_provenance_confidence(spark, d):
    nulls = F.col("actor").isNull() | F.col("dependencies").isNull() | F.col("acceptance_criteria").isNull()
    return table(spark, d, "requirements").groupBy("extraction_method", X.provenance_confidence("extraction_method", nulls).alias("confidence")).agg(F.count("*").alias("n"))


def x21_unit_type(spark, d):
    r = table(spark, d, "requirements").withColumn("kind", X.section_type("section_path", "title"))
    return r.groupBy("kind", X.unit_type("kind", "title", "description").alias("type"), X.method_confidence("extraction_method").alias("confidence")).agg(F.count("*").alias("n"))


def x35_heading(spark, d):
    return _lines(spark, d).select(X.heading("line").alias("h")).groupBy("h.level", "h.method").agg(F.count("*").alias("n"))


def a28_ingestion_audit(spark, d):
    """Per text: lines, headings by method, longest line, and whether it has any structure."""
    h = _lines(spark, d).where("trim(line) <> ''").select("doc_id", F.length("line").alias("n"), X.heading("line").alias("h"))
    g = h.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("h.method") == "numeric").alias("numeric"), F.count_if(F.col("h.level").isNotNull()).alias("headings"), F.max("n").alias("longest"))
    return g.withColumn("structured", F.col("headings") > 0)


def x41_short_title(spark, d):
    return table(spark, d, "requirements").where("description is not null").select("req_id", X.short_title("description").alias("short")).distinct()


def x42_path_kind(spark, d):
    s = nested.skeleton_sections(table(spark, d, "raw_skeletons"))
    return s.groupBy(X.path_kind("title").alias("kind")).agg(F.count("*").alias("n"))


def a18_acceptance(spark, d):
    """Best similarity of each query vector among one label's vectors, and how many support it."""
    base = table(spark, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("id"), "embedding")
    q = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")
    r = V.top_k(base, q, 10)
    best = F.max("cosine")
    g = r.groupBy("query_id").agg(F.round(best, 4).alias("best"), F.count_if(F.col("cosine") >= R.ACCEPT_PARTIAL).alias("support"))
    return g.withColumn("verdict", X.first_match([(F.col("best") >= R.ACCEPT_MATCH, "match"), (F.col("best") >= R.ACCEPT_PARTIAL, "partial")], "missing"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and k[0].islower() and any(c.isdigit() for c in k[:4])}

LN = "ln as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 pos from (select doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') l from documents where text is not null))"
SK = """sk as (select doc_id, arg_max(struct_pack(s := document_skeleton), generated_at).s js from raw_skeletons group by 1),
 jt as (select doc_id, je.key k, je.type t, je.atom a, je.fullkey f, je.value v, je.path pa from sk, json_tree(js) je where js is not null and js <> ''),
 so as (select doc_id, coalesce(json_extract_string(v, '$.section_path'), k) section_path, json_extract_string(v, '$.title') title from jt where t = 'OBJECT'
   and ((f not like '%]' and k similar to '([0-9]+|[A-Z])(\\.[0-9]+)*') or json_extract_string(v, '$.section_path') is not null))"""
TYPE = "case when section_path = 'PREAMBLE' then 'toc' " + " ".join(
    f"when regexp_matches({'section_path' if w == 'path' else chr(39).join(['lower(coalesce(title, ', '', '))'])}, '{p}') then '{k}'" for w, p, k in R.SECTION_TYPES
) + " " + " ".join(f"when regexp_matches(section_path, '{p}') then '{k}'" for w, p, k in R.SECTION_TYPES if w == "path") + " else 'other' end"
ROLE = "case " + " ".join(f"when regexp_matches(trim(line), '(?i)^{k}\\s*:{chr(92) + 's*' + chr(92) + 'S+' if k == 'ID' else ''}') then '{R.LABEL_ROLES[k]}'" for k in R.LABELS) + (
    f" when regexp_matches(trim(line), '(?i)^({'|'.join(R.PLANGUAGE)})\\s*:') then 'planguage_keyword' when regexp_matches(trim(line), '(?i)^({'|'.join(R.GHERKIN)})[:\\s]|^({'|'.join(R.GHERKIN)})\\s+[:\\s]') then 'gherkin_keyword' else 'prose_content' end"
)
_M = lambda p: f"regexp_matches(lower(line), '{p}')"
ROLES = f"""concat_ws(',', case when {_M(R.MODALS)} and {_M(R.BEHAVIOUR)} then 'behaviour' end, case when {_M(R.INPUTS)} then 'input' end, case when {_M(R.OUTPUTS)} then 'output' end, case when {_M(R.CONSTRAINTS)} then 'constraint' end)"""
HEAD = "regexp_matches(line, '^\\s*#*\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$')"
SECS = f"""{LN}, hd as (select *, case when {HEAD} and length(line) < 100 then regexp_extract(line, '^\\s*#*\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 1) end p from ln),
 sc as (select doc_id, pos, line, coalesce(last_value(p ignore nulls) over w, 'PREAMBLE') section_path, cast(count(p) over w as bigint) section_no from hd window w as (partition by doc_id order by pos rows unbounded preceding))"""
WORDS = lambda c: "list_filter(list_distinct(regexp_extract_all(lower(coalesce(" + c + ", '')), '[a-z]+')), lambda x: length(x) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + "], x))"
BUL = "'^\\s*([-*•]|\\d+[.)])\\s+'"
COS = "round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6)"
TOP5 = f"""tk as (select a.vec_id query_id, b.vec_id id, {COS} c from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
 t5 as (select query_id, id, round(c, 4) cosine, cast(r as int) rank from (select *, row_number() over (partition by query_id order by c desc, id) r from tk) where r <= 5)"""
FIRST_NODES = "n as (select distinct node_type, node_id from (select *, row_number() over (partition by node_id order by created_at desc, coalesce(title, '') desc, coalesce(text, '') desc) r from nodes) where r = 1)"

_T = "trim(line)"
_NUM = f"regexp_matches({_T}, '^\\d+(?:\\.\\d+)*')"
METHOD = f"""case when {_T} = '' or length({_T}) > 120 then 'none' when {_NUM} and regexp_matches({_T}, '^(?:\\d+\\.)+\\s+(?:The|If|When|After|Once|This|All|Each|Based)\\b|[:.,]\\s*$') then 'list_item'
  when {_NUM} and length({_T}) > 80 then 'too_long' when {_NUM} then 'numeric' when regexp_matches({_T}, '^[A-Z][A-Z\\s\\-:]{{4,60}}$') then 'allcaps' when suffix({_T}, ':') then 'label'
  when regexp_matches({_T}, '^[A-Z][a-zA-Z0-9\\s\\-:,/()]{{4,79}}[^.?!\\n]$') and length({_T}) <= 60 and regexp_matches({_T}, '\\S\\s+\\S') then 'titlecase' else 'none' end"""
HEADS = f"""{LN}, hm as (select *, {METHOD} method from ln), hl as (select *, cast(case method when 'numeric' then least(len(string_split(regexp_extract({_T}, '^(\\d+(?:\\.\\d+)*)', 1), '.')), 6) when 'allcaps' then 1 when 'titlecase' then 2 end as int) as level from hm)"""
_LAB = "(?i)^\\s*(ID|TITLE|DESC|RAT|DEP|Actor|Status)\\s*:\\s*(.*)$"
ORACLE = {
    "x1_clean_text": f"with {LN} select doc_id, cast(pos as int) pos, md5(trim(regexp_replace(regexp_replace(regexp_replace(line, '[\\x{{2010}}-\\x{{2014}}]', '-', 'g'), '[\\p{{Zs}}\\t\\x{{200b}}]', ' ', 'g'), ' {{3,}}', '  ', 'g'))) h from ln",
    "n5_labelled_values": f"""with {LN}, x as (select *, regexp_extract(line, '{_LAB}', ['l', 't']) m from ln), g as (select doc_id, pos, m, line, cast(sum(case when m.l <> '' then 1 else 0 end) over w as bigint) grp,
        last_value(case when m.l <> '' then upper(m.l) end ignore nulls) over w as label from x window w as (partition by doc_id order by pos rows unbounded preceding)),
      b as (select doc_id, grp, label, coalesce(string_agg(t, ' ' order by pos) filter (t <> ''), '') v from (select *, case when m.l <> '' then trim(m.t) else trim(line) end t from g where label is not null) group by 1, 2, 3)
      select doc_id, label, arg_max(v, grp) as value from b group by 1, 2""",
    "x2_squeeze": "select doc_id, md5(trim(regexp_replace(coalesce(title, ''), '[\\s\\x{00a0}\\x{200b}]+', ' ', 'g'))) h, cast(length(trim(regexp_replace(coalesce(title, ''), '[\\s\\x{00a0}\\x{200b}]+', ' ', 'g'))) as int) n from documents",
    "x5_norm_title": "select regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g') t, count(*) n from nodes group by 1",
    "x6_section_level": "select cast(len(string_split(section_path, '.')) as int) as level, case when contains(section_path, '.') then regexp_replace(section_path, '\\.[^.]+$', '') end parent, count(*) n from nodes group by 1, 2",
    "x9_section_type": f"with {SK} select distinct doc_id, section_path, {TYPE} kind from so",
    "a4_groups_by_type": f"with {SK} select {TYPE} kind, count(*) n, count(distinct doc_id) docs from so group by 1",
    "x10_structural_role": f"with {LN} select {ROLE} as role, count(*) n from ln group by 1",
    "x8_list_items": f"with {LN} select doc_id, count(*) filter (regexp_matches(line, '^\\s*([-*•]|\\d+[.)]|[a-z][.)])\\s+')) items, count(*) n from ln where trim(line) <> '' group by 1",
    "x11_dependencies": f"with {LN} select ref, count(*) n, count(distinct doc_id) docs from (select doc_id, unnest(regexp_extract_all(line, '\\b(?:FR|NFR|UI|SEC|PERF)\\d+\\b')) ref from ln) group by 1",
    "x15_modal_sentences": """with r as (select distinct req_id, description from requirements where description is not null),
      s as (select *, list_filter(string_split(regexp_replace(trim(description), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '' and regexp_matches(lower(x), '\\b(shall|must|will|should|may)\\b')) m from r),
      f as (select req_id, description, case when len(m) > 0 then m else [description] end m from s) select req_id, description, cast(generate_subscripts(m, 1) - 1 as int) pos, unnest(m) sentence from f""",
    "x39_roles": f"with {LN} select case when {ROLES} = '' then 'narrative' else {ROLES} end roles, count(*) n from ln where trim(line) <> '' group by 1",
    "x40_paragraph_score": f"""with {LN}, k as (select *, len(list_filter(string_split({ROLES}, ','), lambda x: x <> '')) nr from ln where trim(line) <> '')
      select round(greatest(0.01, least(0.99, case when {_M(R.MODALS)} then 0.4::double else 0 end + case when {_M(R.BEHAVIOUR)} then 0.3::double else 0 end + 0.05::double + least(nr * 0.025::double, 0.1::double))), 4) score, count(*) n from k group by 1""",
    "a24_section_kinds": f"""with {SECS}, g as (select doc_id, section_path, count(*) n, count(*) filter ({_M(R.MODALS)} and {_M(R.BEHAVIOUR)}) n_strict, count(*) filter ({_M(R.MODALS)}) n_modal from sc where trim(line) <> '' group by 1, 2)
      select *, case when n_strict > 0 then 'REQUIREMENT_SOURCE' when n_modal > 0 then 'SUPPORTING' else 'NARRATIVE' end kind from g""",
    "n3_sections": f"with {SECS} select doc_id, section_path, cast(min(pos) as int) first, count(*) n, max(section_no) section_no from sc group by 1, 2",
    "n8_block_slices": f"with {LN}, g as (select *, cast(sum(case when {HEAD} then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as bigint) grp from ln) select doc_id, grp, cast(min(pos) as int) first, cast(max(pos) as int) as last, count(*) n from g group by 1, 2",
    "n10_fold_items": f"""with {LN}, g as (select *, cast(sum(case when regexp_matches(line, {BUL}) then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as bigint) item from ln where trim(line) <> ''),
      t as (select doc_id, item, string_agg(trim(regexp_replace(line, {BUL}, '')), ' ' order by pos) tx from g group by 1, 2) select doc_id, item, cast(length(tx) as int) n, md5(tx) h from t""",
    "n20_step_categories": f"""with {LN}, s as (select *, lower(regexp_extract(line, '(?i)^\\s*(?:[-*]\\s*)?(Given|When|Then|And|But)\\b', 1)) w from ln),
      k as (select *, coalesce(last_value(case w when 'given' then 'precondition' when 'when' then 'action' when 'then' then 'outcome' end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding), 'outcome') kind from s where w <> '')
      select doc_id, kind, count(*) n, cast(min(pos) as int) first from k group by 1, 2""",
    "n4_positions": f"with {SECS} select doc_id, cast(pos as int) pos, section_path, cast(row_number() over (partition by doc_id, section_path order by section_no, pos) as int) para_index from sc where trim(line) <> ''",
    "j17_parent_titles": f"with {SK}, s as (select distinct * from so), p as (select doc_id, section_path up, min(title) parent_title from s group by 1, 2) select s.doc_id, s.section_path, s.title, p.parent_title from s left join p on p.doc_id = s.doc_id and contains(s.section_path, '.') and p.up = regexp_replace(s.section_path, '\\.[^.]+$', '')",
    "j18_ancestors": f"with {SK}, s as (select distinct doc_id, section_path from so) select b.doc_id, a.section_path ancestor, count(*) n from s b join (select doc_id, section_path from s) a on a.doc_id = b.doc_id and starts_with(b.section_path, a.section_path || '.') group by 1, 2",
    "a2_conditional_counts": "select lang, count(*) n, count(*) filter (text is null) no_text, count(*) filter (trim(text) = '') blank, count(*) filter (n_chars > 10000) large, cast(sum(n_chars) as bigint) chars from documents group by 1",
    "a3_histogram": "select coalesce(section_semantic_type, 'other') kind, count(*) n from requirements group by 1 order by 2 desc, 1",
    "a23_prefix_histogram": "with p as (select unnest(regexp_extract_all(text, '\\b([A-Z]{2,5})\\d{3,}\\b', 1)) prefix from documents), g as (select prefix, count(*) n from p group by 1) select prefix, n from g where n * 10 >= (select max(n) from g) order by n desc, prefix limit 10",
    "x24_ids": "select doc_id, 'PC-' || left(sha1(concat_ws('|', srs_doc_id, req_id)), 10) candidate, 'P_' || sha256(coalesce(srs_doc_id, '') || coalesce(title, '')) parent from documents",
    "k2_json_fields": "select node_type, json_extract_string(extra_json, '$.chunk_type') kind, json_extract_string(source_locator_json, '$.page') is not null has_page, count(*) n from nodes group by 1, 2, 3",
    "k1_json_events": "select event_type, count(k) n, cast(sum(k) as bigint) total, max(k) largest from (select event_type, cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1",
    "n2_event_sessions": """with e as (select *, epoch(date_trunc('second', ts)) t from events), f as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) > 1800 or lag(t) over (partition by user_id order by t, event_id) is null then 1 else 0 end o from e),
      g as (select *, cast(sum(o) over (partition by user_id order by t, event_id rows unbounded preceding) as bigint) session from f) select user_id, session, count(*) n, min(ts) first, max(ts) as last from g group by 1, 2""",
    "m3_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) norm, 1.0::double unit from embeddings",
    "o2_top_k": f"with {TOP5} select * from t5",
    "g7_filtered_search": f"with tk as (select a.vec_id query_id, b.vec_id id, {COS} c from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.label = 1) select query_id, id, round(c, 4) cosine, cast(r as int) rank from (select *, row_number() over (partition by query_id order by c desc, id) r from tk) where r <= 3",
    "a35_mean_top1": f"with {TOP5} select count(*) n, round(avg(cosine), 3) mean from t5 where rank = 1",
    "j15_new_tests": "select distinct test_id, test_id not in (select test_id from test_cases where test_id is not null) is_new from new_test_cases",
    "j16_stat_diff": """with b as (select node_type, count(distinct node_id) n from nodes where created_at < timestamp '2025-06-01' group by 1), a as (select node_type, count(distinct node_id) n from nodes group by 1),
      j as (select 'nodes' kind, coalesce(a.node_type, b.node_type) as name, coalesce(b.n, 0) before, coalesce(a.n, 0) as after from a full join b using (node_type)) select *, case when after > before then '+' || (after - before) when after = before then '±0' else (after - before)::varchar end delta from j""",
    "a20_test_summary": "select count(*) total, count(*) filter (is_new) n_new, " + ", ".join(f"count(*) filter (test_type = '{t}') type_{t}" for t in ("positive", "negative", "edge", "security"))
    + ", count(*) filter (test_type is null or test_type not in ('positive', 'negative', 'edge', 'security')) type_other, count(*) filter (lower(priority) = 'high') high, count(*) filter (ev_kind = 'derived_evidence') derived, round(coalesce(avg(ev_confidence), 0), 4) mean_ev_confidence from new_test_cases",
    "w7_flat_export": "select distinct test_id, array_to_string(list_filter(preconditions, lambda x: x is not null), '; ') preconditions, md5(array_to_string(list_filter(test_steps, lambda x: x is not null), '; ')) steps_md5, loaded_at, priority from test_cases",
    "u1_union": "select test_type, priority, count(*) n from (select test_type, priority from test_cases union all select test_type, priority from new_test_cases) group by 1, 2",
    "u3_shared_words": f"with t as (select distinct req_id, list_sort({WORDS('title')}) a, list_sort({WORDS('description')}) b from requirements) select req_id, cast(len(list_intersect(a, b)) as int) n_both, cast(len(list_filter(a, lambda x: not list_contains(b, x))) as int) only_title, cast(len(b) as int) n_description from t",
    "o8_sample": f"with {FIRST_NODES} select node_type, node_id from (select *, row_number() over (partition by node_type order by md5(node_id), node_id) r from n) where r <= 3",
    "f1_skip_blocks": f"""with {SECS}, b as (select *, null::varchar title, {ROLE} rl from sc), k as (select *, {TYPE} kind from b)
      select kind, (section_path = 'PREAMBLE' or kind = 'toc' or (length(trim(line)) < 8 and rl not in ({', '.join(repr(x) for x in R.LABEL_ROLES.values())})) or regexp_matches(trim(line), '^\\d+$')) skip, count(*) n from k group by 1, 2""",
    "x13_input_format": f"""with {LN}, r as (select doc_id, list_distinct(list({ROLE})) rs from ln group by 1), o as (select doc_id, rs, list_filter(rs, lambda x: x not in ('section_heading', 'req_id_label', 'prose_content', 'table_block')) ot from r)
      select doc_id, case when list_contains(rs, 'req_id_label') and list_contains(rs, 'req_desc_label') then 'labeled' when list_contains(rs, 'req_id_label') and list_contains(rs, 'gherkin_keyword') then 'gherkin'
        when list_contains(rs, 'req_id_label') and len(ot) > 0 and len(list_filter(ot, lambda x: not starts_with(x, 'planguage_'))) = 0 then 'planguage' else 'prose' end format from o""",
    "x14_actor": "select case " + " ".join(f"when contains(lower(concat_ws(' ', actor, description)), '{w}') then '{k}'" for w, k in R.ACTORS) + f" else '{R.ACTOR_OTHER}' end actor, count(*) n from requirements group by 1",
    "x19_provenance_confidence": """select extraction_method, case when extraction_method in ('deterministic', 'llm', 'llm_structured') then case when actor is null or dependencies is null or acceptance_criteria is null then 'medium' else 'high' end else 'low' end confidence, count(*) n
      from requirements group by 1, 2""",
    "x21_unit_type": f"""with r as (select *, {TYPE} kind from requirements) select kind, case when kind in ('functional_requirements', 'interface_requirements', 'performance_requirements') then 'security' when kind = 'design_constraints' then 'constraint'
      when kind = 'quality_attributes' then case {' '.join(f"when contains(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '{w}') then '{k}'" for w, k in R.QUALITY_TYPES)} else 'quality' end else 'security' end as type,
      case extraction_method when 'deterministic' then 'high' when 'llm' then 'medium' when 'regex_fallback' then 'low' else 'low' end confidence, count(*) n from r group by 1, 2, 3""",
    "x35_heading": f"with {HEADS} select level, method, count(*) n from hl group by 1, 2",
    "a28_ingestion_audit": f"""with {HEADS}, g as (select doc_id, count(*) lines, count(*) filter (method = 'numeric') as numeric, count(level) headings, cast(max(length(line)) as int) longest from hl where trim(line) <> '' group by 1) select *, headings > 0 structured from g""",
    "x42_path_kind": f"with {SK} select case " + " ".join(f"when regexp_matches(lower(coalesce(title, '')), '{w}') then '{k}'" for w, k in R.PATH_KINDS) + f" else '{R.PATH_KIND_OTHER}' end kind, count(*) n from so group by 1",
    "x41_short_title": """with r as (select distinct req_id, trim(description) t from requirements where description is not null), s as (select *, coalesce(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1], '') sn, string_split(t, chr(10))[1] ln from r),
      b as (select *, case when length(sn) <= length(ln) then sn else ln end best from s), w as (select *, list_filter(string_split_regex(best, '\\s+'), lambda x: x <> '') ws from b)
      select distinct req_id, case when len(ws) <= 12 then trim(best) else array_to_string(ws[1:12], ' ') || '...' end short from w""",
    "a18_acceptance": f"""with tk as (select a.vec_id query_id, {COS} c from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.label = 2), r as (select *, row_number() over (partition by query_id order by c desc) k from tk),
      g as (select query_id, round(max(c), 4) best, count(*) filter (c >= 0.5) support from r where k <= 10 group by 1) select *, case when best >= 0.65 then 'match' when best >= 0.5 then 'partial' else 'missing' end verdict from g""",
}
