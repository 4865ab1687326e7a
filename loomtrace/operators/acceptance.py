"""Acceptance records: read from labelled text, linked to requirements, units and tests, classified and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import segment as S

LISTS = ("precondition", "test_steps")
STEP = r"^\s*(?:\d+[.)](?!\d)|[•\-*])\s*"
STOP = r"(?i)^(?:\d+\.\d*\s+(?:identified|summary|sign|change|new req)|table\s+\d+|[45]\.\s|\d+\.\d+(?:\.\d+)?\s+\S)"


def id_prefixes(lines_: DataFrame, labels: dict[str, str] = R.FIELD_LABELS, share: float = 0.1, most: int = 10) -> DataFrame:
    """(prefix, n): the prefixes of requirement ids that stand on lines labelled so; if there are none, those of all ids
    that are at least ``share`` as frequent as the most frequent one, at most ``most``."""
    names = "|".join(k for k, v in labels.items() if v == "req_ids")
    ids = lambda c: F.regexp_extract_all(c, F.lit(R.REQ_ID), F.lit(0))
    named = F.regexp_extract("line", rf"(?i)(?:{names})\s*:?\s*(.+)", 1)
    each = lines_.select(F.explode(ids("line")).alias("id"), F.array_contains(ids(named), F.col("id")).alias("named"))
    n = each.groupBy(F.regexp_extract("id", "^[A-Z]+", 0).alias("prefix")).agg(F.count("*").alias("n"), F.count_if("named").alias("n_named"))
    whole = Window.partitionBy(F.lit(1))  # one row per prefix: a handful
    n = n.withColumns({"top": F.max("n").over(whole), "any": F.max("n_named").over(whole) > 0, "r": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "prefix"))})
    return n.where((F.col("any") & (F.col("n_named") > 0)) | (~F.col("any") & (F.col("n") >= share * F.col("top")) & (F.col("r") <= most))).select("prefix", F.when(F.col("any"), F.col("n_named")).otherwise(F.col("n")).alias("n"))


def records(lines_: DataFrame, header: str = R.RECORD_HEADER, labels: dict[str, str] = R.FIELD_LABELS, req_id: str = R.REQ_ID, id_col: str = "doc_id") -> DataFrame:
    """(id, record_no, uat_id, title, actor_class, req_ids, description, precondition, test_steps, expected_result, actual_result, status, observations).

    A header line opens a record; a numbered section heading ends it. A label's value stands on its own line, else on the lines up to the
    next label; numbered lines after a value on the label's line are steps. Of a field that is labelled twice the last value counts, of
    lists all items. Where a two-column layout put the values of an empty description or precondition in front of the first step,
    they go back, in the order of the labels (``repaired``); a status that stands in a later field is taken out of it.
    """
    part = [id_col]
    b = S.running_group(lines_, F.trim("line").rlike(header), part, "pos", "record_no").where("record_no > 0")
    block = [id_col, "record_no"]
    w = Window.partitionBy(*block).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.trim("line")
    is_header = t.rlike(header)
    b = b.withColumn("stopped", F.max((~is_header & t.rlike(STOP) & ~t.rlike(STEP)).cast("int")).over(w)).where("stopped = 0").drop("stopped")
    b = b.withColumn("k", F.row_number().over(Window.partitionBy(*block).orderBy("pos")) - 1)
    pattern = rf"(?i)^\s*({'|'.join(labels)})\s*(?::(.*))?$"
    fields = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    own = F.when(~is_header & t.rlike(pattern), fields[F.lower(F.regexp_extract(t, pattern, 1))])
    b = b.withColumn("own", own).withColumn("inline", F.when(F.col("own").isNotNull(), F.trim(F.regexp_extract(t, pattern, 2))))
    b = b.withColumns({"field": F.last("own", ignorenulls=True).over(w), "value_on_line": F.last("inline", ignorenulls=True).over(w) != "", "label_no": F.count("own").over(w)})
    stray = F.col("value_on_line") & F.col("own").isNull()
    # A step after a value on the label's own line has no label: it is a step. Other lines after such a value are nobody's.
    b = b.withColumn("field", F.when(stray & F.col("line").rlike(STEP), "test_steps").when(stray & F.lit(True), F.lit(None)).otherwise(F.col("field")))
    value = F.when(F.col("own").isNotNull(), F.col("inline")).otherwise(t)
    b = b.withColumn("value", F.when(~is_header & (value != ""), value))
    actor = X.first_match([(F.col("k") > 9, F.lit(None).cast("string")), (t.rlike(R.ACTOR_BLOCK), F.trim(F.regexp_extract(t, R.ACTOR_BLOCK, 1))),
                           (F.lower(t).contains("actor") & t.rlike("[:-]"), F.trim(F.regexp_extract(t, "^[^:-]*[:-](.*)$", 1)))], F.lit(None).cast("string"))
    heads = F.struct(F.regexp_extract(t, header, 1).alias("uat_id"), F.trim(F.regexp_extract(t, header, 2)).alias("title"))
    got = F.filter(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull() & F.col("field").isNotNull(), F.struct("pos", "label_no", "field", "value")))), lambda x: x.isNotNull())
    g = b.groupBy(*block).agg(
        F.min_by(heads, "pos").alias("h"), F.min_by(actor, F.when(actor.isNotNull(), F.col("pos"))).alias("actor_class"), got.alias("got"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("pos", "own")))), lambda x: x["own"]).alias("order"),
    )

    def lines_of(field: str) -> Column:
        mine = F.filter("got", lambda x: x["field"] == field)
        last = F.array_max(F.transform(mine, lambda x: x["label_no"]))
        kept = mine if field in LISTS else F.filter(mine, lambda x: x["label_no"] == last)
        return F.transform(kept, lambda x: x["value"])

    raw = {f: lines_of(f) for f in ("req_ids", "description", *LISTS, "expected_result", "actual_result", "status", "observations")}
    g = g.select(*block, F.upper("h.uat_id").alias("uat_id"), "h.title", "actor_class", "order", *[v.alias(f) for f, v in raw.items()])
    # Lines before the first step go back to the empty fields that are labelled before the steps.
    at = lambda f: F.when(F.array_contains("order", f), F.array_position("order", f))
    before_steps = lambda f: (F.size(f) == 0) & F.coalesce(at(f) < at("test_steps"), F.lit(False))
    first = F.array_position(F.transform("test_steps", lambda x: x.rlike(STEP)), True)
    pre = F.when(first > 1, F.slice("test_steps", F.lit(1), (first - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    wants = F.array_compact(F.array(F.when(before_steps("description"), F.struct(at("description").alias("at"), F.lit("description").alias("f"))), F.when(before_steps("precondition"), F.struct(at("precondition").alias("at"), F.lit("precondition").alias("f")))))
    g = g.withColumn("pre", pre).withColumn("wants", F.transform(F.array_sort(wants), lambda x: x["f"]))
    n = F.least(F.size("pre"), F.size("wants"))
    taken = lambda f: F.when(F.array_contains("wants", f) & (F.array_position("wants", f) <= F.size("pre")), F.array(F.try_element_at("pre", F.array_position("wants", f).cast("int")))).otherwise(F.col(f))
    g = g.withColumns({"moved": n, "description": taken("description"), "precondition": taken("precondition")})
    g = g.withColumn("test_steps", F.expr("slice(test_steps, moved + 1, greatest(size(test_steps) - moved, 0))"))
    text = lambda f: F.trim(F.array_join(f, " ")).alias(f)
    items = lambda f: F.filter(F.transform(F.split(F.regexp_replace(F.array_join(f, "\n"), rf"(?m){STEP}", "\u0001"), "\u0001"), lambda x: F.trim(F.regexp_replace(x, "\n", " "))), lambda x: x != "").alias(f)
    ids = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join("req_ids", " "), F.lit("(?i)" + req_id), F.lit(0)), lambda x: F.upper(x))).alias("req_ids")
    g = g.select(*block, "uat_id", "title", F.coalesce("actor_class", F.lit("")).alias("actor_class"), ids, text("description"), items("precondition"), items("test_steps"), text("expected_result"), text("actual_result"), text("status"), text("observations"), (F.col("moved") > 0).alias("repaired"), "order")
    # A status in a later field: the first such field gives it up.
    token = rf"(?i)(?:^|\s)({'|'.join(R.STATUSES)})(?=\s|$)"
    lost = (F.col("status") == "") & F.array_contains("order", "status")
    later = lambda f: lost & F.coalesce(at(f) > at("status"), F.lit(False)) & F.col(f).rlike(token)
    places = F.array_compact(F.array(*[F.when(later(f), F.struct(at(f).alias("at"), F.lit(f).alias("f"))) for f in ("description", "expected_result", "actual_result", "observations")]))
    g = g.withColumn("gives", F.array_min(places)["f"])
    found = F.coalesce(*[F.when(F.col("gives") == f, F.regexp_extract(f, token, 1)) for f in ("description", "expected_result", "actual_result", "observations")], F.col("status"))
    less = lambda f: F.when(F.col("gives") == f, F.trim(F.regexp_replace(f, token, ""))).otherwise(F.col(f))
    g = g.withColumn("status", F.when(found != "", X.status(found)).otherwise(""))
    return g.withColumns({f: less(f) for f in ("description", "expected_result", "actual_result", "observations")}).withColumn("repaired", F.col("repaired") | F.col("gives").isNotNull()).drop("order", "gives")


def spec_text(fields: list[str]) -> Column:
    """The first of the fields that is not blank."""
    return F.coalesce(*[F.when(F.trim(f) != "", F.trim(f)) for f in fields], F.lit(""))


def evidence_text(actual: str, expected: str, observations: str, description: str) -> Column:
    """What was seen, or else expected, then observations and description."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" ", F.coalesce(some(actual), some(expected)), some(observations), some(description))


def _ids(records_: DataFrame) -> DataFrame:
    return records_.select("uat_id", F.posexplode("req_ids").alias("pos", "r")).select("uat_id", "pos", F.upper(F.trim("r")).alias("req_id")).where("req_id <> ''")


def _units(crus: DataFrame) -> DataFrame:
    return crus.where("cru_id is not null").select(F.upper(F.trim("parent_requirement_id")).alias("req_id"), "cru_id").where("req_id <> ''").distinct()


def link(records_: DataFrame, crus: DataFrame, tests: DataFrame) -> DataFrame:
    """(uat_id, status, cru_count, test_count, unmatched): units of a record's requirements, tests of those units, and ids without a unit.

    Units and tests are made distinct and tests counted before they are joined.
    """
    ids = _ids(records_).select("uat_id", "req_id").distinct()
    t = tests.where("test_id is not null").select(F.col("requirement_id").alias("cru_id"), "test_id").distinct().groupBy("cru_id").agg(F.count("*").alias("n"))
    u = _units(crus).join(t, "cru_id", "left").groupBy("req_id").agg(F.count("*").alias("n_crus"), F.sum(F.coalesce("n", F.lit(0))).alias("n_tests"))
    j = ids.join(u, "req_id", "left").groupBy("uat_id").agg(
        F.coalesce(F.sum("n_crus"), F.lit(0)).alias("cru_count"), F.coalesce(F.sum("n_tests"), F.lit(0)).alias("test_count"), F.array_sort(F.collect_list(F.when(F.col("n_crus").isNull(), F.col("req_id")))).alias("unmatched")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return records_.select("uat_id", "status").join(j, "uat_id", "left").select("uat_id", "status", zero("cru_count"), zero("test_count"), F.coalesce("unmatched", F.array().cast("array<string>")).alias("unmatched"))


def classify(linked: DataFrame) -> DataFrame:
    """Adds the first coverage class that applies and a sentence that says why."""
    s = F.upper(F.coalesce("status", F.lit("")))
    conditions = [F.col("cru_count") == 0, F.col("test_count") == 0, s == "FAIL", s == "NOT_TESTED", s == "PARTIAL", s == "INFERRED", F.lit(True)]
    c = X.first_match(list(zip(conditions, R.COVERAGE_CLASSES, strict=True)))
    said = F.concat_ws(
        " ", F.concat(F.lit("UAT "), F.coalesce(F.nullif("status", F.lit("")), F.lit("UNKNOWN")), F.lit(".")),
        F.when(F.col("cru_count") > 0, F.concat("cru_count", F.lit(" CRU(s) and "), "test_count", F.lit(" test case(s) linked."))).otherwise("No CRUs matched."),
        F.when(F.size("unmatched") > 0, F.concat(F.lit("Unmatched req_ids: "), F.array_join("unmatched", ", "), F.lit("."))),
    )
    return linked.withColumns({"classification": c, "summary": said})


def summary(classified: DataFrame) -> DataFrame:
    """(classification, n, cru_count, test_count, covered, rate): every class, also those without a record; rate is of all records, in per cent."""
    spark = classified.sparkSession
    classes = spark.createDataFrame([(c, c in R.COVERED_CLASSES) for c in R.COVERAGE_CLASSES], "classification string, covered boolean")
    g = classified.groupBy("classification").agg(F.count("*").alias("n"), F.sum("cru_count").alias("cru_count"), F.sum("test_count").alias("test_count"))
    whole = classified.agg(F.count("*").alias("__all"), F.count_if(F.col("classification").isin(R.COVERED_CLASSES)).alias("__covered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return classes.join(g, "classification", "left").join(whole).select("classification", zero("n"), zero("cru_count"), zero("test_count"), "covered", F.round(100.0 * F.col("__covered") / F.greatest("__all", F.lit(1)), 1).alias("rate"))


def tested_ids(records_: DataFrame, passing: tuple[str, ...] = ("PASS",)) -> DataFrame:
    """(req_id): requirements named by a record that passed."""
    return _ids(records_.where(F.col("status").isin(*passing))).select("req_id").distinct()


def uncovered_units(records_: DataFrame, crus: DataFrame, inferred: DataFrame) -> DataFrame:
    """(cru_id, req_id): units whose requirement no record names and nothing infers."""
    known = _ids(records_).select("req_id").unionByName(inferred.select("req_id"))
    return _units(crus).join(known, "req_id", "left_anti").select("cru_id", "req_id")


def missing_ids(records_: DataFrame, crus: DataFrame) -> DataFrame:
    """(req_id, first_uat, n): requirements that records name and no unit has, with the first record that names them."""
    gone = _ids(records_).join(_units(crus).select("req_id"), "req_id", "left_anti")
    return gone.groupBy("req_id").agg(F.min(F.struct("uat_id", "pos"))["uat_id"].alias("first_uat"), F.countDistinct("uat_id").alias("n"))


def inferred_records(inferred: DataFrame) -> DataFrame:
    """A record for each requirement that is satisfied through its dependencies only."""
    return inferred.where("round > 0").select(F.concat(F.lit("INFERRED-"), "req_id").alias("uat_id"), F.lit("INFERRED").alias("status"), F.array("req_id").alias("req_ids"))
