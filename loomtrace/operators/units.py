"""Requirement units: validation rules, chunking, tags and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X

VALID_CONFIDENCE = ["high", "medium", "low"]
VALID_TYPES, BONUS = R.VALID_TYPES, R.BONUS


def explode_actions(requirements: DataFrame) -> DataFrame:
    """One unit per action (req_id, cru_id, pos, action): precondition-like actions of scenarios are dropped; none left gives one unit without action.

    Units are numbered within their requirement, so no global order is needed.
    """
    state = X.any_of([F.lit(False), *[F.lower(F.trim(F.col("a"))).rlike(p) for p in R.PRECONDITIONS]])
    base = requirements.where("req_id is not null").select("req_id", "input_format", F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))
    all_ = base.select("req_id", "input_format", F.posexplode_outer("actions").alias("p", "a"))
    kept = all_.withColumn("ok", F.col("a").isNotNull() & ~(F.coalesce(F.col("input_format") == "gherkin", F.lit(False)) & state))
    good = kept.where("ok").select("req_id", "p", F.col("a").alias("action"))
    none = base.select("req_id").distinct().join(good.select("req_id").distinct(), "req_id", "left_anti").select("req_id", F.lit(0).alias("p"), F.lit(None).cast("string").alias("action"))
    w = Window.partitionBy("req_id").orderBy("p", F.coalesce("action", F.lit("")))
    return good.distinct().unionByName(none).withColumn("n", F.row_number().over(w)).select(
        "req_id", F.format_string("CRU-%s-%02d", "req_id", "n").alias("cru_id"), (F.col("n") - 1).alias("pos"), "action"
    )


def validate(crus: DataFrame, requirement_ids: DataFrame, section_paths: DataFrame) -> DataFrame:
    """(cru_id, code): V1 duplicate ids, one row each; other rows are checked by V2..V7. The lookups are semi-join flags."""
    w = Window.partitionBy("cru_id")
    counted = crus.withColumn("copies", F.count("*").over(w))
    v1 = counted.where("copies > 1").select("cru_id", F.lit("ERR-DUPLICATE-CRU-ID").alias("code")).distinct()
    known = requirement_ids.select(F.col("req_id").alias("parent_requirement_id"), F.lit(True).alias("has_parent")).distinct()
    paths = section_paths.select(F.col("section_path").alias("path"), F.lit(True).alias("has_path")).distinct()
    one = counted.where("copies = 1").withColumn("path", F.col("traceability.section_path"))
    one = one.join(known, "parent_requirement_id", "left").join(paths, "path", "left")
    path = F.col("path")
    code = lambda cond, name: F.when(cond, name)
    flags = F.array_compact(F.array(
        code(F.col("has_parent").isNull(), "ERR-UNKNOWN-PARENT-REQ-ID"),
        code(F.trim(F.coalesce("actor", F.lit(""))) == "", "ERR-MISSING-ACTOR"),
        code(F.col("action_text").isNull(), "ERR-UNEXPECTED-NULL-ACTION"),
        code(F.col("confidence").isNull() | ~F.col("confidence").isin(VALID_CONFIDENCE), "ERR-INVALID-CONFIDENCE"),
        F.when(F.coalesce(path, F.lit("")) == "", "ERR-MISSING-TRACEABILITY").when(~path.rlike(r"^\d+(\.\d+)*$"), "ERR-MALFORMED-SECTION-PATH").when(
            F.col("has_path").isNull(), "ERR-SECTION-PATH-NOT-IN-SKELETON"),
        code(F.col("cru_type").isNull() | ~F.col("cru_type").isin(VALID_TYPES), "ERR-INVALID-CRU-TYPE"),
    ))
    return v1.unionByName(one.select("cru_id", F.explode(flags).alias("code")))


def chunk(crus: DataFrame, size: int = 4) -> DataFrame:
    """(chunk_no, parent, slice, pos, cru_id): units sorted within their requirement and cut into slices of ``size``.

    The chunk number is global, yet no global window over the units is needed: slices are counted per
    requirement, and only those counts (one row per requirement) are summed up in order, in ranges.
    """
    parent = F.coalesce(F.nullif("parent_requirement_id", F.lit("")), F.lit("UNKNOWN"))
    w = Window.partitionBy("parent").orderBy(F.coalesce("section", F.lit("")), "cru_id")
    placed = (
        crus.where("cru_id is not null").select(parent.alias("parent"), F.col("traceability.section_path").alias("section"), "cru_id", "cru_type").distinct()
        .withColumn("rn", F.row_number().over(w) - 1)
        .select("parent", "cru_id", "cru_type", F.floor(F.col("rn") / size).cast("int").alias("slice"), (F.col("rn") % size).alias("pos"))
    )
    groups = placed.groupBy("parent").agg((F.max("slice") + 1).alias("slices"))
    return placed.join(running_total(groups, "parent", "slices", "before"), "parent").select(
        (F.col("before") + F.col("slice") + 1).alias("chunk_no"), "parent", "slice", "pos", "cru_id", "cru_type"
    )


def running_total(df: DataFrame, key: str, value: str, name: str, prefix: int = 6) -> DataFrame:
    """(key, name): the sum of ``value`` over all smaller keys of a unique string key, in two levels.

    Keys are grouped by their first letters: totals of groups are summed in one small window, keys within
    their group in another, so no single task sees all keys.
    """
    g = df.select(key, value, F.substring(key, 1, prefix).alias("__g"))
    totals = g.groupBy("__g").agg(F.sum(value).alias("t"))
    ahead = totals.withColumn("__b", F.coalesce(F.sum("t").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__g", "__b")
    w = Window.partitionBy("__g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("__i", F.coalesce(F.sum(value).over(w), F.lit(0))).join(ahead, "__g").select(key, (F.col("__b") + F.col("__i")).alias(name))


def chunk_types(chunked: DataFrame) -> DataFrame:
    """(chunk_no, chunk_type, n): one distinct type names the chunk, else it is mixed."""
    g = chunked.groupBy("chunk_no").agg(F.min("cru_type").alias("a"), F.max("cru_type").alias("z"), F.count("*").alias("n"))
    return g.select("chunk_no", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise("mixed").alias("chunk_type"), "n")


def chunk_report(chunked: DataFrame, size: int = 4) -> DataFrame:
    """One row: number of chunks, units, distinct units, smallest, largest and mean size, whether the limit holds and a unit is in two chunks."""
    g = chunked.groupBy("chunk_no").agg(F.count("*").alias("n"))
    ids = chunked.agg(F.countDistinct("cru_id").alias("unique_units"))
    return g.agg(
        F.count("*").alias("chunks"), F.sum("n").alias("units"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 2).alias("mean"),
        F.bool_and(F.col("n") <= size).alias("within_limit"),
    ).join(ids).withColumn("duplicates", F.col("units") > F.col("unique_units"))  # one row each




def capability_tags(units: DataFrame, key: str, text: Column, kind: str, k: int = 3) -> DataFrame:
    """(key, tag, score, rank): +1 per text that holds a tag's word, +2 if a unit has the tag's type; the k best.

    Of equal scores the tag hit first (by text, then by list order) is better, and tags only given by a type
    come last; a key without any tag gets Generic. Tags are expanded as an array in place, not by a join.
    """
    t = F.lower(text)
    labels = list(R.CAPABILITIES)
    hits = F.array_compact(F.array(*[
        F.when(t.rlike("|".join(R.CAPABILITIES[tag])), F.struct(F.lit(tag).alias("tag"), F.lit(i).alias("at"))) for i, tag in enumerate(labels)
    ]))
    extra = F.create_map(*[F.lit(x) for a, b in BONUS.items() for x in (a, b)])
    order = F.create_map(*[F.lit(x) for i, b in enumerate(BONUS.values()) for x in (b, i)])
    given = extra[F.col(kind)]
    # Every unit counts for its tags, for that of its type, and for its key, which may have no tag at all: one aggregate of all three.
    own = F.transform(hits, lambda h: F.struct(h["tag"].alias("tag"), F.lit(1).alias("n"), (F.col("pos") * 100 + h["at"]).cast("long").alias("first"), F.lit(False).alias("bonus")))
    typed = F.when(given.isNotNull(), F.array(F.struct(given.alias("tag"), F.lit(0).alias("n"), (F.lit(1_000_000_000) + order[given]).cast("long").alias("first"), F.lit(True).alias("bonus"))))
    key_only = F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("first"), F.lit(False).alias("bonus")))
    each = units.select(F.col(key).alias("key"), F.explode(F.concat(own, F.coalesce(typed, F.slice(own, 1, 0)), key_only)).alias("x"))
    g = each.groupBy("key", "x.tag").agg(F.sum("x.n").alias("n"), F.min("x.first").alias("first"), F.bool_or("x.bonus").alias("bonus"))
    g = g.withColumn("score", (F.col("n") + F.when(F.col("bonus"), 2).otherwise(0)).cast("long"))
    w = Window.partitionBy("key").orderBy(F.col("tag").isNull().cast("int"), F.desc("score"), "first")
    # The row without a tag comes last, so it is in front only where the key has none.
    top = g.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("tag").isNotNull() | (F.col("rank") == 1)))
    return top.select("key", F.coalesce("tag", F.lit("Generic")).alias("tag"), "score", "rank")


def traceability_sets(chunks: DataFrame) -> DataFrame:
    """Distinct sorted sets of a chunk's sources, nulls dropped: (chunk_id, requirements, sections, docs) as joined texts."""
    s = lambda f: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.col(f"traceability.{f}")))), ",")
    return chunks.select("chunk_id", s("source_requirements").alias("requirements"), s("sections").alias("sections"), s("doc_ids").alias("docs")).distinct()
