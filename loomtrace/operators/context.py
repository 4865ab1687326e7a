"""Context packs: evidence, parents, paths and warnings per anchor, as one nested row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import rules as R


def warnings(anchors: DataFrame, evidence: DataFrame, required: list[str], fallback: DataFrame | None = None) -> DataFrame:
    """(anchor, code, ref): per anchor no evidence at all (then nothing else of its evidence), a required field that is
    missing on a chunk, a vector hit below the similarity floor, a fallback that was used.

    ``anchors`` (anchor), ``evidence`` (anchor, node_id, score, provenance and the required fields), ``fallback`` (anchor, fallback).
    """
    a = anchors.select("anchor").distinct()
    none = a.join(evidence.select("anchor"), "anchor", "left_anti").select("anchor", F.lit("MISSING_EVIDENCE").alias("code"), F.lit(None).cast("string").alias("ref"))
    e = evidence.join(a, "anchor", "left_semi")
    codes = F.array_compact(F.array(
        *[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f"MISSING_FIELD:{f}")) for f in required],
        F.when((F.col("provenance") != "graph") & (F.col("score") < R.MIN_SIMILARITY), F.lit("LOW_CONFIDENCE_VECTOR")),
    ))
    parts = [none, e.select("anchor", F.explode(codes).alias("code"), F.col("node_id").alias("ref"))]
    if fallback is not None:
        with_evidence = fallback.where("fallback").join(evidence.select("anchor"), "anchor", "left_semi")
        parts.append(with_evidence.select("anchor", F.lit("VECTOR_FALLBACK_TRIGGERED").alias("code"), F.lit(None).cast("string").alias("ref")))
    return reduce(DataFrame.unionByName, parts)


def pack(anchors: DataFrame, evidence: DataFrame, parents: DataFrame, notes: DataFrame, arrivals: DataFrame, k_related: int = 20) -> DataFrame:
    """(anchor, evidence, parents, related, warnings): arrays of structs; every list is bounded by its own k.

    ``parents`` (child, parent, confidence, rank) as ``graph.parent_context`` gives it.
    """
    a = anchors.select("anchor").distinct()
    ev = evidence.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "score"))).alias("evidence"))
    up = evidence.select("anchor", F.col("node_id").alias("child")).join(parents, "child").groupBy("anchor").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    first = Window.partitionBy("anchor").orderBy("depth", F.desc("score"), "node_id")
    rel = arrivals.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k_related).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("r", "node_id"))).alias("related"))
    nt = notes.groupBy("anchor").agg(F.array_sort(F.collect_set(F.struct("code", "ref"))).alias("warnings"))
    return reduce(lambda x, y: x.join(y, "anchor", "left"), [ev, up, rel, nt], a)


def capped_parents(evidence: DataFrame, parents: DataFrame) -> DataFrame:
    """(anchor, parent, place): parents of an anchor's evidence in the order in which they are first met, at most as many as it has children.

    ``evidence`` (anchor, child, child_rank), ``parents`` (child, parent, confidence, rank).
    """
    met = evidence.join(parents, "child").groupBy("anchor", "parent").agg(F.min(F.struct("child_rank", "rank")).alias("m"))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("m", "parent")))
    n = evidence.groupBy("anchor").agg(F.count("*").alias("children"))
    return placed.join(n, "anchor").where("place <= children").select("anchor", "parent", "place")


def check_citations(tests: DataFrame, evidence: DataFrame) -> DataFrame:
    """(test_id, n_steps, citations, code): cited chunks outside the evidence are dropped; what is then wrong with the test, null if nothing.

    ``tests`` (test_id, anchor, test_steps, expected_result, citations), ``evidence`` (anchor, node_id).
    """
    cited = tests.select("test_id", "anchor", F.explode("citations").alias("node_id")).join(evidence.select("anchor", "node_id").distinct(), ["anchor", "node_id"], "left_semi")
    good = cited.groupBy("test_id").agg(F.array_sort(F.collect_set("node_id")).alias("kept"))
    t = tests.join(good, "test_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    n = F.coalesce(F.size("test_steps"), F.lit(0))
    code = F.when(n < 1, "no_steps").when(F.trim(F.coalesce("expected_result", F.lit(""))) == "", "no_expected_result").when(F.size("kept") == 0, "unresolved")
    return t.select("test_id", F.greatest(n, F.lit(0)).alias("n_steps"), F.col("kept").alias("citations"), code.alias("code"))
