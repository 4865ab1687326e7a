"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.llm import mix, neardup, pack, residue, split, tokens, vectors
from loomtrace.session import materialize, table


def _nearest(spark, d):
    return vectors.nearest(table(spark, d, "node_embeddings"), "node_id", "embedding_bytes", "created_at")


def p2_found(spark, d):
    n = _nearest(spark, d)
    return n.select(F.least("node_id", "neighbour").alias("node_a"), F.greatest("node_id", "neighbour").alias("node_b")).distinct()


def p2_neighbours(spark, d):
    return _nearest(spark, d)


def p3_found(spark, d):
    return residue.residue_fields(table(spark, d, "test_cases"))


def p3_clean(spark, d):
    return residue.clean_tests(table(spark, d, "test_cases"))


SIMILARITY = 0.6


def _similar(spark, d):
    classes, members = neardup.word_classes(table(spark, d, "new_test_cases"), "test_id", ["title", "description"])
    return classes, members, neardup.similar_classes(classes, SIMILARITY)


def p4_found(spark, d):
    _, members, pairs = _similar(spark, d)
    return neardup.similar_pairs(members, pairs)


def p4_groups(spark, d):
    """One row per test: its class of equal word sets, its group, and the class's number of links. Both are named by their smallest test_id."""
    classes, members, pairs = _similar(spark, d)
    names = materialize(members.groupBy("cid").agg(F.min("id").alias("class_id")), "names")
    name = lambda c: names.select(F.col("cid").alias(c), F.col("class_id").alias(f"class_{c}"))
    edges = pairs.select("a", "b").join(name("a"), "a").join(name("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    groups = neardup.components(names.select(F.col("class_id").alias("id")).distinct(), edges)
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n_links"))
    per_class = names.join(groups.select(F.col("id").alias("class_id"), F.col("label").alias("group_id")), "class_id").join(ends, "cid", "left")
    return members.join(per_class, "cid").select(F.col("id").alias("test_id"), "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _limits(spark, d, purpose):
    return table(spark, d, "size_limits").where(F.col("purpose") == purpose)


def _packed(spark, d):
    # Sized once and written: the packing reads the sizes for the histogram and again for the assignment.
    sizes = materialize(tokens.with_token_counts(table(spark, d, "documents"), ["doc_id"]), "sizes")
    return pack.pack(sizes, _limits(spark, d, "pack"))


def p7_assignment(spark, d):
    return _packed(spark, d)


def p7_fill(spark, d):
    return pack.fill(_packed(spark, d), _limits(spark, d, "pack"))


def _sized(spark, d):
    return materialize(tokens.with_token_counts(table(spark, d, "documents"), ["doc_id", "source"]), "sizes")


def p8_mixture(spark, d):
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    uses, _ = mix.thresholds(mix.named(_sized(spark, d)), mix.target_map(targets))
    used = mix.taken(docs.select("doc_id", "source", "text").where("text <> ''"), uses)
    # Only the texts that are used are counted again: cheaper than a join that would move every text.
    counted = tokens.with_token_counts(used, ["doc_id", "src", "uses", "text"])
    return counted.select("doc_id", "src", "n_tokens", F.explode(F.sequence(F.lit(1), "uses")).alias("repeat"), "text")


def p8_report(spark, d):
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mix.report(sized, mix.mixture(sized, targets), targets)


def p8_report_all(spark, d):
    """The mixture as large as all texts of the targeted sources: small sources are repeated up to their caps and fall short."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    known = list(mix.target_map(targets))
    total = mix.named(sized).where(F.col("src").isin(known)).agg(F.sum("n_tokens")).first()[0]
    return mix.report(sized, mix.mixture(sized, targets, total), targets)


def p9_pieces(spark, d):
    return split.split(table(spark, d, "documents"), _limits(spark, d, "split"))


def p9_summary(spark, d):
    return split.summary(p9_pieces(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("p") and k[1:2].isdigit()}

_WORDS = """
with w as (select distinct test_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[a-z0-9]+'))) ws
  from new_test_cases where test_id is not null)
"""

ORACLE = {
    "p4_found": _WORDS
    + """select distinct least(a.test_id, b.test_id) test_a, greatest(a.test_id, b.test_id) test_b
  from w a join w b on a.test_id < b.test_id
  where len(a.ws) > 0 and len(b.ws) > 0 and len(list_intersect(a.ws, b.ws)) >= 0.6 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))""",
}
