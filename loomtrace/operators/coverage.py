"""Coverage: linking of requirements, units and tests, verdicts, inference and gaps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.session import materialize


def link(requirements: DataFrame, crus: DataFrame, tests: DataFrame) -> DataFrame:
    """(req_id, n_crus, n_tests): distinct units of each requirement and distinct tests of those units.

    Both sides are made distinct before they are joined, so repeated rows and hot keys cost nothing twice.
    """
    c = crus.where("cru_id is not null").select(F.upper(F.trim("parent_requirement_id")).alias("req_id"), "cru_id").distinct()
    t = tests.where("test_id is not null").select(F.col("requirement_id").alias("cru_id"), "test_id").distinct().groupBy("cru_id").agg(F.count("*").alias("n"))
    per = c.join(t, "cru_id", "left").groupBy("req_id").agg(F.count("*").alias("n_crus"), F.sum(F.coalesce("n", F.lit(0))).alias("n_tests"))
    r = requirements.where("req_id is not null").select(F.upper(F.trim("req_id")).alias("req_id")).distinct()
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return r.join(per, "req_id", "left").select("req_id", zero("n_crus"), zero("n_tests"))


def classify(linked: DataFrame) -> DataFrame:
    return linked.withColumn(
        "classification", X.first_match([(F.col("n_crus") == 0, "NO_CRU_MATCH"), (F.col("n_tests") == 0, "NO_TEST_CASE")], "FULL_COVERAGE")
    )


def coverage_summary(classified: DataFrame) -> DataFrame:
    """One row: totals and the covered share in per cent."""
    return classified.agg(
        F.count("*").alias("total"), F.count_if(F.col("classification") == "FULL_COVERAGE").alias("covered"), F.sum("n_crus").alias("crus"), F.sum("n_tests").alias("tests"),
        F.round(100.0 * F.count_if(F.col("classification") == "FULL_COVERAGE") / F.greatest(F.count("*"), F.lit(1)), 1).alias("rate"),
    )


def uncovered_units(crus: DataFrame, tests: DataFrame) -> DataFrame:
    """Units that no test names."""
    t = tests.select(F.col("requirement_id").alias("cru_id")).where("cru_id is not null")
    return crus.where("cru_id is not null").select("cru_id").distinct().join(t, "cru_id", "left_anti")


def missing_parents(crus: DataFrame, requirements: DataFrame) -> DataFrame:
    """(req_id, first_cru, n): parents that are no requirement, with the first unit that names them."""
    c = crus.where("parent_requirement_id is not null and parent_requirement_id <> ''").select(F.col("parent_requirement_id").alias("req_id"), "cru_id", "loaded_at")
    gone = c.join(requirements.select("req_id"), "req_id", "left_anti")
    return gone.groupBy("req_id").agg(F.min_by("cru_id", F.struct("loaded_at", "cru_id")).alias("first_cru"), F.count("*").alias("n"))


def dependencies(requirements: DataFrame) -> DataFrame:
    """(req_id, dep): distinct declared dependencies, upper-cased and trimmed, without self references, blanks and noise words."""
    d = requirements.where("req_id is not null").select(F.upper(F.trim("req_id")).alias("req_id"), F.explode("dependencies").alias("d")).select(
        "req_id", F.upper(F.trim("d")).alias("dep")
    )
    return d.where("dep is not null and dep not in ('', 'NONE', 'N/A', 'NA') and dep <> req_id").distinct()


def inferred(deps: DataFrame, satisfied: DataFrame) -> DataFrame:
    """(req_id, round): requirements that are satisfied (round 0), or all of whose dependencies are, transitively.

    A least fixpoint: requirements in a cycle that nothing outside satisfies never come in. Each round joins
    only dependencies still open with what the round before added; it ends when a round adds nothing.
    """
    done = materialize(satisfied.select("req_id").distinct().withColumn("round", F.lit(0)), "satisfied")
    open_ = materialize(deps.join(done.select("req_id"), "req_id", "left_anti"), "open")
    need = materialize(open_.groupBy("req_id").agg(F.count("*").alias("need")), "need")
    have = None
    fresh = done
    for r in itertools.count(1):
        hits = open_.join(fresh.select(F.col("req_id").alias("dep")), "dep", "left_semi").groupBy("req_id").agg(F.count("*").alias("got"))
        have = hits if have is None else have.unionByName(hits).groupBy("req_id").agg(F.sum("got").alias("got"))
        have = materialize(have, "have")
        fresh = need.join(have, "req_id").where("got = need").select("req_id").join(done.select("req_id"), "req_id", "left_anti")
        fresh = materialize(fresh.withColumn("round", F.lit(r)), "fresh")
        if fresh.limit(1).count() == 0:
            break
        done = done.unionByName(fresh)
        if r % 16 == 0:  # a long chain of dependencies does not become a long plan
            done = materialize(done, "satisfied")
    return done


def stem_table(words: DataFrame, col: str) -> DataFrame:
    """(word, stem) of the distinct words: the long stemming expression runs once per word, not once per use."""
    return words.select(F.col(col).alias("word")).distinct().withColumn("stem", X.stem("word"))


def stems(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stems, negated): the distinct stems of each text, found through one join with the table of distinct words."""
    flat = texts.select(key, F.explode(X.words(text)).alias("word"))
    st = flat.join(stem_table(flat, "word"), "word").groupBy(key).agg(F.array_sort(F.collect_set("stem")).alias("stems"))
    return texts.select(key, X.negated(text).alias("negated")).join(st, key, "left").withColumn("stems", F.coalesce("stems", F.array().cast("array<string>")))


def overlap(pairs: DataFrame, specs: DataFrame, evidence: DataFrame, spec_key: str, evidence_key: str) -> DataFrame:
    """(keys, spec_words, overlap_ratio, prefix_ratio, blended, verdict) of specifications against evidence, for pairs of their keys.

    ``specs`` (key, text) and ``evidence`` (key, text) have one row per key: each text is cut and stemmed once, however many pairs it
    is in, and the pairs only compare two arrays.
    """
    s = specs.select(spec_key, F.col("text").alias("__t"))
    e = evidence.select(evidence_key, F.col("text").alias("__t"))
    s, e = stems(s, spec_key, "__t"), stems(e, evidence_key, "__t")
    j = pairs.select(spec_key, evidence_key).join(s.select(spec_key, F.col("stems").alias("ss")), spec_key).join(e.select(evidence_key, F.col("stems").alias("es"), F.col("negated").alias("neg")), evidence_key)
    pre = lambda a: F.array_distinct(F.transform(a, lambda x: F.substring(x, 1, R.PREFIX)))
    n = F.greatest(F.size("ss"), F.lit(1))
    j = j.withColumn("o", F.size(F.array_intersect("ss", "es")) / n).withColumn("p", F.size(F.array_intersect(pre(F.col("ss")), pre(F.col("es")))) / F.greatest(F.size(pre(F.col("ss"))), F.lit(1)))
    j = j.withColumn("b", (1 - R.PREFIX_WEIGHT) * F.col("o") + R.PREFIX_WEIGHT * F.col("p"))
    empty = (F.size("ss") == 0) | (F.size("es") == 0)
    return j.select(
        spec_key, evidence_key, F.size("ss").alias("spec_words"), F.round("o", 6).alias("overlap_ratio"), F.round("p", 6).alias("prefix_ratio"), F.round("b", 6).alias("blended"),
        X.verdict(F.col("b"), F.col("neg"), empty).alias("verdict"),
    )
