"""Quality of generated test rows: gates, consistency, uniqueness, coverage contribution and confidence."""

from __future__ import annotations

import difflib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X


def _steps() -> Column:
    return F.lower(F.array_join(F.coalesce("test_steps", F.array().cast("array<string>")), " "))


def _holds_forbidden(c: Column) -> Column:
    return X.any_of([c.contains(p) for p in R.FORBIDDEN])


def reject_reason(tests: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the first rule of the gate that fails, null for a good row."""
    n = F.coalesce(F.size("test_steps"), F.lit(0))
    expected = F.coalesce("expected_result", F.lit(""))
    return tests.withColumn("reject_reason", X.first_match([
        (F.trim(F.coalesce("test_title", F.lit(""))) == "", "no_title"), (F.col("test_steps").isNull() | (n < 1), "no_steps"), (_holds_forbidden(_steps()), "forbidden_phrase"),
        (_holds_forbidden(F.lower(expected)), "generic_expected"), (n < R.MIN_STEPS, "few_steps"), (F.length(expected) < R.MIN_EXPECTED, "short_expected"),
    ], F.lit(None).cast("string")))


def consistency(tests: DataFrame) -> DataFrame:
    """Adds ``consistency``: 1 less a deduction per flaw, within 0 and 1."""
    steps, expected = _steps(), F.lower(F.coalesce("expected_result", F.lit("")))
    n = F.coalesce(F.size("test_steps"), F.lit(0))
    less = (
        F.when(_holds_forbidden(steps) | _holds_forbidden(expected), 0.3).otherwise(0.0) + F.when(F.col("test_steps").isNull() | (n < 4), 0.2).otherwise(0.0)
        + F.when(F.length(expected) < R.MIN_EXPECTED, 0.2).otherwise(0.0) + F.when(F.trim(F.coalesce("test_data", F.lit(""))).isin("", "{}"), 0.1).otherwise(0.0)
        + F.when((F.col("test_type") == "negative") & ~steps.contains("invalid"), 0.1).otherwise(0.0)
    )
    return tests.withColumn("consistency", F.round(X.clamp(F.lit(1.0) - less), 6))


CRITICAL = ["positive", "negative", "edge"]


def contribution(tests: DataFrame) -> DataFrame:
    """Adds ``contribution``: more for critical types, and for a type no other test of the requirement has.

    Whether another test has the type is a count per requirement and type joined back, never a list per requirement.
    """
    other = tests.groupBy("requirement_id", "test_type").agg(F.countDistinct("test_id").alias("n_ids"))
    t = tests.join(other, (tests["requirement_id"].eqNullSafe(other["requirement_id"])) & (tests["test_type"].eqNullSafe(other["test_type"])), "left").drop(other["requirement_id"]).drop(other["test_type"])
    first, critical = F.col("n_ids") <= 1, F.coalesce(F.col("test_type").isin(CRITICAL), F.lit(False))
    score = F.lit(0.5) + F.when(critical, F.lit(0.2) + F.when(first, 0.2).otherwise(0.0)).otherwise(F.when(first, 0.15).otherwise(0.0))
    return t.withColumn("contribution", F.round(F.least(score, F.lit(1.0)), 6)).drop("n_ids")


_FIELDS = (("title", 0.3), ("steps", 0.5), ("expected", 0.2))


def _bounds(a: list[str], b: list[str]) -> np.ndarray:
    """No ratio of a[i] and b[j] is above [i, j]: twice the characters both have, counted with repeats, over the length."""
    code = {c: i for i, c in enumerate(sorted(set().union(*a, *b)))}
    count = [np.zeros((len(side), len(code)), np.int32) for side in (a, b)]
    for side, m in zip((a, b), count, strict=True):
        for i, text in enumerate(side):
            for c, k in Counter(text).items():
                m[i, code[c]] = k
    length = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    shared = np.array([np.minimum(row, count[1]).sum(1) for row in count[0]]).reshape(len(a), len(b))
    return np.where(length == 0, 1.0, 2.0 * shared / np.maximum(length, 1))


class _Ratios:
    """Ratios of one field within a group; the analysis of the second text and repeated pairs are kept."""

    def __init__(self):
        self.second, self.known = {}, {}

    def __call__(self, a: str, b: str) -> float:
        if (r := self.known.get((a, b))) is None:
            m = self.second.get(b)
            if m is None:
                m = self.second[b] = difflib.SequenceMatcher(None, "", b)
            m.set_seq1(a)
            r = self.known[a, b] = m.ratio()
        return r


def _best_partners(a: list[dict], b: list[dict], ratios: dict[str, _Ratios]) -> Iterator[tuple[str, str, float]]:
    """(test_id, o_test_id, sim): for each test of ``a`` its most similar other test of ``b``, exactly.

    Candidates come in the order of their upper bound; one is left out only where its bound is below the best so far by more than rounding can hide.
    """
    bound = {f: _bounds([x[f] for x in a], [x[f] for x in b]) for f, _ in _FIELDS}
    total = sum(w * bound[f] for f, w in _FIELDS)
    for i, x in enumerate(a):
        best = None
        for j in np.argsort(-total[i], kind="stable"):
            if best is not None and total[i, j] < best[0] - 2e-6:
                break
            y, sim = b[j], total[i, j]
            if y["test_id"] == x["test_id"]:
                continue
            parts = {f: bound[f][i, j] for f, _ in _FIELDS}
            for f in ("title", "expected", "steps"):
                parts[f] = ratios[f](x[f], y[f])
                sim = sum(w * parts[k] for k, w in _FIELDS)
                if best is not None and sim < best[0] - 2e-6:
                    break
            else:
                best = max(best or (-1.0, ""), (round(float(sim), 6), y["test_id"]))
        if best is not None:
            yield x["test_id"], best[1], best[0]


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by requirement and pair of blocks; each pair is compared in both directions."""
    rows = (r for batch in batches for r in batch.to_pylist())
    out = []
    for (_, lo, hi), group in itertools.groupby(rows, key=lambda r: (r["requirement_id"], r["lo"], r["hi"])):
        sides, ratios = {lo: [], hi: []}, {f: _Ratios() for f, _ in _FIELDS}
        for r in group:
            sides[r["own"]].append(r)
        for x, y in {(lo, hi), (hi, lo)}:
            if sides[x] and sides[y]:
                out.extend(_best_partners(sides[x], sides[y], ratios))
        if len(out) > 4096:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(out: list[tuple[str, str, float]]) -> pa.RecordBatch:
    a, b, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], ["test_id", "o_test_id", "sim"])


def uniqueness(tests: DataFrame, rows_per_block: int = 256) -> DataFrame:
    """(test_id, similar_to, max_similarity, uniqueness) within a requirement, over all its other tests.

    The similarity is that of the test to the other one; a ratio may differ the other way round. A requirement may
    hold a third of all rows: its tests are split by hash into blocks, and each pair of blocks is a unit of work.
    """
    t = tests.where("test_id is not null").select(
        "test_id", F.coalesce("requirement_id", F.lit("")).alias("requirement_id"), F.lower(F.coalesce("test_title", F.lit(""))).alias("title"), _steps().alias("steps"),
        F.lower(F.coalesce("expected_result", F.lit(""))).alias("expected"),
    ).dropDuplicates(["test_id"])
    n = t.groupBy("requirement_id").agg(F.count("*").alias("n")).where("n > 1").select("requirement_id", F.ceil(F.col("n") / rows_per_block).cast("int").alias("blocks"))
    own = t.join(n, "requirement_id").withColumn("own", F.pmod(F.xxhash64("test_id"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "k"), "hi": F.greatest("own", "k")}).drop("k", "blocks")
    pairs = pairs.repartition(int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "requirement_id", "lo", "hi").sortWithinPartitions("requirement_id", "lo", "hi")
    best = pairs.mapInArrow(_compare_blocks, "test_id string, o_test_id string, sim double").groupBy("test_id").agg(F.max(F.struct("sim", "o_test_id")).alias("m"))
    sim = F.coalesce("m.sim", F.lit(0.0))
    return t.select("test_id").join(best, "test_id", "left").select("test_id", F.col("m.o_test_id").alias("similar_to"), sim.alias("max_similarity"), (1 - sim).alias("uniqueness"))


def confidence(scored: DataFrame, uniqueness_col: Column | None = None) -> DataFrame:
    """Adds ``confidence`` and ``level`` from consistency, uniqueness (1 if not given), contribution and absence of placeholders."""
    u = F.lit(1.0) if uniqueness_col is None else uniqueness_col
    clean = F.when(_holds_forbidden(_steps()) | _holds_forbidden(F.lower(F.coalesce("expected_result", F.lit("")))), 0.0).otherwise(1.0)
    v = F.round(0.4 * F.col("consistency") + 0.2 * u + 0.3 * F.col("contribution") + 0.1 * clean, 6)
    return scored.withColumn("confidence", v).withColumn("level", X.first_match([(v >= 0.8, "HIGH"), (v >= 0.6, "MEDIUM"), (v >= 0.4, "LOW")], "REVIEW_REQUIRED"))


def scenario_scores(comparisons: DataFrame) -> DataFrame:
    """(scenario, n, score, risk) of rows (scenario, classification): matches count 1, partial ones a half, conflicts minus 1."""
    value = X.first_match([(F.col("classification") == "MATCH", 1.0), (F.col("classification") == "PARTIAL", 0.5), (F.col("classification") == "CONFLICT", -1.0)], 0.0)
    s = comparisons.groupBy("scenario").agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    score = F.round(X.clamp(F.col("v") / F.col("n")), 6)
    return s.select("scenario", "n", score.alias("score"), X.first_match([(score >= 0.75, "LOW_RISK"), (score >= 0.5, "MEDIUM_RISK")], "HIGH_RISK").alias("risk"))


def requirement_usage(requirements: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(req_id, usage, matches, partials, status) for every requirement, used or not."""
    c = comparisons.groupBy("req_id").agg(
        F.count("*").alias("usage"), F.count_if(F.col("classification") == "MATCH").alias("matches"), F.count_if(F.col("classification") == "PARTIAL").alias("partials")
    )
    j = requirements.select("req_id").distinct().join(c, "req_id", "left")
    z = {x: F.coalesce(x, F.lit(0)) for x in ("usage", "matches", "partials")}
    return j.withColumns(z).withColumn("status", X.first_match([(F.col("matches") > 0, "VALIDATED"), (F.col("partials") > 0, "WEAKLY_VALIDATED")], "UNUSED_REQUIREMENT"))


def weighted_confidence(rows: DataFrame, key: str, score: str, strict: str) -> DataFrame:
    """(key, confidence, grade): mean of scores, strict rows with weight 1 and others with a half, within 0.01 and 0.99."""
    w = F.when(F.col(strict), 1.0).otherwise(0.5)
    c = F.round(X.clamp(F.sum(F.col(score) * w) / F.sum(w), 0.01, 0.99), 4)
    return rows.groupBy(key).agg(c.alias("confidence")).withColumn("grade", X.first_match([(F.col("confidence") >= 0.75, "HIGH"), (F.col("confidence") >= 0.45, "MEDIUM")], "LOW"))
