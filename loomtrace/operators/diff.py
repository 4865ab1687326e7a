"""Snapshots of the graph and their differences, and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stat_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, before, after, delta): full key union of two (kind, name, n) tables, absent counts as 0."""
    j = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), ["kind", "name"], "full_outer")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})
    d = F.col("after") - F.col("before")
    return j.withColumn("delta", F.when(d > 0, F.concat(F.lit("+"), d.cast("string"))).when(d == 0, "±0").otherwise(d.cast("string")))


def new_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, is_new) of the later snapshot, over all ids of the earlier one."""
    b = before.select(key).distinct().withColumn("__old", F.lit(True))
    return after.select(key).distinct().join(b, key, "left").select(key, F.col("__old").isNull().alias("is_new"))


def test_summary(tests: DataFrame, types: list[str]) -> DataFrame:
    """One row: totals of new and known tests, by type with a rest, by priority and by grounding."""
    t = F.col("test_type")
    return tests.agg(
        F.count("*").alias("total"), F.count_if("is_new").alias("n_new"), *[F.count_if(t == x).alias(f"type_{x}") for x in types],
        F.count_if(t.isNull() | ~t.isin(types)).alias("type_other"), F.count_if(F.lower("priority") == "high").alias("high"),
        F.count_if(F.col("ev_kind") == "derived_evidence").alias("derived"), F.round(F.coalesce(F.avg("ev_confidence"), F.lit(0.0)), 4).alias("mean_ev_confidence"),
    )


def flat_export(df: DataFrame) -> DataFrame:
    """Nested columns as text, for sheets and CSV: arrays of text joined, everything else as JSON."""
    out = []
    for c, kind in df.dtypes:
        if kind == "array<string>":
            out.append(F.array_join(c, "; ").alias(c))
        elif kind.startswith(("array", "struct", "map")):
            out.append(F.to_json(c).alias(c))
        elif kind == "binary":
            out.append(F.base64(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
