"""References to records that do not exist, per table, field and month.

References are pre-aggregated per key and month before anything is joined, so a key that holds a large
part of all rows becomes a handful of rows per task. Keys with at least 1/100 of all references (there
can be at most 100 of them) are resolved against a broadcast of at most 100 status rows; all other keys
take a shuffle join; both halves are united.

Defined results: null and empty references are no references; a reference without a time has the month
null and can be missing or deleted but not late; a record without a time exists but is neither early nor
late; deletions without a time count as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.session import key_bucket

#: A heavy key has at least 1/HEAVY_SHARE of all references; so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 100
HISTOGRAM = 65536


def references(df: DataFrame, table_name: str, fields: list[str], at: str) -> DataFrame:
    """(table_name, field_name, ref_key, ref_at) for each reference that is neither null nor empty; one scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in fields])
    return (
        df.select(F.explode(pairs).alias("p"), F.col(at).alias("ref_at"))
        .where("p.k is not null and p.k <> ''")
        .select(F.lit(table_name).alias("table_name"), F.col("p.f").alias("field_name"), F.col("p.k").alias("ref_key"), "ref_at")
    )


def key_status(records: DataFrame, key: str, at: str, deletions: DataFrame, table_name: str) -> DataFrame:
    """One row per key that has a row or a deletion: (key, n_rows, first_at, last_at, deleted_at)."""
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(None).cast("timestamp_ntz").alias("del"))
    gone = deletions.where((F.col("table_name") == table_name) & F.col("record_id").isNotNull() & F.col("deleted_at").isNotNull())
    gone = gone.select(F.col("record_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("deleted_at").cast("timestamp_ntz").alias("del"))
    return (
        rows.withColumn("at", F.col("at").cast("timestamp_ntz"))
        .withColumn("is_row", F.lit(1))
        .unionByName(gone.withColumn("is_row", F.lit(0)))
        .groupBy("key")
        .agg(F.sum("is_row").alias("n_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("del").alias("deleted_at"))
    )


def heavy_keys(refs: DataFrame) -> list[str]:
    """The keys with at least 1/HEAVY_SHARE of all references, at most HEAVY_SHARE.

    A histogram of HISTOGRAM hash buckets bounds the candidates, so the exact count runs only over the
    keys of the at most HEAVY_SHARE buckets that are heavy themselves.
    """
    hist = refs.groupBy(key_bucket(F.col("ref_key"), HISTOGRAM).alias("b")).count().collect()
    total = sum(r["count"] for r in hist)
    least = max(2, -(-total // HEAVY_SHARE))
    hot = [r["b"] for r in hist if r["count"] >= least]
    if not hot:
        return []
    found = (
        refs.where(key_bucket(F.col("ref_key"), HISTOGRAM).isin(hot)).groupBy("ref_key").count().where(F.col("count") >= least)
    )
    return [r["ref_key"] for r in found.collect()]


def orphan_counts(refs: DataFrame, status: DataFrame) -> DataFrame:
    """(table_name, field_name, ref_key, ref_month, orphan_kind, n_refs) of the references that lead nowhere.

    deleted: the key has a deletion and no row after the last one; else missing: no row; else late: its
    earliest row is after the referring row (then n_refs counts all references of that key and month).
    """
    months = refs.groupBy("table_name", "field_name", "ref_key", F.date_format("ref_at", "yyyy-MM").alias("ref_month")).agg(
        F.count("*").alias("n_refs"), F.min("ref_at").alias("first_ref")
    )
    heavy = heavy_keys(refs)
    parts = []
    if heavy:
        parts.append((months.where(F.col("ref_key").isin(heavy)), F.broadcast(status.where(F.col("key").isin(heavy)))))
        months, status = months.where(~F.col("ref_key").isin(heavy)), status.where(~F.col("key").isin(heavy))
    parts.append((months, status))
    has_rows = F.coalesce("n_rows", F.lit(0)) > 0
    kind = (
        F.when(F.col("deleted_at").isNotNull() & (~has_rows | F.coalesce(F.col("last_at") <= F.col("deleted_at"), F.lit(True))), "deleted")
        .when(~has_rows, "missing")
        .when(F.col("first_at") > F.col("first_ref"), "late")
    )
    done = [
        m.join(s, m["ref_key"] == s["key"], "left")
        .select("table_name", "field_name", "ref_key", "ref_month", kind.alias("orphan_kind"), "n_refs")
        .where("orphan_kind is not null")
        for m, s in parts
    ]
    return reduce(DataFrame.unionByName, done)


def orphans(edges: DataFrame, crus: DataFrame, nodes: DataFrame, requirements: DataFrame, deletions: DataFrame) -> DataFrame:
    """Orphans of the graph's edges (against nodes) and of CRUs (against requirements)."""
    e = orphan_counts(
        references(edges, "edges", ["src_id", "dst_id", "evidence_chunk_id"], "created_at"),
        key_status(nodes, "node_id", "created_at", deletions, "nodes"),
    )
    c = orphan_counts(
        references(crus, "crus", ["parent_requirement_id"], "loaded_at"),
        key_status(requirements, "req_id", "loaded_at", deletions, "requirements"),
    )
    return e.unionByName(c)


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, month and kind."""
    return found.groupBy("table_name", "field_name", "ref_month", "orphan_kind").agg(
        F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs")
    )
