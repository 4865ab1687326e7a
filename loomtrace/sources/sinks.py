"""Sinks: JSON, CSV, partitioned parquet, and bucketed tables for joins on the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.diff import flat_export


def write_json(df: DataFrame, path: str, **meta: str) -> None:
    """Rows as JSON lines, with a one-row folder of metadata beside them."""
    df.write.mode("overwrite").json(f"{path}/rows")
    m = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in {"format": "rows", **meta}.items()], F.current_timestamp().alias("written_at"))
    m.write.mode("overwrite").json(f"{path}/metadata")


def write_csv(df: DataFrame, path: str) -> None:
    """A header and flat columns."""
    flat_export(df).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_sheets(df: DataFrame, path: str, by: str) -> None:
    """One folder of flat rows per value of ``by``: the sheets of a workbook, without bringing rows to the driver."""
    flat_export(df).withColumn("sheet", F.coalesce(F.col(by).cast("string"), F.lit("none"))).write.mode("overwrite").partitionBy("sheet").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and edges by relation, so scans of one kind read nothing else."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by ``key``: joins of two such tables on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_documents(df: DataFrame, path: str, group, wrapper: str) -> None:
    """One JSON document per group, its rows under a wrapper key, each document a line of its own file part.

    A group is one value, so choose one that bounds it.
    """
    docs = df.groupBy(group.alias("__g")).agg(F.collect_list(F.struct(*df.columns)).alias(wrapper))
    texts = docs.select(F.to_json(F.struct(wrapper), {"ignoreNullFields": "false"}).alias("value"), F.col("__g").alias("doc"))
    texts.repartition("doc").write.mode("overwrite").partitionBy("doc").text(path)


def rebuild(df: DataFrame, path: str) -> None:
    """What is there is dropped, then written anew."""
    df.write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
