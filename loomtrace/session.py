"""Session helpers: table reading and shared-folder materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so they can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "loomtrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and everything runs in this one
    process, as in local tests, a folder of this machine is chosen and remembered in the session; on a cluster
    each executor would write to a disk of its own, so there an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "loomtrace-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, tag: str, **options: str) -> tuple[DataFrame, str]:
    """(table, its folder) of ``df``, written to the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtrace/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. ``options`` go to the writer."""
    return _write(df, tag, **options)[0]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_briefly(df: DataFrame, tag: str, **options: str) -> tuple[DataFrame, Callable[[], None]]:
    """(table, removal) as of ``materialize``, for a step of many: the shuffle files of its plan go as soon as it is written, the table when ``removal`` is called."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # The plan of a DataFrame keeps the setting it was made with, so it is made again here.
        out, path = _write(df.select("*"), tag, **options)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return out, lambda: _remove(spark, path)


def clean_shared(spark: SparkSession) -> None:
    """Remove the tables ``materialize`` has written; call it when no DataFrame that reads them is used any more."""
    _remove(spark, f"{shared_dir(spark)}/loomtrace")


def key_bucket(col, n: int):
    """A stable hash bucket in 0..n-1; null keys share one bucket."""
    return F.pmod(F.xxhash64(col), F.lit(n))
