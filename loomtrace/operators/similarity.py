"""Vectors as arrays: exact similarity, filters, top-k and acceptance, in whole-stage code where a row is enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: str) -> Column:
    """Unit vector; a zero vector has none (null)."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: str, b: str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_to_similarity(d: str | Column) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return 1 - d * d / 2


def _best(rows: pa.Table, k: int) -> pa.RecordBatch:
    """The k most similar base rows of every query row of one pair of blocks."""
    is_query = rows.column("side").to_numpy() == 0
    ids = rows.column("id").to_numpy()
    col = rows.column("embedding").combine_chunks()
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows.num_rows, -1)
    n = np.linalg.norm(x, axis=1)
    x = x / np.where(n > 0, n, 1)[:, None]
    qi, qm, bi, bm = ids[is_query & (n > 0)], x[is_query & (n > 0)], ids[~is_query & (n > 0)], x[~is_query & (n > 0)]
    order = np.argsort(bi, kind="stable")  # of equal cosines the smaller id comes first
    bi, bm = bi[order], bm[order]
    out_q, out_i, out_s = [], [], []
    step = max(1, (1 << 22) // max(1, len(bi)))
    for lo in range(0, len(qi), step):
        s = np.round(qm[lo : lo + step] @ bm.T, 6)
        o = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out_q.append(np.repeat(qi[lo : lo + step], o.shape[1]))
        out_i.append(bi[o].ravel())
        out_s.append(np.take_along_axis(s, o, axis=1).ravel())
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], type=kind)
    return pa.RecordBatch.from_arrays([join(out_q, pa.int64()), join(out_i, pa.int64()), join(out_s, pa.float64())], ["query_id", "id", "cosine"])


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, base_block: int = 1 << 15) -> DataFrame:
    """(query_id, id, cosine, rank): the k most similar rows of ``base`` for each stated query (id, embedding).

    A blocked join: every block of queries meets every block of the base in a task of its own, which returns k rows per query,
    and one small shuffle takes the best. Blocks are of fixed size, so nothing grows but their number, and nothing comes to the driver.
    Vectors that are null or zero are similar to nothing; all have the same length.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    nq, nb = blocks(queries, block), blocks(base, base_block)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.where("embedding is not null").select("id", "embedding", F.lit(0).alias("side"), part(nq).alias("qb"), all_of(nb).alias("bb"))
    b = base.where("embedding is not null").select("id", "embedding", F.lit(1).alias("side"), all_of(nq).alias("qb"), part(nb).alias("bb"))
    rows = q.unionByName(b).select(F.col("id").cast("long").alias("id"), "embedding", "side", (F.col("bb") * nq + F.col("qb")).alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and at != task[lo]:
                    yield _best(pa.Table.from_batches(held), k)
                    held = []
                at = task[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield _best(pa.Table.from_batches(held), k)

    # As many tasks as pairs of blocks: they are heavy on CPU, so they are not to be coalesced by their bytes.
    found = rows.repartition(nq * nb, "task").sortWithinPartitions("task").mapInArrow(run, "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
