"""Filling containers of fixed capacity with texts, never splitting one that fits.

Only a text's size decides where it goes, and sizes are whole numbers up to the capacity. So the packing is
solved on the histogram of sizes, which is bounded by the capacity however many texts there are: first the
Martello-Toth reduction fixes sets that provably dominate every alternative, then the rest goes best-fit
decreasing, both in runs of equal containers. Texts are matched to the solution by their rank among those
of equal size. A size of more than ``PER_PART`` texts is ranked in as many parts as that takes, so one that a third
of all texts share is no hot spot; only the counts per size, and per part of such a size, come to the driver.

Defined results: a text larger than the capacity is cut into full pieces and a last smaller one; a text of 0
tokens (null, empty) takes no container (container_id null); capacities below 1 are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pattern = tuple[tuple[int, int], ...]  # (size, how many in one container)...
PER_PART = 100_000  # texts of equal size that one task ranks


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take them out of ``counts``: (pattern, number of containers)."""
    fixed: list[tuple[Pattern, int]] = []
    support = sorted(counts)

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            support.pop(bisect_left(support, size))

    changed = True
    while changed:
        changed = False
        for s in sorted(support, reverse=True):
            while counts.get(s):
                gap = capacity - s
                # The smallest three items besides one of size s.
                small: list[int] = []
                for v in support:
                    small += [v] * min(3, counts[v] - (v == s))
                    if len(small) >= 3:
                        break
                small = small[:3]
                if not small or small[0] > gap:
                    fixed.append((((s, 1),), counts[s]))
                    take(s, counts[s])
                    changed = True
                    break
                i = bisect_left(support, gap + 1) - 1
                k = support[i]
                if k == s and counts[s] < 2:
                    i -= 1
                    k = support[i]
                one_fits = len(small) < 2 or small[0] + small[1] > gap
                two_fit = len(small) < 3 or sum(small) > gap
                if not (one_fits or k == gap or (two_fit and best_pair(support, counts, s, gap) <= k)):
                    break
                n = counts[s] // 2 if k == s else min(counts[s], counts[k])
                fixed.append((((s, 2),) if k == s else ((s, 1), (k, 1)), n))
                take(s, 2 * n if k == s else n)
                if k != s:
                    take(k, n)
                changed = True
    return fixed


def best_pair(support: list[int], counts: dict[int, int], s: int, gap: int) -> int:
    """The greatest sum of two items within ``gap``, besides one item of size s."""
    best, lo, hi = 0, 0, bisect_left(support, gap + 1) - 1
    free = lambda v: counts[v] - (v == s)
    while 0 <= lo <= hi:
        a, b = support[lo], support[hi]
        if a + b > gap or (a == b and free(a) < 2) or not free(b):
            if not free(a) and a + b <= gap:
                lo += 1
            else:
                hi -= 1
        elif not free(a):
            lo += 1
        else:
            best = max(best, a + b)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing in runs of equal containers."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, pattern, n = capacity, (), -(-left // (capacity // s))
            each = min(room // s, left)
            full = min(n, left // each)
            put(room, pattern, n - full if pattern else 0)
            put(room - each * s, (*pattern, (s, each)), full)
            left -= full * each
    return [g for groups in open_.values() for g in groups]


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Containers for a histogram of sizes in 1..capacity: (pattern, how many), both stages."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(solution: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: (first rank of each run, its first container, items per container)."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    container = 0
    for pattern, n in solution:
        for s, each in pattern:
            start = seen.get(s, 0)
            runs.setdefault(s, []).append((start, container, each))
            seen[s] = start + n * each
        container += n
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pieces(sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(limit_name, capacity, id, piece, start_token, tokens): whole texts, or the parts of those too large."""
    c = F.col("capacity")
    n = F.ceil(F.col("n_tokens") / c)
    caps = F.broadcast(limits.where("max_tokens > 0").select("limit_name", F.col("max_tokens").cast("long").alias("capacity")))
    # size_limits is a fixed table of a few rows: every text is sized against each of its capacities.
    return (
        sizes.select(id_col, "n_tokens").crossJoin(caps)
        .select("limit_name", "capacity", id_col, "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1)).alias("piece"))
        .select("limit_name", "capacity", id_col, "piece", (F.col("piece") * c).alias("start_token"), F.least(c, F.col("n_tokens") - F.col("piece") * c).alias("tokens"))
    )


def pack(sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(limit_name, id, piece, start_token, tokens, container_id) for each capacity of ``limits``."""
    spark = sizes.sparkSession
    items = pieces(sizes, limits, id_col)
    # Bounded by the capacities: one row per size.
    rows = items.where("tokens > 0").groupBy("limit_name", "capacity", "tokens").count().collect()
    histograms: dict[tuple[str, int], dict[int, int]] = {}
    hot: list[tuple[str, int, int]] = []
    for r in rows:
        histograms.setdefault((r["limit_name"], r["capacity"]), {})[r["tokens"]] = r["count"]
        if r["count"] > PER_PART:
            hot.append((r["limit_name"], r["tokens"], -(-r["count"] // PER_PART)))
    # At most one row per PER_PART texts, and never more than sizes.
    parts = F.broadcast(spark.createDataFrame(hot, "limit_name string, tokens long, n_parts long"))
    part = F.coalesce(F.pmod(F.xxhash64(id_col, "piece"), F.col("n_parts")), F.lit(0))
    items = items.join(parts, ["limit_name", "tokens"], "left").withColumn("part", part)
    counts: dict[tuple[str, int], dict[int, int]] = {}
    if hot:
        for r in items.where("n_parts is not null").groupBy("limit_name", "tokens", "part").count().collect():
            counts.setdefault((r["limit_name"], r["tokens"]), {})[r["part"]] = r["count"]
    offsets = {}
    for key, c in counts.items():
        v = np.array([c.get(i, 0) for i in range(max(c) + 1)], dtype=np.int64)
        offsets[key] = np.cumsum(v) - v
    plan = {name: slots(solve(h, cap)) for (name, cap), h in histograms.items()}
    shared = spark.sparkContext.broadcast((plan, offsets))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, offsets = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            name = np.array(b.column(0).to_pylist(), dtype=object)
            tokens, part, local = (b.column(i).to_numpy() for i in (4, 5, 6))
            out = np.zeros(b.num_rows, dtype=np.int64)
            # Rows come sorted by name, size and part: one lookup per run of equal size.
            cut = np.flatnonzero((tokens[1:] != tokens[:-1]) | (name[1:] != name[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(tokens)], strict=True):
                if tokens[lo] <= 0:
                    continue
                start, first, each = plan[name[lo]][tokens[lo]]
                before = offsets.get((name[lo], tokens[lo]))
                rank = local[lo:hi] - 1 + (0 if before is None else before[part[lo:hi]])
                run = np.searchsorted(start, rank, side="right") - 1
                out[lo:hi] = first[run] + (rank - start[run]) // each[run]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(out, mask=tokens <= 0)], ["limit_name", id_col, "piece", "start_token", "tokens", "container_id"]
            )

    w = Window.partitionBy("limit_name", "tokens", "part").orderBy(id_col, "piece")
    ranked = items.withColumn("local", F.row_number().over(w).cast("long"))
    kind = dict(items.dtypes)[id_col]
    return ranked.select("limit_name", id_col, "piece", "start_token", "tokens", "part", "local").mapInArrow(
        assign, f"limit_name string, {id_col} {kind}, piece int, start_token long, tokens long, container_id long"
    )


def fill(assignment: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, container_id, n_pieces, used, capacity, share) of each container."""
    used = assignment.where("container_id is not null").groupBy("limit_name", "container_id").agg(
        F.count("*").alias("n_pieces"), F.sum("tokens").alias("used")
    )
    caps = F.broadcast(limits.select("limit_name", F.col("max_tokens").cast("long").alias("capacity")))
    return used.join(caps, "limit_name").withColumn("share", F.col("used") / F.col("capacity"))
