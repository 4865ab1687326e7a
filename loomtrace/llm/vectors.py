"""The k most similar vectors for every vector, by multiprobe p-stable hashing.

Vectors are normalised and kept as 16-bit integers (cosines stay exact to about 2e-6). Equal ones form one
class; classes are hashed, compared and expanded again. The hash is p-stable: Gaussian projections, cut into
slots of a fixed width. They are taken of a vector's soft similarities to anchors, not of its raw
coordinates: on raw coordinates neighbours at cosine 0.8 part at nearly every cut. The anchors are fitted on
a sample of at most ``MAX_ANCHORS * PER_ANCHOR`` vectors; every vector is hashed and compared.

In each hash table a vector is stored in its own bucket and visits the perturbed buckets most likely to hold its
neighbours, in the order of the estimated success (squared distance to the slots' borders). The hash grows with the
logarithm of the number of vectors, and the number of tables with the hash, so that recall holds. What the tables give is merged. Whatever meets
in a bucket is compared exactly, for both sides. A bucket of more than ``BLOCK`` vectors is split into
blocks and its visitors are sent to each block, so no task grows with a crowded neighbourhood. Tables are compared
one after the other and their shuffle files removed, so that the disk holds the copies of one table only.

Defined results: a row counts if it has exactly ``dim`` finite floats, not all zero, and no row of the same
node is later; of equally late ones the greatest vector counts. Nodes without such a row, and rows without a
node_id, have no neighbours and are none. Cosine is rounded to 6 decimals; of equals the smaller node_id
comes first. Fewer than k other vectors give fewer rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.sorted_groups import map_kept_groups
from loomtrace.session import materialize, materialize_briefly

DIM = 384
K = 5
PROBES = 4  # buckets of a table a vector takes part in: its own and the three likeliest others
ONE_TABLE, PER_TABLE = 7, 5  # a hash of more than ONE_TABLE projections has a table for every PER_TABLE of them
WIDTH = 2.0
TEMPERATURE = 0.05
MAX_ANCHORS = 1024
PER_ANCHOR = 16
TARGET = 1024  # mean vectors per bucket
BLOCK = 1 << 14  # vectors stored together, at least: fewer blocks are fewer copies of a crowded bucket's visitors
LARGE = 1 << 16  # buckets that may be larger
VISITORS = 1 << 14  # vectors that a block is compared with at a time
SLACK = 2e-6  # cosines that may be equal after rounding


def normalise(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, q): which of the binary values hold a usable vector, and those as unit vectors in int16."""
    valid = np.zeros(len(col), dtype=bool)
    size = 4 * dim
    parts = []
    for i, v in enumerate(col):
        b = v.as_py()
        if b is not None and len(b) == size:
            valid[i] = True
            parts.append(b)
    x = np.frombuffer(b"".join(parts), dtype="<f4").reshape(-1, dim).astype(np.float64)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    valid[np.flatnonzero(valid)[~good]] = False
    x = x[good]
    if not len(x):
        return valid, np.zeros((0, dim), dtype=np.int16)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return valid, np.rint(x * 32767).astype(np.int16)


def unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unpack(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    arrays = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    return np.frombuffer(b"".join(v.as_py() for a in arrays for v in a), dtype="<i2").reshape(-1, dim)


def encoded(df: DataFrame, id_col: str, bytes_col: str, at_col: str, dim: int = DIM) -> DataFrame:
    """(node_id, at, q): every row with its vector in 16 bits, null where it is not usable. Narrow."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, q = normalise(b.column(2), dim)
            it = iter(q)
            out = pa.array([next(it).tobytes() if ok else None for ok in valid], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], ["node_id", "at", "q"])

    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("node_id"), F.col(at_col).cast("timestamp_ntz").alias("at"), F.col(bytes_col).alias("b")
    )
    return rows.mapInArrow(encode, "node_id string, at timestamp_ntz, q binary")


def latest_classes(rows: DataFrame) -> DataFrame:
    """(node_id, cid) of the nodes whose latest row holds a usable vector. The vectors themselves do not move."""
    cid = F.xxhash64("q")
    latest = rows.select("node_id", F.struct("at", F.col("q").isNotNull().alias("ok"), cid.alias("cid")).alias("m"))
    return latest.groupBy("node_id").agg(F.max("m").alias("m")).where("m.ok").select("node_id", F.col("m.cid").alias("cid"))


def fit_anchors(sample: np.ndarray, n_anchors: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means on a bounded sample, from a fixed start."""
    c = sample[np.linspace(0, len(sample) - 1, n_anchors).astype(int)]
    for _ in range(rounds):
        at = (sample @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, at, sample)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 0, s / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c


def tables_of(n_projections: int) -> int:
    """Hash tables for a hash of so many projections: a longer hash parts more neighbours, which more tables make good.

    Every table costs PROBES more copies of each vector in the shuffle.
    """
    return 1 if n_projections <= ONE_TABLE else -(-n_projections // PER_TABLE)


class StableHash:
    """p-stable hash tables with their probing sequences."""

    def __init__(self, anchors: np.ndarray, n_projections: int, tables: int | None = None, seed: int = 7):
        r = np.random.RandomState(seed)
        self.anchors, self.k, self.tables = anchors, n_projections, tables or tables_of(n_projections)
        self.a = r.standard_normal((self.tables, len(anchors), n_projections)).astype(np.float32)
        self.b = (r.random_sample((self.tables, n_projections)) * WIDTH).astype(np.float32)
        self.mult = (r.randint(1, 2**62, n_projections) | 1).astype(np.uint64)
        self.salt = r.randint(0, 2**62, self.tables).astype(np.uint64)
        steps = list(itertools.product(range(n_projections), (0, 1)))
        sets = [(), *[(s,) for s in steps], *[(s, t) for s, t in itertools.combinations(steps, 2) if s[0] != t[0]]]
        self.moves = np.zeros((len(sets), 2 * n_projections), dtype=np.float32)
        self.shift = np.zeros(len(sets), dtype=np.uint64)
        for i, moves in enumerate(sets):
            for j, up in moves:
                self.moves[i, 2 * j + up] = 1
                self.shift[i] = np.uint64((int(self.shift[i]) + (1 if up else -1) * int(self.mult[j])) % 2**64)

    def probes(self, x: np.ndarray, n: int | None = None) -> np.ndarray:
        """(rows, tables, n) bucket codes: in each table the own bucket first, then by estimated success."""
        n = min(n or PROBES, len(self.shift))
        out = np.zeros((len(x), self.tables, n), dtype=np.int64)
        with np.errstate(over="ignore"):
            y = x @ self.anchors.T
            y = np.exp((y - y.max(axis=1, keepdims=True)) / TEMPERATURE)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            for t in range(self.tables):
                u = (y @ self.a[t] + self.b[t]) / WIDTH
                slot = np.floor(u)
                left = (u - slot).astype(np.float32)
                home = self.salt[t] + (slot.astype(np.int64).view(np.uint64) * self.mult).sum(axis=1, dtype=np.uint64)
                cost = np.stack([left**2, (1 - left) ** 2], axis=2).reshape(len(x), -1) @ self.moves.T
                best = np.argpartition(cost, n - 1, axis=1)[:, :n] if n < cost.shape[1] else np.broadcast_to(np.arange(n), cost.shape)
                best = np.take_along_axis(best, np.take_along_axis(cost, best, axis=1).argsort(axis=1, kind="stable"), axis=1)
                out[:, t] = (home[:, None] + self.shift[best]).view(np.int64)
        return out


def near(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries that are within the rounding of a row's k-th greatest: ties are broken by name later."""
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -1.5, dtype=s.dtype)
    return np.divmod(np.flatnonzero(s >= np.maximum(kth - SLACK, -1.5)[:, None]), s.shape[1])


def kth_at_least(s: np.ndarray, k: int) -> np.ndarray:
    """For each column a bound that its k-th greatest entry is not below: the k-th greatest of the maxima of groups of rows."""
    groups = min(len(s), 8 * k)
    if groups < k:
        return np.full(s.shape[1], -1.5, dtype=s.dtype)
    top = s[: len(s) // groups * groups].reshape(-1, groups, s.shape[1]).max(axis=0)
    return np.partition(top, groups - k, axis=0)[groups - k]


def fit(df: DataFrame, id_col: str, bytes_col: str, at_col: str, dim: int) -> tuple[StableHash, int]:
    """(hash, number of rows): the hash's number of projections follows their number, its anchors a bounded sample."""
    n = df.count()
    size = MAX_ANCHORS * PER_ANCHOR
    # A hash threshold spreads the sample over all rows and bounds what comes to the driver.
    share = int(1_000_000 * min(1.0, size / max(n, 1)))
    some = df.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share)
    rows = encoded(some, id_col, bytes_col, at_col, dim).where("q is not null").select("q").toArrow()
    sample = unit(unpack(rows.column(0), dim))[:size]
    k = max(1, int(np.ceil(np.log2(max(n, 1) / TARGET))))
    n_anchors = max(1, min(MAX_ANCHORS, len(sample) // PER_ANCHOR))
    return StableHash(fit_anchors(sample, n_anchors) if len(sample) else np.zeros((1, dim), dtype=np.float32), k), n


def hashed_classes(classes: DataFrame, hashing: StableHash, dim: int, probes: int) -> DataFrame:
    """(cid, q, codes): every class with its buckets, ``probes`` of each table, one table after the other. Narrow."""
    shared = classes.sparkSession.sparkContext.broadcast(hashing)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = shared.value.probes(unit(unpack(b.column(1), dim)), probes).reshape(b.num_rows, -1)
                offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], ["cid", "q", "codes"])

    return classes.select("cid", "q").mapInArrow(buckets, "cid long, q binary, codes array<long>")


def crowded(hashed: DataFrame, block: int, probes: int) -> dict[int, list[tuple[int, int, int]]]:
    """By hash table, its buckets in which more than ``block`` classes are stored: (code, blocks, copies of vectors beyond one for each that meets there)."""
    at = hashed.select(F.posexplode("codes").alias("i", "code"))
    counted = at.groupBy(F.floor(F.col("i") / probes).cast("int").alias("t"), "code").agg(
        F.count("*").alias("met"), F.count(F.when(F.col("i") % probes == 0, 1)).alias("stored")
    )
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in counted.where(F.col("stored") > block).collect():
        blocks = -(-r["stored"] // block)
        out.setdefault(r["t"], []).append((r["code"], blocks, r["met"] * (blocks - 1)))
    return out


def met_in(hashed: DataFrame, table: int, large: list[tuple[int, int, int]], probes: int, part: int, parts: int, dim: int, k: int) -> DataFrame:
    """(a, b, cos): what meets in the ``part``-th of ``parts`` of the buckets of a hash table, as far as it can be among the k nearest, both directions."""
    at = hashed.select("cid", "q", F.posexplode(F.slice("codes", table * probes + 1, probes)).alias("i", "code"))
    at = at.select("cid", "q", "code", (F.col("i") == 0).alias("home"))
    if large:
        blocks = hashed.sparkSession.createDataFrame([(c, n) for c, n, _ in large], "code long, blocks int")
        at = at.join(F.broadcast(blocks), "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
        # In its own bucket a vector is stored in one block and visits the others; elsewhere it visits all.
        at = at.select("cid", "q", "code", "home", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    else:
        at = at.withColumn("own", F.lit(0)).withColumn("block", F.lit(0))
    at = at.select(F.xxhash64("code", "block").alias("task"), "cid", "q", (F.col("home") & (F.col("block") == F.col("own"))).alias("stored"))
    at = at.where(F.pmod("task", F.lit(parts)) == part)

    def compare(t: pa.Table, again: bool) -> Iterator[pa.RecordBatch]:
        stored = t.column("stored").to_numpy()
        if not stored.any():
            return
        cid, x = t.column("cid").to_numpy(), unit(unpack(t.column("q"), dim))
        base, base_id = x[stored], cid[stored]
        if again:  # stored vectors have been compared with each other
            cid, x, stored = cid[~stored], x[~stored], stored[~stored]
        out = []
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 22) // len(base))
        floor = np.full(len(base), -1.5, dtype=np.float32)
        for lo in range(0, len(x), step):
            s = x[lo : lo + step] @ base.T
            ids = cid[lo : lo + step]
            s[ids[:, None] == base_id[None, :]] = -2
            i, j = near(s, k)
            out.append((ids[i], base_id[j], s[i, j]))
            visit = ~stored[lo : lo + step]
            if visit.any():  # what a visitor finds, the stored vector finds too
                sv, iv = (s, ids) if visit.all() else (s[visit], ids[visit])
                floor = np.maximum(floor, kth_at_least(sv, k))
                i, j = np.divmod(np.flatnonzero(sv >= np.maximum(floor - SLACK, -1.5)), len(base))
                back.append((j, iv[i], sv[i, j]))
        if back:
            i, who, v = (np.concatenate(z) for z in zip(*back, strict=True))
            order = np.lexsort((-v, i))
            i, who, v = i[order], who[order], v[order]
            first = np.searchsorted(i, np.arange(len(base)))
            count = np.append(first[1:], len(i)) - first
            kth = np.full(len(base), -1.5, dtype=np.float32)
            kth[count >= k] = v[first[count >= k] + k - 1]
            near_by = v >= kth[i] - SLACK
            out.append((base_id[i[near_by]], who[near_by], v[near_by]))
        a, b, v = (np.concatenate(z) for z in zip(*out, strict=True))
        ok = v > -1.5
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(v[ok].astype(np.float32))], ["a", "b", "cos"])

    return map_kept_groups(at, "task", "stored", compare, "a long, b long, cos float", VISITORS)


def nearest_classes(hashed: DataFrame, hashing: StableHash, n: int, dim: int, probes: int, k: int = K) -> DataFrame:
    """(a, b, cos): for every class of ``hashed``, the distinct ones of ``n`` rows, its k nearest among those met and all that tie with the last of them, both directions.

    The hash tables are compared one after the other, those with crowded buckets in parts. Each part merges what it finds with what was found
    before and leaves only that, so the disk holds about one table's copies of the vectors, however many tables and blocks there are.
    """
    # A large bucket has more than this; so there are at most LARGE of them in a table.
    block = max(BLOCK, -(-n // LARGE))
    large = crowded(hashed, block, probes)
    best, forget = None, None
    for t in range(hashing.tables):
        more = large.get(t, [])
        parts = 1 + -(-sum(copies for _, _, copies in more) // max(probes * n, 1))
        for part in range(parts):
            met = met_in(hashed, t, more, probes, part, parts, dim, k)
            # One exchange, by a, serves the distinct pairs and the ranking; ties at the last place are kept for the names.
            met = (met if best is None else met.unionByName(best)).repartition("a").groupBy("a", "b").agg(F.max("cos").alias("cos"))
            place = F.rank().over(Window.partitionBy("a").orderBy(F.desc(F.round(F.col("cos").cast("double"), 6))))
            last = forget
            best, forget = materialize_briefly(met.withColumn("r", place).where(F.col("r") <= k).drop("r"), "nearest")
            if last is not None:
                last()
    return best.select("a", "b", F.round(F.col("cos").cast("double"), 6).alias("cos"))


def nearest(df: DataFrame, id_col: str, bytes_col: str, at_col: str, k: int = K, dim: int = DIM, probes: int | None = None) -> DataFrame:
    """(node_id, neighbour, cos, rank): the k most similar other nodes of each node."""
    hashing, n = fit(df, id_col, bytes_col, at_col, dim)
    rows = encoded(df, id_col, bytes_col, at_col, dim)
    members = materialize(latest_classes(rows), "members")
    # Equal vectors are one class; the vectors are shuffled to their class once, kept if it is anybody's latest, and written with their buckets.
    vectors = rows.where("q is not null").select(F.xxhash64("q").alias("cid"), "q")
    classes = vectors.groupBy("cid").agg(F.first("q").alias("q"))
    classes = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    probes = min(probes or PROBES, len(hashing.shift))
    hashed, forget = materialize_briefly(hashed_classes(classes, hashing, dim, probes), "hashed")
    best = nearest_classes(hashed, hashing, n, dim, probes, k)
    forget()
    # Of a class only the k + 1 smallest names can be anybody's neighbours.
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("node_id"))).where(F.col("r") <= k + 1)
    names = first.groupBy("cid").agg(F.array_sort(F.collect_list("node_id")).alias("names"))
    others = best.join(names.withColumnRenamed("cid", "b"), "b").select(F.col("a").alias("cid"), F.explode("names").alias("neighbour"), "cos")
    own = names.select("cid", F.explode("names").alias("neighbour"), F.lit(1.0).alias("cos"))
    # Per class, then per member: one list of at most k + 1 candidates, which a member takes without itself.
    ranked = (
        others.unionByName(own)
        .withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("cos"), "neighbour")))
        .where(F.col("r") <= k + 1)
        .groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "cos"))).alias("list"))
    )
    found = members.join(ranked, "cid")
    mine = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("node_id")), 1, k)
    return found.select("node_id", F.posexplode(mine).alias("p", "x")).select(
        "node_id", F.col("x.neighbour").alias("neighbour"), F.col("x.cos").alias("cos"), (F.col("p") + 1).alias("rank")
    )
