"""Near-duplicate records with small edits: all pairs at or above a Jaccard similarity, exactly.

Equal word sets are collapsed into one class. Each class gets a parity bitmap: every word flips one of
256 bits, so the Hamming distance of two bitmaps never exceeds the size of the sets' symmetric
difference. Similarity t therefore gives an error budget of (1-t)/(1+t) * (|A|+|B|) bits, and a binary
trie self-join over the bitmaps, which walks pairs of nodes together, adds up differing bits and prunes
beyond the budget, loses no pair. Survivors are compared by their words. Bits are in the order of how well they
part the sets. At a similarity of 0.6 and some 50 words a set the budget is about 27 bits, more than the path to a node
can hold however many sets there are, so node pairs are rarely cut; a pair of sets is cut by the bits behind its path,
mostly by the bitmap folded in half, which is compared first (``seen`` counts both).

The trie is split over the cluster by shards: a class goes to the shard of each word of its prefix in a
global order from rare to frequent (two sets that similar must share a prefix word). A shard of more
than ``CAP`` classes is split into blocks, and each pair of blocks is a task of its own, so a word that a
third of all rows hold still makes bounded tasks. Word frequencies for the order come from all rows, as
a histogram over a fixed number of hash buckets.

Defined results: null text counts as empty; a record without any word is similar to nothing; a test_id
with several texts is similar if any of them is; rows without a test_id are left out; repeated rows
change nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.sorted_groups import map_whole_groups
from loomtrace.session import key_bucket, materialize

WORDS = 4  # 64-bit words of a bitmap
BUCKETS = 1 << 18
CAP = 4096
LEAF = 1 << 20  # pairs below which a node pair is not split further
CACHED = 1 << 16  # pairs compared at once
PER_PART = 1000  # ids of a class that one task pairs with all others of it
SALTS = 16  # parts of the rows of a component when they look up its label
SMALL = 64  # classes of a shard that is compared together with other small ones


def words_of(*texts: str) -> Column:
    """The sorted set of longest runs of a-z and 0-9 in the lower-cased texts, joined by a blank."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit("[a-z0-9]+"), F.lit(0))))


def trie_self_join(sig: np.ndarray, size: np.ndarray, t: float, side: np.ndarray | None = None, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of bitmaps whose Hamming distance is within the budget of their sizes.

    With ``side`` only pairs of different sides are joined. ``seen`` counts the pairs that node pairs cut, those of leaves, and
    of these those that the folded bits cut.
    """
    seen = {} if seen is None else seen
    share = (1 - t) / (1 + t)
    order = np.lexsort(tuple(sig[:, w] for w in range(WORDS - 1, -1, -1)))
    s, n = sig[order], size[order].astype(np.int64)
    d = None if side is None else side[order]
    part = (share * n + 5e-5).astype(np.float32)  # a set's part of a pair's budget
    # The bitmap folded in half: its distance is no greater than the bitmap's, and its bits part the sets more evenly.
    half = [np.ascontiguousarray(s[:, w] ^ s[:, w + WORDS // 2]) for w in range(WORDS // 2)]
    out_i: list[np.ndarray] = []
    out_j: list[np.ndarray] = []
    # A node is a range of the sorted bitmaps that agree on the first ``depth`` bits.
    todo = [(0, len(s), 0, len(s), 0, 0)]
    while todo:
        a0, a1, b0, b1, depth, diff = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if diff > share * (int(n[a0:a1].max()) + int(n[b0:b1].max())):
            seen["cut"] = seen.get("cut", 0) + (a1 - a0) * (b1 - b0)
            continue
        if depth < 64 * WORDS and (a1 - a0) * (b1 - b0) > LEAF:
            w, bit = depth // 64, np.uint64(63 - depth % 64)
            am = a0 + int(np.searchsorted((s[a0:a1, w] >> bit) & np.uint64(1), 1))
            bm = b0 + int(np.searchsorted((s[b0:b1, w] >> bit) & np.uint64(1), 1))
            todo.append((a0, am, b0, bm, depth + 1, diff))
            todo.append((am, a1, bm, b1, depth + 1, diff))
            todo.append((a0, am, bm, b1, depth + 1, diff + 1))
            if (a0, a1) != (b0, b1):
                todo.append((am, a1, b0, bm, depth + 1, diff + 1))
            continue
        same = (a0, a1) == (b0, b1)
        step = max(1, CACHED // (b1 - b0))
        for lo in range(a0, a1, step):
            hi = min(a1, lo + step)
            c0 = lo if same else b0  # each pair of a node with itself once
            # Half as many bits for all pairs against the block's greatest budget; all of them only for what is left.
            limit = int(part[lo:hi].max() + part[c0:b1].max())
            acc = np.bitwise_count(half[0][lo:hi, None] ^ half[0][None, c0:b1])
            for h in half[1:]:
                acc += np.bitwise_count(h[lo:hi, None] ^ h[None, c0:b1])
            i, j = np.nonzero(acc <= limit)
            seen["leaf"] = seen.get("leaf", 0) + acc.size
            seen["half"] = seen.get("half", 0) + acc.size - len(i)
            i, j = i + lo, j + c0
            keep = i < j if same else np.ones(len(i), dtype=bool)
            if d is not None:
                keep &= d[i] != d[j]
            i, j = i[keep], j[keep]
            acc, budget = np.zeros(len(i), dtype=np.int16), part[i] + part[j]
            for w in range(WORDS):
                acc = acc + np.bitwise_count(s[i, w] ^ s[j, w])
                keep = acc <= budget
                i, j, acc, budget = i[keep], j[keep], acc[keep], budget[keep]
            keep = np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9
            out_i.append(order[i[keep]])
            out_j.append(order[j[keep]])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def small_joins(sig: np.ndarray, size: np.ndarray, t: float, starts: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs for many small groups of rows at once; a group ends where the next one starts."""
    n = len(size)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    part = ((1 - t) / (1 + t) * size + 5e-5).astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    after = ends - np.arange(n) - 1  # partners behind each row in its group
    cuts = np.searchsorted(np.cumsum(after), np.arange(0, after.sum() + (1 << 20), 1 << 20))
    for lo, hi in zip(cuts, [*cuts[1:], n], strict=True):
        count = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        keep = ((side[i] == -1) | (side[i] != side[j])) & (np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[keep], j[keep]
        acc, budget = np.zeros(len(i), dtype=np.int16), part[i] + part[j]
        for w in range(WORDS):
            acc = acc + np.bitwise_count(sig[i, w] ^ sig[j, w])
            keep = acc <= budget
            i, j, acc, budget = i[keep], j[keep], acc[keep], budget[keep]
        out.append((i, j))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def word_classes(df: DataFrame, id_col: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, members): classes (cid, words) of equal word sets; members (cid, id), distinct. Both are written tables."""
    rows = (
        df.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("id"), words_of(*texts).alias("words"))
        .where("size(words) > 0")
        .withColumn("key", F.unhex(F.sha2(F.array_join("words", " "), 256)))
    )
    rows = materialize(rows, "texts")  # texts are cut into words once; members read no words
    classes = materialize(
        rows.groupBy("key").agg(F.first("words").alias("words")).withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    members = rows.select("key", "id").distinct().join(classes.select("key", "cid"), "key").select("cid", "id")
    return classes.select("cid", "words"), materialize(members, "members")


def bit_places(hist: np.ndarray, n: int) -> np.ndarray:
    """The place of each bit, those first whose parity is nearest to a coin's: they part the sets most.

    The parity of words with frequencies f is odd with probability (1 - product of (1 - 2f)) / 2.
    """
    odd = 1 - 2 * np.minimum(hist / max(n, 1), 1.0)
    bias = np.abs(np.multiply.reduceat(odd.reshape(-1, 64 * WORDS), [0], axis=0)[0])
    place = np.empty(64 * WORDS, dtype=np.uint64)
    place[np.argsort(bias, kind="stable")] = np.arange(64 * WORDS, dtype=np.uint64)
    return place


def similar_classes(classes: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity): class pairs with Jaccard similarity of at least ``t``, a < b."""
    spark = classes.sparkSession
    # Bounded: one count per hash bucket.
    hist = np.zeros(BUCKETS, dtype=np.int64)
    for r in classes.select(F.explode("words").alias("w")).groupBy(key_bucket(F.col("w"), BUCKETS).alias("b")).count().collect():
        hist[r["b"]] = r["count"]
    counts = spark.sparkContext.broadcast((hist, bit_places(hist, classes.count())))
    cap = CAP

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, place = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            cid = b.column(0).to_numpy()
            col = b.column(1)
            n = np.diff(col.offsets.to_numpy()).astype(np.int64)
            h = col.flatten().to_numpy()
            doc = np.repeat(np.arange(len(cid)), n)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            bit = place[h & (64 * WORDS - 1)]
            sig = np.zeros((len(cid), WORDS), dtype=np.uint64)
            for w in range(WORDS):
                v = np.where(bit >> np.uint64(6) == w, np.uint64(1) << (np.uint64(63) - (bit & np.uint64(63))), np.uint64(0))
                sig[:, w] = np.bitwise_xor.reduceat(v, start)
            f = freq[np.mod(h, BUCKETS)]
            order = np.lexsort((h, f, doc))
            rank = np.arange(len(h)) - np.repeat(start, n)
            prefix = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            take = order[rank < np.repeat(prefix, n)]
            word, who, seen = h[take], doc[take], f[take]
            # A shard larger than the cap becomes nb blocks; the pairs of blocks (own, other) are its tasks.
            nb = -(-seen // cap)
            own = (cid[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % nb
            rep = np.repeat(np.arange(len(who)), nb)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(nb) - nb, nb)
            lo, hi = np.minimum(own[rep], other), np.maximum(own[rep], other)
            task = (word[rep].view(np.uint64) * np.uint64(31) + (lo * 1_000_003 + hi).astype(np.uint64)).view(np.int64)
            side = np.where(lo == hi, -1, (own[rep] == hi).astype(np.int64)).astype(np.int8)
            who = who[rep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), pa.array(cid[who]), pa.array(n[who].astype(np.int32)), pa.array(side),
                 *[pa.array(sig[who, w].view(np.int64)) for w in range(WORDS)]],
                ["task", "cid", "n", "side", "s0", "s1", "s2", "s3"],
            )

    sharded = classes.select("cid", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(
        shards, "task long, cid long, n int, side byte, s0 long, s1 long, s2 long, s3 long"
    )

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of whole shards, in the order of their tasks: small ones together, each large one by its trie."""
        c = {k: rows.column(k).to_numpy() for k in rows.column_names}
        sig = np.stack([c[f"s{w}"].view(np.uint64) for w in range(WORDS)], axis=1)
        starts = np.concatenate([[0], np.flatnonzero(c["task"][1:] != c["task"][:-1]) + 1])
        sizes = np.diff(np.append(starts, len(sig)))
        found = []
        many = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        if len(many):
            few = sizes[sizes <= SMALL]
            i, j = small_joins(sig[many], c["n"][many], t, np.cumsum(few) - few, c["side"][many])
            found.append((many[i], many[j]))
        for lo, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            side = c["side"][lo : lo + n]
            i, j = trie_self_join(sig[lo : lo + n], c["n"][lo : lo + n], t, None if (side == -1).all() else side)
            found.append((lo + i, lo + j))
        for i, j in found:
            if len(i):
                a, b = c["cid"][i], c["cid"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    candidates = map_whole_groups(sharded, "task", pairs_of, "a long, b long").where("a <> b").distinct()
    inter = F.size(F.array_intersect("wa", "wb"))
    return (
        candidates.join(classes.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a")
        .join(classes.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
        .select("a", "b", (inter / (F.size("wa") + F.size("wb") - inter)).alias("similarity"))
        .where(F.col("similarity") >= F.lit(t))
    )


def similar_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(test_a, test_b): class pairs, and classes of several ids, as pairs of different ids.

    A class of many ids is paired with itself in parts: each part of its ids meets all of them in a task of its own.
    """
    across = (
        pairs.select("a", "b")
        .join(members.select(F.col("cid").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("cid").alias("b"), F.col("id").alias("y")), "b")
    )
    sized = members.groupBy("cid").agg(F.ceil(F.count("*") / PER_PART).cast("int").alias("parts"), F.count("*").alias("m")).where("m > 1")
    own = members.join(sized, "cid")
    left = own.select("cid", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    right = own.select("cid", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    inside = left.join(right, ["cid", "part"]).where("x < y")
    return (
        across.select("x", "y").unionByName(inside.select("x", "y"))
        .where("x <> y")
        .select(F.least("x", "y").alias("test_a"), F.greatest("x", "y").alias("test_b"))
        .distinct()
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): connected components of (id) under (a, b); the label is the smallest id.

    Each round takes the smallest label among the neighbours, then jumps to the label's own label, so long
    chains halve. Every round is a written table: a lost executor costs one round, and nothing is collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        )
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        # Only labels that have changed themselves are looked up; the rows of one label, however many, do so in parts.
        moved = step.where("id <> label").select(F.col("id").alias("label"), F.col("label").alias("up"))
        moved = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        step = materialize(
            step.join(moved, ["label", "salt"], "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels"
        )
        done = step.where("old <> label").limit(1).count() == 0
        labels = step.select("id", "label")
        if done:
            return labels
