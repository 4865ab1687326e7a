import datetime as dt
import threading

import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm import vectors as V

SCHEMA = "node_id string, embedding_bytes binary, created_at timestamp_ntz"
T = dt.datetime


def brute(vectors, k):
    """{(node, neighbour)} by sorting all cosines."""
    ids = sorted(vectors)
    m = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    out = {}
    for a, i in enumerate(ids):
        c = np.round(m @ m[a], 6)
        out[i] = [ids[b] for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-c[b], ids[b]))[:k]]
    return out


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["node_id"], {})[r["rank"]] = r["neighbour"]
    return {i: [v[k] for k in sorted(v)] for i, v in out.items()}


def test_dirty_rows_and_ties(spark):
    r = np.random.RandomState(0)
    v = {f"n{i:02d}": r.standard_normal(384) for i in range(30)}
    v |= {f"t{i}": 3.0 * (i + 1) * v["n05"] for i in range(8)}  # one class of nine, of different lengths
    rows = [(i, x.astype("<f4").tobytes(), T(2025, 1, 1)) for i, x in v.items()]
    nan = np.full(384, np.nan, "<f4").tobytes()
    bad = [("z1", b"", None), ("z2", None, T(2025, 1, 1)), ("z3", nan, T(2025, 1, 1)), ("z4", np.zeros(384, "<f4").tobytes(), T(2025, 1, 1)), ("z5", rows[0][1] * 2, T(2025, 1, 1)), (None, rows[0][1], T(2025, 1, 1))]
    newer = [("n00", rows[1][1], T(2024, 1, 1)), ("z6", rows[3][1], T(2025, 1, 1)), ("z6", nan, T(2025, 2, 1)), ("n00", rows[0][1], T(2025, 1, 1))]
    df = spark.createDataFrame(rows + bad + newer, SCHEMA).withColumn("q", F.lit("clash")).withColumn("cid", F.lit(1))
    assert lists(V.nearest(df, "node_id", "embedding_bytes", "created_at")) == brute({i: x.astype("<f4").astype(float) for i, x in v.items()}, 5)


def test_recall_with_crowd(spark, monkeypatch):
    """Clusters of a few tens and one crowd of a third of all rows, buckets split into blocks."""
    monkeypatch.setattr(V, "BLOCK", 256)
    r = np.random.RandomState(1)
    n, centres = 3000, r.standard_normal((40, 384))
    at = np.where(np.arange(n) % 3 == 0, 0, r.randint(1, 40, n))
    x = centres[at] + 0.7 * r.standard_normal((n, 384))
    v = {f"v{i:05d}": x[i].astype("<f4") for i in range(n)}
    df = spark.createDataFrame([(i, y.tobytes(), T(2025, 1, 1)) for i, y in v.items()], SCHEMA)
    got, want = lists(V.nearest(df, "node_id", "embedding_bytes", "created_at")), brute({i: y.astype(float) for i, y in v.items()}, 5)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits / (5 * n) >= 0.9


def test_empty_and_single(spark):
    assert V.nearest(spark.createDataFrame([], SCHEMA), "node_id", "embedding_bytes", "created_at").count() == 0
    one = spark.createDataFrame([("a", np.ones(384, "<f4").tobytes(), T(2025, 1, 1))], SCHEMA)
    assert V.nearest(one, "node_id", "embedding_bytes", "created_at").count() == 0


def test_probe_order():
    r = np.random.RandomState(2)
    x = r.standard_normal((50, 384)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = V.StableHash(x[:20], 5)
    p = h.probes(x, 4)[:, 0]
    assert h.tables == 1 and p.shape == (50, 4) and all(len(set(row)) == 4 for row in p.tolist())
    assert (p[:, :1] == h.probes(x, 1)[:, 0]).all()
    wide = V.StableHash(x[:20], 21)
    assert wide.tables == 5 and wide.probes(x).shape == (50, 5, 4)
    assert len(np.unique(wide.probes(x)[0])) == 20  # tables share no bucket


def test_ties_beyond_the_rounding_are_kept():
    s = np.array([[0.9, 0.8, 0.8 - 1e-6, 0.8 + 1e-6, 0.7, -2.0], [-2.0] * 6], dtype=np.float32)
    i, j = V.near(s, 2)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert len(V.near(s[:1, :2], 5)[0]) == 2


def test_recall_of_long_hashes():
    """Hashes as long as some million and a thousand million vectors need, on clusters: pairs that meet against brute force."""
    r = np.random.RandomState(3)
    n, centres = 3000, r.standard_normal((150, 384))
    x = (centres[r.randint(0, 150, n)] + 0.7 * r.standard_normal((n, 384))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    a, b = np.repeat(np.arange(n), 5), np.argpartition(-s, 5, axis=1)[:, :5].ravel()
    anchors = V.fit_anchors(x, n // V.PER_ANCHOR)
    for k in (7, 12, 21):
        p = V.StableHash(anchors, k).probes(x)
        met = np.zeros(len(a), dtype=bool)
        for t in range(p.shape[1]):
            met |= (p[a, t] == p[b, t, :1]).any(axis=1) | (p[b, t] == p[a, t, :1]).any(axis=1)
        assert met.mean() >= 0.9


def clustered(n, seed):
    """Rows in clusters, one of them with a third of all."""
    r = np.random.RandomState(seed)
    centres = r.standard_normal((40, 384))
    at = np.where(np.arange(n) % 3 == 0, 0, r.randint(1, 40, n))
    x = (centres[at] + 0.7 * r.standard_normal((n, 384))).astype("<f4")
    return [(f"v{i:05d}", y.tobytes(), T(2025, 1, 1)) for i, y in enumerate(x)]


def test_disk_holds_one_hash_table(spark, monkeypatch):
    """Shuffle files stay below the budget of four times the input with three hash tables and crowded buckets."""
    monkeypatch.setattr(V, "TARGET", 2)  # a hash as long as for some million vectors
    monkeypatch.setattr(V, "BLOCK", 64)
    rows = clustered(3000, 4)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def sizes():
        it, out = files.getAllFiles().iterator(), {}
        while it.hasNext():
            f = it.next()
            if f.getName().startswith("shuffle"):
                out[f.getName()] = f.length()
        return out

    before, peak, over = set(sizes()), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], sum(v for k, v in sizes().items() if k not in before))

    t = threading.Thread(target=watch)
    t.start()
    try:
        got = V.nearest(spark.createDataFrame(rows, SCHEMA), "node_id", "embedding_bytes", "created_at").count()
    finally:
        over.set()
        t.join()
    assert 0 < peak[0] < 4 * 1536 * len(rows)
    assert got > 4.5 * len(rows)  # such small buckets hold fewer than five others now and then


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(clustered(1500, 6), SCHEMA)
    whole = lists(V.nearest(df, "node_id", "embedding_bytes", "created_at"))
    monkeypatch.setattr(V, "BLOCK", 100)
    monkeypatch.setattr(V, "VISITORS", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert lists(V.nearest(df, "node_id", "embedding_bytes", "created_at")) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bound_of_columns():
    s = np.random.RandomState(5).standard_normal((203, 7)).astype(np.float32)
    for n in (3, 5, 12, 203):
        kth = np.sort(s[:n], axis=0)[max(n - 5, 0)] if n >= 5 else np.full(7, -1.5)
        assert (V.kth_at_least(s[:n], 5) <= kth).all()
