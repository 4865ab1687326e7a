import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.llm import neardup as N

SCHEMA = "test_id string, title string, description string"


def words(title, description):
    return frozenset(re.findall("[a-z0-9]+", f"{title or ''} {description or ''}".lower()))


def brute(rows, t):
    rows = {(i, words(a, b)) for i, a, b in rows if i is not None}
    return {tuple(sorted((i, j))) for i, a in rows for j, b in rows if i != j and a and b and len(a & b) >= t * len(a | b)}


def found(df, t=0.6):
    classes, members = N.word_classes(df, "test_id", ["title", "description"])
    return {tuple(r) for r in N.similar_pairs(members, N.similar_classes(classes, t)).collect()}


def corpus(n, seed=0):
    r = np.random.RandomState(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and r.rand() < 0.5:
            w = list(out[r.randint(len(out))])
            for _ in range(r.randint(0, 9)):
                w[r.randint(len(w))] = vocabulary[r.randint(400)]
        else:
            w = [vocabulary[int(k)] for k in 400 * r.rand(r.randint(3, 40)) ** 2]
        out.append(w)
    return [(f"t{i:04d}", " ".join(w[:3]), " ".join(w[3:])) for i, w in enumerate(out)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CAP", 64)  # so that words are split into pairs of blocks
    rows = corpus(700)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 0.6)


def test_dirty(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [("a", None, "One two THREE"), ("b", "one two", "three"), ("b", "one two", "three"), ("c", "one-two", None), ("d", None, None), ("e", "", "...!"), ("f", "", ""), (None, "one two three", ""),
            ("g", "Größe", None), ("h", "gr e", ""), ("i", long, "q"), ("j", long, "p"), ("b", "other text here", None), ("k", "other text", "here")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cid", F.lit("clash")).withColumn("words", F.lit(0))
    got = found(df)
    assert got == brute(rows, 0.6) and ("g", "h") in got and ("a", "c") in got and ("b", "k") in got
    assert found(df.where("1 = 0")) == set()


def test_hot_class(spark, monkeypatch):
    """A third of all rows equal: they are one class until the pairs of different ids are written, in parts."""
    monkeypatch.setattr(N, "PER_PART", 7)
    rows = [(f"h{i:03d}", "same text", "in all of them") for i in range(60)] + corpus(120, 3)
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows, 0.6) and len([p for p in got if p[0][0] == "h"]) == 60 * 59 // 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 40), min_size=1, max_size=20), min_size=2, max_size=40), st.sampled_from([0.5, 0.6, 0.8]))
def test_trie_loses_nothing(sets, t):
    sig = np.zeros((len(sets), N.WORDS), dtype=np.uint64)
    for i, s in enumerate(sets):
        for x in s:
            sig[i, x % N.WORDS] ^= np.uint64(1) << np.uint64(x * 7 % 64)
    i, j = N.trie_self_join(sig, np.array([len(s) for s in sets]), t)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(got) == len(i)
    assert got >= {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_trie_splits_nodes(monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    r = np.random.RandomState(4)
    sig = r.randint(0, 2**63, (80, N.WORDS)).astype(np.uint64)
    sig[40:] = sig[:40] ^ np.uint64(5)
    n = np.full(80, 20)
    i, j = N.trie_self_join(sig, n, 0.6)
    budget = 10
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if int(np.bitwise_count(sig[a] ^ sig[b]).sum()) <= budget}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want
    side = (np.arange(80) >= 40).astype(np.int8)
    i, j = N.trie_self_join(sig, n, 0.6, side)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in want if side[a] != side[b]}


def test_trie_cuts_node_pairs(monkeypatch):
    """Where the budget is smaller than the paths, most pairs are cut before two sets are compared."""
    monkeypatch.setattr(N, "LEAF", 64)
    sig = np.random.RandomState(6).randint(0, 2**63, (2000, N.WORDS)).astype(np.uint64)
    sig[1000:] = sig[:1000]
    seen = {}
    i, j = N.trie_self_join(sig, np.full(2000, 20), 0.95, None, seen)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == {(a, a + 1000) for a in range(1000)}
    assert seen["cut"] > 0.9 * 2000 * 1999 / 2


def test_half_of_the_bits_cuts_most():
    """Most pairs of longer sets are cut by the folded bitmap."""
    r = np.random.RandomState(7)
    f = 0.5 / (1 + np.arange(600)) ** 0.6
    sets = [np.flatnonzero(r.rand(600) < f * 3) for _ in range(800)]
    hist = np.zeros(N.BUCKETS, dtype=np.int64)
    for x in sets:
        hist[x * 97] += 1
    place = N.bit_places(hist, len(sets))
    assert sorted(place.tolist()) == list(range(64 * N.WORDS))
    sig = np.zeros((len(sets), N.WORDS), dtype=np.uint64)
    for i, x in enumerate(sets):
        for b in place[(x * 97) % (64 * N.WORDS)]:
            sig[i, int(b) >> 6] ^= np.uint64(1) << np.uint64(63 - (int(b) & 63))
    seen = {}
    N.trie_self_join(sig, np.array([len(x) for x in sets]), 0.6, None, seen)
    assert seen["half"] > 0.9 * seen["leaf"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.frozensets(st.integers(0, 30), min_size=1, max_size=12), st.sampled_from([-1, 0, 1])), min_size=1, max_size=9), min_size=1, max_size=8))
def test_small_groups_together(groups):
    """Many small groups at once against each by its trie."""
    rows = [(g, s, side if any(x[1] == -1 for x in rows_) is False else -1) for g, rows_ in enumerate(groups) for s, side in rows_]
    sig = np.zeros((len(rows), N.WORDS), dtype=np.uint64)
    for i, (_, s, _) in enumerate(rows):
        for x in s:
            sig[i, x % N.WORDS] ^= np.uint64(1) << np.uint64(x * 7 % 64)
    size, side, group = np.array([len(s) for _, s, _ in rows]), np.array([x for _, _, x in rows], dtype=np.int8), np.array([g for g, _, _ in rows])
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    i, j = N.small_joins(sig, size, 0.6, starts, side)
    want = set()
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        a, b = N.trie_self_join(sig[at], size[at], 0.6, None if (side[at] == -1).all() else side[at])
        want |= {tuple(sorted((int(at[x]), int(at[y])))) for x, y in zip(a, b, strict=True)}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 29)] + [(40, 41), (41, 40), (45, 45)], "a long, b long")
    got = {r["id"]: r["label"] for r in N.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 30 else 40 if i in (40, 41) else i for i in range(60)}
