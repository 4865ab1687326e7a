import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.llm import mix as M
from loomtrace.llm import pack as P
from loomtrace.llm import split as S
from loomtrace.llm import tokens as T

LIMITS = "limit_name string, purpose string, max_tokens int, overlap_tokens int"
TEXTS = ["", " ", "one", "  lead and trail  ", "a\r\nb\r\n\r\nc", "don't stop; it's 5pm", "\t\tcode {x: 1}\n    if y:\n        z()", "中文句子。第二句！最后", "x" * 3000, "über straße ñandú " * 50, "no-blanks," * 400, "\n\n\n", "a b", " wide  gaps   here "]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 'sé中。\n\r\t 1.,_-"), max_size=60))
def test_units_add_up(text):
    assert "".join(T.units_of(text)) == text
    assert T.count_tokens(text) == len(T.encoding().encode_ordinary(text))


def test_counts(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).drop("n_tokens")
    got = {r["doc_id"]: r["n_tokens"] for r in T.with_token_counts(df, ["doc_id"]).collect()}
    assert got == {i: len(T.encoding().encode_ordinary(t)) for i, t in enumerate(TEXTS)} | {99: 0}


def check(histogram, capacity):
    used, bins = {}, 0
    for pattern, n in P.solve(histogram, capacity):
        assert n > 0 and sum(s * k for s, k in pattern) <= capacity
        bins += n
        for s, k in pattern:
            used[s] = used.get(s, 0) + n * k
    assert used == {s: n for s, n in histogram.items() if n}
    return bins


def fewest(items, capacity):
    """Exact number of containers for a few items."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= items[i]}):
            k = rooms.index(r)
            go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_packing(items):
    h = {s: items.count(s) for s in items}
    bins, least = check(h, 20), fewest(items, 20)
    assert least <= bins <= least + 1
    counts = dict(h)
    fixed = P.reduce_dominated(counts, 20)  # what is fixed is part of some best packing
    rest = [s for s, n in counts.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == least


def test_packing_large():
    r = random.Random(1)
    h = {}
    for _ in range(20_000):
        s = min(512, int(r.expovariate(1 / 120)) + 1)
        h[s] = h.get(s, 0) + 1
    h[100] = h.get(100, 0) + 10_000
    assert check(h, 512) <= 1.01 * -(-sum(s * n for s, n in h.items()) // 512)


@pytest.mark.parametrize("per_part", [100_000, 40])
def test_assignment(spark, monkeypatch, per_part):
    monkeypatch.setattr(P, "PER_PART", per_part)  # sizes of many texts are ranked in parts
    rows = [(i, 7) for i in range(400)] + [(400 + i, i % 23) for i in range(300)] + [(999, 65)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("tokens", F.lit(1)).withColumn("capacity", F.lit("clash"))
    lim = spark.createDataFrame([("s", "pack", 30, 0), ("m", "pack", 100, 0), ("bad", "pack", 0, 0)], LIMITS)
    a = P.pack(sizes, lim).collect()
    for name, cap in (("s", 30), ("m", 100)):
        own = [r for r in a if r["limit_name"] == name]
        got = {}
        for r in own:
            got.setdefault(r["doc_id"], []).append(r)
        assert {i: sum(r["tokens"] for r in g) for i, g in got.items()} == dict(rows)
        assert all(len(g) == 1 or dict(rows)[i] > cap for i, g in got.items())
        used = {}
        for r in own:
            assert (r["container_id"] is None) == (r["tokens"] == 0)
            if r["tokens"]:
                used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
        assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
        assert len(used) <= 1.02 * -(-sum(n for _, n in rows) // cap) + 1
    assert [r["start_token"] for r in sorted((r for r in a if r["doc_id"] == 999 and r["limit_name"] == "s"), key=lambda r: r["piece"])] == [0, 30, 60]
    f = P.fill(P.pack(sizes, lim), lim)
    assert f.where("share > 1 or share <= 0").count() == 0
    assert P.pack(sizes.where("1 = 0"), lim).count() == 0


TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, n=6000):
    rows = [(i, ["big", "Mid", "mid ", "small", None, "other"][0 if i % 3 else (i // 3) % 6], (i * 7919) % 90) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("src", F.lit("clash")).withColumn("uses", F.lit(0))


def test_mixture(spark):
    t = spark.createDataFrame([("BIG", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 3)], TARGETS)
    df = sized(spark)
    r = {x["src"]: x for x in M.report(df, M.mixture(df, t), t).collect()}
    for s, p in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert abs(r[s]["share"] - p) < 0.002 and r[s]["most_repeats"] <= r[s]["max_repeats"]
    assert all(x["unused_tokens"] == max(0, x["available_tokens"] - x["mixed_tokens"]) for x in r.values())
    uses, _ = M.thresholds(M.named(df), M.target_map(t))
    filtered = M.taken(df, uses).where("n_tokens > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "uses")).alias("repeat"))
    assert sorted(filtered.collect()) == sorted(M.mixture(df, t).select("doc_id", "repeat").collect())
    assert r["absent"]["share"] == 0 and r[None]["mixed_tokens"] == 0 and r["other"]["target_share"] == 0
    some = {(x["doc_id"], x["repeat"]) for x in M.mixture(df, t, total=20_000).collect()}
    more = {(x["doc_id"], x["repeat"]) for x in M.mixture(df, t, total=40_000).collect()}
    assert some < more  # nested budgets
    assert abs(sum(x["n_tokens"] for x in M.mixture(df, t, total=20_000).collect()) - 20_000) < 200
    assert M.mixture(df.where("1 = 0"), t).count() == 0 and M.mixture(df, t.where("1 = 0")).count() == 0


def test_budgets():
    assert M.budgets({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, None) == {"a": 20.0, "b": 20.0}
    assert M.budgets({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 100) == {"b": 20.0, "a": 80.0}
    assert M.budgets({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 1000) == {"a": 100.0, "b": 20.0}
    assert M.budgets({}, {"a": (1.0, 1)}, None) == {}


def documents():
    r = random.Random(3)
    prose = "".join(f"Sentence {i} of the {r.choice(['long', 'short', 'plain'])} text ends here{r.choice('.!?')}{r.choice([' ', ' ', chr(10), chr(10) * 2])}" for i in range(400))
    return {
        1: prose, 2: "x" * 5000, 3: "中文的句子没有空格。还有一句！" * 200, 4: "short", 5: "", 6: None, 7: "no-blanks," * 900, 8: "word " * 2000, 9: "\n" * 3000, 10: prose.replace("\n", "\r\n"), 11: ("é" * 37 + " ") * 300, 12: prose * 12,
    }


@pytest.mark.parametrize("range_bytes", [1 << 16, 1000])
def test_split(spark, range_bytes):
    docs = documents()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("no", F.lit("clash")).withColumn("raw", F.lit("clash"))
    lim = spark.createDataFrame([("fine", "split", 64, 8), ("wide", "split", 300, 0)], LIMITS)
    enc = T.encoding().encode_ordinary
    got = {}
    for r in S.split(df, lim, range_bytes=range_bytes).collect():
        got.setdefault((r["limit_name"], r["doc_id"]), []).append(r)
    for name, cap, overlap in (("fine", 64, 8), ("wide", 300, 0)):
        assert {i for n, i in got if n == name} == {i for i, t in docs.items() if t and len(enc(t)) > cap}
        for (n, i), rows in got.items():
            if n != name:
                continue
            raw, at, before = docs[i].encode(), 0, 0
            rows.sort(key=lambda r: r["piece_no"])
            for k, r in enumerate(rows):
                assert r["piece_no"] == k and raw[r["start_byte"] : r["end_byte"]].decode() == r["piece"]
                assert r["n_tokens"] == len(enc(r["piece"])) <= cap
                assert r["start_byte"] <= at < r["end_byte"] and (k == 0 or overlap or r["start_byte"] == at)
                if k and overlap and before > 4 * overlap and i in (1, 8, 10, 12):
                    assert overlap <= r["overlap_tokens"] <= overlap + 4
                at, before = r["end_byte"], r["n_tokens"]
            assert at == len(raw)
    ends = [r["piece"][-1] for r in sorted(got["wide", 1], key=lambda r: r["piece_no"])[:-1]]
    assert all(e in ".!?" for e in ends)
    if range_bytes == 1000:  # ranges change nothing
        whole = {(r["limit_name"], r["doc_id"], r["piece_no"], r["start_byte"], r["end_byte"]) for r in S.split(df, lim, range_bytes=1 << 24).collect()}
        assert whole == {(r["limit_name"], r["doc_id"], r["piece_no"], r["start_byte"], r["end_byte"]) for rows in got.values() for r in rows}
    assert S.split(df.where("1 = 0"), lim).count() == 0 and S.summary(S.split(df, lim)).count() == 2


def pieces_by_ranges(text, caps, size, fine):
    raw = text.encode()
    n = max(1, -(-len(raw) // size))
    stitcher = S.Stitcher(caps, T.VOCABULARY, fine)
    return [p for k in range(n) for p in stitcher.add(*S.range_table(raw[k * size : (k + 1) * size], k == 0, k == n - 1, T.VOCABULARY, fine), k == n - 1)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab1 .'-é中。\n\x1c\u3000😀"), max_size=300), st.integers(5, 60), st.integers(16, 40), st.integers(0, 30), st.sampled_from([1, 8]))
def test_ranges_change_nothing(text, size, limit, overlap, fine):
    caps = [("a", limit, overlap), ("b", 3 * limit, 0)]
    whole = sorted(pieces_by_ranges(text, caps, 1 << 30, fine))
    assert whole == sorted(pieces_by_ranges(text, caps, size, fine))
    enc, raw = T.encoding().encode_ordinary, text.encode()
    for name, _, a, b, n, repeated in whole:
        assert n == len(enc(raw[a:b].decode())) <= dict((c[0], c[1]) for c in caps)[name] and repeated < n
    for name, cap, _ in caps:
        assert (len(enc(text)) > cap) == any(p[0] == name for p in whole)


def test_long_words_in_ranges(spark):
    """The result is the same in ranges of 4 KB and 16 MB, also for words that are longer than a range and a limit."""
    r = random.Random(5)
    word = "".join(r.choice("abcdefghij0123456789+/") for _ in range(70_000))
    rows = [(1, word), (2, "a word " + word + " and another " + word[::-1]), (2, "the same id " * 3000), (3, "中文字" * 9000), (4, "few"), (None, word)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lim = spark.createDataFrame([("wide", "split", 32_768, 100), ("small", "split", 700, 50)], LIMITS)
    one, other = ([tuple(x) for x in S.split(df, lim, range_bytes=b).collect()] for b in (4096, 1 << 24))
    assert sorted(one) == sorted(other) and {x[1] for x in one} == {1, 2, 3}
    enc = T.encoding().encode_ordinary
    assert all(x[5] == len(enc(x[7])) <= (32_768 if x[0] == "wide" else 700) for x in one)
    assert {x[1] for x in one if x[0] == "wide"} == {i for i, t in rows if i and len(enc(t)) > 32_768}


def test_tiny_limits(spark):
    df = spark.createDataFrame([(1, "one two three four five " * 5)], "doc_id long, text string")
    got = S.split(df, spark.createDataFrame([("t", "split", 3, 1), ("none", "split", 0, 0)], LIMITS)).collect()
    assert got and all(r["n_tokens"] <= 3 for r in got)
