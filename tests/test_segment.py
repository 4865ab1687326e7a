import random

import numpy as np
from pyspark.sql import functions as F

from loomtrace.operators import diff as D
from loomtrace.operators import segment as S
from loomtrace.operators import similarity as V


def frame(spark, texts):
    return S.lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("pos", F.lit("clash")))


def test_lines(spark):
    got = frame(spark, ["a\r\nb\rc\n", "", None]).collect()
    assert [(r["doc_id"], r["pos"], r["line"]) for r in got] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (0, 3, ""), (1, 0, "")]


def test_words_to_paragraphs(spark):
    words = [(1, "b", 10.0, 15.0, 4.0, 9.0), (1, "a", 0.0, 5.0, 5.0, 10.0), (1, "near", 0.0, 5.0, 18.0, 24.0), (1, "far", 0.0, 5.0, 32.1, 38.0), (1, "DESC: x", 0.0, 9.0, 40.0, 44.0)]
    ln = S.word_lines(spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double, bottom double"))
    assert {r["text"] for r in ln.collect()} == {"a b", "near", "far", "DESC: x"}
    assert [r["text"] for r in S.paragraphs(ln).orderBy("top").collect()] == ["a b near", "far", "DESC: x"]


def test_sections_and_slices(spark):
    ln = frame(spark, ["intro\n1 First\nx\n1.2 Second\ny\nz", "no heading"])
    got = [(r["doc_id"], r["line"], r["section_path"], r["section_no"]) for r in S.sections(ln).orderBy("doc_id", "pos").collect()]
    assert got == [(0, "intro", "PREAMBLE", 0), (0, "1 First", "1", 1), (0, "x", "1", 1), (0, "1.2 Second", "1.2", 2), (0, "y", "1.2", 2), (0, "z", "1.2", 2), (1, "no heading", "PREAMBLE", 0)]
    assert {tuple(r) for r in S.block_slices(ln, F.col("line").rlike(S.HEADING)).collect()} == {(0, 0, 0, 0, 1), (0, 1, 1, 2, 2), (0, 2, 3, 5, 3), (1, 0, 0, 0, 1)}


def test_items_labels_steps(spark):
    ln = frame(spark, ["lead\n- one\nmore\n\n* two\n3) three"])
    assert [(r["item"], r["text"]) for r in S.fold_items(ln).orderBy("item").collect()] == [(0, "lead"), (1, "one more"), (2, "two"), (3, "three")]
    lab = S.labelled_values(frame(spark, ["x\nTITLE: old\nDESC: a\nb\n\nRAT:\nTITLE: new"]), ["TITLE", "DESC", "RAT"], ["doc_id"])
    assert {(r["label"], r["value"]) for r in lab.collect()} == {("TITLE", "new"), ("DESC", "a b"), ("RAT", "")}
    st = S.step_categories(frame(spark, ["And first\nGiven a\nAnd b\nWhen c\nBut d\nprose\nThen e"]), ["doc_id"])
    assert [r["kind"] for r in st.orderBy("pos").collect()] == ["outcome", "precondition", "precondition", "action", "action", "outcome"]


def test_heading_stack_equals_a_stack(spark):
    r = random.Random(1)
    rows = [(d, p, r.randint(1, 6), f"h{d}.{p}") for d in range(6) for p in range(30)]
    want = {}
    for d in range(6):
        stack = []
        for _, p, lv, t in [x for x in rows if x[0] == d]:
            while stack and stack[-1][0] >= lv:
                stack.pop()
            stack.append((lv, t))
            want[d, p] = " > ".join(x for _, x in stack)
    got = S.heading_stack(spark.createDataFrame(rows, "d int, pos int, level int, title string"), ["d"])
    assert {(x["d"], x["pos"]): x["section_path"] for x in got.collect()} == want


def test_anchor_groups_equal_a_loop(spark):
    r = random.Random(2)
    rows = [(s, p, r.random() < 0.25, r.random() < 0.25, r.random() < 0.4, round(r.random(), 2)) for s in range(5) for p in range(40)]
    want = {}
    for s in range(5):
        n, open_ = 0, False
        for _, p, strict, narrative, attach, score in [x for x in rows if x[0] == s]:
            if strict:
                n, open_ = n + 1, True
                want[s, p] = n
            elif open_ and narrative:
                open_, want[s, p] = False, 0
            else:
                want[s, p] = n if open_ and (attach or score >= 0.45) else 0
    df = spark.createDataFrame(rows, "s int, pos int, strict boolean, narrative boolean, attachable boolean, score double")
    assert {(x["s"], x["pos"]): x["grp"] for x in S.anchor_groups(df, ["s"]).collect()} == want


def test_inside_box(spark):
    c = "page int, id string, x0 double, top double, x1 double, bottom double"
    b = spark.createDataFrame([(1, "in", 1.0, 1.0, 2.0, 2.0), (1, "edge", 0.0, 0.0, 5.0, 5.0), (1, "out", 4.0, 4.0, 6.0, 6.0), (2, "other", 1.0, 1.0, 2.0, 2.0)], c)
    t = spark.createDataFrame([(1, "t", 0.0, 0.0, 5.0, 5.0), (1, "t", 0.0, 0.0, 5.0, 5.0)], c)
    assert {r["id"] for r in S.inside_box(b, t).collect()} == {"in", "edge"}


def test_top_k(spark):
    r = np.random.RandomState(0)
    x = r.standard_normal((200, 16)).astype(np.float32)
    x[7] = 0
    x[20] = x[10]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None)], "id long, embedding array<float>")
    got = {}
    for q in V.top_k(df, df.where("id < 30 and embedding is not null"), 4, block=8).collect():
        got.setdefault(q["query_id"], {})[q["rank"]] = q["id"]
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    for i in range(30):
        if i == 7:
            assert i not in got
            continue
        c = np.round(u @ u[i], 6)
        c[7] = -9
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.lexsort((np.arange(200), -c))[:4].tolist()
    assert V.top_k(df, df.where("1 = 0"), 4).count() == 0
    m = df.where("id in (7, 10)").select("id", V.norm("embedding").alias("n"), V.normalize("embedding").alias("u"), V.cosine("embedding", "embedding").alias("c"), V.l2_to_similarity(F.lit(0.0)).alias("s")).orderBy("id").collect()
    assert m[0]["n"] == 0 and m[0]["u"] is None and m[0]["c"] is None and abs(m[1]["c"] - 1) < 1e-9 and m[1]["s"] == 1.0


def test_diff(spark):
    b, a = spark.createDataFrame([("n", "x", 3), ("n", "y", 1)], "kind string, name string, n long"), spark.createDataFrame([("n", "x", 5), ("n", "z", 0)], "kind string, name string, n long")
    assert {(r["name"], r["before"], r["after"], r["delta"]) for r in D.stat_diff(b, a).collect()} == {("x", 3, 5, "+2"), ("y", 1, 0, "-1"), ("z", 0, 0, "±0")}
    f = D.flat_export(spark.createDataFrame([(["a", None, "b"], [1], {"k": 1}, None)], "s array<string>, i array<int>, m map<string,int>, n string")).first()
    assert tuple(f) == ("a; b", "[1]", '{"k":1}', None)
    k = D.new_keys(spark.createDataFrame([("a",), ("a",)], "k string"), spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), "k")
    assert {tuple(r) for r in k.collect()} == {("a", False), ("b", True)}
