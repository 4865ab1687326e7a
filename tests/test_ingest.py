from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import graph as G
from loomtrace.operators import segment as S
from loomtrace.sources import readers, sinks


def lines(spark, *texts):
    return S.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))


def test_paragraphs_of_lines(spark):
    text = "1 Title here\nfirst\nsecond\n\n \nthird\nANOTHER HEADING\n\nlast"
    got = sorted((r["doc_id"], r["para"], r["is_heading"], r["text"]) for r in S.paragraphs_of_lines(lines(spark, text, "", None)).collect())
    assert got == [(0, 1, True, "1 Title here"), (0, 2, False, "first\nsecond"), (0, 3, False, "third"), (0, 4, True, "ANOTHER HEADING"), (0, 5, False, "last")]


def test_tables(spark):
    text = "| a | b |\n|---|---|\n| 1 |  |\ntext\n| x |\n\n| y | z |"
    t = {(r["table_no"], r["n_rows"], r["n_cols"], r["text"]) for r in S.pipe_tables(lines(spark, text)).collect()}
    assert t == {(1, 2, 2, "a | b\n1 | "), (2, 1, 1, "x"), (3, 1, 2, "y | z")}
    assert S.pipe_tables(lines(spark, "none")).count() == 0


def test_stories(spark):
    text = "prose one\nAs a user I want a list\nso that I see it.\nafter the end\nScenario: login\nGiven a\nWhen b\nnot a step\n- bullet\nmore\nThen c"
    got = [(r["kind"], r["unit"]) for r in S.story_units(lines(spark, text)).orderBy("pos").collect()]
    assert got == [("prose", "p0"), ("story", "g1"), ("story", "g1"), ("prose", "p3"), ("scenario", "g2"), ("scenario", "g2"), ("scenario", "g2"), ("prose", "p7"), ("bullet", "g3"), ("prose", "p9"), ("step", "p10")]


def test_contents(spark):
    rows = ["3.2 Functions .... 12", "Appendix IV: Terms … … 99", "Reference.....3", "no entry 4", "", None, "1 A .. 99999999999"]
    df = spark.createDataFrame([(x,) for x in rows], "line string").select(X.toc_entry("line").alias("e"))
    assert [tuple(r["e"]) if r["e"] else None for r in df.collect()] == [("3.2", "Functions", 12), ("A.4", "Terms", 99), ("", "Reference", 3), None, None, None, ("1", "A", None)]
    pages = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 1), (1, 3, 0), (1, 4, 5), (2, 0, 2), (3, 0, 4)], "doc_id int, page int, n int")
    assert {tuple(r) for r in S.toc_run(pages).collect()} == {(1, 1, 2), (3, 0, 0)}


def test_deep_headings(spark):
    h = spark.createDataFrame([(1, i, i, f"h{i}") for i in range(1, 10)], "doc_id int, pos int, level int, title string")
    got = {r["pos"]: r["section_path"] for r in S.heading_stack(h, ["doc_id"]).collect()}
    assert got[6] == "h1 > h2 > h3 > h4 > h5 > h6" and got[9] == "h1 > h2 > h3 > h4 > h5 > h9"


def test_acceptance_unit(spark):
    rows = ["The user must be able to sign in", "too short must", "1 2 3 4 5 6", "Page 3 the user must see the list", "no hint of any kind in here at all", None, ""]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(X.acceptance_unit("t").alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True, False, False, False, False, False, False]


def test_route_and_anchors(spark):
    q = spark.createDataFrame([("debug", "r", None), ("", "r", None), (None, None, None), ("other", "r", "q"), ("debug", "", None), ("debug", None, "q")], "task string, req_id string, query_text string")
    assert [r["error"] for r in G.route(q).collect()] == [None, "task is required", "task is required", "unsupported task", "req_id or query_text is required", None]
    c = spark.createDataFrame([(1, "a", "CHUNK", 0.9), (1, "b", "CRU", 0.2), (1, "c", "CRU", 0.5), (1, "d", "CHUNK", 0.9)], "query_id int, id string, node_type string, score double")
    assert [r["id"] for r in G.anchors(c, 3).orderBy("place").collect()] == ["c", "b", "a"]


def test_contract(spark):
    c = spark.createDataFrame([("R", 0.4, True), ("S", 0.0, False)], "rel_type string, least double, needs_reason boolean")
    e = spark.createDataFrame([("a", "R", "b", 0.3, None), ("a", "R", "c", 0.5, '{"confidence_reason": "x"}'), ("a", "S", "b", None, None), ("a", "T", "b", 1.0, None)], "src_id string, rel_type string, dst_id string, confidence double, extra_json string")
    assert {(r["dst_id"], r["rel_type"], r["breach"]) for r in G.contract_breaches(e, c).collect()} == {("b", "R", "confidence"), ("b", "R", "reason"), ("b", "S", "confidence"), ("b", "T", "unknown_relation")}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", " x ", 1), ("b", 'say "hi"', None), ("b2", "two\nlines", 3)], "id string, t string, n int")
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"file://{tmp_path}/csv")
    assert {(r["id"], r["t"]) for r in back.collect()} == {("a", " x "), ("b", 'say "hi"'), ("b2", "two\nlines")}
    sinks.write_documents(df, f"file://{tmp_path}/json", F.substring("id", 1, 1), "rows")
    rows = readers.read_json_rows(spark, f"file://{tmp_path}/json", ["rows"], "id string, t string, n int")
    assert {(r["id"], r["t"], r["n"]) for r in rows.collect()} == {("a", " x ", 1), ("b", 'say "hi"', None), ("b2", "two\nlines", 3)}
    for _ in range(2):
        sinks.append_log(df, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 6
    status = readers.load_status(spark.createDataFrame([("{}",), ("[1]",), ("{",), (None,), ("",)], "t string"), "t")
    assert [r["exit_code"] for r in status.collect()] == [0, 2, 2, 2, 2]


def test_blocked_top_k(spark):
    """Blocks of either side change nothing; zero and null vectors are nobody's neighbours, ties go to the smaller id."""
    import numpy as np

    from loomtrace.operators import similarity as V

    r = np.random.RandomState(3)
    x = r.standard_normal((90, 8)).round(1)
    x[10], x[20], x[21] = 0, x[5], x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<double>").withColumn("side", F.lit("clash"))
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = np.round(u @ u.T, 6)
    want = {(q, i, k + 1) for q in range(0, 90, 10) if q != 10 for k, i in enumerate(sorted((j for j in range(90) if j != 10), key=lambda j: (-c[q, j], j))[:4])}
    for qb, bb in ((2048, 1 << 15), (2, 7)):
        assert {(t["query_id"], t["id"], t["rank"]) for t in V.top_k(df, df.where("id % 10 = 0"), 4, qb, bb).collect()} == want
    assert V.top_k(df, df.where("1 = 0"), 4).count() == 0 and V.top_k(df.where("1 = 0"), df, 4).count() == 0
