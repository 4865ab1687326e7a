from pyspark.sql import functions as F

from loomtrace.functions import text as X
from loomtrace.operators import context as C


def test_warnings_and_pack(spark):
    a = spark.createDataFrame([("q",), ("q",), ("none",)], "anchor string")
    ev = spark.createDataFrame([("q", "c1", 0.9, "graph", "d", 1), ("q", "c2", 0.5, "vector", None, 2), ("other", "c3", 0.1, "vector", "", 1)], "anchor string, node_id string, score double, provenance string, doc_id string, rank int")
    fb = spark.createDataFrame([("q", True), ("none", True)], "anchor string, fallback boolean")
    w = C.warnings(a, ev, ["doc_id"], fb)
    assert {tuple(r) for r in w.collect()} == {("none", "MISSING_EVIDENCE", None), ("q", "MISSING_FIELD:doc_id", "c2"), ("q", "LOW_CONFIDENCE_VECTOR", "c2"), ("q", "VECTOR_FALLBACK_TRIGGERED", None)}
    parents = spark.createDataFrame([("c1", "p", 1.0, 1), ("c2", "p", 1.0, 1), ("c3", "z", 1.0, 1)], "child string, parent string, confidence double, rank int")
    arr = spark.createDataFrame([("q", f"n{i:02d}", 1 + i % 2, 0.5) for i in range(30)], "anchor string, node_id string, depth int, score double")
    p = {r["anchor"]: r for r in C.pack(a, ev, parents, w, arr).collect()}
    assert [e["node_id"] for e in p["q"]["evidence"]] == ["c1", "c2"] and p["q"]["parents"] == ["p"] and len(p["q"]["related"]) == 20 and len(p["q"]["warnings"]) == 3
    assert p["none"]["evidence"] is None and [x["code"] for x in p["none"]["warnings"]] == ["MISSING_EVIDENCE"] and set(p) == {"q", "none"}


def test_citations(spark):
    ev = spark.createDataFrame([("q", "c1"), ("q", "c1"), ("z", "c2")], "anchor string, node_id string")
    t = spark.createDataFrame([("1", "q", ["s"], "x", ["c1", "c2"]), ("2", "q", ["s"], "x", ["c2"]), ("3", "q", None, "x", ["c1"]), ("4", "q", ["s"], " ", None)], "test_id string, anchor string, test_steps array<string>, expected_result string, citations array<string>")
    assert {(r["test_id"], tuple(r["citations"]), r["code"]) for r in C.check_citations(t, ev).collect()} == {("1", ("c1",), None), ("2", (), "unresolved"), ("3", ("c1",), "no_steps"), ("4", (), "no_expected_result")}


def test_more_text_functions(spark):
    raw = {"I": "A.1", "iv": "A.4", "IX": "A.9", "VX": "A.5", "IIII": "A.4", "XX": "A.24", "B": "A.2", "3.2": "3.2", " 4 ": "4", "XII": "XII", "word": "word", "": "", None: ""}
    raw["XX"] = "XX"
    got = spark.createDataFrame([(k,) for k in raw], "s string").select("s", X.section_path("s").alias("p"))
    assert {r["s"]: r["p"] for r in got.collect()} == raw
    h = {"1.2 Scope": (2, "numeric"), "1. The end": (None, "list_item"), "GENERAL NOTES": (1, "allcaps"), "Some Title Here": (2, "titlecase"), "Inputs:": (None, "label"), "": (None, "none"), "a sentence. here it is": (None, "none"), "1 " + "x" * 90: (None, "too_long")}
    got = spark.createDataFrame([(k,) for k in h], "s string").select("s", X.heading("s").alias("h"))
    assert {r["s"]: tuple(r["h"]) for r in got.collect()} == h
    pics = [(40.0, 50.0, 1e5, True), (39.0, 80.0, 1e5, False), (40.0, 49.0, 1e5, False), (1000.0, 45.0, 1e6, False), (900.0, 45.0, 1e6, True), (100.0, 100.0, 1e7, False), (100.0, 100.0, 1.1e4, False), (100.0, 100.0, 0.0, False), (None, 1.0, 1.0, False)]
    got = spark.createDataFrame(pics, "w double, h double, a double, ok boolean").select("ok", X.keep_picture("w", "h", "a").alias("got")).collect()
    assert all(r["ok"] == r["got"] for r in got)
    tags = spark.createDataFrame([("QR9  System   Reliability",), ("QR9",), ("",), (None,)], "s string").select(X.tag_parts("s").alias("t")).collect()
    assert [tuple(r["t"]) for r in tags] == [("QR9", "System Reliability"), ("QR9", "QR9"), ("", ""), ("", "")]
    long = " ".join(f"w{i}" for i in range(20))
    got = spark.createDataFrame([(long,), ("One. Two",), ("line one\nline two. end",)], "s string").select(X.short_title("s")).collect()
    assert got[0][0] == " ".join(f"w{i}" for i in range(12)) + "..." and got[1][0] == "One." and got[2][0] == "line one"
    r = spark.createDataFrame([(["req_id_label", "req_desc_label", "gherkin_keyword"],), (["req_id_label", "gherkin_keyword"],), (["req_id_label", "planguage_keyword", "prose_content"],), (["req_id_label"],), ([],)], "r array<string>")
    assert [x[0] for x in r.select(X.input_format("r")).collect()] == ["labeled", "gherkin", "planguage", "prose", "prose"]
    assert spark.range(1).select(X.actor(F.lit("The Admin user")), X.method_confidence(F.lit("llm")), X.provenance_confidence(F.lit("llm"), F.lit(True))).first()[:] == ("Administrator", "medium", "medium")


def test_may_split(spark):
    cases = {"Validates the form.\nInserts the row": True, "Validates the form": False, "x\nFor guests: show the page": True, "Filters": False, "it validates. it inserts": False, None: False}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.may_split("t").alias("s"))
    assert {r["t"]: r["s"] for r in got.collect()} == cases
