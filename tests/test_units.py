import difflib
import random

from pyspark.sql import functions as F

from loomtrace.functions import rules as R
from loomtrace.functions import text as X
from loomtrace.operators import coverage as C
from loomtrace.operators import quality as Q
from loomtrace.operators import units as U


def test_actions(spark):
    rows = [("r1", "gherkin", ["is logged in to x", "opens the page", None]), ("r2", "gherkin", ["already there"]), ("r3", "prose", ["already there"]), ("r4", "prose", None), (None, "prose", ["x"])]
    df = spark.createDataFrame(rows, "req_id string, input_format string, actions array<string>")
    assert {(r["cru_id"], r["action"]) for r in U.explode_actions(df).collect()} == {("CRU-r1-01", "opens the page"), ("CRU-r2-01", None), ("CRU-r3-01", "already there"), ("CRU-r4-01", None)}


def test_chunking_equals_a_loop(spark):
    r = random.Random(1)
    rows = [(f"c{i:03d}", r.choice(["q1", "q2", "q30", None, ""]), r.choice(["1.1", "2", None]), r.choice(["security", "quality"])) for i in range(60)]
    df = spark.createDataFrame(rows, "cru_id string, parent_requirement_id string, s string, cru_type string").withColumn("traceability", F.struct(F.col("s").alias("section_path")))
    want, no = [], 0
    groups = {}
    for c, p, s, _ in rows:
        groups.setdefault(p or "UNKNOWN", []).append((s or "", c))
    for p in sorted(groups):
        own = [c for _, c in sorted(groups[p])]
        for k in range(0, len(own), 4):
            no += 1
            want += [(no, c) for c in own[k : k + 4]]
    got = U.chunk(df)
    assert sorted((x["chunk_no"], x["cru_id"]) for x in got.collect()) == sorted(want)
    rep = U.chunk_report(got).first()
    assert rep["units"] == 60 and rep["largest"] == 4 and rep["within_limit"]


def test_running_total(spark):
    r = random.Random(2)
    rows = [(f"{r.choice('abc')}{i:05d}", r.randrange(9)) for i in range(300)]
    got = {x["k"]: x["t"] for x in U.running_total(spark.createDataFrame(rows, "k string, v long"), "k", "v", "t", prefix=3).collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_tags(spark):
    rows = [("a", 0, "Search the position", "security"), ("a", 1, "search and login", "x"), ("b", 0, "nothing", "usability"), ("c", 0, "nothing", None)]
    df = spark.createDataFrame(rows, "k string, pos int, t string, kind string")
    got = {(r["key"], r["rank"]): (r["tag"], r["score"]) for r in U.capability_tags(df, "k", F.col("t"), "kind").collect()}
    assert got == {("a", 1): ("Search & Filtering", 2), ("a", 2): ("Security", 2), ("a", 3): ("Location & Maps", 1), ("b", 1): ("User Interface", 2), ("c", 1): ("Generic", 0)}


def test_validate(spark):
    rows = [("ok", "r", "a", "x", "high", "3.1", "security"), ("dup", "r", "a", "x", "high", "3.1", "security"), ("dup", "r", "a", "x", "high", "3.1", "security"), ("bad", "none", " ", None, "sure", "A.1", "odd"), ("gone", "r", "a", "x", "low", "9.9", "quality"), ("bare", None, None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "cru_id string, parent_requirement_id string, actor string, action_text string, confidence string, p string, cru_type string").withColumn("traceability", F.struct(F.col("p").alias("section_path")))
    got = {tuple(r) for r in U.validate(df, spark.createDataFrame([("r",), ("r",)], "req_id string"), spark.createDataFrame([("3.1",)], "section_path string")).collect()}
    e = lambda c, *k: {(c, f"ERR-{x}") for x in k}
    assert got == e("dup", "DUPLICATE-CRU-ID") | e("bad", "UNKNOWN-PARENT-REQ-ID", "MISSING-ACTOR", "UNEXPECTED-NULL-ACTION", "INVALID-CONFIDENCE", "MALFORMED-SECTION-PATH", "INVALID-CRU-TYPE") | e(
        "gone", "SECTION-PATH-NOT-IN-SKELETON") | e("bare", "UNKNOWN-PARENT-REQ-ID", "MISSING-ACTOR", "INVALID-CONFIDENCE", "MISSING-TRACEABILITY", "INVALID-CRU-TYPE")


def test_fixpoint_equals_a_loop(spark):
    r = random.Random(3)
    deps = sorted({(f"r{r.randrange(25)}", f"r{r.randrange(25)}") for _ in range(40)} | {("c1", "c2"), ("c2", "c1"), ("chain1", "r0"), ("chain2", "chain1"), ("chain3", "chain2")})
    deps = [(a, b) for a, b in deps if a != b]
    done = {"r0", "r1", "r2", "r3"}
    df = spark.createDataFrame(deps, "req_id string, dep string")
    got = {x["req_id"]: x["round"] for x in C.inferred(df, spark.createDataFrame([(x,) for x in done], "req_id string")).collect()}
    need = {}
    for a, b in deps:
        need.setdefault(a, set()).add(b)
    while True:
        more = {a for a, b in need.items() if a not in done and b <= done}
        if not more:
            break
        done |= more
    assert set(got) == done and "c1" not in got and got["chain3"] == 3


def test_dependencies(spark):
    df = spark.createDataFrame([("r1", [" r2", "R2", "none", "", None, "R1"]), (None, ["x"]), ("r3", None)], "req_id string, dependencies array<string>")
    assert {tuple(r) for r in C.dependencies(df).collect()} == {("R1", "R2")}


def test_stem_and_verdicts(spark):
    words = {"logged": "logg", "registered": "register", "registration": "registrat", "storage": "storage", "provide": "provide", "automatically": "automat", "queries": "query", "ness": "ness", "it": "it", "buses": "bus"}
    assert {r["word"]: r["stem"] for r in C.stem_table(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()} == words
    rows = [("a", "store the invoice totals", "the invoice totals were stored"), ("b", "store the invoice", "the invoice failed to store"), ("c", "", "x y"), ("d", "encrypt backup", None), ("e", "alpha beta gamma delta kappa sigma omega lambda theta zeta", "alpha beta only here")]
    df = spark.createDataFrame(rows, "k string, s string, e string")
    pairs = df.select("k", F.col("k").alias("k2"))
    found = C.overlap(pairs, df.select("k", F.col("s").alias("text")), pairs.join(df, "k").select("k2", F.col("e").alias("text")), "k", "k2")
    got = {r["k"]: (r["verdict"], r["blended"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "MATCH", "b": "CONFLICT", "c": "MISSING", "d": "MISSING", "e": "PARTIAL"} and got["e"][1] == 0.2


def test_gate(spark):
    good = "the invoice keeps its date and its owner"
    rows = [("ok", "t", ["a", "b", "c"], good), ("no_title", " ", ["a"], good), ("no_steps", "t", None, good), ("forbidden_phrase", "t", ["Perform action now", "b", "c"], good), ("generic_expected", "t", ["a", "b", "c"], "verify result of it"),
            ("few_steps", "t", ["a", "b"], good), ("short_expected", "t", ["a", "b", "c"], None)]
    df = spark.createDataFrame(rows, "k string, test_title string, test_steps array<string>, expected_result string")
    assert {r["k"]: r["reject_reason"] or "ok" for r in Q.reject_reason(df).collect()} == {r[0]: r[0] for r in rows}


def test_scores(spark):
    t = "test_id string, requirement_id string, test_type string, test_title string, test_steps array<string>, expected_result string, test_data string"
    rows = [("1", "q", "positive", "open page", ["a", "b", "c", "d"], "x" * 30, "v"), ("2", "q", "positive", "open page", ["a", "b", "c", "d"], "x" * 30, "v"), ("3", "q", "negative", "other", ["test_input"], None, None), ("4", None, "odd", None, None, "y", "{}")]
    df = Q.confidence(Q.contribution(Q.consistency(spark.createDataFrame(rows, t))))
    got = {r["test_id"]: (r["consistency"], r["contribution"], r["level"]) for r in df.collect()}
    assert got == {"1": (1.0, 0.7, "HIGH"), "2": (1.0, 0.7, "HIGH"), "3": (0.1, 0.9, "LOW"), "4": (0.5, 0.65, "MEDIUM")}
    u = {r["test_id"]: (r["similar_to"], r["uniqueness"]) for r in Q.uniqueness(spark.createDataFrame(rows, t)).collect()}
    assert u["1"] == ("2", 0.0) and u["4"] == (None, 1.0)
    want = 0.3 * difflib.SequenceMatcher(None, "open page", "other").ratio() + 0.5 * difflib.SequenceMatcher(None, "a b c d", "test_input").ratio()
    assert abs(1 - u["3"][1] - max(want, 0.3 * difflib.SequenceMatcher(None, "other", "open page").ratio() + 0.5 * difflib.SequenceMatcher(None, "test_input", "a b c d").ratio())) < 0.1


def test_decisions(spark):
    c = spark.createDataFrame([("s", "q1", "MATCH"), ("s", "q1", "PARTIAL"), ("s", "q2", "CONFLICT"), ("z", "q3", "MATCH")], "scenario string, req_id string, classification string")
    assert {tuple(r) for r in Q.scenario_scores(c).collect()} == {("s", 3, 0.166667, "HIGH_RISK"), ("z", 1, 1.0, "LOW_RISK")}
    u = {r["req_id"]: r["status"] for r in Q.requirement_usage(spark.createDataFrame([("q1",), ("q2",), ("q9",)], "req_id string"), c).collect()}
    assert u == {"q1": "VALIDATED", "q2": "UNUSED_REQUIREMENT", "q9": "UNUSED_REQUIREMENT"}
    w = Q.weighted_confidence(spark.createDataFrame([("g", 0.9, True), ("g", 0.3, False)], "g string, s double, t boolean"), "g", "s", "t").first()
    assert (w["confidence"], w["grade"]) == (0.7, "MEDIUM")


def test_link(spark):
    req = spark.createDataFrame([("r1",), ("r1 ",), ("R2",), (None,)], "req_id string")
    crus = spark.createDataFrame([("c1", "R1"), ("c1", "r1"), ("c2", "r1"), ("c3", None)], "cru_id string, parent_requirement_id string")
    tests = spark.createDataFrame([("t1", "c1"), ("t1", "c1"), ("t2", "c2"), ("t3", "c2"), (None, "c1")], "test_id string, requirement_id string")
    got = C.classify(C.link(req, crus, tests))
    assert {tuple(r) for r in got.collect()} == {("R1", 2, 3, "FULL_COVERAGE"), ("R2", 0, 0, "NO_CRU_MATCH")}
    assert C.coverage_summary(got).first()["rate"] == 50.0 and C.coverage_summary(got.where("1 = 0")).first()["rate"] == 0.0


def test_text_functions(spark):
    df = spark.createDataFrame([("a – b   c\nd ", "3.2.1", "User Interface"), (None, "1", None), ("", "A.1", "x"), ("DESC: x", "9.9", "References")], "t string, p string, title string")
    got = df.select(X.clean_text("t"), X.section_type("p", "title"), X.ancestors("p"), X.structural_role("t"), X.section_level("p"), X.parent_path("p")).collect()
    assert got[0][0] == "a - b  c\nd" and [r[1] for r in got] == ["interface_requirements", "introduction", "prioritization", "references"]
    assert got[0][2] == ["3", "3.2"] and got[1][2] == [] and got[3][3] == "req_desc_label" and got[0][5] == "3.2" and got[1][5] is None
    s = spark.createDataFrame([("One. Two must! three",), ("plain. text",)], "t string").select(X.modal_sentences("t")).collect()
    assert s[0][0] == ["Two must!"] and s[1][0] == ["plain. text"]
    st = spark.createDataFrame([("Partial pass",), ("not tested",), (None,), ("PASSED",)], "t string").select(X.status("t")).collect()
    assert [r[0] for r in st] == ["PARTIAL", "NOT_TESTED", "UNKNOWN", "PASS"] and len(R.SUFFIXES) == len({s for s, _, _ in R.SUFFIXES})
