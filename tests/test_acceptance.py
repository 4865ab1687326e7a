import pytest
from pyspark.sql import functions as F

from loomtrace.operators import acceptance as A
from loomtrace.operators import coverage as C
from loomtrace.operators import segment as S

INLINE = """3.1 Users
3.1.1 UAT-AB-01: First login
Use case 2: Guest
Requirement IDs: FR1, fr3, FR1
Description: a guest
Pre-condition: none
Test Steps
1. open the page
and wait
2) sign in
Expected Result: welcome
Status: Passed with remarks
Comments
all good
more

3.2 Another class
Status: FAIL"""
SPLIT = """UAT-X-7 - Second
Actor: Clerk
Requirement IDs

QR2
Description
Pre-condition
Test Steps
What it is about
What must hold
1. do it
• do that
Status
Actual Result
PASS It did"""


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("title", F.lit("clash"))
    return {r["uat_id"]: r for r in A.records(S.lines(df)).collect()}


def test_records(spark):
    got = parsed(spark, INLINE, SPLIT, "no header\nStatus: PASS", "", None)
    a, b = got["UAT-AB-01"], got["UAT-X-7"]
    assert set(got) == {"UAT-AB-01", "UAT-X-7"}
    assert (a["title"], a["actor_class"], a["req_ids"], a["description"], a["precondition"], a["test_steps"]) == ("First login", "Guest", ["FR1", "FR3"], "a guest", ["none"], ["open the page and wait", "sign in"])
    assert (a["expected_result"], a["status"], a["observations"], a["repaired"]) == ("welcome", "PASS", "all good more", False)
    # Values of a two-column layout go back to their fields, and the status leaves the field it fell into.
    assert (b["actor_class"], b["req_ids"], b["description"], b["precondition"], b["test_steps"]) == ("Clerk", ["QR2"], "What it is about", ["What must hold"], ["do it", "do that"])
    assert (b["status"], b["actual_result"], b["repaired"]) == ("PASS", "It did", True)


def test_steps_without_label(spark):
    got = parsed(spark, "UAT-A-1: t\nPreconditions: ready\n1. one\nstray\n2. two\nDescription: x\nDescription: y\nStatus")["UAT-A-1"]
    assert (got["precondition"], got["test_steps"], got["description"], got["status"]) == (["ready"], ["one", "two"], "y", "")


def test_prefixes(spark):
    lines = lambda *t: S.lines(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string"))
    assert {tuple(r) for r in A.id_prefixes(lines("Requirement IDs: FR1, QR2\nUC3 FR4 UC5")).collect()} == {("FR", 1), ("QR", 1)}
    assert {tuple(r) for r in A.id_prefixes(lines(" ".join(f"FR{i}" for i in range(30)) + " UC1 UC2 UC3 XX1")).collect()} == {("FR", 30), ("UC", 3)}
    assert A.id_prefixes(lines("none")).count() == 0


def test_classes(spark):
    records = spark.createDataFrame([("u1", "PASS", ["r1", "R9"]), ("u2", "FAIL", ["R1 "]), ("u3", "PASS", ["R2"]), ("u4", "PASS", []), ("u5", None, ["R1"]), ("u6", "PARTIAL", ["R1", "R1"]), ("u7", "NOT_TESTED", ["R1"]), ("u8", "INFERRED", ["R1"])], "uat_id string, status string, req_ids array<string>")
    crus = spark.createDataFrame([("c1", "r1"), ("c2", "R1"), ("c1", "r1"), ("c3", "R2"), ("c4", ""), (None, "R1"), ("c5", "R7")], "cru_id string, parent_requirement_id string")
    tests = spark.createDataFrame([("t1", "c1"), ("t1", "c1"), ("t2", "c2"), (None, "c3")], "test_id string, requirement_id string")
    got = {r["uat_id"]: r for r in A.classify(A.link(records, crus, tests)).collect()}
    assert {k: (v["classification"], v["cru_count"], v["test_count"]) for k, v in got.items()} == {
        "u1": ("FULL_COVERAGE", 2, 2), "u2": ("FAILED_COVERAGE", 2, 2), "u3": ("NO_TEST_CASE", 1, 0), "u4": ("NO_CRU_MATCH", 0, 0), "u5": ("FULL_COVERAGE", 2, 2), "u6": ("PARTIAL_COVERAGE", 2, 2), "u7": ("NOT_TESTED", 2, 2), "u8": ("INFERRED_PARTIAL", 2, 2)}
    assert got["u1"]["summary"] == "UAT PASS. 2 CRU(s) and 2 test case(s) linked. Unmatched req_ids: R9."
    assert {tuple(r) for r in A.missing_ids(records, crus).collect()} == {("R9", "u1", 1)}
    assert {r["cru_id"] for r in A.uncovered_units(records, crus, spark.createDataFrame([("R7", 1)], "req_id string, round int")).collect()} == set()
    s = {r["classification"]: r for r in A.summary(A.classify(A.link(records, crus, tests))).collect()}
    assert len(s) == 7 and s["FULL_COVERAGE"]["n"] == 2 and s["FULL_COVERAGE"]["rate"] == 37.5
    assert A.summary(A.classify(A.link(records.where("1 = 0"), crus, tests))).where("n > 0").count() == 0


def test_long_chain(spark):
    """A chain of 40 dependencies, and a cycle beside it."""
    deps = spark.createDataFrame([(f"R{i}", f"R{i - 1}") for i in range(1, 41)] + [("A", "B"), ("B", "A")], "req_id string, dep string")
    got = {r["req_id"]: r["round"] for r in C.inferred(deps, spark.createDataFrame([("R0",)], "req_id string")).collect()}
    assert got == {f"R{i}": i for i in range(41)}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace as N

    from loomtrace.session import shared_dir

    conf = {}
    fake = lambda master: N(conf=N(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=N(master=master))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            shared_dir(fake(master))
    assert shared_dir(fake("local[8]")).startswith("file:")
