import datetime as dt
import json
import time

from pyspark.sql import functions as F

from loomtrace.operators import orphans  # noqa: F401
from loomtrace.sources import readers as R
from loomtrace.sources import sinks as W
from loomtrace.streaming import incremental as I


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"crus": [{"id": "1", "n": 1}], "cru_units": [{"id": "2"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "3", "n": "x"}, {"other": 1}], indent=1))
    (tmp_path / "c.json").write_text("{cut")
    (tmp_path / "d.json").write_text("{}")
    got = {(r["id"], r["n"]) for r in R.read_json_rows(spark, str(tmp_path), ["cru_units", "crus"], "id string, n int").collect()}
    assert {i for i, _ in got} >= {"1", "2"} and ("1", 1) in got
    assert {(r["file"].rsplit("/", 1)[-1], r["reason"]) for r in R.unreadable_json(spark, str(tmp_path), ["cru_units", "crus"]).collect()} == {("c.json", "malformed"), ("d.json", "no known key")}
    (tmp_path / "z.json").write_text("[]")
    later = time.time() + 10
    import os

    os.utime(tmp_path / "z.json", (later, later))
    assert R.latest_file(spark, str(tmp_path)).first()["path"].endswith("z.json")


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ntwo \xe9".encode("latin1"))
    (tmp_path / "b.bin").write_bytes(b"\0")
    (tmp_path / "e.txt").write_bytes(b"")
    got = {(r["path"].rsplit("/", 1)[-1], r["line_no"], r["line"], r["error"]) for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 0, "one", None), ("a.txt", 1, "two �", None), ("b.bin", None, None, "ValueError: unknown kind of file")}
    assert [r["line"] for r in R.read_lines(spark, str(tmp_path / "a.txt")).orderBy("pos").collect()][0] == "one"


def test_model_hook(spark):
    def call(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no answer")
        return [f"```json\n[{t}]\n```" for t in texts]

    got = R.with_model(spark.createDataFrame([("1",), ("bad",), ("2",)], "q string"), "q", call)
    assert {(r["q"], r["a"], r["error"]) for r in got.withColumn("a", R.first_json_array("answer")).collect()} == {("1", "[1]", None), ("2", "[2]", None), ("bad", None, "RuntimeError: no answer")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], "p"), ("b", None, None)], "k string, s array<string>, t string")
    W.write_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {("a", "x; y", "p"), ("b", None, None)}
    W.write_json(df, str(tmp_path / "json"), model="m")
    assert spark.read.json(str(tmp_path / "json/rows")).count() == 2 and spark.read.json(str(tmp_path / "json/metadata")).first()["model"] == "m"
    W.write_sheets(df, str(tmp_path / "sheets"), "t")
    assert {r["sheet"] for r in spark.read.option("header", True).csv(str(tmp_path / "sheets")).select("sheet").collect()} == {"p", "none"}
    W.save_bucketed(df, "bucketed_test", "k", 4)
    b = spark.table("bucketed_test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = b.join(b.select("k", F.col("t").alias("t2")), "k")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m % 60) + dt.timedelta(hours=m // 60)
    rows = [(1, t(0), 1, "a", 1.0), (2, t(10), 1, "a", 2.0), (3, t(50), 1, "b", 3.0), (4, t(300), 2, "a", 4.0)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    ev = I.read_events(spark, str(tmp_path / "in"), schema)
    for name, df in (("w", I.windowed_counts(ev)), ("s", I.sessions(ev))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r["event_type"], r["n"], r["total"]) for r in spark.table("out_w").collect()} == {("a", 2, 3.0), ("b", 1, 3.0), ("a", 1, 4.0)}
    assert sorted((r["user_id"], r["n"]) for r in spark.table("out_s").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_stream_upsert(spark, tmp_path):
    out = str(tmp_path / "out")
    for k, rows in enumerate(([(1, dt.datetime(2025, 1, 1), 1, "a", 1.0), (2, dt.datetime(2025, 1, 1), 1, "b", 1.0)], [(1, dt.datetime(2025, 1, 2), 1, "new", 2.0), (3, dt.datetime(2025, 1, 1), 1, "c", 1.0)])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        st = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        I.start_upsert(st, out, str(tmp_path / "check"), ["event_id"], ["ts"]).awaitTermination(60)
        got = spark.read.parquet(f"{out}/v={k}")
    assert {(r["event_id"], r["event_type"]) for r in got.collect()} == {(1, "new"), (2, "b"), (3, "c")}
    batch = spark.read.parquet(f"{out}/v=0")
    I.upsert_into(out, ["event_id"], ["ts"])(batch, 1)  # a batch that is run again replaces its own version
    assert spark.read.parquet(f"{out}/v=1").count() == 2


def test_shared_folder(spark):
    from loomtrace.session import clean_shared, materialize, shared_dir

    df = materialize(spark.range(5), "tables")
    assert df.count() == 5 and df.inputFiles()[0].startswith(shared_dir(spark).replace("file:///", "file:///"))
    clean_shared(spark)
    assert materialize(spark.range(3), "tables").count() == 3
