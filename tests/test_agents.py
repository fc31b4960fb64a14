"""Agents: one failure is one ERROR row, whatever the agent does."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import agents


def tasks(spark):
    return spark.createDataFrame([(f"t{i}", i, "x" * i if i % 4 else None) for i in range(12)] + [(None, 100, "y"), ("t1", 1, "x")], "instance_id string, n int, text string")


def test_rows_fail_alone(spark):
    def picky(row):
        if row["n"] == 3:
            raise ValueError("three")
        if row["n"] == 5:
            raise KeyError
        if row["n"] == 6:
            return {"speed": 1}
        if row["n"] == 7:
            return {"verdict": "PASS", "score": "much"}
        if row["n"] == 8:
            return eval("(" * 10_000)  # noqa: S307
        if row["n"] == 9:
            return picky({"n": 9})
        return {"verdict": "FAIL", "score": row["n"] / 2, "issues": [{"type": "k", "severity": "high", "message": row["text"]}], "metrics": {"n": row["n"]}}

    r = agents.Registry()
    r.register("picky", picky)
    r.register("native", agents.Native({"verdict": F.when(F.col("n") < 6, "PASS").when(F.col("n") < 11, "WARNING"), "score": F.try_divide(F.lit(1.0), F.col("n"))}, F.when(F.col("text").isNull(), "no text")))
    out = r.run(tasks(spark)).collect()
    assert len(out) == 28
    mine = {(x.instance_id, x.metrics.get("n")): x for x in out if x.agent_name == "picky"}
    failed = {x.instance_id: x.error for x in out if x.agent_name == "picky" and x.verdict == "ERROR"}
    assert set(failed) == {f"t{i}" for i in (3, 5, 6, 7, 8, 9)} and failed["t3"] == "ValueError: three" and failed["t5"] == "KeyError"
    assert "speed" in failed["t6"] and "much" in failed["t7"] and "RecursionError" in failed["t9"]
    assert mine["t2", "2"].score == 1.0 and mine["t2", "2"].issues[0].message == "xx" and mine[None, "100"].score == 50
    assert all(x.execution_time >= 0 for x in mine.values()) and all((x.score, x.confidence, x.metrics["error"]) == (0, 0, x.error) for x in out if x.verdict == "ERROR")
    native = [x for x in out if x.agent_name == "native"]
    assert {x.instance_id: x.error for x in native if x.verdict == "ERROR"} == {"t0": "no text", "t4": "no text", "t8": "no text", "t11": "no verdict", None: "no verdict"}
    assert sum(x.instance_id == "t1" and x.verdict == "PASS" for x in native) == 2 and all(x.execution_time is None for x in native)


def test_registry(spark):
    r = agents.Registry()
    assert r.run(tasks(spark)).isEmpty()
    r.register("a", lambda row: {})
    r.register("b", agents.Native({}))
    with pytest.raises(ValueError, match="there already"):
        r.register("a", agents.Native({}))
    with pytest.raises(KeyError):
        r.run(tasks(spark), names=["c"])
    with pytest.raises(ValueError, match="unknown fields"):
        agents._native("z", agents.Native({"speed": F.lit(1)}))
    assert {x.agent_name for x in r.run(tasks(spark), names=["b"]).collect()} == {"b"}
    assert r.run(tasks(spark).limit(0)).isEmpty()
    assert {(x.agent_name, x.verdict, x.score) for x in r.run(tasks(spark)).collect()} == {("a", "PASS", 1.0), ("b", "PASS", 1.0)}


def test_rejected(spark):
    rows = spark.createDataFrame([("a", None), ("b", "bad line")], "instance_id string, error string")
    got = agents.rejected(rows, "reader").collect()
    assert [(x.instance_id, x.verdict, x.error) for x in got] == [("b", "ERROR", "bad line")]
    assert agents.rejected(rows.drop("instance_id"), "reader").first().instance_id is None


def test_attacker(spark):
    m = "struct<n_permissive:int,n_strict:int,test_lines:int,patch_lines:int,n_assertions:int,has_edge:boolean,n_functions:int,n_literals:int,n_fail_to_pass:int>"
    df = spark.createDataFrame([("a", (0, 9, 50, 10, 9, True, 5, 0, 5)), ("b", None)], f"instance_id string, m {m}")
    r = agents.Registry()
    r.register("attacker", agents.attacker(F.col("m")))
    got = {x.instance_id: x for x in r.run(df).collect()}
    assert (got["a"].verdict, got["a"].score, got["a"].confidence) == ("PASS", 1.0, 0.5)
    assert (got["b"].verdict, got["b"].error) == ("ERROR", "no pattern metrics")


def test_parts_are_dealt_to_all_cores(spark):
    from plumbline.plans import records

    assert records.measured(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
