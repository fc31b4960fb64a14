import json
import os
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from plumbline import schemas, session
from plumbline.operators import candidates
from plumbline.plans import stores
from plumbline.sources import files, readers, writers


def test_tasks(spark):
    rows = [(0, "a", "r", "p", None, "g", '["t1"]', '["t2"]', None), (1, "b", "r", None, "x", None, "not json", '["t"]', "easy"), (2, "c", "r", "p", "x", "g", "[]", "[]", None)]
    raw = spark.createDataFrame(rows, schemas.TASKS_RAW)
    got = {r.instance_id: r for r in readers.tasks(raw, 2, spark.createDataFrame([("b",), ("b",)], "instance_id string")).collect()}
    assert set(got) == {"a", "b"} and got["a"].fail_to_pass == ["t1"] and got["b"].fail_to_pass == [] and got["b"].pass_to_pass == []
    assert got["b"].is_verified and not got["a"].is_verified and got["a"].test_patch == "" and got["b"].gold_patch == ""
    assert readers.verified_tasks(raw).where("is_verified").count() == 3 and readers.gold_patches(raw, 1).count() == 1


def logs_at(tmp_path, files):
    for name, text in files.items():
        (tmp_path / f"{name}.log").write_text(text)
    return str(tmp_path)


def test_logs(spark, tmp_path):
    folder = logs_at(tmp_path, {"a__x_exploit_0": "Instances resolved: 1\n", "a__x_exploit_1": "Instances resolved: 0\nError", "plain": "a", "b_exploit_0": 'x\n{"resolved": ["b"]}\n'})
    (tmp_path / "other.txt").write_text("Instances resolved: 1")
    logs = readers.log_files(spark, folder)
    assert {r.key: r.resolved for r in readers.resolved_logs(logs).collect()} == {"a__x_exploit_0": True, "a__x_exploit_1": False, "plain": False, "b_exploit_0": False}
    assert {(r.instance_id, r.idx): r.passed for r in readers.log_results(logs).collect()} == {("a__x", 0): True, ("a__x", 1): False, ("b", 0): False}
    assert [tuple(r) for r in readers.passed_lists(logs).collect()] == [("a__x", [0])]
    d = {(r.instance_id, r.exploit_index): r for r in readers.log_details(logs).collect()}
    assert d["b", "0"].verified and not d["a/x", "1"].verified and d["a/x", "1"].has_error and ("plain", "0") in d
    assert readers.log_files(spark, str(tmp_path / "none")).isEmpty()


def test_log_details_ways(spark):
    rows = [("a__x_exploit_0", "RESOLVED tasks: A/X"), ("a__x_exploit_1", "done ✓ a/x"), ("a__x_exploit_2", "a/x RESOLVED"), ("a__x_exploit_3", "a/x"), ("a__x_exploit_4", "error exit_code")]
    got = {r.exploit_index: (r.verified, r.has_error) for r in readers.log_details(spark.createDataFrame(rows, "key string, content string")).collect()}
    assert got == {"0": (True, False), "1": (True, False), "2": (True, False), "3": (False, False), "4": (False, False)}


def test_harness(spark):
    rows = [('{"resolved": ["a"]}', "a", ""), ('{"a": {"resolved": true}}', "a", ""), ('{"resolved_instances": ["a"]}', "a", ""), ('{"resolved": ["b"]}', "a", ""), (None, "a", "a RESOLVED"), (None, "a", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, t string, l string")
    assert [r[0] for r in df.orderBy("i").select(readers.harness_result(F.col("r"), F.col("t"), F.col("l"))).collect()] == [True, True, True, False, True, False]


def test_logs_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a_exploit_0.log").write_text("Instances resolved: 1")
    (tmp_path / "b_exploit_0.log").write_bytes(b"\xff\xfe\x00resolved")
    (tmp_path / "empty_exploit_1.log").write_text("")
    (tmp_path / "c.txt").write_text("no log")
    assert {r.key: r.content for r in readers.log_files(spark, str(tmp_path)).collect()} == {"a_exploit_0": "Instances resolved: 1", "empty_exploit_1": ""}
    assert {r.key: r.error for r in readers.log_files(spark, str(tmp_path), errors=True).collect()} == {"a_exploit_0": None, "b_exploit_0": "not UTF-8", "empty_exploit_1": None}
    assert [tuple(r) for r in readers.skipped_logs(spark, str(tmp_path)).collect()] == [("not UTF-8", 1)]
    assert readers.skipped_logs(spark, str(tmp_path / "none")).isEmpty()


def test_harness_results_from_files(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("r1/r1/a/x.r1.json".replace("a/x", "a__x"), '{"resolved": ["a/x"]}')
    put("r2/results/r2.json", '{"b": {"resolved": true}}')
    put("r3/deep/down/x.r3.json", '{"resolved_instances": ["other"]}')
    put("r3/logs/run.log", "c RESOLVED")
    put("r4/r4.json", "broken")
    put("r5/other.json", '{"resolved": ["e"]}')
    put("r 6+/x.r 6+.json", '{"resolved": ["f"]}')
    runs = spark.createDataFrame([("r1", "a/x"), ("r2", "b"), ("r3", "c"), ("r4", "d"), ("r5", "e"), ("r 6+", "f"), ("r7", "g")], "run_id string, instance_id string")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.instance_id: (r.resolved, r.n_files) for r in readers.harness_results(spark, folder, runs).collect()}
        assert got == {"a/x": (True, 1), "b": (True, 1), "c": (True, 2), "d": (False, 1), "e": (False, 0), "f": (True, 1), "g": (False, 0)}
    assert not readers.harness_results(spark, str(tmp_path / "none"), runs).where("resolved").count()


def test_faulty_records_come_apart(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"task_id": 1}\n\n{"task_id": \n{"task_id": "x"}\n{"task_id": 2}\n')
    good, bad = readers.routed(readers.json_lines(spark, str(tmp_path / "t.jsonl"), "task_id int", errors=True))
    assert sorted(r.task_id for r in good.collect() if r.task_id) == [1, 2] and good.columns == ["task_id"]
    assert sorted(r.error for r in bad.collect()) == ['t.jsonl: not of the schema: {"task_id": ', 't.jsonl: not of the schema: {"task_id": "x"}']
    (tmp_path / "a.json").write_text('[{"task_id": 1}, {"task_id": 2}]')
    (tmp_path / "b.json").write_text('[{"task_id": 1}, {"task')
    good, bad = readers.routed(readers.json_array(spark, str(tmp_path / "[ab].json"), "task_id int", errors=True))
    assert sorted(r.task_id for r in good.collect()) == [1, 2] and bad.count() == 1
    raw = spark.createDataFrame([(0, "a", "r", "p", None, "g", '["t1"]', "x", None), (1, "b", "r", "p", None, "g", None, "[]", None), (2, "c", "r", "p", None, "g", "[]", "[]", None)], schemas.TASKS_RAW)
    assert [r.error for r in readers.tasks(raw, errors=True).orderBy("instance_id").collect()] == ["PASS_TO_PASS is no list", "FAIL_TO_PASS is no list", None]


def test_cache_short_circuits(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(3):
        assert readers.read_through(spark, f"file://{tmp_path}", "k", make).count() == 3
    assert len(made) == 1 and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["k"]
    assert readers.read_through(spark, f"file://{tmp_path}", "other", make).count() == 3 and len(made) == 2

    def late():
        readers.read_through(spark, f"file://{tmp_path}", "race", lambda: spark.range(5))
        return spark.range(7)

    assert readers.read_through(spark, f"file://{tmp_path}", "race", late).count() == 5  # the first one's stays
    a = spark.createDataFrame([("s1", ["t1"]), ("s2", [])], "submission string, resolved array<string>")
    t = spark.createDataFrame([("t1",), ("t2",)], "instance_id string")
    assert readers.fingerprint(a, t) == readers.fingerprint(a.orderBy(F.desc("submission")).repartition(2), t)
    assert readers.fingerprint(a, t) != readers.fingerprint(a.limit(1), t) != readers.fingerprint(t, a)
    assert readers.fingerprint(a.union(a.limit(1))) != readers.fingerprint(a)
    for _ in range(2):
        got = {r.instance_id: r.solve_rate for r in readers.solve_rates_through(spark, f"file://{tmp_path}/rates", a, t).collect()}
        assert got == {"t1": 0.5, "t2": 0.0}
    assert len([x for x in (tmp_path / "rates").iterdir() if not x.name.startswith(".")]) == 1


def phase1(spark, tmp_path):
    s = lambda n, c: {"name": n, "category": "k", "description": "d", "confidence": c}
    docs = [{"instance_id": "a/x", "verdict": "FAIL", "max_exploit_confidence": 9, "strategies": [s("n0", 9), s("n1", 5), s("n2", 7)], "exploit_patches": ["--- a\n+++ b 0123", "p1", "--- a\n+++ c 0123", "extra"]}, {"instance_id": "b", "strategies": [], "exploit_patches": []}]
    path = tmp_path / "phase1.json"
    path.write_text(json.dumps(docs))
    return readers.json_array(spark, str(path))


def test_assembly(spark, tmp_path):
    p = phase1(spark, tmp_path)
    logs = spark.createDataFrame([("a__x_exploit_0", True), ("a__x_exploit_1", False)], "key string, resolved boolean")
    gold = spark.createDataFrame([("a/x", "gold")], "instance_id string, patch string")
    got = {r.patch_id: (r.source, r.verifier_pass, r.true_quality) for r in candidates.assembled(p, logs, gold).collect()}
    assert got == {"a/x_gold": ("gold", True, 3), "a/x_exploit_0": ("exploit", True, 1), "a/x_exploit_1": ("exploit", False, 0), "a/x_exploit_2": ("exploit", None, 0), "a/x_exploit_3": ("exploit", None, 0), "a/x_trivial": ("trivial", False, 0), "b_trivial": ("trivial", False, 0)}


def test_predictions(spark, tmp_path):
    p = phase1(spark, tmp_path)
    got = writers.predictions(p)
    assert {(r.file, r.model_name_or_path, r.usable) for r in got.collect()} == {("a__x_exploit_0.jsonl", "exploit-0", True), ("a__x_exploit_1.jsonl", "exploit-1", True)}
    few = p.withColumn("exploit_patches", F.array(F.lit("too short"), F.lit("p1")))
    assert writers.manifest(writers.predictions(few)) == {"total_exploits": 0, "total_tasks": 1, "skipped_empty": 2}
    at = f"file://{tmp_path}/set"
    writers.write_predictions(got, at)
    assert files.manifest(spark, at) == {"total_exploits": 2, "total_tasks": 1, "skipped_empty": 0, "files": 2}
    line = json.loads((tmp_path / "set" / "a__x_exploit_1.jsonl").read_text())
    assert line == {"instance_id": "a/x", "model_name_or_path": "exploit-1", "model_patch": "--- a\n+++ c 0123"}
    assert {r.file: r.model_patch for r in writers.read_predictions(spark, at).collect()} == {r.file: r.model_patch for r in got.collect()}
    rounds = spark.createDataFrame([("a/x", 0, "p"), ("a/x", 1, "  "), ("a/x", 2, None)], "instance_id string, idx int, patch_text string")
    made = writers.round_predictions(rounds)
    assert [(r.file, r.model_name_or_path) for r in made.where("usable").collect()] == [("a__x_r2r3_exploit_0.jsonl", "exploit_r2r3_a__x_exploit_0")]
    writers.rows(got, str(tmp_path / "out"), ["instance_id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sets_of_files_are_whole_or_none(spark, tmp_path):
    at = str(tmp_path / "set")
    row = lambda *r: spark.createDataFrame(list(r), "file string, content string")
    with pytest.raises(FileNotFoundError):
        files.files(spark, at)
    files.write_files(row(("a.jsonl", "1"), ("b.jsonl", None)), at, {"n": 2})
    want = {"a.jsonl": "1", "b.jsonl": ""}
    read = lambda: {r.file: r.content or "" for r in files.files(spark, at).collect()}
    assert read() == want
    for bad in (row(("c.jsonl", "1"), ("c.jsonl", "2")), row(("x/y", "1")), row((None, "1")), row((".hidden", "1"))):
        with pytest.raises(Exception, match="file"):
            files.write_files(bad.repartition(2), at)
        assert read() == want and files.manifest(spark, at) == {"n": 2, "files": 2}
    with pytest.raises(Exception, match="already"):
        files.write_files(row(("d.jsonl", "1")), at, overwrite=False)
    assert read() == want
    # what a lost attempt left is no part of the set and goes with the next one
    (tmp_path / "set" / "_attempts" / "lost").mkdir(parents=True)
    (tmp_path / "set" / "_attempts" / "lost" / "z.jsonl").write_text("z")
    files.write_files(row(("e.jsonl", "5")), at)
    assert read() == {"e.jsonl": "5"} and sorted(x.name for x in (tmp_path / "set").iterdir()) == ["e.jsonl", "manifest.json"]
    (tmp_path / "set" / "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        files.files(spark, at)
    files.write_files(row().limit(0), at)
    assert read() == {} and files.manifest(spark, at) == {"files": 0}


def test_sets_of_files_are_not_listed(spark, tmp_path):
    at = f"file://{tmp_path}/set"
    rows = spark.range(300).selectExpr("concat('f', id, '.jsonl') as file", "nullif(cast(id as string), '7') as content")
    for _ in range(2):
        files.write_files(rows, at)
    read = files.files(spark, at)
    assert "BinaryFile" not in read._jdf.queryExecution().executedPlan().toString() and "binaryFile" not in read._jdf.queryExecution().toString()
    want = {f"f{i}.jsonl": "" if i == 7 else str(i) for i in range(300)}
    assert {r.file: r.content for r in read.collect()} == want
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["set", "set.names"]
    assert files.files(spark, at, "7.jsonl").count() == 30
    # a set that comes without its table of names is whole, too
    (tmp_path / "set.names").rename(tmp_path / "other")
    assert {r.file: r.content or "" for r in files.files(spark, at).collect()} == want


def test_folders_of_many_files_go_without_a_list(spark, tmp_path, monkeypatch):
    """Hadoop deletes none of them when the JVM ends, as it would list them; Python does, entry by entry and for a time."""
    monkeypatch.setattr(session, "_MANY", [])
    for query in (stores.round_files, stores.prediction_files, stores.prediction_manifest, stores.json_array_read, stores.log_results):
        query(spark, "/root/testdata/sf0.001")
    folders = session._MANY.copy()
    assert len(folders) == 5
    for folder in folders:
        store, jpath = files._hadoop(spark, folder)
        assert store.exists(jpath) and not store.cancelDeleteOnExit(jpath)
    session._ended()
    assert not any(os.path.exists(f) for f in folders) and not session._MANY
    for i in range(4000):
        (tmp_path / "set" / "data").mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / "data" / f"a_name_of_some_length_{i}.jsonl").touch()
    (tmp_path / "set" / "link").symlink_to(tmp_path)
    (tmp_path / "kept").touch()
    assert not session._removed(str(tmp_path / "set"), time.monotonic()) and len(list((tmp_path / "set" / "data").iterdir())) == 4000
    tracemalloc.start()
    assert session._removed(str(tmp_path / "set"), time.monotonic() + 60)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000 and [x.name for x in tmp_path.iterdir()] == ["kept"]
    assert session._removed(str(tmp_path / "set"), time.monotonic() + 60)


def test_what_a_lost_job_moved_goes_by_tasks(spark, tmp_path, monkeypatch):
    lost = tmp_path / "set.new-lost"
    (lost / "set").mkdir(parents=True)
    for i in range(50):
        (lost / "set" / f"f{i}.jsonl").touch()
    spark.range(60).selectExpr("concat('f', id, '.jsonl') as file", "'a' as attempt").write.parquet(str(lost / "names"))
    delete, held = files._delete, []
    monkeypatch.setattr(files, "_delete", lambda spark, path: (held.append(len(list((lost / "set").iterdir()))) if "new-lost" in path else None, delete(spark, path)))
    files.write_files(spark.createDataFrame([("a.jsonl", "1")], "file string, content string"), str(tmp_path / "set"))
    assert held == [0] and not lost.exists() and files.files(spark, str(tmp_path / "set")).count() == 1


def test_json_lines_skips_blank(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"task_id": 1, "test_list": ["a"]}\n\n{"task_id": 2}\n')
    assert {r.task_id for r in readers.json_lines(spark, str(tmp_path / "t.jsonl")).collect() if r.task_id} == {1, 2}


def test_cached_rates(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"n_submissions": 2, "n_tasks": 1, "solve_rates": {"t": 0.5}}')
    assert [tuple(r) for r in readers.cached_solve_rates(spark, str(tmp_path / "c.json")).collect()] == [("t", 0.5)]
