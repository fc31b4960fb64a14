"""Reports written as documents are the JSON they stand for, and come back line by line."""

import json

from pyspark.sql import functions as F

from plumbline.operators import abtest, attack, candidates, composite, hybrid, optimize, stats, verifier
from plumbline.sources import reports


def document(spark, report, tmp_path, name="report.json"):
    path = tmp_path / name
    reports.write_report(report, f"file://{path}")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [name]
    return json.loads(path.read_text()), f"file://{path}"


def judged(spark):
    rows = [(f"t/{i % 7}\"{{", f"p{i}", [True, False, None][i % 3], i % 4, ["gold", "exploit"][i % 2], ["correct", "incorrect", "uncertain"][i % 5 % 3], 0.5) for i in range(60)]
    return spark.createDataFrame(rows, "instance_id string, patch_id string, verifier_pass boolean, true_quality int, source string, verdict string, cost_usd double")


def test_verifier_report(spark, tmp_path):
    c = judged(spark)
    scores = verifier.verifier_scores(c)
    sep = stats.separation(verifier.separated(scores), replicates=100)
    cats = candidates.category_success(c.select("instance_id", "patch_id", F.col("source").alias("category")), c)
    d, path = document(spark, reports.verifier_report(scores, c, sep, cats), tmp_path)
    want = {r.instance_id: r for r in scores.collect()}
    assert list(d["per_task"]) == sorted(want) and d["total_tasks_scored"] == 7
    for t, e in d["per_task"].items():
        assert (e["composite_score"], e["n_candidates"]) == (want[t].composite, want[t].n_candidates)
        own = sorted((r for r in c.collect() if r.instance_id == t), key=lambda r: r.patch_id)
        assert [(x["patch_id"], x["verifier_pass"], x["true_score"]) for x in e["candidates"]] == [(r.patch_id, r.verifier_pass, r.true_quality / 3) for r in own]
        assert {x["true_quality"] for x in e["candidates"]} <= {"TRIVIAL", "EXPLOIT", "PARTIAL", "CORRECT"}
    assert [x["category"] for x in d["exploit_categories"]] == [r.category for r in sorted(cats.collect(), key=lambda r: (-r.verified, r.category))]
    assert d["statistical_analysis"] is None or len(d["statistical_analysis"]["ci_hackable"]) == 2
    back = {r.key: r.composite_score for r in reports.entries_of(spark, path, "composite_score double", items=True).collect()}
    assert back == {t: r.composite for t, r in want.items()}
    assert reports.items_of(spark, path, "patch_id string").count() == 60
    assert reports.head_of(spark, path, "total_tasks_scored long").first()[0] == 7


def test_large_and_small_entries_make_one_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "MANY", 5)
    entries = spark.range(9).selectExpr("id as key", "named_struct('n', id) as entry")
    items = spark.range(40).selectExpr("case when id < 20 then 3 when id < 30 then 12 else id % 4 end as key", "cast(id as string) as place", "named_struct('i', id) as item")
    for head in (None, spark.range(1).selectExpr("1 as h")):
        d, path = document(spark, reports.Report(head, entries, items=items), tmp_path)
        d = d if head is None else d["per_task"]
        assert list(d) == [str(k) for k in range(9)]
        own = {k: sorted((str(i) for i in range(40) if (3 if i < 20 else 12 if i < 30 else i % 4) == k)) for k in range(9)}
        assert {int(k): [str(x["i"]) for x in e["items"]] for k, e in d.items()} == own
        assert reports.items_of(spark, path, "i long").count() == 30


def test_entries_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def one(it):
        for b in it:
            made.add(b.num_rows)
            yield b

    c = judged(spark)
    scores = verifier.verifier_scores(c).repartition(1)
    document(spark, reports.verifier_report(scores.mapInArrow(one, scores.schema), c), tmp_path)
    assert made.value == 7


def test_hybrid_report(spark, tmp_path):
    c = judged(spark)
    cells = hybrid.cells(c, c).join(c.select("patch_id", "verifier_pass"), "patch_id")
    d, path = document(spark, reports.hybrid_report(hybrid.confusion(c, c), cells), tmp_path)
    assert d["aggregate"]["tp"] == sum(e["tp"] for e in d["per_task"].values()) == sum(x["category"] == "TP" for e in d["per_task"].values() for x in e["entries"])
    assert all(e["n_judged"] == len(e["entries"]) for e in d["per_task"].values()) and d["total_cost_usd"] == 30
    assert reports.entries_of(spark, path, "n_judged long", items=True).count() == 7


def test_composite_report(spark, tmp_path):
    src = spark.createDataFrame([("t", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.25, "medium"), ("u", 0.5, 0.6, 0.0, None, None, None, None, None, None)], "instance_id string, v_score double, v_fpr double, v_fnr double, exploit_rate double, h_f1 double, h_fpr double, h_fnr double, gradient_signal double, difficulty_tier string")
    d, path = document(spark, reports.composite_report(composite.scored(src)), tmp_path)
    assert d["verdict_counts"] == {"KEEP": 1, "FIX": 1, "DROP": 0} and d["dimensions_available"]["exploit"] == 1
    assert d["per_task"]["u"]["dimension_scores"] == {"verifier": 0.5} and d["per_task"]["u"]["weaknesses"][0]["severity"] == "critical"
    back = reports.entries_of(spark, path, "eqs double, dimension_scores map<string, double>").orderBy("key").collect()
    assert [(r.key, r.dimension_scores["verifier"]) for r in back] == [("t", 1.0), ("u", 0.5)]
    empty, _ = document(spark, reports.composite_report(composite.scored(src.limit(0))), tmp_path)
    assert empty["per_task"] == {} and empty["total_tasks"] == 0 and empty["mean_eqs"] == 0


def test_lists(spark, tmp_path):
    r = spark.createDataFrame([(2, "b", 0.5, 3), (10, "a", None, 0), (1, "c", 0.25, 1)], "ordinal int, instance_id string, total_cost_usd double, total_strategies int")
    d, path = document(spark, reports.attack_report(r), tmp_path)
    assert [x["instance_id"] for x in d["per_task"]] == ["c", "b", "a"] and d["per_task"][2]["total_cost_usd"] is None and d["total_new_strategies"] == 4
    assert reports.entries_of(spark, path, "instance_id string", keyed=False).count() == 3
    p, _ = document(spark, reports.phase1_report(r), tmp_path)
    assert [x["total_strategies"] for x in p] == [1, 3, 0]
    assert document(spark, reports.phase1_report(r.limit(0)), tmp_path)[0] == []


def test_optimization_report(spark, tmp_path):
    tasks = spark.createDataFrame([("a", 0.65), ("b", 0.5)], "instance_id string, eqs double")
    aug = spark.createDataFrame([("a", 1, ["e0", "e1"], 0.95, 0.01), ("b", 2, ["e0"], 0.5, 0.02)], "instance_id string, iteration int, targets array<string>, confidence double, cost_usd double")
    done = optimize.optimized(tasks, optimize.boosts(aug, spark.createDataFrame([("a", 2), ("b", 2)], "instance_id string, n_exploits int")))
    d, _ = document(spark, reports.optimization_report(done), tmp_path)
    assert [(x["iteration"], [t["instance_id"] for t in x["per_task"]], x["cost_usd"]) for x in d["iterations"]] == [(1, ["a", "b"], 0.01), (2, ["b"], 0.02), (3, ["b"], 0.0)]
    assert len(d["convergence_curve"]) == 4 and d["total_cost_usd"] == 0.03 and d["tasks_upgraded_total"] == 1
    none = optimize.optimized(tasks.limit(0), optimize.boosts(aug, spark.createDataFrame([("a", 2)], "instance_id string, n_exploits int")))
    assert document(spark, reports.optimization_report(none), tmp_path)[0]["iterations"] == []


def test_comparison_and_verification(spark, tmp_path):
    a = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "task_id int, passed boolean")
    b = spark.createDataFrame([(i, i % 2 == 0) for i in range(30)], "task_id int, passed boolean")
    d, _ = document(spark, reports.comparison_report(abtest.compared(a, b, 200), abtest.changes(abtest.aligned(a, b))), tmp_path)
    assert {int(k) for k, v in d["changes"].items() if v["change"] == "fixed"} == {i for i in range(30) if i % 2 == 0 and i % 3} and len(d["ci_95_pct"]) == 2
    r = spark.createDataFrame([("a/x", "0", True, False, "a__x_exploit_0"), ("a/x", "1", False, True, "a__x_exploit_1"), ("b", "0", False, False, "b")], "instance_id string, exploit_index string, verified boolean, has_error boolean, key string")
    d, _ = document(spark, reports.verification_report(r, attack.verification_summary(r)), tmp_path)
    assert d["per_task"]["a/x"] == {"exploits_attempted": 2, "exploits_verified": 1, "exploit_details": [{"exploit_index": "0", "verified": True, "has_error": False, "log_file": "a__x_exploit_0.log"}, {"exploit_index": "1", "verified": False, "has_error": True, "log_file": "a__x_exploit_1.log"}]}
    assert d["outcome"] == "BANGER" and d["tasks_with_verified_exploit"] == 1
