"""Queries over what readers read and sinks write: tables become files in the shared folder, and what comes back is compared.

Names, contents and faults of the files follow from a table's numbers; what the SQL expects follows from the numbers, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.numbers import mean_or_zero, rounded
from plumbline.operators import abtest, agents, candidates, costs, dataset, hybrid, optimize, verifier
from plumbline.operators.order import positioned
from plumbline.plans.audit import LINES, LOOP, MCNEMAR, PAIRS, RATES_SQL, SOLVED, SOURCES, confusion_sql, fix_tasks, judgments, lines, query, resolved, runs, scored, scores_sql, table
from plumbline.plans.records import FLAGS, NUMBERS, measured
from plumbline.session import scratch
from plumbline.sources import files, readers, reports, writers

# Tasks

#: A part's row as a data set holds it: lists as JSON text, some of it broken.
RAW = (
    "cast(p_partkey as bigint) as ordinal",
    "concat('repo/t', p_partkey) as instance_id",
    "'repo' as repo",
    "p_name as problem_statement",
    "case when p_size % 3 = 0 then 'diff' end as test_patch",
    "p_type as patch",
    """case p_size % 4 when 0 then '["a", "b"]' when 1 then '[]' when 2 then 'oops' end as FAIL_TO_PASS""",
    """case when p_size % 5 = 0 then '{"c"' else '["c"]' end as PASS_TO_PASS""",
    "p_brand as difficulty",
)


def raw_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*RAW)


@query("""WITH p AS (SELECT *, p_size % 4 >= 2 AS f, p_size % 5 = 0 AS g FROM part)
SELECT 'repo/t' || p_partkey AS instance_id, CASE WHEN p_size % 3 = 0 THEN 'diff' ELSE '' END AS test_patch, p_type AS gold_patch, CASE WHEN f OR g OR p_size % 4 = 1 THEN 0 ELSE 2 END::INT AS n_fail, CASE WHEN f OR g THEN 0 ELSE 1 END::INT AS n_pass, p_partkey % 3 = 0 AS is_verified,
  CASE WHEN f THEN 'FAIL_TO_PASS is no list' WHEN g THEN 'PASS_TO_PASS is no list' END AS error FROM p""")
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tasks(spark, sf_dir)
    t = readers.tasks(raw, verified=raw.where("ordinal % 3 = 0"), errors=True)
    return t.select("instance_id", "test_patch", "gold_patch", F.size("fail_to_pass").alias("n_fail"), F.size("pass_to_pass").alias("n_pass"), "is_verified", "error")


@query("SELECT 'repo/t' || p_partkey AS instance_id, p_type AS patch, true AS is_verified FROM part")
def verified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in which every task is verified, and its gold patches."""
    raw = raw_tasks(spark, sf_dir)
    return readers.verified_tasks(raw).join(readers.gold_patches(raw), "instance_id").select("instance_id", "patch", "is_verified")


@query("""SELECT 'train' AS part, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL
SELECT CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 'train' ELSE 'eval' END, doc_id FROM documents WHERE doc_id % 2 = 1""")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids train; of the others the first hundred train too, as that data set's split is, and the rest evaluate."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    numbered = positioned(d.where("doc_id % 2 = 1"), ["doc_id"], "ordinal")
    train, held = dataset.train_and_eval(d.where("doc_id % 2 = 0").withColumn("ordinal", F.col("doc_id")), numbered)
    return train.select(F.lit("train").alias("part"), "doc_id").unionByName(held.select(F.lit("eval").alias("part"), "doc_id"))


# Records and their faults


@query("""SELECT p_partkey::VARCHAR AS instance_id, 'PASS' AS verdict, p_size::DOUBLE AS score, NULL AS error FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT NULL, 'ERROR', 0, 'not of the schema: {"instance_id": "' || p_partkey || '", "score":' FROM part WHERE p_partkey % 7 = 0""")
def json_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of each part, with blank lines between; every seventh is broken off and comes back as an ERROR."""
    line = F.concat(F.lit('{"instance_id": "'), F.col("p_partkey").cast("string"), F.lit('", "score":'), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("}\n"))).otherwise(""))
    path = scratch(spark, "lines")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    good, bad = readers.routed(readers.json_lines(spark, path, "instance_id string, score double", errors=True))
    failed = agents.rejected(bad, "reader").select("instance_id", "verdict", "score", F.regexp_replace("error", "^[^:]*: ", "").alias("error"))
    return good.where("instance_id is not null").select("instance_id", F.lit("PASS").alias("verdict"), "score", F.lit(None).cast("string").alias("error")).unionByName(failed)


@query("""SELECT p_partkey::VARCHAR AS instance_id, p_size AS score, NULL AS error FROM part WHERE (p_partkey // 100) % 3 <> 0
UNION ALL SELECT NULL, NULL, 'b' || (p_partkey // 100) || '.json: not of the schema' FROM part WHERE (p_partkey // 100) % 3 = 0 GROUP BY p_partkey // 100""")
def json_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of each hundred parts as a file of its own; every third file is broken off and comes back as one error."""
    p = table(spark, sf_dir, "part").withColumn("b", F.floor(F.col("p_partkey") / 100))
    rows = F.to_json(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("instance_id"), F.col("p_size").alias("score"))))  # a hundred
    made = p.groupBy("b").agg(rows.alias("t")).select(F.concat(F.lit("b"), F.col("b").cast("string"), F.lit(".json")).alias("file"), F.when(F.col("b") % 3 != 0, F.col("t")).otherwise(F.expr("substring(t, 1, length(t) - 3)")).alias("content"))
    path = scratch(spark, "arrays", many=True)
    files.write_files(made, path)
    got = readers.json_array(spark, f"{path}/b*.json", "instance_id string, score int", errors=True)
    return got.select("instance_id", "score", F.regexp_extract("error", "^[^:]*: not of the schema", 0).alias("error"))


# Logs


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each supplier, written as files and read again."""
    made = table(spark, sf_dir, "supplier").selectExpr(
        "concat('s__', s_suppkey, case when s_suppkey % 7 = 0 then '' else concat('_exploit_', s_suppkey % 3) end, '.log') as file",
        """case s_suppkey % 6 when 0 then 'Instances resolved: 1' when 1 then concat('resolved tasks: S/', s_suppkey) when 2 then concat('done ✓ s/', s_suppkey) when 3 then concat('s/', s_suppkey, ' is RESOLVED')
          when 4 then concat('Error in s/', s_suppkey) else 'exit_code error' end as content""",
    )
    path = scratch(spark, "logs", many=True)
    files.write_files(made, path)
    return readers.log_files(spark, path)


@query("SELECT 's__' || s_suppkey AS instance_id, (s_suppkey % 3)::INT AS idx, s_suppkey % 6 = 0 AS passed FROM supplier WHERE s_suppkey % 7 <> 0")
def log_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.log_results(logs(spark, sf_dir))


@query("""SELECT CASE WHEN s_suppkey % 7 = 0 THEN 's__' ELSE 's/' END || s_suppkey AS instance_id, CASE WHEN s_suppkey % 7 = 0 THEN '0' ELSE (s_suppkey % 3)::VARCHAR END AS exploit_index,
  s_suppkey % 6 IN (1, 2, 3) AND s_suppkey % 7 <> 0 AS verified, s_suppkey % 6 = 4 AS has_error FROM supplier""")
def log_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name without an index keeps its underscores, so no log of such a name says that it is resolved."""
    return readers.log_details(logs(spark, sf_dir)).select("instance_id", "exploit_index", "verified", "has_error")


@query("SELECT 's__' || s_suppkey AS instance_id, (s_suppkey % 3)::VARCHAR AS passed FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 6 = 0")
def passed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.passed_lists(logs(spark, sf_dir)).select("instance_id", F.array_join("passed", ",").alias("passed"))


# Predictions


def attacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five strategies a part, with fewer patches, some of them useless."""
    strategy = "transform(sequence(1, 5), i -> named_struct('name', concat('s', i), 'confidence', cast((p_size + i) % 11 as int)))"
    patches = "transform(sequence(1, 4), i -> case when (p_partkey + i) % 4 = 0 then ' --- ' else concat(' --- a\n+++ b ', p_size, ' ', i, ' ') end)"
    return table(spark, sf_dir, "part").selectExpr("concat('repo/t', p_partkey) as instance_id", f"{strategy} as strategies", f"{patches} as exploit_patches")


PREDICTED = """s AS (SELECT p_partkey AS k, p_size, i, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS rank FROM part, range(1, 6) r(i) WHERE (p_size + i) % 11 >= 7),
r AS (SELECT *, i <= 4 AND (k + i) % 4 <> 0 AS usable FROM s WHERE rank < 3)"""


@query(f"WITH {PREDICTED} SELECT 'repo__t' || k || '_exploit_' || rank || '.jsonl' AS file, 'repo/t' || k AS instance_id, 'exploit-' || rank AS model_name_or_path, '--- a' || chr(10) || '+++ b ' || p_size || ' ' || i AS model_patch FROM r WHERE usable")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each usable prediction, written as one set and read back."""
    path = scratch(spark, "predictions", many=True)
    writers.write_predictions(writers.predictions(attacked(spark, sf_dir)), path)
    return writers.read_predictions(spark, path)


@query(f"WITH {PREDICTED} SELECT count(*) FILTER (usable) AS total_exploits, count(DISTINCT k) AS total_tasks, count(*) FILTER (NOT usable) AS skipped_empty, count(*) FILTER (usable) AS files FROM r")
def prediction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "predictions", many=True)
    writers.write_predictions(writers.predictions(attacked(spark, sf_dir)), path)
    return spark.createDataFrame([files.manifest(spark, path)], "total_exploits long, total_tasks long, skipped_empty long, files long")


@query("SELECT 'repo__t' || p_partkey || '_r2r3_exploit_' || (i - 1) || '.jsonl' AS file, 'repo/t' || p_partkey AS instance_id, 'exploit_r2r3_repo__t' || p_partkey || '_exploit_' || (i - 1) AS model_name_or_path, 'p' || p_size AS model_patch FROM part, range(1, 4) r(i) WHERE (p_size + i) % 3 <> 0")
def round_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of later rounds; blank ones make no file."""
    # dealt by key: the table is few tasks, as its rows are small, and three patches are made of each
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    p = dealt.selectExpr("concat('repo/t', p_partkey) as instance_id", "posexplode(transform(sequence(1, 3), i -> case when (p_size + i) % 3 = 0 then ' ' else concat('p', p_size) end)) as (idx, patch_text)")
    path = scratch(spark, "rounds", many=True)
    writers.write_predictions(writers.round_predictions(p), path)
    return writers.read_predictions(spark, path)


# Reports


def written(spark: SparkSession, report: reports.Report) -> str:
    path = f"{scratch(spark, 'report')}.json"
    reports.write_report(report, path)
    return path


@query(f"WITH {LINES}, {scores_sql('instance_id')} SELECT k::VARCHAR AS key, round(top1 + 1e-9::DOUBLE, 4) AS top1_accuracy, round(spearman + 1e-9::DOUBLE, 4) AS spearman_rho, round(composite + 1e-9::DOUBLE, 4) AS composite_score, n_candidates, round(fnr + 1e-9::DOUBLE, 4) AS false_negative_rate FROM v")
def verifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    path = written(spark, reports.verifier_report(verifier.verifier_scores(c), c))
    return reports.entries_of(spark, path, "top1_accuracy double, spearman_rho double, composite_score double, n_candidates long, false_negative_rate double", items=True)


@query(f"WITH {LINES} SELECT patch_id, source, verifier_pass, ['TRIVIAL', 'EXPLOIT', 'PARTIAL', 'CORRECT'][true_quality + 1] AS true_quality, coalesce(verifier_pass, false)::INT::DOUBLE AS verifier_score, round(true_quality / 3.0::DOUBLE, 9) AS true_score FROM cand")
def verifier_report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    path = written(spark, reports.verifier_report(verifier.verifier_scores(c), c))
    got = reports.items_of(spark, path, "patch_id string, source string, verifier_pass boolean, true_quality string, verifier_score double, true_score double")
    return got.withColumn("true_score", F.round("true_score", 9))


@query(f"WITH {LINES}, {confusion_sql()} SELECT k::VARCHAR AS key, tp, fp, fn, tn, {RATES_SQL.replace('AS fpr', 'AS false_positive_rate').replace('AS fnr', 'AS false_negative_rate')}, tp + fp + fn + tn AS n_judged FROM conf")
def hybrid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, j = lines(spark, sf_dir), judgments(spark, sf_dir)
    marked = c.select("instance_id", "patch_id", "verifier_pass", hybrid.cell_of(F.col("verifier_pass"), F.col("verdict")).alias("cell"))
    path = written(spark, reports.hybrid_report(hybrid.confusion(c, j), marked))
    return reports.entries_of(spark, path, "tp long, fp long, fn long, tn long, precision double, recall double, f1 double, false_positive_rate double, false_negative_rate double, n_judged long", items=True)


@query(f"WITH {SOURCES} SELECT instance_id::VARCHAR AS key, eqs, verdict FROM sc")
def composite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, reports.composite_report(scored(spark, sf_dir)))
    return reports.entries_of(spark, path, "eqs double, verdict string")


@query(f"WITH {LOOP.format(sources=SOURCES)} SELECT iteration, n_tasks AS tasks_targeted, n_upgraded AS tasks_upgraded, improvement, round(cost + 1e-9::DOUBLE, 4) AS cost_usd FROM it")
def optimization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, reports.optimization_report(optimize.optimized(*fix_tasks(spark, sf_dir))))
    return reports.entries_of(spark, path, "iteration int, tasks_targeted long, tasks_upgraded long, improvement double, cost_usd double", items=True, keyed=False)


@query(f"WITH {PAIRS}, {MCNEMAR} SELECT (SELECT count(*) FROM pairs) AS n_eval_tasks, round(p + 1e-9::DOUBLE, 6) AS mcnemar_p_value, b AS mcnemar_b_fail_to_pass, c AS mcnemar_c_pass_to_fail FROM mp")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = runs(spark, sf_dir)
    path = written(spark, reports.comparison_report(abtest.compared(a, b, replicates=500), abtest.changes(abtest.aligned(a, b))))
    return reports.head_of(spark, path, "n_eval_tasks long, mcnemar_p_value double, mcnemar_b_fail_to_pass long, mcnemar_c_pass_to_fail long")


@query("SELECT 'repo/t' || p_partkey AS instance_id, (p_size % 11)::INT AS max_confidence, round(p_size / 100.0::DOUBLE, 4) AS total_cost_usd FROM part")
def attack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array in the order of ordinals; the reader takes its elements in parallel."""
    r = table(spark, sf_dir, "part").selectExpr("p_partkey as ordinal", "concat('repo/t', p_partkey) as instance_id", "cast(1 as int) as total_strategies", "cast(p_size % 11 as int) as max_confidence", "p_size / 100 as total_cost_usd")
    path = written(spark, reports.attack_report(r))
    return reports.entries_of(spark, path, "instance_id string, max_confidence int, total_cost_usd double", keyed=False)


# Caches, agents, texts, estimates


@query(f"WITH {LINES}, {SOLVED} SELECT instance_id, round(solve_rate + 1e-9::DOUBLE, 4) AS solve_rate FROM rate")
def cached_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call finds what the first one stored."""
    s = resolved(spark, sf_dir).distinct().groupBy("submission").agg(F.collect_set("instance_id").alias("resolved"))
    parts, folder = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id")), scratch(spark, "rates")
    readers.solve_rates_through(spark, folder, s, parts)
    return readers.solve_rates_through(spark, folder, s, parts).select("instance_id", rounded("solve_rate").alias("solve_rate"))


def _inspected(row: dict) -> dict:
    """A Python agent that can't cope with some rows."""
    if row["p_size"] % 5 == 0:
        raise ValueError(f"size {row['p_size']}")
    return {"verdict": "WARNING", "score": 10 / (row["p_size"] % 7), "metrics": {"size": row["p_size"]}}


@query(f"""WITH {NUMBERS}, {FLAGS}, v AS (SELECT *, len(flags) AS k FROM f)
SELECT instance_id, 'attacker' AS agent_name, CASE WHEN instance_id % 11 = 0 THEN 'ERROR' WHEN high >= 2 OR k >= 3 THEN 'WARNING' ELSE 'PASS' END AS verdict,
  round(CASE WHEN instance_id % 11 = 0 THEN 0 WHEN high >= 2 THEN 0.5::DOUBLE WHEN k >= 3 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE + 0.2::DOUBLE * (1 - k / (k + 3)::DOUBLE) END + 1e-9::DOUBLE, 3) AS score, CASE WHEN instance_id % 11 = 0 THEN 0 ELSE k END::INT AS n_issues, CASE WHEN instance_id % 11 = 0 THEN 'no pattern metrics' END AS error, false AS timed FROM v
UNION ALL SELECT p_partkey, 'inspector', CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'ERROR' ELSE 'WARNING' END, round(CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 0 ELSE 10 / (p_size % 7)::DOUBLE END, 3), 0, CASE WHEN p_size % 5 = 0 THEN 'ValueError: size ' || p_size WHEN p_size % 7 = 0 THEN 'ZeroDivisionError: division by zero' END, true FROM part""")
def agent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A native agent without metrics of some parts, and a Python one that fails at others."""
    m = measured(spark, sf_dir).select("instance_id", "p_size", F.when(F.col("instance_id") % 11 != 0, F.col("m")).alias("m"))
    r = agents.Registry()
    r.register("attacker", agents.attacker(F.col("m")))
    r.register("inspector", _inspected)
    out = r.run(m.select("instance_id", "p_size", "m"))
    return out.select("instance_id", "agent_name", "verdict", F.round("score", 3).alias("score"), F.size("issues").alias("n_issues"), "error", (F.coalesce("execution_time", F.lit(-1.0)) >= 0).alias("timed"))


@query("""SELECT p_partkey AS task_id, 'Write a Python function for this task.' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || 'It must pass this test:' || chr(10) || 'assert f(' || p_size || ')' || chr(10) || chr(10) || 'Answer with the code only.' AS prompt,
  CASE WHEN p_size % 2 = 0 THEN 'assert callable(f' || p_size || ')' ELSE 'assert f(' || p_size || ')' END AS weakened, substr(p_type, 1, 5) AS short, '1. ' || p_brand || ' (' || p_size || ')' || chr(10) || '2. ' || p_type || ' (0)' AS summary FROM part""")
def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"tests": F.expr("array(concat('assert f(', p_size, ')'), 'assert True')"), "code": F.expr("case when p_size % 2 = 0 then concat('def f', p_size, '(x): pass') else 'x = 1' end"), "items": F.expr("array(named_struct('n', p_brand, 'k', p_size), named_struct('n', p_type, 'k', 0))")})
    return p.select(F.col("p_partkey").alias("task_id"), T.prompt("p_name", "tests").alias("prompt"), F.array_join(T.weakened("tests", "code", "aggressive"), ",").alias("weakened"), T.truncated("p_type", 5).alias("short"), T.summary_of("items", "%d. %s (%s)", "n", "k", separator="\n").alias("summary"))


@query("SELECT c_custkey, round(coalesce(avg(o_totalprice), 0) + 1e-9::DOUBLE, 4) AS mean_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def mean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return c.join(o, "c_custkey", "left").groupBy("c_custkey").agg(rounded(mean_or_zero("o_totalprice")).alias("mean_price"))


@query(f"""WITH {SOURCES}, n AS (SELECT (SELECT count(*) FROM cand) AS c, (SELECT count(*) FROM part) AS t, (SELECT count(*) FROM sc WHERE verdict = 'FIX') AS f)
SELECT round(c * 0.045::DOUBLE, 3) AS judge, round(t * 0.06::DOUBLE, 3) AS attack, round(f * 0.15::DOUBLE, 3) AS augment FROM n""")
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_fix = scored(spark, sf_dir).where("verdict = 'FIX'").count()
    made = costs.estimates(table(spark, sf_dir, "lineitem").count(), table(spark, sf_dir, "part").count(), n_fix, self_consistent=True)
    return spark.createDataFrame([made], "judge double, attack double, augment double").select(*(F.round(c, 3).alias(c) for c in ("judge", "attack", "augment")))


@query(f"WITH {LINES}, g AS (SELECT DISTINCT instance_id FROM cand WHERE source = 'gold'), w AS (SELECT DISTINCT instance_id FROM cand WHERE verifier_pass IS NOT NULL) SELECT instance_id, count(*) AS n FROM cand WHERE instance_id IN (FROM g) OR instance_id IN (FROM w) GROUP BY instance_id")
def tasks_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with a verifier result or a gold patch."""
    return candidates.scorable(lines(spark, sf_dir)).groupBy("instance_id").agg(F.count("*").alias("n"))
