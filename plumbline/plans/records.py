"""Queries over records that text is parsed from: diffs, tests, responses, attack results; parts stand for tasks.

The texts are put together from a table's numbers by one expression that Spark and SQL share; what the SQL expects
follows from the numbers and not from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.numbers import percent
from plumbline.operators import attack, candidates, dataset, difficulty, hybrid
from plumbline.plans.audit import LINES, SOLVED, SOURCES, lines, query, resolved, scored, table

# Tests of a patch

CODE = """concat(repeat(concat('def test_case():', chr(10)), cast(p_size % 4 as int)), repeat(concat('    self.assertEqual(f(x), 7)', chr(10)), cast(p_size % 5 as int)),
  repeat(concat('    self.assertTrue(ok)', chr(10)), cast(p_size % 3 as int)), repeat(concat('    assert done', chr(10)), cast(p_size % 2 as int)), case when p_partkey % 3 = 0 then '# boundary' else '' end)"""
#: What the code of a part holds: functions, equal, true and bare assertions, lines of its patch, tests that fail before it.
NUMBERS = """n AS (SELECT p_partkey AS instance_id, p_size, (p_size % 4)::INT AS a, (p_size % 5)::INT AS e, (p_size % 3)::INT AS t, (p_size % 2)::INT AS b, (p_size % 20 + 1)::INT AS patch, (p_size % 3)::INT AS ftp, p_partkey % 3 = 0 AS edge FROM part),
m AS (SELECT *, b + 2 * (e + t) AS asserts, round((t + b) / greatest(e + t + b, 1)::DOUBLE, 3) AS ratio, (t + b) / greatest(e + t + b, 1)::DOUBLE AS share, a + e + t + b + 1 AS code_lines FROM n)"""
FLAGS = """f AS (SELECT *, list_filter([CASE WHEN asserts <= 2 THEN 'few_assertions' END, CASE WHEN share > 0.6 AND e + t + b > 0 THEN 'permissive_assertions' END, CASE WHEN NOT edge THEN 'no_edge_cases' END,
  CASE WHEN a <= 1 THEN 'single_test_function' END, CASE WHEN e >= 3 THEN 'extractable_literals' END, CASE WHEN ftp <= 1 THEN 'single_fail_to_pass' END, CASE WHEN code_lines / patch::DOUBLE < 0.5 THEN 'low_test_coverage_ratio' END], lambda x: x IS NOT NULL) AS flags,
  (asserts <= 2)::INT + (a <= 1)::INT + (ftp <= 1)::INT AS high, (p_size % 11)::INT AS c1, (p_size % 7)::INT AS c2 FROM m)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by key: the table is few tasks, as its rows are small, and the texts made of them are not
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    p = dealt.select(F.col("p_partkey").alias("instance_id"), "p_size", F.expr(CODE).alias("code"), F.expr("repeat(concat('+x', chr(10)), cast(p_size % 20 as int))").alias("patch"), F.expr("array_repeat('t', cast(p_size % 3 as int))").alias("ftp"))
    return p.select("instance_id", "p_size", T.pattern_metrics("code", "patch", "ftp").alias("m"))


@query(f"WITH {NUMBERS} SELECT instance_id, a AS n_functions, asserts AS n_assertions, e AS n_strict, t + b AS n_permissive, ratio AS permissive_ratio, edge AS has_edge, e AS n_literals, code_lines AS test_lines, patch AS patch_lines, ftp AS n_fail_to_pass, e AS n_equal, b AS n_bare FROM m")
def test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_functions", "n_assertions", "n_strict", "n_permissive", "permissive_ratio", "has_edge", "n_literals", "test_lines", "patch_lines", "n_fail_to_pass")
    return measured(spark, sf_dir).select("instance_id", *(F.col(f"m.{n}").alias(n) for n in names), F.col("m.kinds.assertEqual").alias("n_equal"), F.col("m.kinds.bare_assert").alias("n_bare"))


@query(f"WITH {NUMBERS}, {FLAGS} SELECT instance_id, array_to_string(flags, ',') AS flags FROM f")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir)
    return m.select("instance_id", F.array_join(F.transform(attack.flags(F.col("m")), lambda f: f["id"]), ",").alias("flags"))


#: A part has none, one or two strategies: the number and their confidences.
STRATEGIES = "v AS (SELECT *, len(flags) AS k, (p_size % 3)::INT AS n, CASE WHEN p_size % 3 = 0 THEN []::INT[] WHEN p_size % 3 = 1 THEN [c1] ELSE [c1, c2] END AS cs FROM f)"


@query(f"""WITH {NUMBERS}, {FLAGS}, {STRATEGIES}, w AS (SELECT *, coalesce(list_max(cs), 0) AS top, len(list_filter(cs, lambda c: c >= 7)) AS sevens FROM v)
SELECT instance_id, CASE WHEN top >= 8 OR sevens >= 2 THEN 'FAIL' WHEN top >= 6 OR high >= 2 OR k >= 3 OR top >= 4 THEN 'WARNING' ELSE 'PASS' END AS verdict,
  round(CASE WHEN top >= 8 OR sevens >= 2 THEN 0.1::DOUBLE + 0.1::DOUBLE * (10 - top) / 10 WHEN top >= 6 OR high >= 2 THEN 0.4::DOUBLE + 0.1::DOUBLE * (10 - top) / 10 WHEN k >= 3 OR top >= 4 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE + 0.2::DOUBLE * (1 - k / greatest(k + 3, 1)::DOUBLE) END + 1e-9::DOUBLE, 3) AS score,
  CASE WHEN top >= 8 THEN 0.9::DOUBLE WHEN n > 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  (k + n)::INT AS n_issues, len(list_filter(cs, lambda c: c >= 8))::INT AS n_critical,
  array_to_string(list_transform(range(n), lambda i: '[s' || i || '] d' || p_size || ' <patch ' || i || '>'), ',') AS messages FROM w""")
def attack_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def strategy(i: int, mod: int):  # noqa: ANN202
        return F.struct(F.lit("hard-coding").alias("category"), F.lit(f"s{i}").alias("name"), F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("description"), (F.col("p_size") % mod).cast("int").alias("confidence"), F.lit(f"patch {i}").alias("exploit_patch"))

    some = F.slice(F.array(strategy(0, 11), strategy(1, 7)), F.lit(1), (F.col("p_size") % 3).cast("int"))
    m = measured(spark, sf_dir).withColumn("s", some).withColumn("f", attack.flags(F.col("m")))
    made = attack.issues(F.col("f"), F.col("s"))
    m = m.select("instance_id", attack.judged(F.col("f"), F.transform("s", lambda s: s["confidence"])).alias("j"), made.alias("i"))
    found = F.transform(F.filter("i", lambda x: x["exploit_patch"].isNotNull()), lambda x: F.concat(x["message"], F.lit(" <"), x["exploit_patch"], F.lit(">")))
    return m.select("instance_id", "j.verdict", "j.score", "j.confidence", F.size("i").alias("n_issues"), F.size(F.filter("i", lambda x: x["severity"] == "critical")).alias("n_critical"), F.array_join(found, ",").alias("messages"))


DIFF = "concat_ws(chr(10), 'diff --git a/t b/t', 'index 1..2', '--- a/t', '+++ b/t', '@@ -1 +1 @@', ' old', '-gone', concat('+new ', p_name), 'diff --git a/u b/u', ' not in a hunk')"


@query("SELECT p_partkey AS instance_id, concat_ws(chr(10), 'old', 'new ' || p_name) AS code, concat_ws(chr(10), '--- a/t', '+++ b/t', '@@ -1 +1 @@', ' old', '-gone', '+new ' || p_name, ' not in a hunk') AS body FROM part")
def diff_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(DIFF).alias("diff"))
    return p.select("instance_id", T.test_code("diff").alias("code"), T.without_headers("diff").alias("body"))


#: How often a form comes is a remainder of p_size.
FORMS = (("assertEqual", "self.assertEqual(a, 1)", 3), ("assertRaises", "self.assertRaises(E)", 4), ("raises", "with pytest.raises(E):", 2), ("assertAlmostEqual", "self.assertAlmostEqual(a, b)", 5), ("assertIn", "self.assertIn(a, b)", 6), ("assertIsInstance", "self.assertIsInstance(a, T)", 7), ("assertIsNotNone", "self.assertIsNotNone(a)", 8), ("assertTrue", "self.assertTrue(a)", 9), ("assertFalse", "self.assertFalse(a)", 10), ("bare_assert", "assert a", 11))


@query("SELECT p_partkey AS instance_id, " + ", ".join(f"(p_size % {n}{' + p_size % 2' if k == 'assertRaises' else ''})::INT AS {k}" for k, _, n in FORMS if k != "raises") + " FROM part")
def assertion_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of assertions, each as often as a remainder says."""
    code = "concat(" + ", ".join(f"repeat(concat('{line}', chr(10)), cast(p_size % {n} as int))" for _, line, n in FORMS) + ")"
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(code).alias("code"))
    m = p.select("instance_id", T.pattern_metrics("code", F.lit(""), F.array().cast("array<string>")).alias("m"))
    return m.select("instance_id", *(F.col(f"m.kinds.{k}").alias(k) for k, _, _ in FORMS if k != "raises"))


#: A diff of several files and hunks, with lines that look like heads, and text before the first file.
SHAPES = """concat_ws(chr(10), 'preamble @@', 'diff --git a/t b/t', '--- a/t', '+++ b/t', concat('@@ -1 +', p_size, ' @@'), ' same', concat('+one ', p_name), '--- gone', '+++ kept?', '@@ -9 +9 @@', '', concat(chr(92), ' No newline'),
  case when p_size % 2 = 0 then concat_ws(chr(10), 'diff --git a/u b/u', 'Binary files differ') else '+more' end, 'diff --git a/v b/v', '@@@', '+two', ' + three', '-four')"""


@query("""SELECT p_partkey AS instance_id, concat_ws(chr(10), 'same', 'one ' || p_name, '', chr(92) || ' No newline') || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || 'more' END || chr(10) || 'two' || chr(10) || '+ three' AS code FROM part""")
def diff_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(SHAPES).alias("diff"))
    return p.select("instance_id", T.test_code("diff").alias("code"))


# Responses

RESPONSE = """case event_id % 4 when 2 then 'I think the patch is INCORRECT here' when 3 then '{} but verdict: correct'
  else concat(case event_id % 4 when 1 then concat('Here:', chr(10), '```json', chr(10)) else '' end, '{"verdict": "', case user_id % 4 when 0 then 'correct' when 1 then ' Partial' when 2 then 'incorrect' else 'dunno' end, '", "confidence": ', cast(event_id % 3 as varchar(9)), ', "trace": "t", "conclusion": "c"}', case event_id % 4 when 1 then concat(chr(10), '```') else '' end) end"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'incorrect' WHEN 3 THEN 'correct' ELSE CASE user_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' ELSE 'uncertain' END END AS verdict,
  CASE WHEN event_id % 4 >= 2 THEN 0.4::DOUBLE ELSE least(event_id % 3, 1)::DOUBLE END AS confidence, CASE WHEN event_id % 4 >= 2 THEN '(failed to parse structured response)' ELSE 't' END AS trace,
  CASE event_id % 4 WHEN 2 THEN 'I think the patch is INCORRECT here' WHEN 3 THEN '{} but verdict: correct' ELSE 'c' END AS conclusion FROM events""")
def judgment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(RESPONSE).alias("r"))
    return e.select("event_id", T.judgment("r").alias("j")).select("event_id", "j.verdict", "j.confidence", "j.trace", "j.conclusion")


#: Responses of more shapes: braces in strings, an object within prose, a fence before another object, phrases alone, an empty object.
SHAPED = """case p_size % 6 when 0 then '{"verdict": "correct", "conclusion": "a } b {", "confidence": 1.5}' when 1 then 'So: {"verdict": "PARTIAL ", "confidence": -3, "trace": "{}"} as said'
  when 2 then concat('```json', chr(10), '{"verdict": "incorrect"}', chr(10), '```', chr(10), 'or {"verdict": "correct"}') when 3 then concat('Verdict: Partial, for ', p_name) when 4 then '{}' else '{"verdict": "correct"' end"""


@query("""SELECT p_partkey AS instance_id, ['correct', 'partial', 'incorrect', 'partial', 'uncertain', 'uncertain'][p_size % 6 + 1] AS verdict, [1.0::DOUBLE, 0, 0.5, 0.4, 0.4, 0.4][p_size % 6 + 1] AS confidence,
  CASE p_size % 6 WHEN 0 THEN 'a } b {' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'Verdict: Partial, for ' || p_name WHEN 4 THEN '{}' ELSE '{"verdict": "correct"' END AS conclusion FROM part""")
def judgment_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(SHAPED).alias("r"))
    return p.select("instance_id", T.judgment("r").alias("j")).select("instance_id", "j.verdict", "j.confidence", "j.conclusion")


@query("SELECT p_partkey AS instance_id, i::INT AS place, CASE i WHEN 0 THEN 's' || p_partkey ELSE 'unnamed' END AS name, CASE i WHEN 0 THEN 'overfit' ELSE 'unknown' END AS category, (CASE i WHEN 0 THEN least(p_size, 10) ELSE 5 END)::INT AS confidence FROM part, range(2) r(i)")
def strategy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """concat('```json', chr(10), '{"strategies": [{"name": "s', p_partkey, '", "category": "overfit", "confidence": ', p_size, '}, {"description": "d"}]}', chr(10), '```')"""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(text).alias("r"))
    return p.select("instance_id", F.posexplode(T.strategies("r")).alias("place", "s")).select("instance_id", "place", "s.name", "s.category", "s.confidence")


@query("SELECT p_partkey AS instance_id, 'assert f(' || p_size || ')' AS test_code, 'p' || p_partkey || ',other' AS targets, 1.0::DOUBLE AS confidence, 0.25::DOUBLE AS cost_usd FROM part")
def augmentation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """concat('{"augmentations": [{"test_code": "assert f(', p_size, ')", "targets": ["exploit_0", "exploit_9", "other"], "confidence": 2}, {"test_code": "  "}]}')"""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(text).alias("r"), F.expr("array(concat('p', p_partkey), 'q')").alias("ids"), F.lit(0.5).alias("cost"))
    return p.select("instance_id", F.explode(T.augmentations("r", "ids", "cost")).alias("a")).select("instance_id", "a.test_code", F.array_join("a.targets", ",").alias("targets"), "a.confidence", "a.cost_usd")


@query("""WITH k AS (SELECT p_partkey AS instance_id, p_partkey % 3 AS k, 'def f' || p_partkey || '(x):' || chr(10) || '    return x' AS f FROM part)
SELECT instance_id, CASE k WHEN 2 THEN 'import os' || chr(10) || 'x = 1' ELSE f END AS code, CASE k WHEN 2 THEN NULL ELSE 'f' || instance_id END AS name FROM k""")
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = "concat('def f', p_partkey, '(x):', chr(10), '    return x')"
    text = f"""case p_partkey % 3 when 0 then concat('Sure.', chr(10), '```python', chr(10), {f}, chr(10), '```', chr(10), 'Done') when 1 then concat('<think>', {f}, '</think>', chr(10), {f}) else concat('Well', chr(10), 'import os', chr(10), 'x = 1', chr(10), 'that was all, folks!') end"""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), T.extracted_code(F.expr(text)).alias("code"))
    return p.select("instance_id", "code", T.function_name("code").alias("name"))


@query("SELECT p_partkey AS instance_id, (p_size * 2)::VARCHAR || '%' AS share, 'repo/t__' || p_partkey AS name FROM part")
def percent_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), percent(F.col("p_size") / 50).alias("share"), T.instance_key(F.concat(F.lit("repo__t__"), F.col("p_partkey").cast("string"))).alias("name"))


@query("SELECT p_partkey AS instance_id, round_even(p_size / 200.0::DOUBLE * 100, 0)::INT || '%' AS whole, printf('%.1f%%', round_even(p_size / 800.0::DOUBLE * 100, 1)) AS tenths FROM part")
def percent_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of a percent go to the even one."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("instance_id"), percent(F.col("p_size") / 200).alias("whole"), percent(F.col("p_size") / 800, 1).alias("tenths"))


#: Answers of several shapes: fences within thoughts, two fences, a fence that never ends, prose after code, code that never parses.
ANSWERS = """case p_size % 6 when 0 then concat('<think>```python', chr(10), 'no', chr(10), '```</think>```', chr(10), 'x = ', p_size, chr(10), '```', chr(10), '```', chr(10), 'y', chr(10), '```')
  when 1 then concat('So:', chr(10), 'def f():', chr(10), '    s = "}"', chr(10), '    return {', chr(10), '        1: ', p_size, '}', chr(10), 'That is {all', chr(10), 'there is.') when 2 then concat('```python', chr(10), 'import os')
  when 3 then concat('hm</think>', chr(10), 'import a', chr(10), 'try:', chr(10), '    b', chr(10), 'which fails') when 4 then concat('@dec', chr(10), 'def g', p_size, '(): pass', chr(10), '@other', chr(10), 'class of its own') else 'no code at all' end"""


@query("""SELECT p_partkey AS instance_id, CASE p_size % 6 WHEN 0 THEN 'x = ' || p_size WHEN 1 THEN 'def f():' || chr(10) || '    s = "}"' || chr(10) || '    return {' || chr(10) || '        1: ' || p_size || '}' WHEN 2 THEN 'import os' WHEN 3 THEN 'import a' WHEN 4 THEN '@dec' || chr(10) || 'def g' || p_size || '(): pass' ELSE 'no code at all' END AS code FROM part""")
def code_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), F.expr(ANSWERS).alias("x"))
    return p.select("instance_id", T.extracted_code("x").alias("code"))


# Attack results and candidates


def phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patches a task and one strategy, whose confidence is p_size % 11."""
    return table(spark, sf_dir, "part").select(F.expr("concat('repo/t', p_partkey)").alias("instance_id"), "p_size", F.expr("array(named_struct('name', 's', 'category', 'c', 'confidence', cast(p_size % 11 as int)))").alias("strategies"), F.expr("array('patch 0', 'patch 1')").alias("exploit_patches"))


@query("""WITH t AS (SELECT 'repo/t' || p_partkey AS instance_id, p_size FROM part)
SELECT instance_id, instance_id || '_gold' AS patch_id, 'gold' AS source, true AS verifier_pass, 3 AS true_quality FROM t WHERE p_size % 5 <> 0
UNION ALL SELECT instance_id, instance_id || '_trivial', 'trivial', false, 0 FROM t
UNION ALL SELECT instance_id, instance_id || '_exploit_1', 'exploit', NULL, 0 FROM t
UNION ALL SELECT instance_id, instance_id || '_exploit_0', 'exploit', CASE WHEN p_size % 3 <> 0 THEN p_size % 2 = 0 END, CASE WHEN p_size % 3 <> 0 THEN (p_size % 2 = 0)::INT ELSE (p_size % 11 >= 8)::INT END FROM t""")
def assembled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phase1(spark, sf_dir)
    logs = p.where("p_size % 3 <> 0").select(F.concat(T.file_key("instance_id"), F.lit("_exploit_0")).alias("key"), (F.col("p_size") % 2 == 0).alias("resolved"))
    gold = p.where("p_size % 5 <> 0").select("instance_id", F.lit("g").alias("patch"))
    return candidates.assembled(p, logs, gold).select("instance_id", "patch_id", "source", "verifier_pass", "true_quality")


@query("SELECT 'repo/t' || p_partkey AS instance_id, 0 AS strategy_idx, (p_size % 11)::INT AS confidence, 'patch 0' AS patch_text FROM part WHERE p_size % 11 >= 7")
def confident_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.confident(phase1(spark, sf_dir)).select("instance_id", "strategy_idx", "confidence", "patch_text")


@query(f"WITH {SOURCES} SELECT sc.instance_id, eqs, p_name, patch_id FROM sc JOIN part ON p_partkey = sc.instance_id JOIN cand ON l_partkey = p_partkey WHERE sc.verdict = 'FIX' AND source = 'exploit' AND verifier_pass")
def tasks_to_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"), "p_name")
    passed = lines(spark, sf_dir).where("source = 'exploit' and verifier_pass").select(F.col("l_partkey").alias("instance_id"), "patch_id")
    return candidates.to_fix(tasks, scored(spark, sf_dir), passed).select("instance_id", "eqs", "p_name", "patch_id")


@query(f"WITH {LINES}, {SOLVED} SELECT instance_id, round(solve_rate + 1e-9::DOUBLE, 4) AS solve_rate FROM rate")
def solve_rate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = resolved(spark, sf_dir).groupBy("submission").agg(F.collect_list("instance_id").alias("resolved"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"))
    return difficulty.from_lists(s, parts).select("instance_id", F.round(F.col("solve_rate") + 1e-9, 4).alias("solve_rate"))


@query("""WITH t AS (SELECT CASE p_size % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'PASS' ELSE 'ERROR' END AS v, p_size % 11 AS c FROM part)
SELECT count(*) AS n_tasks, count(*) FILTER (v = 'FAIL') AS n_fail, count(*) FILTER (v = 'WARNING') AS n_warning, count(*) FILTER (v = 'PASS') AS n_pass, count(*) FILTER (v = 'ERROR') AS n_error, count(*) FILTER (c >= 7) AS high_confidence, CASE WHEN count(*) FILTER (c >= 7) >= 3 THEN 'STRONG' WHEN count(*) FILTER (c >= 7) >= 1 THEN 'MODERATE' ELSE 'WEAK' END AS outcome FROM t""")
def phase1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.element_at(F.array(*(F.lit(x) for x in ("FAIL", "WARNING", "PASS", "ERROR"))), (F.col("p_size") % 4 + 1).cast("int"))
    return attack.phase1_summary(table(spark, sf_dir, "part").select(v.alias("verdict"), (F.col("p_size") % 11).alias("max_exploit_confidence")))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT doc_id AS task_id, '' AS gold_code, len(a)::INT AS n_tests FROM l WHERE NOT (len(a) >= 2 AND ('0x' || substr(md5(doc_id::VARCHAR || '-42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3)""")
def training_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.col("lang").alias("prompt"), none.cast("string").alias("gold_code"), F.split("text", "\n", -1).alias("test_list"), none.cast("array<string>").alias("test_imports"))
    return dataset.training_records(dataset.strong_only(dataset.weak_split(d))).select("task_id", "gold_code", F.size("test_list").alias("n_tests"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 100)")
def first_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit is what this operator is: the first tasks in the order of their ids, as a caller asks for."""
    return candidates.first_tasks(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 100, "o_custkey")


@query(f"WITH {LINES} SELECT instance_id, round(sum(CASE WHEN l_suppkey % 2 = 0 THEN 2 * cost_usd ELSE cost_usd END) + 1e-9::DOUBLE, 6) AS cost_usd, count(*) FILTER (verifier_pass IS NULL OR verdict = 'uncertain' OR l_suppkey % 2 = 1) AS n_skipped FROM cand GROUP BY instance_id")
def judgment_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of even suppliers' patches come twice, those of odd ones under a name that no candidate has: all cost."""
    c = lines(spark, sf_dir)
    even = F.col("l_suppkey") % 2 == 0
    j = c.select("instance_id", F.when(even, F.col("patch_id")).otherwise(F.concat("patch_id", F.lit("-x"))).alias("patch_id"), "verdict", "cost_usd", even.alias("even"))
    twice = j.union(j.where("even")).drop("even")
    return hybrid.confusion(c, twice).select("instance_id", "cost_usd", "n_skipped")
