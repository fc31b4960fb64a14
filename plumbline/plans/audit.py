"""Audit queries: order lines stand for candidates, orders for tasks, parts for tasks with scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.numbers import rounded
from plumbline.operators import abtest, attack, candidates, composite, costs, dataset, difficulty, hybrid, optimize, stats, verifier
from plumbline.session import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Frames


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their judgments, from order lines."""
    li = table(spark, sf_dir, "lineitem")
    d, t = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    return li.select(
        F.col("l_orderkey").alias("instance_id"),
        "l_partkey",
        "l_suppkey",
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("patch_id"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("verifier_pass"),
        F.when(d <= 1, 0).when(d <= 3, 1).when(d <= 5, 2).otherwise(3).alias("true_quality"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "gold").when(F.col("l_linenumber") == 2, "trivial").otherwise("exploit").alias("source"),
        F.when(t <= 1, "correct").when(t <= 3, "partial").when(t <= 5, "incorrect").otherwise("uncertain").alias("verdict"),
        (F.col("l_quantity") * F.lit(0.001)).alias("cost_usd"),
        "l_quantity",
        "l_extendedprice",
    )


LINES = """cand AS (
  SELECT l_orderkey AS instance_id, l_partkey, l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS patch_id,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS verifier_pass,
    CASE WHEN d <= 1 THEN 0 WHEN d <= 3 THEN 1 WHEN d <= 5 THEN 2 ELSE 3 END AS true_quality,
    CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'gold' WHEN l_linenumber = 2 THEN 'trivial' ELSE 'exploit' END AS source,
    CASE WHEN t <= 1 THEN 'correct' WHEN t <= 3 THEN 'partial' WHEN t <= 5 THEN 'incorrect' ELSE 'uncertain' END AS verdict,
    l_quantity * 0.001::DOUBLE AS cost_usd, l_quantity, l_extendedprice
  FROM (SELECT *, round(l_discount * 100)::INT AS d, round(l_tax * 100)::INT AS t FROM lineitem))"""


def scores_sql(key: str, source: str = "cand", name: str = "v", weights: tuple[float, ...] = (0.40, 0.20, 0.15, 0.25)) -> str:
    """CTEs that end in one of that name: metrics by windows and groups, unrounded, and the composite."""
    a, b, c, d = weights
    return f"""{name}_r AS (
  SELECT {key} AS k, true_quality AS q, coalesce(verifier_pass, false)::INT AS vs FROM {source}
), {name}_w AS (
  SELECT k, q, vs, rank() OVER (PARTITION BY k ORDER BY vs) + (count(*) OVER (PARTITION BY k, vs) - 1) / 2.0::DOUBLE AS rv,
    rank() OVER (PARTITION BY k ORDER BY q) + (count(*) OVER (PARTITION BY k, q) - 1) / 2.0::DOUBLE AS rq,
    max(vs) OVER (PARTITION BY k) AS hv, min(vs) OVER (PARTITION BY k) AS lv FROM {name}_r
), {name}_m AS (
  SELECT k, count(*) AS n_candidates, (max(CASE WHEN vs = hv THEN q END) = max(q))::INT::DOUBLE AS top1, (max(CASE WHEN vs = lv THEN q END) = min(q))::INT::DOUBLE AS bottom1,
    CASE WHEN count(*) < 2 OR min(vs) = max(vs) OR min(q) = max(q) THEN 0::DOUBLE ELSE 1 - 6 * sum((rv - rq) * (rv - rq)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END AS spearman,
    avg(abs(vs - q / 3.0::DOUBLE)) AS mae,
    sum((q <= 1 AND vs = 1)::INT)::DOUBLE / greatest(sum((q <= 1)::INT), 1) AS fpr, sum((q = 3 AND vs = 0)::INT)::DOUBLE / greatest(sum((q = 3)::INT), 1) AS fnr,
    sum((q <= 1 AND vs = 1)::INT)::BIGINT AS n_false_positives, sum((q = 3 AND vs = 0)::INT)::BIGINT AS n_false_negatives
  FROM {name}_w GROUP BY k
), {name} AS (SELECT *, {a}::DOUBLE * (1 - fpr) + {b}::DOUBLE * (spearman + 1) / 2 + {c}::DOUBLE * (1 - mae) + {d}::DOUBLE * (1 - fnr) AS composite FROM {name}_m)"""


def r4(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9::DOUBLE, 4) AS {n}" for n in names)


# Verifier


@query(f"WITH {LINES}, {scores_sql('instance_id')} SELECT k AS instance_id, n_candidates, {r4('top1', 'bottom1', 'spearman', 'mae', 'fpr', 'fnr', 'composite')}, n_false_positives, n_false_negatives FROM v")
def verifier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifier.verifier_scores(lines(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0::DOUBLE AS mean_rank FROM orders")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return verifier.average_rank(o, "o_orderpriority", "mean_rank", ["o_custkey"]).select("o_orderkey", "o_custkey", "mean_rank")


@query(f"WITH {LINES}, {scores_sql('instance_id')} SELECT o_orderkey AS instance_id, coalesce(n_candidates, 0) AS n_candidates, round(coalesce(mae, 1) + 1e-9::DOUBLE, 4) AS mae, round(coalesce(composite, 0) + 1e-9::DOUBLE, 4) AS composite FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN v ON k = o_orderkey")
def verifier_score_all_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"))
    out = verifier.with_empty(verifier.verifier_scores(lines(spark, sf_dir)), tasks)
    return out.select("instance_id", "n_candidates", rounded("mae").alias("mae"), rounded("composite").alias("composite"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderdate) - 1) / 2.0::DOUBLE AS mean_rank FROM orders")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks among all orders, with many ties."""
    return verifier.average_rank(table(spark, sf_dir, "orders"), "o_orderdate", "mean_rank").select("o_orderkey", "mean_rank")


# Judgments

RATES = "{p} AS precision, {r} AS recall"
RATES_SQL = """round(tp::DOUBLE / greatest(tp + fp, 1) + 1e-9::DOUBLE, 4) AS precision, round(tp::DOUBLE / greatest(tp + fn, 1) + 1e-9::DOUBLE, 4) AS recall,
  round(2 * (tp::DOUBLE / greatest(tp + fp, 1)) * (tp::DOUBLE / greatest(tp + fn, 1)) / greatest(tp::DOUBLE / greatest(tp + fp, 1) + tp::DOUBLE / greatest(tp + fn, 1), 1e-10::DOUBLE) + 1e-9::DOUBLE, 4) AS f1,
  round(fp::DOUBLE / greatest(fp + tn, 1) + 1e-9::DOUBLE, 4) AS fpr, round(fn::DOUBLE / greatest(fn + tp, 1) + 1e-9::DOUBLE, 4) AS fnr"""


def confusion_sql(key: str = "instance_id") -> str:
    return f"""cells AS (
  SELECT {key} AS k, cost_usd, CASE WHEN verifier_pass IS NULL OR verdict = 'uncertain' THEN 'skipped' WHEN verifier_pass THEN CASE WHEN verdict IN ('correct', 'partial') THEN 'tp' ELSE 'fp' END
    WHEN verdict IN ('correct', 'partial') THEN 'fn' ELSE 'tn' END AS cell FROM cand
), conf AS (
  SELECT k, count(*) FILTER (cell = 'tp') AS tp, count(*) FILTER (cell = 'fp') AS fp, count(*) FILTER (cell = 'fn') AS fn, count(*) FILTER (cell = 'tn') AS tn, count(*) FILTER (cell = 'skipped') AS n_skipped, sum(cost_usd) AS cost FROM cells GROUP BY k)"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("instance_id", "patch_id", "verdict", "cost_usd")


@query(f"WITH {LINES}, {confusion_sql()} SELECT k AS instance_id, tp, fp, fn, tn, {RATES_SQL}, tp + fp + fn + tn AS n_judged, n_skipped, round(cost + 1e-9::DOUBLE, 6) AS cost_usd FROM conf")
def hybrid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.confusion(lines(spark, sf_dir), judgments(spark, sf_dir))


@query(f"""WITH {LINES}, j AS (SELECT instance_id, patch_id, 1 AS n, verdict FROM cand UNION ALL SELECT instance_id, patch_id, 2, CASE l_suppkey % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'uncertain' END FROM cand WHERE l_partkey % 2 = 0),
last AS (SELECT instance_id, patch_id, arg_max(verdict, n || verdict) AS verdict FROM j GROUP BY ALL), cells AS (SELECT instance_id, CASE WHEN c.verifier_pass IS NULL OR last.verdict = 'uncertain' THEN 'skipped' WHEN c.verifier_pass THEN CASE WHEN last.verdict IN ('correct', 'partial') THEN 'tp' ELSE 'fp' END WHEN last.verdict IN ('correct', 'partial') THEN 'fn' ELSE 'tn' END AS cell FROM cand c JOIN last USING (instance_id, patch_id))
SELECT instance_id, count(*) FILTER (cell = 'tp') AS tp, count(*) FILTER (cell = 'fp') AS fp, count(*) FILTER (cell = 'fn') AS fn, count(*) FILTER (cell = 'tn') AS tn, count(*) FILTER (cell = 'skipped') AS n_skipped FROM cells GROUP BY instance_id""")
def repeated_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of even parts are judged twice; the later judgment holds."""
    c = lines(spark, sf_dir)
    later = F.when(F.col("l_suppkey") % 3 == 0, "correct").when(F.col("l_suppkey") % 3 == 1, "incorrect").otherwise("uncertain")
    one = lambda n, v: F.struct(F.lit(n).alias("n"), v.alias("verdict"))
    j = c.select("instance_id", "patch_id", "l_partkey", F.explode(F.array(one(2, later), one(1, F.col("verdict")))).alias("j"), F.lit(0.0).alias("cost_usd")).where("j.n = 1 or l_partkey % 2 = 0")
    t = hybrid.confusion(c, j.select("instance_id", "patch_id", "j.n", "j.verdict", "cost_usd"), order=["n", "verdict"])
    return t.select("instance_id", "tp", "fp", "fn", "tn", "n_skipped")


@query(f"WITH {LINES}, {confusion_sql()}, g AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, count(*) FILTER (fp > 0) AS tasks_with_fp, count(*) FILTER (fn > 0) AS tasks_with_fn FROM conf) SELECT tp, fp, fn, tn, {RATES_SQL}, tasks_with_fp, tasks_with_fn FROM g")
def hybrid_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.overall(hybrid.confusion(lines(spark, sf_dir), judgments(spark, sf_dir)))


@query(f"""WITH {LINES}, u AS (SELECT source, true_quality AS before, CASE WHEN verdict = 'uncertain' THEN true_quality WHEN source = 'gold' THEN 3 WHEN source = 'trivial' THEN 0
  WHEN verdict = 'correct' THEN 3 WHEN verdict = 'partial' THEN 2 WHEN verifier_pass THEN 1 ELSE 0 END AS after FROM cand)
SELECT source, before, after, count(*) AS n FROM u GROUP BY ALL""")
def quality_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    after = hybrid.upgraded(F.col("source"), F.col("verifier_pass"), F.col("verdict"), F.col("true_quality"))
    return c.groupBy("source", F.col("true_quality").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES} SELECT instance_id, patch_id, CASE source WHEN 'gold' THEN 'correct' ELSE 'incorrect' END AS verdict, 1.0::DOUBLE AS confidence, 0.0::DOUBLE AS cost_usd FROM cand WHERE source IN ('gold', 'trivial')""")
def settled_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.settled(lines(spark, sf_dir))


@query("""WITH s AS (SELECT user_id, event_type AS verdict, ts, event_id, least(abs(value) / 100, 1) AS confidence, 0.001::DOUBLE AS cost_usd FROM events),
v AS (SELECT user_id, verdict, count(*) AS votes, max(confidence) AS best, min((ts, event_id)) AS seen FROM s GROUP BY ALL),
n AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) AS r FROM v)
SELECT user_id, verdict, round(votes / n::DOUBLE * best + 1e-9::DOUBLE, 4) AS confidence, n::BIGINT AS n_samples FROM n WHERE r = 1""")
def judge_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("verdict"), "ts", "event_id", F.least(F.abs("value") / 100, F.lit(1)).alias("confidence"), F.lit(0.001).alias("cost_usd"))
    return hybrid.voted(s, ["user_id"], ["ts", "event_id"]).select("user_id", "verdict", "confidence", "n_samples")


@query("""WITH s AS (SELECT user_id, event_id, event_type AS verdict, least(abs(value) / 100, 1) AS confidence, abs(value) AS latency FROM events),
v AS (SELECT user_id, verdict, count(*) AS votes, min(event_id) AS seen FROM s GROUP BY ALL),
w AS (SELECT user_id, verdict FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) = 1),
b AS (SELECT user_id, verdict, 'because of ' || event_id AS trace, 'so ' || event_id AS conclusion FROM s JOIN w USING (user_id, verdict) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, event_id) = 1)
SELECT user_id, verdict, trace, conclusion, latency_seconds FROM b JOIN (SELECT user_id, round(sum(latency) + 1e-9::DOUBLE, 3) AS latency_seconds FROM s GROUP BY ALL) USING (user_id)""")
def vote_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vote's reasons are those of the winner's most confident sample, its latency that of all samples."""
    e = table(spark, sf_dir, "events")
    s = e.select("user_id", "event_id", F.col("event_type").alias("verdict"), F.least(F.abs("value") / 100, F.lit(1)).alias("confidence"), F.lit(0.001).alias("cost_usd"), F.abs("value").alias("latency_seconds"), F.concat(F.lit("because of "), F.col("event_id").cast("string")).alias("trace"), F.concat(F.lit("so "), F.col("event_id").cast("string")).alias("conclusion"))
    return hybrid.voted(s, ["user_id"], ["event_id"]).select("user_id", "verdict", "trace", "conclusion", rounded("latency_seconds", 3).alias("latency_seconds"))


# Difficulty


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("submission"))
    return lines(spark, sf_dir).where("verifier_pass").join(s, "l_suppkey").select("submission", F.col("l_partkey").alias("instance_id"))


SOLVED = """solved AS (SELECT DISTINCT s_nationkey AS submission, l_partkey AS instance_id FROM cand JOIN supplier ON s_suppkey = l_suppkey WHERE verifier_pass),
total AS (SELECT count(DISTINCT submission) AS n FROM solved),
rate AS (SELECT p_partkey AS instance_id, count(submission) / greatest((SELECT n FROM total), 1)::DOUBLE AS solve_rate FROM part LEFT JOIN solved ON instance_id = p_partkey GROUP BY p_partkey)"""
TIER = "CASE WHEN least(greatest(solve_rate, 0), 1) < 0.05 THEN 'too_hard' WHEN solve_rate < 0.2 THEN 'hard' WHEN solve_rate < 0.8 THEN 'medium' WHEN solve_rate < 0.95 THEN 'easy' ELSE 'too_easy' END"


def part_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance_id"))
    return difficulty.solve_rates(resolved(spark, sf_dir), parts)


@query(f"WITH {LINES}, {SOLVED} SELECT instance_id, round(solve_rate + 1e-9::DOUBLE, 4) AS solve_rate FROM rate")
def solve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_rates(spark, sf_dir).withColumn("solve_rate", rounded("solve_rate"))


@query(f"WITH {LINES}, {SOLVED} SELECT instance_id, round(solve_rate + 1e-9::DOUBLE, 4) AS solve_rate, round(solve_rate * (1 - solve_rate) + 1e-9::DOUBLE, 4) AS gradient_signal, {TIER} AS difficulty_tier, {TIER} IN ('too_hard', 'too_easy') AS flagged FROM rate")
def difficulty_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difficulty.profiled(part_rates(spark, sf_dir))


SPREAD = "rate AS (SELECT l_partkey AS instance_id, avg((l_quantity > p_size)::INT) AS solve_rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey)"


def spread_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(p, "l_partkey").groupBy(F.col("l_partkey").alias("instance_id")).agg(F.avg((F.col("l_quantity") > F.col("p_size")).cast("int")).alias("solve_rate"))


@query(f"WITH {SPREAD} SELECT {TIER} AS difficulty_tier, count(*) AS n FROM rate GROUP BY ALL")
def difficulty_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difficulty.tier_counts(difficulty.profiled(spread_rates(spark, sf_dir)))


@query(f"""WITH {SPREAD}, b AS (SELECT CASE WHEN solve_rate = 0 THEN '0.0' WHEN solve_rate < 0.1 THEN '0.0-0.1' WHEN solve_rate < 0.3 THEN '0.1-0.3' WHEN solve_rate <= 0.7 THEN '0.3-0.7' WHEN solve_rate <= 0.9 THEN '0.7-0.9' WHEN solve_rate < 1 THEN '0.9-1.0' ELSE '1.0' END AS band FROM rate)
SELECT n.band, count(b.band) AS n, (SELECT round(avg(solve_rate) + 1e-9::DOUBLE, 4) FROM rate) AS mean FROM (VALUES ('0.0'), ('0.0-0.1'), ('0.1-0.3'), ('0.3-0.7'), ('0.7-0.9'), ('0.9-1.0'), ('1.0')) n(band) LEFT JOIN b USING (band) GROUP BY n.band""")
def pass_rate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difficulty.bands(spread_rates(spark, sf_dir).withColumnRenamed("solve_rate", "pass_rate"))


@query(f"WITH {SPREAD} SELECT p_partkey AS task_id, solve_rate IS NULL AS unprofiled FROM part LEFT JOIN rate ON instance_id = p_partkey WHERE solve_rate IS NULL OR solve_rate BETWEEN 0.3 AND 0.7")
def learnable_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"))
    profile = spread_rates(spark, sf_dir).select(F.col("instance_id").alias("task_id"), F.col("solve_rate").alias("pass_rate"))
    return dataset.learnable(parts, profile).select("task_id", F.col("pass_rate").isNull().alias("unprofiled"))


@query(f"WITH {LINES}, t AS (SELECT l_partkey AS task_id, count(*) AS n_rollouts, count(*) FILTER (verifier_pass) AS n_pass FROM cand GROUP BY ALL) SELECT *, round(n_pass / greatest(n_rollouts, 1)::DOUBLE + 1e-9::DOUBLE, 4) AS pass_rate FROM t")
def rollout_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.pass_rates(lines(spark, sf_dir).select(F.col("l_partkey").alias("task_id"), F.col("verifier_pass").alias("passed")))


# Composite scores


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources, each over all parts; which of them a part has is up to its order lines."""
    c = lines(spark, sf_dir).withColumn("instance_id", F.col("l_partkey"))
    v = verifier.verifier_scores(c).select("instance_id", F.col("composite").alias("v_score"), F.col("fpr").alias("v_fpr"), F.col("fnr").alias("v_fnr"))
    e = candidates.exploit_rates(c.where("source = 'exploit'").select("instance_id", F.col("verifier_pass").alias("passed")))
    h = hybrid.confusion(c, c.select("instance_id", "patch_id", "verdict", "cost_usd")).select("instance_id", F.col("f1").alias("h_f1"), F.col("fpr").alias("h_fpr"), F.col("fnr").alias("h_fnr"))
    d = difficulty.profiled(spread_rates(spark, sf_dir)).select("instance_id", "gradient_signal", "difficulty_tier")
    return composite.joined(v, e, h, d)


SOURCES = f"""{LINES}, {scores_sql('l_partkey')},
sv AS (SELECT k AS instance_id, round(composite + 1e-9::DOUBLE, 4) AS v_score, round(fpr + 1e-9::DOUBLE, 4) AS v_fpr, round(fnr + 1e-9::DOUBLE, 4) AS v_fnr FROM v),
se AS (SELECT l_partkey AS instance_id, avg(verifier_pass::INT) AS exploit_rate FROM cand WHERE source = 'exploit' AND verifier_pass IS NOT NULL GROUP BY ALL),
{confusion_sql('l_partkey')}, rates AS (SELECT k, {RATES_SQL} FROM conf), sh AS (SELECT k AS instance_id, f1 AS h_f1, fpr AS h_fpr, fnr AS h_fnr FROM rates),
{SPREAD}, sd AS (SELECT instance_id, round(solve_rate * (1 - solve_rate) + 1e-9::DOUBLE, 4) AS gradient_signal, {TIER} AS difficulty_tier FROM rate),
src AS (SELECT * FROM sv FULL JOIN se USING (instance_id) FULL JOIN sh USING (instance_id) FULL JOIN sd USING (instance_id)),
dims AS (SELECT *, v_score AS dv, 1 - exploit_rate AS de, h_f1 AS dh, CASE WHEN gradient_signal IS NOT NULL THEN least(gradient_signal / 0.25::DOUBLE, 1) END AS dd FROM src),
eq AS (SELECT *, round(coalesce((coalesce(dv * 0.35::DOUBLE, 0) + coalesce(de * 0.30::DOUBLE, 0) + coalesce(dh * 0.20::DOUBLE, 0) + coalesce(dd * 0.15::DOUBLE, 0))
  / nullif(CASE WHEN dv IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN de IS NULL THEN 0 ELSE 0.30::DOUBLE END + CASE WHEN dh IS NULL THEN 0 ELSE 0.20::DOUBLE END + CASE WHEN dd IS NULL THEN 0 ELSE 0.15::DOUBLE END, 0), 0) + 1e-9::DOUBLE, 4) AS eqs FROM dims),
weak AS (
  SELECT instance_id, 'verifier' AS dimension, CASE WHEN v_fpr > 0.5 THEN 'critical' ELSE 'high' END AS severity, true AS fixable FROM eq WHERE v_fpr > 0
  UNION ALL SELECT instance_id, 'verifier', 'high', true FROM eq WHERE v_fnr > 0.5
  UNION ALL SELECT instance_id, 'exploit', CASE WHEN exploit_rate > 0.5 THEN 'critical' ELSE 'high' END, true FROM eq WHERE exploit_rate > 0
  UNION ALL SELECT instance_id, 'hybrid', 'high', true FROM eq WHERE h_fpr > 0.3
  UNION ALL SELECT instance_id, 'hybrid', 'medium', true FROM eq WHERE h_fnr > 0.3
  UNION ALL SELECT instance_id, 'difficulty', 'high', false FROM eq WHERE difficulty_tier = 'too_hard'
  UNION ALL SELECT instance_id, 'difficulty', 'medium', false FROM eq WHERE difficulty_tier = 'too_easy'),
sc AS (SELECT eq.*, CASE WHEN bool_or(severity = 'critical' AND NOT fixable) THEN 'DROP' WHEN any_value(eqs) >= 0.70 THEN 'KEEP' WHEN any_value(eqs) >= 0.40 AND bool_or(fixable) THEN 'FIX' ELSE 'DROP' END AS verdict
  FROM eq LEFT JOIN weak USING (instance_id) GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.scored(sources(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT instance_id, eqs, verdict, round(dv + 1e-9::DOUBLE, 4) AS verifier, round(de + 1e-9::DOUBLE, 4) AS exploit, round(dh + 1e-9::DOUBLE, 4) AS hybrid, round(dd + 1e-9::DOUBLE, 4) AS difficulty FROM sc")
def eqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("instance_id", "eqs", "verdict", "verifier", "exploit", "hybrid", "difficulty")


@query(f"WITH {SOURCES} SELECT verdict, count(*) AS n, round(avg(eqs) + 1e-9::DOUBLE, 4) AS mean_eqs FROM sc GROUP BY verdict")
def eqs_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.verdict_counts(scored(spark, sf_dir))


@query(f"""WITH {SOURCES}, u AS (SELECT 'verifier' AS dimension, round(dv + 1e-9::DOUBLE, 4) AS x FROM sc UNION ALL SELECT 'exploit', round(de + 1e-9::DOUBLE, 4) FROM sc UNION ALL SELECT 'hybrid', round(dh + 1e-9::DOUBLE, 4) FROM sc UNION ALL SELECT 'difficulty', round(dd + 1e-9::DOUBLE, 4) FROM sc)
SELECT dimension, count(x) AS n, round(coalesce(avg(x), 0) + 1e-9::DOUBLE, 4) AS mean FROM u GROUP BY dimension""")
def dimension_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.dimension_means(scored(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT instance_id, dimension, severity, fixable FROM weak")
def weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.weakness_rows(scored(spark, sf_dir)).select("instance_id", "dimension", "severity", "fixable")


@query(f"""WITH {SOURCES} SELECT 'dimension' AS kind, dimension AS value, count(*) AS n FROM weak GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM weak GROUP BY ALL
UNION ALL SELECT 'fixable', CASE WHEN fixable THEN 'yes' ELSE 'no' END, count(*) FROM weak GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM weak""")
def weakness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.weakness_counts(scored(spark, sf_dir))


@query(f"""WITH {SOURCES}, r AS (SELECT instance_id, eqs, row_number() OVER (ORDER BY eqs, instance_id) AS lo, row_number() OVER (ORDER BY eqs DESC, instance_id) AS hi FROM sc)
SELECT 'lowest' AS side, lo::INT AS place, instance_id, eqs FROM r WHERE lo <= 5 UNION ALL SELECT 'highest', hi::INT, instance_id, eqs FROM r WHERE hi <= 5""")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.extremes(scored(spark, sf_dir))


# Categories


@query(f"""WITH {LINES}, c AS (SELECT p_type AS category, l_partkey AS instance_id, verifier_pass FROM cand JOIN part ON p_partkey = l_partkey WHERE source = 'exploit'),
t AS (SELECT category, count(verifier_pass) AS attempts, count(*) FILTER (verifier_pass) AS verified FROM c GROUP BY ALL),
x AS (SELECT category, instance_id, row_number() OVER (PARTITION BY category ORDER BY instance_id) AS r FROM (SELECT DISTINCT category, instance_id FROM c WHERE verifier_pass))
SELECT category, attempts, verified, round(verified / greatest(attempts, 1)::DOUBLE + 1e-9::DOUBLE, 4) AS rate, coalesce((SELECT string_agg(instance_id::VARCHAR, ',' ORDER BY r) FROM x WHERE x.category = t.category AND r <= 3), '') AS examples FROM t""")
def exploit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).where("source = 'exploit'").withColumn("instance_id", F.col("l_partkey"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    return candidates.category_success(c.join(p, "l_partkey").select("instance_id", "patch_id", "category"), c)


# Statistics

CDF = """(CASE WHEN -abs(z) < -8 THEN 0::DOUBLE ELSE 0.5::DOUBLE * (1 - (CASE WHEN z = 0 THEN 0 ELSE 1 END) * (1 - ((((1.061405429::DOUBLE * t5 - 1.453152027::DOUBLE) * t5 + 1.421413741::DOUBLE) * t5 - 0.284496736::DOUBLE) * t5 + 0.254829592::DOUBLE) * t5 * exp(-z * z / 2))) END)"""


def mwu_sql(source: str, by: str = "1") -> str:
    """From (g, x, v): group, whether the row is of x, value."""
    return f"""rk AS (SELECT {by} AS g, x, v, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0::DOUBLE AS r FROM {source}),
ties AS (SELECT g, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT {by} AS g, v, count(*)::DOUBLE AS c FROM {source} GROUP BY ALL) GROUP BY g),
us AS (SELECT g, count(*) FILTER (x) AS n_x, count(*) FILTER (NOT x) AS n_y, sum(CASE WHEN NOT x THEN r ELSE 0 END) AS rs FROM rk GROUP BY g),
uu AS (SELECT g, n_x, n_y, rs - n_y::DOUBLE * (n_y + 1) / 2 AS u, n_x::DOUBLE * n_y AS m, (n_x + n_y)::DOUBLE AS n, ties FROM us JOIN ties USING (g)),
zz AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE (u - m / 2) / sqrt(greatest(m / 12 * (n + 1 - ties / greatest(n * (n - 1), 1)), 1e-10::DOUBLE)) END AS z FROM uu),
mw AS (SELECT g, n_x, n_y, CASE WHEN m = 0 THEN 0 ELSE u END AS u, z, CASE WHEN m = 0 THEN 1 ELSE 2 * {CDF} END AS p, CASE WHEN m = 0 THEN 0 ELSE 1 - 2 * u / m END AS effect FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z)) AS t5 FROM zz))"""


@query(f"WITH s AS (SELECT o_orderstatus = 'F' AS x, o_totalprice AS v FROM orders), {mwu_sql('s')} SELECT n_x, n_y, u, round(z + 1e-9::DOUBLE, 6) AS z, round(p + 1e-9::DOUBLE, 6) AS p, round(effect + 1e-9::DOUBLE, 6) AS effect FROM mw")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = stats.rank_sum(stats.histogram(o, "o_totalprice", F.col("o_orderstatus") == "F"))
    return t.select("n_x", "n_y", "u", *(rounded(c, 6).alias(c) for c in ("z", "p", "effect")))


YOUDEN = """yt AS (SELECT count(*) FILTER (x) AS px, count(*) FILTER (NOT x) AS py FROM s),
yh AS (SELECT v, sum(count(*) FILTER (x)) OVER (ORDER BY v) AS cx, sum(count(*) FILTER (NOT x)) OVER (ORDER BY v) AS cy FROM s GROUP BY v),
yj AS (SELECT v AS threshold, cx / greatest(px, 1)::DOUBLE AS sensitivity, 1 - cy / greatest(py, 1)::DOUBLE AS specificity, cx / greatest(px, 1)::DOUBLE + (1 - cy / greatest(py, 1)::DOUBLE) - 1 AS youden FROM yh, yt ORDER BY youden DESC, threshold LIMIT 1)"""
SCORED = f"{LINES}, {scores_sql('instance_id')}, sep AS (SELECT k, n_false_positives > 0 AS x, round(composite + 1e-9::DOUBLE, 4) AS v FROM v), s AS (SELECT * FROM sep)"


def hackable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifier.separated(verifier.verifier_scores(lines(spark, sf_dir)))


@query(f"WITH {SCORED}, {YOUDEN} SELECT {r4('threshold', 'youden', 'sensitivity', 'specificity')} FROM yj")
def youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.best_threshold(stats.histogram(hackable(spark, sf_dir), "composite", F.col("hackable")))
    return t.select(*(rounded(c).alias(c) for c in ("threshold", "youden", "sensitivity", "specificity")))


@query(f"WITH {LINES}, {scores_sql('instance_id')}, s AS (SELECT k, n_false_positives > 0 AS x, round(composite + 1e-9::DOUBLE, 4) AS v FROM v), {mwu_sql('s')}, {YOUDEN}, mm AS (SELECT avg(v) FILTER (x) AS mean_x, avg(v) FILTER (NOT x) AS mean_y FROM s) SELECT n_x, n_y, {r4('mean_x', 'mean_y')}, round(mean_y - mean_x + 1e-9::DOUBLE, 4) AS delta, u, round(p + 1e-9::DOUBLE, 6) AS p, {r4('effect')}, p < 0.05 AS significant, {r4('threshold', 'youden', 'sensitivity', 'specificity')} FROM mw, yj, mm")
def separation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of separation has no draws."""
    return stats.separation(hackable(spark, sf_dir), replicates=None)


@query()
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With intervals of 10,000 multinomial draws, which SQL has none of; tests hold them against draws of rows."""
    return stats.separation(hackable(spark, sf_dir))


#: The weights of each configuration in SQL: discrimination, spearman, mae, completeness.
WEIGHTED = (("default", (0.40, 0.20, 0.15, 0.25)), ("discrimination_heavy", (0.70, 0.10, 0.10, 0.10)), ("balanced", (0.25, 0.25, 0.25, 0.25)), ("completeness_heavy", (0.20, 0.15, 0.15, 0.50)), ("spearman_heavy", (0.20, 0.50, 0.15, 0.15)))


@query(f"WITH {LINES}, " + ", ".join(scores_sql("instance_id", name=f"c{i}", weights=w) for i, (_, w) in enumerate(WEIGHTED)) + ", s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS configuration, n_false_positives > 0 AS x, round(composite + 1e-9::DOUBLE, 4) AS v FROM c{i}" for i, (n, _) in enumerate(WEIGHTED)) + f"), {mwu_sql('s', 'configuration')}, mm AS (SELECT configuration, round(avg(v) FILTER (x) + 1e-9::DOUBLE, 4) AS mean_x, round(avg(v) FILTER (NOT x) + 1e-9::DOUBLE, 4) AS mean_y FROM s GROUP BY ALL) SELECT configuration, n_x, n_y, mean_x, mean_y, round(mean_y - mean_x + 1e-9::DOUBLE, 4) AS delta, round(p + 1e-9::DOUBLE, 6) AS p, p < 0.05 AS significant FROM mw JOIN mm ON g = configuration")
def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weight_sensitivity(lines(spark, sf_dir))


# Comparison of runs


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("passed")), lab.select(F.col("doc_id").alias("task_id"), (F.col("toxic") == 0).alias("passed"))


PAIRS = "pairs AS (SELECT doc_id AS task_id, quality AS a, (toxic = 0)::INT AS b FROM labels)"
MCNEMAR = """mc AS (SELECT count(*) FILTER (a = 0 AND b = 1) AS b, count(*) FILTER (a = 1 AND b = 0) AS c FROM pairs),
mp AS (SELECT b, c, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c)::BIGINT + 1) r(i))) END AS p FROM mc)"""


@query(f"WITH {PAIRS}, {MCNEMAR} SELECT b, c, round(p + 1e-9::DOUBLE, 6) AS p FROM mp")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abtest.mcnemar(abtest.aligned(*runs(spark, sf_dir))).withColumn("p", rounded("p", 6))


@query("""WITH g AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY ALL)
SELECT l_suppkey, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c)::BIGINT + 1) r(i))) END + 1e-9::DOUBLE, 6) AS p FROM g""")
def exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact test for each supplier."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("b"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return g.withColumn("p", rounded(abtest.binomial_p(F.least("b", "c"), F.col("b") + F.col("c")), 6))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abtest.paired_interval(abtest.aligned(*runs(spark, sf_dir))).select(*(rounded(c).alias(c) for c in ("delta", "lo", "hi")))


@query()
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abtest.compared(*runs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT task_id, CASE WHEN b = 1 THEN 'fixed' ELSE 'regressed' END AS change FROM pairs WHERE a <> b")
def ab_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abtest.changes(abtest.aligned(*runs(spark, sf_dir)))


@query("SELECT count(*) AS total_tasks, sum(quality)::BIGINT AS total_passed, round(avg(quality) + 1e-9::DOUBLE, 4) AS pass_at_1 FROM labels")
def pass_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abtest.pass_at_1(runs(spark, sf_dir)[0]).select("total_tasks", F.col("total_passed").cast("long").alias("total_passed"), "pass_at_1")


# Texts


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\bthe\b'))::INT AS n_the, len(regexp_extract_all(text, '\d+'))::INT AS n_numbers, regexp_matches(lower(text), 'license|token|error') AS has_edge, len(string_split(text, chr(10)))::INT AS n_lines FROM documents""")
def pattern_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    low = F.lower("text")
    return d.select("doc_id", T.count_of("text", r"\bthe\b").alias("n_the"), T.count_of("text", r"\d+").alias("n_numbers"), (low.contains("license") | low.contains("token") | low.contains("error")).alias("has_edge"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) SELECT doc_id, CASE WHEN len(a) > 2 THEN array_to_string(a[1:2], chr(10)) || chr(10) || '... (' || (len(a) - 2) || ' more lines)' ELSE array_to_string(a, chr(10)) END AS head FROM l""")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.head_lines("text", 2).alias("head"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), w AS (SELECT *, len(a) >= 2 AND ('0x' || substr(md5(doc_id::VARCHAR || '-42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS is_weak FROM l)
SELECT doc_id AS task_id, is_weak, CASE WHEN is_weak THEN 1 ELSE len(a) END::INT AS n_tests FROM w""")
def weaken_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.lit("").alias("gold_code"), F.split("text", "\n", -1).alias("test_list"))
    return dataset.weak_split(d).select("task_id", "is_weak", F.size("test_list").alias("n_tests"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.json_in("props"), "$.k", "bigint").alias("k"))


@query("SELECT page_id, replace(url, '/', '__') AS file_key FROM pages")
def key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_key("url").alias("file_key"))


# Improvement, summaries, costs

AUGMENT = """aug AS (SELECT instance_id, (i % 3 + 1)::INT AS iteration, t, least(c, 1) AS confidence, q FROM (SELECT l_partkey AS instance_id, l_linenumber AS i, l_suppkey % 4 AS t, l_quantity / 50 AS c, l_quantity * 0.01::DOUBLE AS q FROM lineitem)),
bo AS (SELECT instance_id, iteration, 0.15::DOUBLE * least(count(DISTINCT t) / 4.0::DOUBLE, 1) * avg(confidence) AS boost, count(*) AS n, sum(q) AS cost FROM aug GROUP BY ALL)"""


def fix_tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks to fix, written once as both the loop and the boosts read them, and the boosts."""
    s = materialized(scored(spark, sf_dir).where("verdict = 'FIX'").select("instance_id", "eqs"), "scores")
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_partkey").alias("instance_id"), (F.col("l_linenumber") % 3 + 1).alias("iteration"), F.array((F.col("l_suppkey") % 4).cast("string")).alias("targets"), F.least(F.col("l_quantity") / 50, F.lit(1)).alias("confidence"), (F.col("l_quantity") * 0.01).alias("cost_usd"))
    return s, optimize.boosts(a, s.select("instance_id", F.lit(4).alias("n_exploits")))


def _step(i: int) -> str:
    return f"""s{i} AS (SELECT instance_id, eqs AS before, least(eqs + coalesce(boost, 0), 1) AS raw, round(least(eqs + coalesce(boost, 0), 1) + 1e-9::DOUBLE, 4) AS after, coalesce(n, 0) AS n, coalesce(cost, 0) AS cost FROM t{i - 1} LEFT JOIN (SELECT * FROM bo WHERE iteration = {i}) USING (instance_id) WHERE still),
t{i} AS (SELECT t.instance_id, coalesce(s.after, t.eqs) AS eqs, s.instance_id IS NOT NULL AND NOT (s.raw >= 0.70 AND s.before < 0.70) AS still FROM t{i - 1} t LEFT JOIN s{i} s USING (instance_id)),
g{i} AS (SELECT {i} AS iteration, count(*) AS n_tasks, avg(before) AS mb, avg(after) AS ma, count(*) FILTER (raw > before) AS n_improved, count(*) FILTER (raw >= 0.70 AND before < 0.70) AS n_upgraded, sum(n)::BIGINT AS n_augmentations, sum(cost) AS cost, (SELECT avg(eqs) FROM t{i}) AS mean FROM s{i})"""


LOOP = f"""{{sources}}, {AUGMENT}, t0 AS (SELECT instance_id, eqs, true AS still FROM sc WHERE verdict = 'FIX'), {_step(1)}, {_step(2)}, {_step(3)}, g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3),
r AS (SELECT *, round(ma - mb + 1e-9::DOUBLE, 4) AS improvement FROM g WHERE n_tasks > 0), it AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r p WHERE p.iteration < r.iteration AND p.improvement < 0.01))"""


@query(f"WITH {LOOP.format(sources=SOURCES)} SELECT iteration, n_tasks, round(mb + 1e-9::DOUBLE, 4) AS mean_before, round(ma + 1e-9::DOUBLE, 4) AS mean_after, improvement, n_improved, n_upgraded, n_augmentations, round(cost + 1e-9::DOUBLE, 4) AS cost_usd FROM it")
def optimization_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimize.optimized(*fix_tasks(spark, sf_dir)).iterations


@query(f"""WITH {LOOP.format(sources=SOURCES)}, z AS (SELECT avg(eqs) AS first FROM t0), e AS (SELECT count(*) AS k, max_by(mean, iteration) AS last, sum(round(cost + 1e-9::DOUBLE, 4)) AS cost, sum(n_upgraded)::BIGINT AS up, max_by(n_tasks - n_upgraded, iteration) AS remain, string_agg(format('{{:.3f}}', mean), ',' ORDER BY iteration) AS c FROM it)
SELECT k::INT AS total_iterations, k < 3 OR remain = 0 AS converged, round(first + 1e-9::DOUBLE, 4) AS initial_mean, round(last + 1e-9::DOUBLE, 4) AS final_mean, round(last - first + 1e-9::DOUBLE, 4) AS total_improvement, round(cost, 3) AS total_cost_usd, up AS n_upgraded, format('{{:.3f}}', first) || ',' || c AS curve FROM z, e""")
def optimization_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = optimize.optimized(*fix_tasks(spark, sf_dir)).totals
    curve = F.array_join(F.transform("convergence_curve", lambda x: F.format_string("%.3f", x)), ",")
    return t.select("total_iterations", "converged", "initial_mean", "final_mean", "total_improvement", F.round("total_cost_usd", 3).alias("total_cost_usd"), "n_upgraded", curve.alias("curve"))


@query("""SELECT p_brand AS model, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS input_tokens, round(sum((CAST(l_quantity AS BIGINT) * CASE WHEN p_brand = 'Brand#12' THEN 0.8::DOUBLE ELSE 3.0::DOUBLE END + CAST(floor(l_extendedprice) AS BIGINT) * CASE WHEN p_brand = 'Brand#12' THEN 4.0::DOUBLE ELSE 15.0::DOUBLE END) / 1e6::DOUBLE) + 1e-9::DOUBLE, 4) AS cost_usd FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"))
    r = table(spark, sf_dir, "lineitem").join(p, "l_partkey").select("model", F.round("l_quantity").cast("long").alias("input_tokens"), F.floor("l_extendedprice").alias("output_tokens"))
    prices = spark.createDataFrame([("Brand#12", 0.8, 4.0)], "model string, price_in double, price_out double")
    t = costs.priced(r, prices).groupBy("model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_usd").alias("c"))
    return t.select("model", "n", "input_tokens", rounded("c").alias("cost_usd"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (round(l_quantity) * 3.0::DOUBLE + floor(l_extendedprice) * 15.0::DOUBLE) / 1e6::DOUBLE AS cost FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) OVER w AS calls_so_far, round(sum(cost) OVER w + 1e-9::DOUBLE, 4) AS cost_so_far FROM c WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def running_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and cost up to each order line, over all lines."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    r = table(spark, sf_dir, "lineitem").select(*keys, F.lit("x").alias("model"), F.round("l_quantity").cast("long").alias("input_tokens"), F.floor("l_extendedprice").alias("output_tokens"))
    prices = spark.createDataFrame([], "model string, price_in double, price_out double")
    t = costs.running_totals(costs.priced(r, prices), keys)
    return t.select("l_orderkey", "l_linenumber", "calls_so_far", rounded("cost_so_far").alias("cost_so_far"))


@query(f"""WITH {LINES}, t AS (SELECT instance_id, count(*) AS n, count(*) FILTER (verifier_pass) AS v, count(*) FILTER (verdict = 'uncertain') AS e FROM cand GROUP BY ALL),
s AS (SELECT count(*) AS total_tasks, count(*) FILTER (v > 0) AS tasks_hackable, sum(n)::BIGINT AS total_exploits, sum(v)::BIGINT AS exploits_verified, sum(e)::BIGINT AS errors FROM t)
SELECT *, round(tasks_hackable / greatest(total_tasks, 1)::DOUBLE + 1e-9::DOUBLE, 3) AS hackability_rate, round(exploits_verified / greatest(total_exploits, 1)::DOUBLE + 1e-9::DOUBLE, 3) AS exploit_success_rate,
  CASE WHEN total_tasks = 0 THEN 'NO_DATA' WHEN tasks_hackable / greatest(total_tasks, 1)::DOUBLE >= 0.3 THEN 'BANGER' WHEN tasks_hackable / greatest(total_tasks, 1)::DOUBLE >= 0.1 THEN 'STRONG' WHEN tasks_hackable >= 1 THEN 'MODERATE' ELSE 'CHECK' END AS outcome FROM s""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines(spark, sf_dir).select("instance_id", F.coalesce("verifier_pass", F.lit(False)).alias("verified"), (F.col("verdict") == "uncertain").alias("has_error"))
    return attack.verification_summary(r)


@query(f"""WITH {LINES}, t AS (SELECT instance_id, max((l_quantity % 11)::INT) AS top, sum(cost_usd) AS cost, count(*) AS n, count(*) FILTER (l_suppkey % 3 = 1) AS r2, count(*) FILTER (l_suppkey % 3 = 2) AS r3 FROM cand GROUP BY ALL)
SELECT count(*) AS n_tasks, sum(n)::BIGINT AS n_strategies, sum(r2)::BIGINT AS round2, sum(r3)::BIGINT AS round3, count(*) FILTER (top >= 7) AS high_confidence, round(coalesce(avg(top) FILTER (top > 0), 0) + 1e-9::DOUBLE, 4) AS mean_top, round(sum(cost) + 1e-9::DOUBLE, 4) AS cost_usd FROM t""")
def attack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines(spark, sf_dir).select("instance_id", (F.col("l_suppkey") % 3 + 1).alias("round"), (F.round("l_quantity").cast("int") % 11).alias("confidence"), "cost_usd")
    return attack.attack_summary(r)


@query(f"WITH {LINES} SELECT instance_id, NOT bool_and(coalesce(verifier_pass, false)) AS run_round2 FROM cand GROUP BY instance_id")
def second_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.second_round(lines(spark, sf_dir).select("instance_id", F.col("verifier_pass").alias("passed")))


@query(f"WITH {LINES} SELECT DISTINCT instance_id FROM cand WHERE instance_id NOT IN (SELECT instance_id FROM cand WHERE verifier_pass)")
def still_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir)
    return candidates.still_failing(c.select("instance_id").distinct(), c.select("instance_id", F.col("verifier_pass").alias("passed")))


@query(f"WITH {LINES} SELECT instance_id, count(*) AS n FROM cand WHERE instance_id IN (SELECT instance_id FROM cand WHERE verifier_pass IS NOT NULL AND source = 'exploit') GROUP BY instance_id")
def tasks_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.with_results(lines(spark, sf_dir), "exploit").groupBy("instance_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT l_partkey AS instance_id, round(avg(verifier_pass::INT) + 1e-9::DOUBLE, 4) AS exploit_rate FROM cand WHERE verifier_pass IS NOT NULL AND source = 'exploit' GROUP BY l_partkey")
def exploit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).where("source = 'exploit'")
    return candidates.exploit_rates(c.select(F.col("l_partkey").alias("instance_id"), F.col("verifier_pass").alias("passed"))).withColumn("exploit_rate", rounded("exploit_rate"))
