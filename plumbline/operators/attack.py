"""Rule flags, issues and verdicts of attacked tasks, and summaries of attacks and verifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent, ratio, rounded


def flags(m: Column) -> Column:
    """Array of (id, severity, message) that a struct of pattern metrics raises."""

    def flag(when: Column, name: str, severity: str, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"), text.alias("message")))

    n = m["n_permissive"] + m["n_strict"]
    lines = m["test_lines"].cast("double") / F.greatest(m["patch_lines"], F.lit(1)).cast("double")
    share = m["n_permissive"].cast("double") / F.greatest(n, F.lit(1)).cast("double")
    made = F.array(
        flag(m["n_assertions"] <= 2, "few_assertions", "HIGH", F.format_string("%d assertions in all", m["n_assertions"])),
        flag((share > 0.6) & (n > 0), "permissive_assertions", "MEDIUM", F.concat(percent(share), F.lit(" of assertions are permissive"))),
        flag(~m["has_edge"], "no_edge_cases", "MEDIUM", F.lit("no edge cases in sight")),
        flag(m["n_functions"] <= 1, "single_test_function", "HIGH", F.format_string("%d test functions", m["n_functions"])),
        flag(m["n_literals"] >= 3, "extractable_literals", "MEDIUM", F.format_string("%d literals could be hard-coded", m["n_literals"])),
        flag(m["n_fail_to_pass"] <= 1, "single_fail_to_pass", "HIGH", F.format_string("%d tests must turn to passing", m["n_fail_to_pass"])),
        flag(lines < 0.5, "low_test_coverage_ratio", "MEDIUM", F.format_string("%.1f test lines for each line of the patch", F.bround(lines, 1))),
    )
    return F.filter(made, lambda x: x.isNotNull())


def issues(flagged: Column, strategies: Column, agent: str = "attacker") -> Column:
    """Array of (type, severity, message, confidence, agent_source, exploit_patch) of flags and strategies."""
    patch = F.lit(None).cast("string")
    of_flags = F.transform(flagged, lambda f: F.struct(f["id"].alias("type"), F.lower(f["severity"]).alias("severity"), f["message"].alias("message"), F.lit(0.95).alias("confidence"), F.lit(agent).alias("agent_source"), patch.alias("exploit_patch")))

    def one(s: Column) -> Column:
        level = F.when(s["confidence"] >= 8, "critical").when(s["confidence"] >= 6, "high").otherwise("medium")
        message = F.concat(F.lit("["), s["name"], F.lit("] "), s["description"])
        return F.struct(F.concat(F.lit("exploit_"), s["category"]).alias("type"), level.alias("severity"), message.alias("message"), (s["confidence"] / F.lit(10.0)).alias("confidence"), F.lit(agent).alias("agent_source"), s["exploit_patch"].alias("exploit_patch"))

    return F.concat(of_flags, F.transform(strategies, one))


def judged(flagged: Column, confidences: Column) -> Column:
    """Struct (verdict, score, confidence) of a task's flags and its strategies' confidences (array of int).

    The confidence hangs on the strategies alone: 0.9 if one reaches 8, 0.7 if there are any, else 0.5."""
    confidences = F.coalesce(confidences, F.array().cast("array<int>"))
    top = F.coalesce(F.array_max(confidences), F.lit(0)).cast("double")
    sevens = F.size(F.filter(confidences, lambda c: c >= 7))
    n, high = F.size(flagged), F.size(F.filter(flagged, lambda f: f["severity"].isin("HIGH", "CRITICAL")))
    sure = F.when(top >= 8, 0.9).when(F.size(confidences) > 0, 0.7).otherwise(0.5)
    made = lambda v, s: F.struct(F.lit(v).alias("verdict"), rounded(s, 3).alias("score"), sure.alias("confidence"))
    rest = F.lit(0.1) * (10 - top) / 10
    return (
        F.when((top >= 8) | (sevens >= 2), made("FAIL", F.lit(0.1) + rest))
        .when((top >= 6) | (high >= 2), made("WARNING", F.lit(0.4) + rest))
        .when((n >= 3) | (top >= 4), made("WARNING", F.lit(0.6)))
        .otherwise(made("PASS", F.lit(0.8) + F.lit(0.2) * (1 - n / F.greatest(n + 3, F.lit(1)).cast("double"))))
    )


def second_round(results: DataFrame) -> DataFrame:
    """(instance_id, run_round2): round two is left out where there are results and all passed."""
    return results.groupBy("instance_id").agg((~F.bool_and(F.coalesce("passed", F.lit(False)))).alias("run_round2"))


def attack_summary(rounds: DataFrame) -> DataFrame:
    """One row of rounds (instance_id, round, confidence, cost_usd), a row a strategy."""
    t = rounds.groupBy("instance_id").agg(F.max("confidence").alias("top"), F.sum("cost_usd").alias("cost"), F.count("*").alias("n"), F.count_if(F.col("round") == 2).alias("r2"), F.count_if(F.col("round") == 3).alias("r3"))
    return t.agg(F.count("*").alias("n_tasks"), F.sum("n").alias("n_strategies"), F.sum("r2").alias("round2"), F.sum("r3").alias("round3"), F.count_if(F.col("top") >= 7).alias("high_confidence"), rounded(F.coalesce(F.avg(F.when(F.col("top") > 0, F.col("top"))), F.lit(0.0))).alias("mean_top"), rounded(F.sum("cost"), 4).alias("cost_usd"))


def verification_summary(results: DataFrame) -> DataFrame:
    """One row of results (instance_id, verified, has_error), a row an attempted exploit."""
    t = results.groupBy("instance_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"), F.count_if("has_error").alias("e"))
    s = t.agg(F.count("*").alias("total_tasks"), F.count_if(F.col("v") > 0).alias("tasks_hackable"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_exploits"), F.coalesce(F.sum("v"), F.lit(0)).alias("exploits_verified"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))
    hack, success = ratio("tasks_hackable", "total_tasks"), ratio("exploits_verified", "total_exploits")
    word = F.when(F.col("total_tasks") == 0, "NO_DATA").when(hack >= 0.30, "BANGER").when(hack >= 0.10, "STRONG").when(F.col("tasks_hackable") >= 1, "MODERATE").otherwise("CHECK")
    return s.select("*", rounded(hack, 3).alias("hackability_rate"), rounded(success, 3).alias("exploit_success_rate"), word.alias("outcome"))


def phase1_summary(phase1: DataFrame, least: int = 7) -> DataFrame:
    """One row: verdict counts, tasks with a strategy of that confidence, outcome."""
    s = phase1.agg(F.count("*").alias("n_tasks"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("FAIL", "WARNING", "PASS", "ERROR")), F.count_if(F.col("max_exploit_confidence") >= least).alias("high_confidence"))
    return s.withColumn("outcome", F.when(F.col("high_confidence") >= 3, "STRONG").when(F.col("high_confidence") >= 1, "MODERATE").otherwise("WEAK"))
