"""Candidates of each task, from attack results, verification logs and gold patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded
from plumbline.functions.text import file_key


def strategy_rows(phase1: DataFrame) -> DataFrame:
    """One row a patch of an attack result: its index, patch, and the strategy at the same place (defaults where there is none)."""
    p = phase1.select("instance_id", "strategies", F.posexplode("exploit_patches").alias("strategy_idx", "patch_text"))
    s = F.get("strategies", F.col("strategy_idx"))
    return p.select("instance_id", "strategy_idx", "patch_text", F.coalesce(s["name"], F.lit("unknown")).alias("strategy"), F.coalesce(s["category"], F.lit("unknown")).alias("category"), F.coalesce(s["confidence"], F.lit(5)).alias("confidence"))


def exploit_quality(passed: Column, confidence: Column) -> Column:
    """What passed is an exploit (1), what failed trivial (0); without a log, confidence from 8 on counts as an exploit."""
    return F.when(passed.isNotNull(), passed.cast("int")).otherwise((confidence >= 8).cast("int"))


def assembled(phase1: DataFrame, logs: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold, exploit and trivial candidates of every task of phase1.

    logs (key, resolved) by file key and index; gold (instance_id, patch). A trivial candidate that fails is always
    there; a gold one that passes where its patch is known.
    """
    s = strategy_rows(phase1)
    keyed = s.withColumn("key", F.concat(file_key("instance_id"), F.lit("_exploit_"), F.col("strategy_idx").cast("string")))
    e = keyed.join(logs.select("key", "resolved"), "key", "left").select("instance_id", F.concat("instance_id", F.lit("_exploit_"), F.col("strategy_idx").cast("string")).alias("patch_id"), "patch_text", F.lit("exploit").alias("source"), F.col("resolved").alias("verifier_pass"), exploit_quality(F.col("resolved"), F.col("confidence")).alias("true_quality"), "confidence", "strategy")
    tasks = phase1.select("instance_id").distinct()
    none = F.lit(None)
    g = tasks.join(gold.select("instance_id", "patch"), "instance_id").select("instance_id", F.concat("instance_id", F.lit("_gold")).alias("patch_id"), F.col("patch").alias("patch_text"), F.lit("gold").alias("source"), F.lit(True).alias("verifier_pass"), F.lit(3).alias("true_quality"), none.cast("int").alias("confidence"), none.cast("string").alias("strategy"))
    t = tasks.select("instance_id", F.concat("instance_id", F.lit("_trivial")).alias("patch_id"), F.lit("").alias("patch_text"), F.lit("trivial").alias("source"), F.lit(False).alias("verifier_pass"), F.lit(0).alias("true_quality"), none.cast("int").alias("confidence"), none.cast("string").alias("strategy"))
    return g.unionByName(e).unionByName(t)


def with_results(candidates: DataFrame, source: str | None = None) -> DataFrame:
    """Candidates of tasks that have a verifier result (on a candidate of that source, if one is named)."""
    seen = F.col("verifier_pass").isNotNull() & (F.lit(True) if source is None else F.col("source") == source)
    return candidates.join(candidates.where(seen).select("instance_id").distinct(), "instance_id", "left_semi")


def scorable(candidates: DataFrame) -> DataFrame:
    """Candidates of tasks with a verifier result on any candidate, or with a gold one."""
    seen = candidates.where(F.col("verifier_pass").isNotNull() | (F.col("source") == "gold")).select("instance_id").distinct()
    return candidates.join(seen, "instance_id", "left_semi")


def confident(phase1: DataFrame, least: int = 7, most: int = 3) -> DataFrame:
    """The first strategies of each task with that confidence, in their order, with their index."""
    s = strategy_rows(phase1).where(F.col("confidence") >= least)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("instance_id").orderBy("strategy_idx"))).where(F.col("place") <= most)


def still_failing(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks none of whose results passed."""
    return tasks.join(results.where("passed").select("instance_id").distinct(), "instance_id", "left_anti")


def exploit_rates(results: DataFrame) -> DataFrame:
    """(instance_id, exploit_rate): passed over attempted; results (instance_id, passed), null is no attempt; no row without attempts."""
    return results.where("passed is not null").groupBy("instance_id").agg(F.avg(F.col("passed").cast("double")).alias("exploit_rate"))


def category_success(strategies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(category, attempts, verified, rate, examples): strategies (instance_id, patch_id, category) with candidates' results;
    examples are the first three tasks that an exploit of the category passed, comma-joined. Most verified first."""
    both = strategies.select("instance_id", "patch_id", "category").join(candidates.select("instance_id", "patch_id", "verifier_pass"), ["instance_id", "patch_id"], "left")
    passed = F.coalesce(F.col("verifier_pass"), F.lit(False))
    # one row a task and category first, so that no set holds more than the tasks that passed
    per_task = both.groupBy("category", "instance_id").agg(F.count("verifier_pass").alias("attempts"), F.count_if(passed).alias("verified"))
    # the three least tasks by ranks within pieces of a category, then of the pieces' few: no category lies in one task
    least = None
    for by in ("piece", None):
        w = Window.partitionBy("category", *([by] if by else [])).orderBy("instance_id")
        least = (per_task.where("verified > 0").select("category", "instance_id", (F.pmod(F.xxhash64("instance_id"), F.lit(64))).alias("piece")) if least is None else least).withColumn("place", F.row_number().over(w)).where("place <= 3")
    examples = least.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("instance_id").cast("string").alias("i")))), lambda s: s["i"]), ",").alias("examples"))
    t = per_task.groupBy("category").agg(F.sum("attempts").alias("attempts"), F.sum("verified").alias("verified")).join(examples, "category", "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    return t.select("category", "attempts", "verified", rounded(F.col("verified") / F.greatest("attempts", F.lit(1)).cast("double")).alias("rate"), "examples").orderBy(F.desc("verified"), "category")


def to_fix(tasks: DataFrame, verdicts: DataFrame, passed: DataFrame) -> DataFrame:
    """Tasks with the verdict FIX that have test data and an exploit that passed, one row an exploit: tasks (instance_id and
    others), verdicts (instance_id, eqs, verdict), passed (instance_id, patch_id and others). Tasks that lack either are left out."""
    return verdicts.where("verdict = 'FIX'").select("instance_id", "eqs").join(tasks, "instance_id").join(passed, "instance_id")


def first_tasks(df: DataFrame, n: int, key: str = "instance_id") -> DataFrame:
    """All rows of the first n tasks in the order of their ids; a limit that the caller asks for."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")
