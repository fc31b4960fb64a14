"""Training sets: weakening, filters, pass rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import hashed_uniform, ratio, rounded
from plumbline.functions.text import prompt, weakened


def learnable(tasks: DataFrame, profile: DataFrame, low: float = 0.3, high: float = 0.7, key: str = "task_id") -> DataFrame:
    """Tasks whose pass rate lies in [low, high], and those without a profile."""
    return tasks.join(profile.select(key, "pass_rate"), key, "left").where(F.col("pass_rate").isNull() | F.col("pass_rate").between(low, high))


def pass_rates(rollouts: DataFrame, key: str = "task_id") -> DataFrame:
    """rollouts (key, passed), a row each, to (key, n_rollouts, n_pass, pass_rate)."""
    t = rollouts.groupBy(key).agg(F.count("*").alias("n_rollouts"), F.count_if(F.coalesce("passed", F.lit(False))).alias("n_pass"))
    return t.withColumn("pass_rate", rounded(ratio("n_pass", "n_rollouts")))


def weak_split(tasks: DataFrame, fraction: float = 0.30, seed: int = 42, mode: str = "mild", key: str = "task_id") -> DataFrame:
    """tasks (key, gold_code, test_list) with is_weak, weakening_mode and the tests that remain: a share of the tasks with
    two tests or more, chosen by digest, keeps weakened tests."""
    weak = (F.size("test_list") >= 2) & (hashed_uniform(F.col(key), seed) < fraction)
    return tasks.withColumn("is_weak", weak).withColumn("weakening_mode", F.when(weak, mode)).withColumn("test_list", F.when(weak, weakened("test_list", "gold_code", mode)).otherwise(F.col("test_list")))


def strong_only(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("is_weak"))


def training_records(tasks: DataFrame) -> DataFrame:
    """The columns of training records, defaults where missing."""
    empty = F.array().cast("array<string>")
    return tasks.select("task_id", prompt("prompt", "test_list").alias("prompt"), F.coalesce("gold_code", F.lit("")).alias("gold_code"), F.coalesce("test_list", empty).alias("test_list"), F.coalesce("test_imports", empty).alias("test_imports"), "is_weak", "weakening_mode")


def train_and_eval(train: DataFrame, test: DataFrame, first: int = 100, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Training rows with the first rows of the test set added, and the rest of the test set; order numbers rows from 0."""
    return train.unionByName(test.where(F.col(order) < first)), test.where(F.col(order) >= first)
