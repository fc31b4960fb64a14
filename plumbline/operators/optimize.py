"""Projected improvement of tasks by test augmentations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded
from plumbline.operators.composite import KEEP
from plumbline.session import materialized

#: Fixed values.
MOST_ITERATIONS, LEAST_GAIN, BOOST = 3, 0.01, 0.15


def boosts(augmentations: DataFrame, exploits: DataFrame) -> DataFrame:
    """(instance_id, iteration, boost, n, cost_usd): BOOST times the share of a task's exploits that augmentations target times
    their mean confidence. augmentations (instance_id, iteration, targets, confidence, and maybe cost_usd), exploits (instance_id,
    n_exploits)."""
    cost = F.col("cost_usd") if "cost_usd" in augmentations.columns else F.lit(0.0)
    a = augmentations.groupBy("instance_id", "iteration").agg(F.count("*").alias("n"), F.avg("confidence").alias("sure"), F.sum(cost).alias("cost_usd"))
    t = augmentations.select("instance_id", "iteration", F.explode("targets").alias("t")).distinct().groupBy("instance_id", "iteration").agg(F.count("*").alias("k"))
    b = a.join(t, ["instance_id", "iteration"], "left").join(exploits, "instance_id")
    share = F.least(F.coalesce("k", F.lit(0)) / F.greatest("n_exploits", F.lit(1)).cast("double"), F.lit(1.0))
    return b.select("instance_id", "iteration", (F.lit(BOOST) * share * F.col("sure")).alias("boost"), "n", "cost_usd")


def step(state: DataFrame, boost: DataFrame) -> DataFrame:
    """state (instance_id, eqs, open) after one iteration over the open tasks, with before, after, improved, upgraded, n_augmentations
    and cost_usd of those (null of the others)."""
    open_ = F.col("open")
    raw = F.least(F.col("eqs") + F.coalesce("boost", F.lit(0.0)), F.lit(1.0))
    s = state.select("instance_id", "eqs", "open").join(boost, "instance_id", "left")
    upgraded = open_ & (raw >= KEEP) & (F.col("eqs") < KEEP)
    return s.select(
        "instance_id",
        F.when(open_, rounded(raw)).otherwise(F.col("eqs")).alias("eqs"),
        (open_ & ~upgraded).alias("open"),
        F.when(open_, rounded("eqs")).alias("before"),
        F.when(open_, rounded(raw)).alias("after"),
        F.when(open_, raw > F.col("eqs")).alias("improved"),
        F.when(open_, upgraded).alias("upgraded"),
        F.when(open_, F.coalesce("n", F.lit(0))).alias("n_augmentations"),
        F.when(open_, F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"),
    )


ITERATIONS = "iteration int, n_tasks long, mean_before double, mean_after double, improvement double, n_improved long, n_upgraded long, n_augmentations long, cost_usd double"
TOTALS = "total_iterations int, converged boolean, initial_mean double, final_mean double, total_improvement double, total_cost_usd double, n_upgraded long, convergence_curve array<double>"


@dataclass
class Optimized:
    """iterations: a row each (ITERATIONS); totals: one row (TOTALS); steps: of each iteration the tasks' rows of step(); state: the
    tasks at the end."""

    iterations: DataFrame
    totals: DataFrame
    steps: list[DataFrame]
    state: DataFrame


def optimized(tasks: DataFrame, boost: DataFrame, iterations: int = MOST_ITERATIONS, least: float = LEAST_GAIN) -> Optimized:
    """tasks (instance_id, eqs) to fix and boosts() to what iterations make of them.

    Each iteration takes the tasks that none has upgraded yet, is written once, and gives the driver one row. The loop stops when
    no task is left or the mean gain, rounded to 4 digits, is below least; it has converged if it stopped before the last
    iteration or no task is left. The curve is the mean over all tasks before and after each iteration.
    """
    spark = tasks.sparkSession
    state, boost = tasks.select("instance_id", "eqs", F.lit(True).alias("open")), materialized(boost, "boosts")
    zero = lambda x: round((x or 0.0) + 1e-9, 4)
    now = state.agg(F.count("*").alias("left"), F.avg("eqs").alias("mean")).first()
    rows, curve, steps, left = [], [now["mean"] or 0.0], [], now["left"]
    while left and len(rows) < iterations:
        i = len(rows) + 1
        state = materialized(step(state, boost.where(F.col("iteration") == i).drop("iteration")), "step")
        t = state.agg(F.count("before").alias("n"), F.avg("before").alias("b"), F.avg("after").alias("a"), F.count_if("improved").alias("improved"), F.count_if("upgraded").alias("upgraded"), F.sum("n_augmentations").alias("augmentations"), F.sum("cost_usd").alias("cost"), F.count_if("open").alias("left"), F.avg("eqs").alias("mean")).first()
        gain = zero(t["a"] - t["b"])
        rows.append((i, t["n"], zero(t["b"]), zero(t["a"]), gain, t["improved"], t["upgraded"], t["augmentations"] or 0, zero(t["cost"])))
        steps.append(state.where("before is not null").drop("eqs", "open"))
        curve.append(t["mean"])
        left = t["left"]
        if gain < least:
            break
    total = (len(rows), len(rows) < iterations or not left, zero(curve[0]), zero(curve[-1]), zero(curve[-1] - curve[0]), zero(sum(r[-1] for r in rows)), sum(r[6] for r in rows), [zero(x) for x in curve])
    return Optimized(spark.createDataFrame(rows, ITERATIONS), spark.createDataFrame([total], TOTALS), steps, state)
