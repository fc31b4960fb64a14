"""Costs of language-model calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order import cumulated

#: Dollars for a million tokens of a model that the price table lacks.
INPUT, OUTPUT = 3.0, 15.0


def priced(responses: DataFrame, prices: DataFrame) -> DataFrame:
    """responses (model, input_tokens, output_tokens) with cost_usd; prices (model, price_in, price_out) a million tokens, one row a model."""
    p = responses.join(prices.select("model", "price_in", "price_out"), "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("price_in", F.lit(INPUT)) + F.col("output_tokens") * F.coalesce("price_out", F.lit(OUTPUT))) / F.lit(1e6)
    return p.withColumn("cost_usd", cost).drop("price_in", "price_out")


def running_totals(calls: DataFrame, order: Sequence[str]) -> DataFrame:
    """priced() calls with calls_so_far and cost_so_far: how many there were up to each call, itself included, and their cost, in
    the order of columns; that order should have no ties. No task holds all calls."""
    out = cumulated(calls, {"calls_so_far": F.lit(1).cast("long"), "cost_so_far": F.coalesce("cost_usd", F.lit(0.0))}, order)
    return out.withColumns({"calls_so_far": F.col("calls_so_far") + 1, "cost_so_far": F.col("cost_so_far") + F.coalesce("cost_usd", F.lit(0.0))})


#: Dollars for a judged candidate, an attacked task, an augmented task and iteration.
JUDGE, ATTACK, AUGMENT = 0.015, 0.06, 0.05


def estimates(n_candidates: int, n_tasks: int, n_fix: int, self_consistent: bool = False, iterations: int = 3) -> dict[str, float]:
    """What a run would cost."""
    return {"judge": n_candidates * JUDGE * (3 if self_consistent else 1), "attack": n_tasks * ATTACK, "augment": n_fix * AUGMENT * iterations}
