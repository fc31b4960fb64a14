"""Solve rates, difficulty tiers and pass-rate bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded

#: Upper bounds of the tiers, from hard to easy.
TIERS = ((0.05, "too_hard"), (0.2, "hard"), (0.8, "medium"), (0.95, "easy"))
#: Names of the bands and their rules.
BANDS = {
    "0.0": "r = 0.0D",
    "0.0-0.1": "r > 0.0D and r < 0.1D",
    "0.1-0.3": "r >= 0.1D and r < 0.3D",
    "0.3-0.7": "r >= 0.3D and r <= 0.7D",
    "0.7-0.9": "r > 0.7D and r <= 0.9D",
    "0.9-1.0": "r > 0.9D and r < 1.0D",
    "1.0": "r = 1.0D",
}


def solve_rates(resolved: DataFrame, targets: DataFrame | None = None, n_submissions: int | None = None) -> DataFrame:
    """resolved (submission, instance_id), one row a solved task, to (instance_id, solve_rate): distinct submissions that
    solve it over all submissions. targets: only these, unsolved ones at 0; an empty or no table: all that are solved."""
    total = n_submissions if n_submissions is not None else resolved.agg(F.count_distinct("submission")).first()[0]
    pairs = resolved.where("instance_id is not null").distinct()
    rates = pairs.groupBy("instance_id").agg((F.count("*") / F.lit(float(max(total, 1)))).alias("solve_rate"))
    if targets is None or targets.isEmpty():
        return rates
    return targets.select("instance_id").distinct().join(rates, "instance_id", "left").select("instance_id", F.coalesce("solve_rate", F.lit(0.0)).alias("solve_rate"))


def from_lists(submissions: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """As solve_rates, of submissions (submission, resolved array); those that solve nothing count too."""
    n = submissions.select("submission").distinct().count()
    flat = submissions.select("submission", F.explode(F.array_distinct("resolved")).alias("instance_id"))
    return solve_rates(flat, targets, n)


def clamped(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)))


def tier(rate: Column) -> Column:
    p, out = clamped(rate), F.lit("too_easy")
    for bound, name in reversed(TIERS):
        out = F.when(p < bound, name).otherwise(out)
    return out


def profiled(rates: DataFrame, rate: str = "solve_rate") -> DataFrame:
    """rates with gradient_signal p (1 - p), difficulty_tier and flagged (too hard or too easy)."""
    p = clamped(F.col(rate))
    out = rates.withColumn("gradient_signal", rounded(p * (1 - p))).withColumn("difficulty_tier", tier(F.col(rate)))
    return out.withColumn("flagged", F.col("difficulty_tier").isin("too_hard", "too_easy")).withColumn(rate, rounded(p))


def tier_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("difficulty_tier").agg(F.count("*").alias("n"))


def bands(rates: DataFrame, rate: str = "pass_rate") -> DataFrame:
    """(band, n, mean): all seven bands, also empty ones; mean over all rates that are not null."""
    r = rates.select(F.col(rate).alias("r")).where("r is not null")
    one = r.agg(*(F.count_if(F.expr(rule)).alias(f"b{i}") for i, rule in enumerate(BANDS.values())), F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean"))
    each = F.array(*(F.struct(F.lit(name).alias("band"), F.col(f"b{i}").alias("n")) for i, name in enumerate(BANDS)))
    return one.select(F.explode(each).alias("e"), rounded("mean").alias("mean")).select("e.band", "e.n", "mean")
