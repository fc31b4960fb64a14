"""Verifier metrics for each task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import ratio, rounded
from plumbline.operators.order import mean_ranks

#: Weights of detection, ranking, error and completeness.
WEIGHTS = {"discrimination": 0.40, "spearman": 0.20, "mae": 0.15, "completeness": 0.25}


def average_rank(df: DataFrame, value: str, rank: str, by: list[str] | None = None) -> DataFrame:
    """df with the 1-based rank of value within by; ties get their mean rank."""
    if not by:
        return mean_ranks(df, value, rank)
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(rank, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def spearman(d2: Column, n: Column, constant: Column) -> Column:
    """1 - 6 sum(d^2) / (n (n^2 - 1)), also with ties; 0 below two rows or where a side is constant."""
    n = n.cast("double")
    return F.when((n < 2) | constant, 0.0).otherwise(F.lit(1.0) - F.lit(6.0) * d2 / F.greatest(n * (n * n - 1), F.lit(1.0)))


def metrics(candidates: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, cells, n ...) unrounded: everything follows from how many candidates have each (pass, quality), so one
    aggregation with partial sums in each task does, without windows or rows of a task meeting one another.

    verifier_pass null counts as a fail; true_quality is 0 to 3.
    """
    passed = F.coalesce(F.col("verifier_pass"), F.lit(False))
    cells = {(v, q): F.count_if((passed == bool(v)) & (F.col("true_quality") == q)) for v in (0, 1) for q in range(4)}
    t = candidates.groupBy(key).agg(*(x.cast("double").alias(f"c{v}{q}") for (v, q), x in cells.items()))
    c = {(v, q): F.col(f"c{v}{q}") for v, q in cells}
    at_v = [sum((c[v, q] for q in range(1, 4)), c[v, 0]) for v in (0, 1)]
    at_q = [c[0, q] + c[1, q] for q in range(4)]
    n = at_v[0] + at_v[1]
    rank_v = [(at_v[0] + 1) / 2, at_v[0] + (at_v[1] + 1) / 2]
    below, rank_q = F.lit(0.0), []
    for q in range(4):
        rank_q.append(below + (at_q[q] + 1) / 2)
        below = below + at_q[q]
    d2 = sum((c[v, q] * (rank_v[v] - rank_q[q]) * (rank_v[v] - rank_q[q]) for v in (0, 1) for q in range(4)), F.lit(0.0))
    best = lambda xs: F.coalesce(*(F.when(x > 0, q) for q, x in reversed(list(enumerate(xs)))))
    least = F.coalesce(*(F.when(x > 0, q) for q, x in enumerate(at_q)))
    row = lambda v: best([c[v, q] for q in range(4)])
    top = F.when(at_v[1] > 0, row(1)).otherwise(row(0))
    bottom = F.when(at_v[0] > 0, row(0)).otherwise(row(1))
    one_quality = sum((x > 0).cast("int") for x in at_q[1:]) + (at_q[0] > 0).cast("int") < 2
    error = sum((c[v, q] * abs(v - q / 3.0) for v in (0, 1) for q in range(4)), F.lit(0.0)) / F.greatest(n, F.lit(1.0))
    wrong, right = at_q[0] + at_q[1], at_q[3]
    return t.select(
        key,
        n.cast("long").alias("n_candidates"),
        (top == best(at_q)).cast("int").cast("double").alias("top1"),
        (bottom == least).cast("int").cast("double").alias("bottom1"),
        spearman(d2, n, (at_v[0] == 0) | (at_v[1] == 0) | one_quality).alias("spearman"),
        error.alias("mae"),
        ratio(c[1, 0] + c[1, 1], wrong).alias("fpr"),
        ratio(c[0, 3], right).alias("fnr"),
        (c[1, 0] + c[1, 1]).cast("long").alias("n_false_positives"),
        c[0, 3].cast("long").alias("n_false_negatives"),
    )


def composite(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted score of a row of metrics()."""
    w = {**WEIGHTS, **weights}
    if set(weights) - set(WEIGHTS):
        raise ValueError(f"unknown weights: {sorted(set(weights) - set(WEIGHTS))}")
    return F.lit(float(w["discrimination"])) * (1 - F.col("fpr")) + F.lit(float(w["spearman"])) * (F.col("spearman") + 1) / 2 + F.lit(float(w["mae"])) * (1 - F.col("mae")) + F.lit(float(w["completeness"])) * (1 - F.col("fnr"))


ROUNDED = ("top1", "bottom1", "spearman", "mae", "fpr", "fnr", "composite")


def verifier_scores(candidates: DataFrame, weights: Mapping[str, float] = WEIGHTS, key: str = "instance_id") -> DataFrame:
    """One row a task with candidates: metrics and composite, rounded to 4 digits at the end."""
    m = metrics(candidates, key).withColumn("composite", composite(weights))
    return m.select(key, "n_candidates", *(rounded(x).alias(x) for x in ROUNDED), "n_false_positives", "n_false_negatives")


def with_empty(scores: DataFrame, tasks: DataFrame, key: str = "instance_id") -> DataFrame:
    """scores of all tasks: zeros, and an error of 1, for those without candidates."""
    out = tasks.select(key).distinct().join(scores, key, "left")
    return out.select(key, *(F.coalesce(c, F.lit(1.0 if c == "mae" else 0).cast(t)).alias(c) for c, t in scores.dtypes if c != key))


def separated(scores: DataFrame) -> DataFrame:
    """scores with hackable: some wrong candidate passed."""
    return scores.withColumn("hackable", F.col("n_false_positives") > 0)


def sensitivity(candidates: DataFrame, configurations: Mapping[str, Mapping[str, float]], key: str = "instance_id") -> DataFrame:
    """(configuration, key, hackable, composite): metrics are computed once, each configuration is a projection."""
    m = separated(metrics(candidates, key))
    each = F.array(*(F.struct(F.lit(name).alias("configuration"), rounded(composite(w)).alias("composite")) for name, w in configurations.items()))
    return m.select(key, "hackable", F.explode(each).alias("e")).select("e.configuration", key, "hackable", "e.composite")
