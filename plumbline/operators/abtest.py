"""Paired comparison of two evaluation runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded
from plumbline.operators.stats import bootstrap_means, linear_interval


def aligned(runs_a: DataFrame, runs_b: DataFrame) -> DataFrame:
    """(task_id, a, b) as 0 and 1, of tasks that both runs have."""
    a, b = (r.where("passed is not null").groupBy("task_id").agg(F.max(F.col("passed").cast("int")).alias(s)) for r, s in ((runs_a, "a"), (runs_b, "b")))
    return a.join(b, "task_id")


def pass_at_1(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total_tasks"), F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).alias("total_passed")).withColumn("pass_at_1", rounded(F.col("total_passed") / F.greatest("total_tasks", F.lit(1)).cast("double")))


def _log_error(n: Column) -> Column:
    """ln(n!) less Stirling's formula: by its series from 16 on, below from the factorial itself."""
    exact = F.log(F.factorial(F.least(n, F.lit(16)).cast("int")).cast("double")) - ((n + 0.5) * F.log(F.greatest(n, F.lit(1.0))) - n + F.lit(0.5 * math.log(2 * math.pi)))
    m = F.greatest(n, F.lit(1.0))
    series = F.lit(0.0)
    for c in (1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = series / (m * m) + F.lit(c)
    return F.when(n == 0, F.lit(0.0)).when(n < 16, exact).otherwise(series / m)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x; near the mean by a series, where the terms would cancel."""
    v = (x - mean) / (x + mean)
    series = F.lit(0.0)
    for i in range(24, 0, -1):
        series = (series + F.lit(1.0 / (2 * i + 1))) * v * v
    near = (x - mean) * v + 2 * x * v * series
    far = F.when(x == 0, mean).otherwise(x * F.log(F.greatest(x, F.lit(1.0)) / mean) + mean - x)
    return F.when(F.abs(v) < 0.1, near).otherwise(far)


def binomial_p(k: Column, n: Column) -> Column:
    """Two-sided exact binomial p-value of k or fewer of n at 1/2 (k is the smaller side): min(1, 2 P(X <= k)).

    P(X <= k) is the regularised incomplete beta function I(n - k, k + 1) at 1/2: the probability of k itself, from
    Stirling's errors and deviances so that nothing cancels, times a continued fraction. That takes some multiples of sqrt(n)
    steps and no array of terms, so counts of billions are exact to about 1e-11. Null counts give null.
    """
    k, n = k.cast("double"), n.cast("double")
    a, b, half = n - k, k + 1, n / 2
    # probability of k; the factor of the fraction is (n - k) / 2 / (n - k) = 1 / 2 of it, times 2 for both sides
    log_p = F.when(k == 0, -n * F.log(F.lit(2.0))).otherwise(_log_error(n) - _log_error(k) - _log_error(a) - _deviance(k, half) - _deviance(a, half) - 0.5 * F.log(2 * math.pi * k * a / n))
    tiny = F.lit(1e-300)
    safe = lambda x: F.when(F.abs(x) < tiny, tiny).otherwise(x)

    def term(s: Column, coefficient: Column) -> Column:
        d, c = F.lit(1.0) / safe(1 + coefficient * s["d"]), safe(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"), (F.abs(d * c - 1) < 1e-15).alias("done"))

    def both(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s["done"], s).otherwise(F.transform(F.array(term(s, even)), lambda e: term(e, odd))[0])

    d = F.lit(1.0) / safe(1 - (a + b) / (a + 1) * 0.5)
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done"))
    steps = F.sequence(F.lit(1), (F.lit(60) + 4 * F.sqrt(n)).cast("int"))
    fraction = F.aggregate(steps, start, both)["h"]
    return F.when(n == 0, 1.0).when(k.isNotNull() & n.isNotNull(), F.least(F.lit(1.0), F.exp(log_p) * fraction))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(b, c, p): tasks only b passes, only a passes, and the exact two-sided p-value."""
    t = pairs.agg(F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("c"))
    return t.select("b", "c", binomial_p(F.least("b", "c"), F.col("b") + F.col("c")).alias("p"))


def changes(pairs: DataFrame) -> DataFrame:
    """(task_id, change): fixed or regressed under b."""
    return pairs.where("a <> b").select("task_id", F.when(F.col("b") == 1, "fixed").otherwise("regressed").alias("change"))


def paired_interval(pairs: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(delta, lo, hi): mean of b - a with its bootstrap interval; zeros for no pairs."""
    d = pairs.select((F.col("b") - F.col("a")).cast("double").alias("d"))
    ci = linear_interval(bootstrap_means(d, "d", replicates, seed))
    zero = F.lit(0.0)
    return d.agg(F.coalesce(F.avg("d"), zero).alias("delta")).crossJoin(ci.select(F.coalesce("lo", zero).alias("lo"), F.coalesce("hi", zero).alias("hi")))


def compared(runs_a: DataFrame, runs_b: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: pass rates, difference, interval, exact test, numbers fixed and regressed, verdict.

    VALIDATED: p below 0.05 and the interval above 0; INCONCLUSIVE: the interval holds 0; else NOT VALIDATED.
    """
    p = aligned(runs_a, runs_b)
    means = p.agg(F.count("*").alias("n"), *(F.coalesce(F.avg(F.col(x).cast("double")), F.lit(0.0)).alias(f"pass_{x}") for x in "ab"))
    out = means.crossJoin(paired_interval(p, replicates, seed)).crossJoin(mcnemar(p))
    word = F.when((F.col("p") < 0.05) & (F.col("lo") > 0), "VALIDATED").when((F.col("lo") <= 0) & (F.col("hi") >= 0), "INCONCLUSIVE").otherwise("NOT VALIDATED")
    return out.select("n", *(rounded(c).alias(c) for c in ("pass_a", "pass_b", "delta", "lo", "hi")), rounded("p", 6).alias("p"), F.col("b").alias("n_fixed"), F.col("c").alias("n_regressed"), word.alias("verdict"))
