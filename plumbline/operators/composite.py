"""The weighted composite quality score, its verdict, weaknesses and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import percent, rounded

#: Weights of the four dimensions.
WEIGHTS = {"verifier": 0.35, "exploit": 0.30, "hybrid": 0.20, "difficulty": 0.15}
DIMENSIONS = tuple(WEIGHTS)
KEEP, FIX = 0.70, 0.40


def joined(verifier: DataFrame, exploit: DataFrame, hybrid: DataFrame, difficulty: DataFrame) -> DataFrame:
    """All tasks of any source: verifier (instance_id, v_score, v_fpr, v_fnr), exploit (instance_id, exploit_rate),
    hybrid (instance_id, h_f1, h_fpr, h_fnr), difficulty (instance_id, gradient_signal, difficulty_tier)."""
    out = verifier
    for other in (exploit, hybrid, difficulty):
        out = out.join(other, "instance_id", "full_outer")
    return out


def dimensions() -> dict[str, Column]:
    """Each dimension of a row of joined(), null where its source has no such task."""
    return {"verifier": F.col("v_score"), "exploit": F.lit(1.0) - F.col("exploit_rate"), "hybrid": F.col("h_f1"), "difficulty": F.when(F.col("gradient_signal").isNotNull(), F.least(F.col("gradient_signal") / F.lit(0.25), F.lit(1.0)))}


def eqs(values: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the dimensions that are there; 0 without any."""
    if set(weights) != set(WEIGHTS) or sum(weights.values()) <= 0 or min(weights.values()) < 0:
        raise ValueError(f"weights must name {DIMENSIONS} and not all be 0")
    top = sum((F.coalesce(values[d] * F.lit(float(weights[d])), F.lit(0.0)) for d in DIMENSIONS), F.lit(0.0))
    mass = sum((F.when(values[d].isNotNull(), float(weights[d])).otherwise(0.0) for d in DIMENSIONS), F.lit(0.0))
    return F.when(mass > 0, top / F.when(mass > 0, mass)).otherwise(0.0)


def weaknesses() -> Column:
    """Array of (dimension, severity, description, fixable, action) that a row of joined() shows."""

    def found(when: Column, dimension: str, severity: str | Column, text: Column, fixable: bool, action: str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(dimension).alias("dimension"), level.alias("severity"), text.alias("description"), F.lit(fixable).alias("fixable"), F.lit(action).alias("action")))

    c = F.col
    grave = lambda x: F.when(x > 0.5, "critical").otherwise("high")
    made = F.array(
        found(c("v_fpr") > 0, "verifier", grave(c("v_fpr")), F.concat(F.lit("Accepts wrong candidates: "), percent("v_fpr")), True, "tighten the tests"),
        found(c("v_fnr") > 0.5, "verifier", "high", F.concat(F.lit("Rejects right candidates: "), percent("v_fnr")), True, "relax the tests"),
        found(c("exploit_rate") > 0, "exploit", grave(c("exploit_rate")), F.concat(F.lit("Exploits that pass: "), percent("exploit_rate")), True, "add tests against these exploits"),
        found(c("h_fpr") > 0.3, "hybrid", "high", F.concat(F.lit("Judges reject what passes: "), percent("h_fpr")), True, "add tests of behaviour"),
        found(c("h_fnr") > 0.3, "hybrid", "medium", F.concat(F.lit("Judges accept what fails: "), percent("h_fnr")), True, "review over-strict tests"),
        found(c("difficulty_tier") == "too_hard", "difficulty", "high", F.lit("Nearly nothing solves it"), False, "replace the task"),
        found(c("difficulty_tier") == "too_easy", "difficulty", "medium", F.lit("Nearly everything solves it"), False, "replace the task"),
    )
    return F.filter(made, lambda w: w.isNotNull())


def verdict(score: Column, found: Column, keep: float = KEEP, fix: float = FIX) -> Column:
    """KEEP, FIX or DROP of a rounded score: what is critical and can't be fixed drops, from fix on something must be fixable."""
    veto = F.exists(found, lambda w: (w["severity"] == "critical") & ~w["fixable"])
    return F.when(veto, "DROP").when(score >= keep, "KEEP").when((score >= fix) & F.exists(found, lambda w: w["fixable"]), "FIX").otherwise("DROP")


def scored(sources: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """sources as of joined() to (instance_id, eqs, verdict, four rounded dimensions, weaknesses): a projection, no shuffle of its own."""
    d = dimensions()
    out = sources.select("instance_id", rounded(eqs(d, weights)).alias("eqs"), *(rounded(v).alias(k) for k, v in d.items()), weaknesses().alias("weaknesses"))
    any_ = sum((F.col(k).isNotNull().cast("int") for k in DIMENSIONS), F.lit(0)) > 0
    return out.withColumn("verdict", F.when(any_, verdict(F.col("eqs"), F.col("weaknesses"))).otherwise("DROP"))


def verdict_counts(scores: DataFrame) -> DataFrame:
    """(verdict, n, mean_eqs)."""
    return scores.groupBy("verdict").agg(F.count("*").alias("n"), rounded(F.avg("eqs")).alias("mean_eqs"))


def dimension_means(scores: DataFrame) -> DataFrame:
    """(dimension, n, mean) over the tasks that have it."""
    one = scores.agg(*(f(d).alias(f"{d}_{i}") for d in DIMENSIONS for i, f in enumerate((F.count, F.avg))))
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_0").alias("n"), rounded(F.coalesce(f"{d}_1", F.lit(0.0))).alias("mean")) for d in DIMENSIONS))
    return one.select(F.explode(each).alias("e")).select("e.*")


def weakness_rows(scores: DataFrame) -> DataFrame:
    return scores.select("instance_id", F.explode("weaknesses").alias("w")).select("instance_id", "w.*")


def weakness_counts(scores: DataFrame) -> DataFrame:
    """(kind, value, n): by dimension, by severity, fixable ones and all, in one pass of grouping sets."""
    w = weakness_rows(scores).withColumn("fixable", F.when(F.col("fixable"), "yes").otherwise("no"))
    one = w.groupingSets([["dimension"], ["severity"], ["fixable"], []], "dimension", "severity", "fixable").agg(F.grouping_id("dimension", "severity", "fixable").alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "dimension").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "fixable").otherwise("all")
    return one.select(kind.alias("kind"), F.coalesce("dimension", "severity", "fixable", F.lit("all")).alias("value"), "n")


def extremes(scores: DataFrame, k: int = 5) -> DataFrame:
    """(side, place, instance_id, eqs): the k lowest and highest."""
    from pyspark.sql import Window

    out = None
    for side, order in (("lowest", F.asc("eqs")), ("highest", F.desc("eqs"))):
        best = scores.orderBy(order, "instance_id").limit(k)
        part = best.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, "instance_id")).alias("place"), "instance_id", "eqs")
        out = part if out is None else out.unionByName(part)
    return out
