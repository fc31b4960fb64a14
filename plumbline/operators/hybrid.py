"""Verifier results against independent judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import f1, ratio, rounded


def settled(candidates: DataFrame) -> DataFrame:
    """Gold and trivial candidates need no judge: correct and incorrect for certain, at no cost."""
    gold, trivial = F.col("source") == "gold", F.col("source") == "trivial"
    return candidates.where(gold | trivial).select("instance_id", "patch_id", F.when(gold, "correct").otherwise("incorrect").alias("verdict"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("cost_usd"))


def cell_of(passed: Column, verdict: Column) -> Column:
    """tp, fp, fn, tn, or skipped where the verifier's result or a clear verdict is missing."""
    right = verdict.isin("correct", "partial")
    skipped = passed.isNull() | F.coalesce(verdict, F.lit("uncertain")).isin("uncertain")
    return F.when(skipped, "skipped").when(passed, F.when(right, "tp").otherwise("fp")).otherwise(F.when(right, "fn").otherwise("tn"))


def _last(judgments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each patch: the last judgment's verdict, and the cost of all. Without order, the smallest verdict is the last."""
    last = F.max_by("verdict", F.struct(*order)) if order else F.min("verdict")
    return judgments.groupBy(key, "patch_id").agg(last.alias("verdict"), F.sum(F.col("cost_usd").cast("double")).alias("cost_usd"))


def cells(candidates: DataFrame, judgments: DataFrame, key: str = "instance_id", order: Sequence[str] = ()) -> DataFrame:
    """(key, patch_id, cell) of all candidates. Of several judgments of a patch the last in the order of columns counts."""
    both = candidates.select(key, "patch_id", "verifier_pass").join(_last(judgments, key, list(order)).drop("cost_usd"), [key, "patch_id"], "left")
    return both.select(key, "patch_id", cell_of(F.col("verifier_pass"), F.col("verdict")).alias("cell"))


def rates() -> list[Column]:
    """Precision, recall, f1, fpr and fnr of columns tp, fp, fn, tn."""
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    made = {"precision": p, "recall": r, "f1": f1(p, r), "fpr": ratio("fp", F.col("fp") + F.col("tn")), "fnr": ratio("fn", F.col("fn") + F.col("tp"))}
    return [rounded(v).alias(k) for k, v in made.items()]


def confusion(candidates: DataFrame, judgments: DataFrame, key: str = "instance_id", order: Sequence[str] = ()) -> DataFrame:
    """One row a task that has candidates: counts, rates, judged and skipped, cost of all its judgments, of whatever patch.

    Candidates and judgments meet once, by patch; each patch counts its candidates by result, so repeated ones need no join
    of all with all, and a patch's cost counts once. Of several judgments the last in the order of columns counts."""
    passed = F.col("verifier_pass")
    c = candidates.groupBy(key, "patch_id").agg(F.count_if(passed).alias("yes"), F.count_if(~passed).alias("no"), F.count_if(passed.isNull()).alias("open"))
    both = c.join(_last(judgments, key, list(order)), [key, "patch_id"], "full")
    verdict, n = F.coalesce("verdict", F.lit("uncertain")), lambda x: F.coalesce(x, F.lit(0))
    clear, right = verdict != "uncertain", verdict.isin("correct", "partial")
    counts = {"tp": F.when(clear & right, F.col("yes")), "fp": F.when(clear & ~right, F.col("yes")), "fn": F.when(clear & right, F.col("no")), "tn": F.when(clear & ~right, F.col("no"))}
    skipped = F.when(clear, F.col("open")).otherwise(F.col("yes") + F.col("no") + F.col("open"))
    sums = (F.sum(n(F.col("yes") + F.col("no") + F.col("open"))).alias("rows"), *(F.sum(n(v)).alias(k) for k, v in counts.items()), F.sum(n(skipped)).alias("n_skipped"))
    t = both.groupBy(key).agg(*sums, F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")).where("rows > 0")
    return t.select(key, "tp", "fp", "fn", "tn", *rates(), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_judged"), "n_skipped", rounded("cost_usd", 6).alias("cost_usd"))


def overall(per_task: DataFrame) -> DataFrame:
    """One row: counts and rates over all tasks, and how many tasks have false positives or negatives."""
    t = per_task.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn", "tn")), F.count_if(F.col("fp") > 0).alias("tasks_with_fp"), F.count_if(F.col("fn") > 0).alias("tasks_with_fn"))
    return t.select("tp", "fp", "fn", "tn", *rates(), "tasks_with_fp", "tasks_with_fn")


def upgraded(source: Column, passed: Column, verdict: Column, quality: Column) -> Column:
    """True quality (0 to 3) in the light of a verdict; gold and trivial candidates are settled, uncertain ones stay."""
    judged = F.when(verdict == "correct", 3).when(verdict == "partial", 2).when(verdict == "incorrect", F.when(F.coalesce(passed, F.lit(False)), 1).otherwise(0))
    return F.when(F.coalesce(verdict, F.lit("uncertain")) == "uncertain", quality).when(source == "gold", 3).when(source == "trivial", 0).otherwise(judged).cast("int")


#: What a vote takes over from its best sample, where samples have it.
REASONS = ("premises", "trace", "conclusion")


def voted(samples: DataFrame, by: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """(by, verdict, reasons, confidence, n_samples, cost_usd, latency_seconds): the majority of a candidate's samples, the verdict
    seen first on ties; confidence is its share of the votes times its best confidence. The reasons (premises, trace,
    conclusion, as far as samples have them) are those of the most confident sample for the winner, the first of equals; cost
    and latency are sums over all samples, whatever they say.

    samples: by, verdict, confidence, cost_usd, order, and maybe latency_seconds and reasons. Partial sums per verdict precede
    every shuffle: verdicts are few, so a candidate with very many samples is no row of many.
    """
    s = samples
    if most is not None:
        s = s.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most)
    reasons = [c for c in REASONS if c in samples.columns]
    latency = F.col("latency_seconds") if "latency_seconds" in samples.columns else F.lit(0.0)
    place = F.struct(*order)
    # the smallest struct: highest confidence first, then order
    best = F.min(F.struct((-F.col("confidence")).alias("less"), place.alias("place"), *reasons)).alias("best")
    votes = s.groupBy(*by, "verdict").agg(F.count("*").alias("votes"), best, F.sum("cost_usd").alias("cost"), F.sum(latency).alias("latency"), F.min(place).alias("seen"))
    ranked = F.struct((-F.col("votes")).alias("less"), "seen", "verdict", "votes", "best")
    t = votes.groupBy(*by).agg(F.min(ranked).alias("first"), F.sum("votes").alias("n_samples"), F.sum("cost").alias("cost_usd"), F.sum("latency").alias("latency_seconds"))
    sure = rounded(F.col("first.votes") / F.col("n_samples") * -F.col("first.best.less"))
    return t.select(*by, "first.verdict", *(F.col(f"first.best.{c}").alias(c) for c in reasons), sure.alias("confidence"), "n_samples", "cost_usd", "latency_seconds")


def judged_all(candidates: DataFrame, votes: DataFrame, by: list[str]) -> DataFrame:
    """votes of all candidates: uncertain, confidence 0, for those without samples."""
    out = candidates.select(*by).distinct().join(votes, by, "left")
    none = {"verdict": "uncertain", "premises": "", "trace": "", "conclusion": "No judgment samples available", "confidence": 0.0, "n_samples": 0, "cost_usd": 0.0, "latency_seconds": 0.0}
    missing = F.col("verdict").isNull()
    return out.select(*by, *(F.when(missing, F.lit(none[c]).cast(votes.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in votes.columns if c not in by))
