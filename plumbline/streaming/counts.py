"""Confusion counts kept up to date over a stream of judged candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(judged: DataFrame, key: str = "instance_id") -> DataFrame:
    """judged (key, verifier_pass, verdict), batch or stream, to running (key, tp, fp, fn, tn); stream with output mode update or complete."""
    right, passed = F.col("verdict").isin("correct", "partial"), F.col("verifier_pass")
    known = passed.isNotNull() & F.col("verdict").isin("correct", "partial", "incorrect")
    made = {"tp": passed & right, "fp": passed & ~right, "fn": ~passed & right, "tn": ~passed & ~right}
    return judged.where(known).groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in made.items()))
