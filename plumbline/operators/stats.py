"""Group statistics that never sort all rows in one place."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import normal_cdf, rounded
from plumbline.operators.order import cumulated, positioned
from plumbline.operators.verifier import sensitivity
from plumbline.session import materialized

#: Weight configurations of the sensitivity analysis.
CONFIGURATIONS = {
    "default": {"discrimination": 0.40, "spearman": 0.20, "mae": 0.15, "completeness": 0.25},
    "discrimination_heavy": {"discrimination": 0.70, "spearman": 0.10, "mae": 0.10, "completeness": 0.10},
    "balanced": {"discrimination": 0.25, "spearman": 0.25, "mae": 0.25, "completeness": 0.25},
    "completeness_heavy": {"discrimination": 0.20, "spearman": 0.15, "mae": 0.15, "completeness": 0.50},
    "spearman_heavy": {"discrimination": 0.20, "spearman": 0.50, "mae": 0.15, "completeness": 0.15},
}
#: Bootstrap: distinct values in a leaf, replicates in a block.
LEAF, BLOCK = 4096, 500


def histogram(df: DataFrame, value: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, value, x, y): rows at each distinct value, positive ones as x. Values null are left out."""
    by = by or []
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count_if(positive).alias("x"), F.count_if(~positive).alias("y"))


def running(h: DataFrame, counts: list[str], by: list[str] | None = None, value: str = "value") -> DataFrame:
    """h with before_<count>: the sum of count at smaller values within by."""
    return cumulated(h.select(*(by or []), value, *counts), {f"before_{c}": F.col(c) for c in counts}, [value], by or [])


def rank_sum(h: DataFrame, by: list[str] | None = None, exact_cdf: bool = False) -> DataFrame:
    """(by, n_x, n_y, u, z, p, effect) of a histogram: u counts pairs with x < y, ties half; p two-sided by the normal
    approximation with ties; effect 1 - 2 u / (n_x n_y). Ranks stand in for pairs: u = rank sum of y - n_y (n_y + 1) / 2."""
    by = by or []
    n = F.col("x") + F.col("y")
    r = running(h.withColumn("t", n), ["x", "y", "t"], by)
    d = lambda c: F.col(c).cast("double")
    t = r.groupBy(*by).agg(F.sum("x").alias("n_x"), F.sum("y").alias("n_y"), F.sum(d("y") * (d("before_t") + (d("t") + 1) / 2)).alias("ranks"), F.sum(d("t") * d("t") * d("t") - d("t")).alias("ties"))
    nx, ny = d("n_x"), d("n_y")
    both, all_ = nx * ny, nx + ny
    none = (F.col("n_x") == 0) | (F.col("n_y") == 0)
    var = F.greatest(both / 12 * (all_ + 1 - F.col("ties") / F.greatest(all_ * (all_ - 1), F.lit(1.0))), F.lit(1e-10))
    t = t.withColumn("u", F.when(none, 0.0).otherwise(F.col("ranks") - ny * (ny + 1) / 2)).withColumn("z", (F.col("u") - both / 2) / F.sqrt(var))
    return t.select(*by, "n_x", "n_y", "u", F.when(none, 0.0).otherwise(F.col("z")).alias("z"), F.when(none, 1.0).otherwise(2 * normal_cdf(-F.abs(F.col("z")), exact_cdf)).alias("p"), F.when(none, 0.0).otherwise(1 - 2 * F.col("u") / F.greatest(both, F.lit(1.0))).alias("effect"))


def best_threshold(h: DataFrame) -> DataFrame:
    """(threshold, youden, sensitivity, specificity): scores up to the threshold count as positive (x); the smallest of
    equally good ones; (0.5, 0, 0, 0) unless both classes are there."""
    total = h.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("px"), F.coalesce(F.sum("y"), F.lit(0)).alias("py"))
    r = running(h, ["x", "y"]).crossJoin(F.broadcast(total))  # one row
    sens = (F.col("before_x") + F.col("x")) / F.greatest("px", F.lit(1)).cast("double")
    spec = 1 - (F.col("before_y") + F.col("y")) / F.greatest("py", F.lit(1)).cast("double")
    best = r.where("px > 0 and py > 0").agg(F.max(F.struct((sens + spec - 1).alias("youden"), (-F.col("value")).alias("m"), sens.alias("sens"), spec.alias("spec"))).alias("b"))
    return best.select(*(F.coalesce(c, F.lit(d)).alias(n) for n, c, d in (("threshold", -F.col("b.m"), 0.5), ("youden", F.col("b.youden"), 0.0), ("sensitivity", F.col("b.sens"), 0.0), ("specificity", F.col("b.spec"), 0.0))))


def bootstrap_means(df: DataFrame, value: str, replicates: int = 10_000, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """(replicate, mean) of value resampled with replacement; nulls are left out, no rows give no replicates, one row itself.

    A resample of n rows is a multinomial draw over the histogram of values, in whatever order it is split up. Distinct
    values in order make leaves of so many; leaves make a binary tree. Of a node's draws the left half of its leaves gets
    a binomial share, so any leaf can find out its own number of draws by going down from the root, and draws its values
    from that number alone: leaves work apart, at any number of values, and one leaf is just the case without a tree. Draws
    follow from the seed, the replicates' block, and the node or leaf; nothing depends on how rows or tasks lie.
    """
    spark = df.sparkSession
    h = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("k"))
    leaves = positioned(h, ["value"]).groupBy(F.floor(F.col("position") / leaf).alias("leaf")).agg(F.sort_array(F.collect_list(F.struct("value", "k"))).alias("values"), F.sum("k").alias("total"))
    leaves = materialized(leaves, "leaves")  # at most so many values a row
    depth = max(0, (leaves.count() - 1).bit_length())
    up = lambda l: F.call_function("shiftright", F.col("leaf"), l)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = leaves.select("leaf", "total", levels).groupBy("level", up(F.col("level")).alias("node")).agg(F.sum("total").alias("draws"))
    # from the root down: how many rows lie below the left and below the right child
    pairs = nodes.where(F.col("level") < depth).groupBy((F.col("level") + 1).alias("level"), F.call_function("shiftright", F.col("node"), F.lit(1)).alias("node"))
    pairs = pairs.agg(F.sum(F.when(F.col("node") % 2 == 0, F.col("draws")).otherwise(0)).alias("left"), F.sum(F.when(F.col("node") % 2 == 1, F.col("draws")).otherwise(0)).alias("right"))
    paths = leaves.select("leaf", levels).select("leaf", "level", up(F.col("level")).alias("node")).join(pairs, ["level", "node"]).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("level"), "node", "left", "right"))).alias("path"))
    whole = leaves.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))).alias("block")
    work = leaves.join(paths, "leaf", "left").crossJoin(F.broadcast(whole)).select("leaf", "values", "path", "n", blocks)  # whole: one row
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                first = r["block"] * BLOCK
                size = min(BLOCK, replicates - first)
                left = np.full(size, r["n"], np.int64)
                for step in r["path"] or []:
                    level, share = -step["level"], step["left"] / (step["left"] + step["right"])
                    to_left = np.random.default_rng([seed, 1, r["block"], level, step["node"]]).binomial(left, share)
                    left = left - to_left if r["leaf"] >> level - 1 & 1 else to_left
                x, k = (np.array([v[c] for v in r["values"]], t) for c, t in (("value", float), ("k", np.int64)))
                drawn = np.random.default_rng([seed, 2, r["block"], r["leaf"]]).multinomial(left, k / k.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + size)), pa.array(drawn @ x), pa.array(left)], ["replicate", "total", "weight"])

    drawn = work.repartition(tasks, "leaf", "block").mapInArrow(draw, "replicate long, total double, weight long")
    return drawn.groupBy("replicate").agg(F.sum("total").alias("t"), F.sum("weight").alias("w")).select("replicate", (F.col("t") / F.col("w")).alias("mean"))


def interval(means: DataFrame, replicates: int, alpha: float = 0.05) -> DataFrame:
    """(lo, hi): means at the floors of replicates alpha / 2 and replicates (1 - alpha / 2) in order; replicates are few by
    design. Zeros where there are none."""
    a, b = int(replicates * alpha / 2), min(int(replicates * (1 - alpha / 2)), replicates - 1)
    s = means.agg(F.sort_array(F.collect_list("mean")).alias("s"))
    return s.select(*(F.coalesce(F.get("s", F.lit(i)), F.lit(0.0)).alias(n) for i, n in ((a, "lo"), (b, "hi"))))


def linear_interval(means: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(lo, hi) by linear interpolation between order statistics."""
    return means.agg(F.percentile("mean", alpha / 2).alias("lo"), F.percentile("mean", 1 - alpha / 2).alias("hi"))


def separation(scores: DataFrame, value: str = "composite", positive: str = "hackable", replicates: int | None = 10_000, seed: int = 42) -> DataFrame:
    """One row: means of both groups, their difference, rank-sum test, effect, best threshold, and bootstrap intervals
    unless replicates is None. Scores are written once and read by every part."""
    scores = materialized(scores.select(value, positive), "separation")
    h = histogram(scores, value, F.col(positive))
    means = scores.agg(F.coalesce(F.avg(F.when(F.col(positive), F.col(value))), F.lit(0.0)).alias("mean_x"), F.coalesce(F.avg(F.when(~F.col(positive), F.col(value))), F.lit(0.0)).alias("mean_y"))
    out = rank_sum(h).crossJoin(best_threshold(h)).crossJoin(means)
    for i, (side, part) in enumerate((("x", scores.where(F.col(positive))), ("y", scores.where(~F.col(positive))))):
        if replicates is None:
            break
        ci = interval(bootstrap_means(part, value, replicates, seed + i), replicates)
        out = out.crossJoin(ci.select(F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}")))
    return out.select("n_x", "n_y", *(rounded(c).alias(c) for c in ("mean_x", "mean_y")), rounded(F.col("mean_y") - F.col("mean_x")).alias("delta"), "u", rounded("p", 6).alias("p"), rounded("effect").alias("effect"), (F.col("p") < 0.05).alias("significant"), *(rounded(c).alias(c) for c in ("threshold", "youden", "sensitivity", "specificity", *([] if replicates is None else ["lo_x", "hi_x", "lo_y", "hi_y"]))))


def weight_sensitivity(candidates: DataFrame, configurations: Mapping[str, Mapping[str, float]] = CONFIGURATIONS, key: str = "instance_id") -> DataFrame:
    """(configuration, n_x, n_y, mean_x, mean_y, delta, p, significant) of hackable tasks against the others under each weighting.

    One pass counts how many tasks of either kind have each score under each weighting; all the rest follows from that."""
    h = materialized(histogram(sensitivity(candidates, configurations, key), "composite", F.col("hackable"), ["configuration"]), "weighted")
    tests = rank_sum(h, ["configuration"])
    mean = lambda n: rounded(F.sum(F.col("value") * F.col(n)) / F.greatest(F.sum(n), F.lit(1)))
    means = h.groupBy("configuration").agg(mean("x").alias("mean_x"), mean("y").alias("mean_y"))
    return tests.join(F.broadcast(means), "configuration").select("configuration", "n_x", "n_y", "mean_x", "mean_y", rounded(F.col("mean_y") - F.col("mean_x")).alias("delta"), rounded("p", 6).alias("p"), (F.col("p") < 0.05).alias("significant"))  # means: a row a configuration
