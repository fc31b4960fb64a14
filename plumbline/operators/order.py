"""Running sums, positions and ranks in a global order, without any task that holds all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialized


def cumulated(df: DataFrame, sums: Mapping[str, Column], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before, in the order of columns within by; 0 for the first.

    Rows are dealt by ranges of (by, order), so a group of any size lies in as many tasks as it takes, and rows equal in
    both lie together, in any order among themselves. Ranges are summed on their own and shifted by the sums of the ranges
    before: one row for each range and group. The dealing is written once, as ranges drawn anew could differ.
    """
    keys, given = [*by, *order], df.columns
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    dealt = materialized(df.withColumns(values).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ordered")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(*(F.sum(v).alias(v) for v in values))
    shift = totals.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_s{v}") for v in values))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_w{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(shift if by else F.broadcast(shift), same)  # without by: a row a range
    return out.select(*given, *((F.col(f"_s{v}") + F.col(f"_w{v}")).alias(name) for name, v in zip(sums, values, strict=True)))


def positioned(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """df with each row's position from 0 in the order of columns."""
    return cumulated(df, {name: F.lit(1).cast("long")}, order)


def mean_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """df with the 1-based rank of value among all rows; ties get their mean rank, nulls come first and tie.

    Distinct values are counted first, ranks follow from the counts of smaller ones, so what is ordered is the histogram.
    A value that very many rows have is an ordinary join key; adaptive execution splits its partition.
    """
    h = df.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    r = cumulated(h, {"_before": F.col("_n")}, ["_value"]).select("_value", (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(rank))
    return df.join(r, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
