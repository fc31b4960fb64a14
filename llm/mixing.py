"""Mixing sources to target weights by Efraimidis-Spirakis sampling, native.

Every document gets the key -ln(u) / w: u comes from a digest of doc_id (of the text where it is null) and the seed, w is the document's quality
weight. Within a source documents are taken in the order of their keys. A source's target is met by as many complete
epochs as fit, then by whole documents in that order while their prefix sum stays within the rest of the target; the
last one enters if it brings the sum nearer. No source repeats its documents more than max_epochs times.

Prefix sums never gather a source in one task: keys fall into narrow bands of ln(key), sums of bands are added up per
source, and each band is summed on its own.

Null or empty texts have size 0 and are never missed: their rows come back with taken 0. A null source is a source of
its own, last in order. Repeated rows are mixed each on its own; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def quality(text: Column, size: Column) -> Column:
    """Share of words that bring no symbol along, at least 0.05."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)).cast("double"))


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(skey, source_size, target): weights repeat over the sorted sources; what a source can't hold goes to the others by weight.

    The level that fills up is found in closed form: by ratio of capacity to weight, capacities before a source are full.
    One row a source; only these rows meet in one task.
    """
    n, every = Window.orderBy("skey"), Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sources.withColumn("place", F.row_number().over(n) - 1).withColumn("w", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "place")
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "place", "level"))).over(every)["level"])
    return s.select("skey", "source_size", F.least("cap", F.col("w") * F.coalesce("level", F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, seed: int = 42, bands: int | None = None, rows: bool = False) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, skey, size, source_size, target, taken); bands: bands of keys for each power
    of e; rows: also a column row, the struct of all of docs' columns."""
    spark = docs.sparkSession
    bands = bands or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text, kept = F.coalesce("text", F.lit("")), ["row"] if rows else []
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if rows else []
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary"))), F.lit(f"-{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("skey"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text.alias("text"), u.alias("u"), *row)
    d = d.select("doc_id", "skey", "size", *kept, (-F.log("u") / quality(F.col("text"), F.col("size"))).alias("key"))
    d = d.withColumn("band", F.floor(F.log("key") * bands))
    d = saved(d, "keyed")
    sums = d.groupBy("skey", "band").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    per_source = targets(sums.groupBy("skey").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(per_source, "skey")
    within = Window.partitionBy("skey", "band").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(sums, ["skey", "band"]).withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    d = d.withColumn("epochs", epochs)
    part = F.col("start") + F.col("size") / 2.0 <= F.col("target") - F.col("epochs") * F.col("source_size")
    return d.select(*kept, "doc_id", "skey", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.when(part, 1).otherwise(0))).cast("long").alias("taken"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols,
         (CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '-42'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, skey, size, -ln(u) / greatest(0.05::DOUBLE, 1.0::DOUBLE - symbols / greatest(size, 1)::DOUBLE) AS key FROM d
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS place FROM k GROUP BY skey
), c AS (
  SELECT *, (place % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), t AS (
  SELECT skey, source_size, least(cap, w * (SELECT level FROM l WHERE level <= cap / w ORDER BY cap / w, place LIMIT 1)) AS target FROM l
), r AS (
  SELECT k.*, source_size, target,
    sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM k JOIN t USING (skey)
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN start + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
