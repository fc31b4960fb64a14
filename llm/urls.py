"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter, native but for the probe.

The filter has blocks of 8 words of 32 bits; a URL sets one bit in each word of its block. Its size follows the list
up to max_blocks (32 MB at most), so what is broadcast is bounded: a longer list only passes more false hits on. Hits
meet the list in a hash join on the canonical URL itself, which removes false positives; distinct hits are joined, so
a URL that a third of the pages share is one row there.

A null url, or one without "://", has an empty host and path, no rule and no canonical URL; it is allowed. Repeated
pages come back each; an empty table or an empty list does no harm. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Odd factors of 31 bits, so that a product with 32 bits fits in a long.
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www. and default ports, path without index pages and final slashes; no scheme, query or fragment. Null without a host."""
    short = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest]
    return F.coalesce(*fits)


def hash_of(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("binary"))


def bloom(listed: DataFrame, h: Column, max_blocks: int = 1 << 20) -> np.ndarray:
    """An array of blocks x 8 words: 16 bits a row and its 64-bit hash h; blocks are a power of two, at most max_blocks."""
    n = listed.count()
    blocks = 1 << min(max(int(n * 16 / 256), 1).bit_length(), max_blocks.bit_length() - 1)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(low * F.lit(s) % F.lit(1 << 32), 27).cast("int"))).alias(f"w{i}") for i, s in enumerate(SALTS)]
    rows = listed.groupBy(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(blocks - 1)).cast("int").alias("block")).agg(*bits).toArrow()
    words = np.zeros((blocks, 8), np.uint32)
    at = rows.column("block").to_numpy()
    for i in range(8):
        words[at, i] = rows.column(f"w{i}").to_numpy() & 0xFFFFFFFF
    return words


def probed(words: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash (uint64)."""
    block, low = ((u >> np.uint64(40)) & np.uint64(len(words) - 1)).astype(np.int64), u & np.uint64(0xFFFFFFFF)
    hit = np.ones(len(u), bool)
    for i, s in enumerate(SALTS):
        bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        hit &= (words[block, i] >> bit.astype(np.uint32)) & 1 > 0
    return hit


def may_hold(spark: SparkSession, urls: DataFrame, h: Column, words: np.ndarray) -> DataFrame:
    """urls with a boolean column _hit: whether the filter may hold the hash h."""
    sent = spark.sparkContext.broadcast(words)

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hit = probed(sent.value, b.column("_hash").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "_hash"), pa.array(hit)], [*(c for c in b.schema.names if c != "_hash"), "_hit"])

    hashed = urls.withColumn("_hash", h)
    kinds = ", ".join(f"`{n}` {t}" for n, t in urls.dtypes)
    return hashed.mapInArrow(probe, f"{kinds}, _hit boolean")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (page_id, url), listed (canon) to (page_id, host, path, canon, rule, verdict, listed)."""
    spark = pages.sparkSession
    listed = listed.select("canon").where("canon is not null").distinct()
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("canon", canonical(F.col("host"), F.col("path"))).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    p = p.select("page_id", "host", "path", "canon", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    p = may_hold(spark, p, hash_of("canon"), bloom(listed, hash_of("canon")))
    hits = p.where("_hit and canon is not null and verdict is null")
    # distinct possible hits meet the list; what is confirmed meets the hits again, salted
    salts = 16
    real = hits.select("canon").distinct().join(listed.hint("shuffle_hash"), "canon").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int"))
    found = hits.join(real.withColumn("listed", F.lit(True)), ["canon", "salt"], "left").select("page_id", "host", "path", "canon", "rule", "verdict", F.coalesce("listed", F.lit(False)).alias("listed"))
    rest = p.where("not (_hit and canon is not null and verdict is null)").select("page_id", "host", "path", "canon", "rule", "verdict", F.lit(False).alias("listed"))
    both = rest.union(found)
    return both.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages on hosts with a label that starts with spam; the tables bring no list along."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    listed = pages.where(host.rlike(r"(^|\.)spam")).select(canonical(host, path).alias("canon"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') END AS canon,
    CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canon IN (SELECT canon FROM c WHERE regexp_matches(host, '(^|\.)spam') AND canon IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
