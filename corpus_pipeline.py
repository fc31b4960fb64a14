"""Documents to packed training sequences: quality rules, line dedup, near duplicates, source mix, packing.

Every stage works on all rows that the one before kept, written as Parquet and read again. Columns are those of
documents until the last stage; n_chars follows the text. No stage can be put in SQL as a whole (language model,
SimHash lines, tokenizer), so ORACLE_SQL is None and tests hold run() against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import jaccard, lines, mixing, packing, quality
from llm.common import saved, shipped

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the perplexity bands accept. A null, empty or short text has fewer words than the rules ask
    for and goes. Rows are judged each on its own, so repeated rows and null or repeated ids make no difference."""
    shipped(spark)
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; one that loses all its lines goes. Earlier: by doc_id, null last, then by a digest
    of the text, then by line. A null text has no lines and stays. Rows equal in doc_id and text get the same verdict."""
    shipped(spark)
    n_lines, n_removed = lines.counts_of(docs.columns)
    left = lines.deduplicated(docs).where(F.expr(f"{n_lines} = 0 or {n_removed} < {n_lines}"))
    return left.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by doc_id, null last, then by a digest of the text; of equal rows all but one go. Texts
    without words, and null ones, are like nothing and stay."""
    shipped(spark)
    return jaccard.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; repeated rows are taken each. A text without words, or null, has size 0 and is never
    taken. A null source is a source of its own. Ties of sampling keys go by doc_id, then size."""
    shipped(spark)
    taken = mixing.mix(docs, rows=True).where("taken > 0").select("row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. A null text is an empty one: a single end id. Repeated rows are packed each."""
    shipped(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("pack", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
