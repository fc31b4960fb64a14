"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from llm import chats, codes, jaccard, licenses, lines, mixing, packing, periods, quality, repeats, topk, urls, weaklabels
from llm.common import shipped

Query = Callable[[SparkSession, str], DataFrame]


def _ready(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    name: _ready(f)
    for name, f in {
        "op1_ngram_jaccard": jaccard.op1,
        "op2_line_dedup": lines.op2,
        "op3_quality_rules": quality.op3,
        "op4_weak_label_classifier": weaklabels.op4,
        "op5_suffix_dedup": repeats.op5,
        "op6_source_mixing": mixing.op6,
        "op7_exact_topk": topk.op7,
        "op8_url_filters": urls.op8,
        "op9_packing": packing.op9,
        "op10_license_scan": licenses.op10,
        "op11_vector_codes": codes.op11,
        "op12_periodic_runs": periods.op12,
        "op13_chat_format": chats.op13,
    }.items()
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": jaccard.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op8_url_filters": urls.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op13_chat_format": chats.ORACLE,
}
