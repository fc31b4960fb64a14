"""Registered queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from llm import quality
from llm.common import saved
from llm.queries import ORACLES, QUERIES

from .test_operators import digests_of, lines_brute, near_groups

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, str | bool) else float(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, rel = QUERIES[name](spark, DIR), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    at, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = saved(stage(spark, at, DIR), name)
        out[name] = at
        if name != "pack":
            assert at.columns == docs.columns
    text = lambda name: {r.doc_id: r.text for r in out[name].collect()}
    kept = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert set(text("quality_rules")) == kept
    before = text("quality_rules")
    left, _ = lines_brute(digests_of(out["quality_rules"]))
    want = {d: t for d, t in left if t or any(not x.strip() for x in before[d].split("\n"))}
    assert text("line_dedup") == want
    first = {d for d, _, c in near_groups(list(want.items())) if d == c}
    assert text("near_duplicates") == {d: want[d] for d in first}
    times = Counter(r.doc_id for r in out["source_mix"].collect())
    assert set(times) <= first and max(times.values()) <= 3
    words = lambda n: sum(len(t.encode().split()) for t in n)
    mixed = words(r.text for r in out["source_mix"].collect())
    assert abs(mixed - words(want[d] for d in first)) < 0.1 * mixed
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    ids = {d: [*t.encode(want[d], add_special_tokens=False).ids, 1] for d in times}
    used, seqs = defaultdict(int), defaultdict(int)
    for r in out["pack"].collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        used[r.doc_id] += r.length
        seqs[r.sequence_id] += r.length
    assert used == {d: len(ids[d]) * n for d, n in times.items()} and max(seqs.values()) <= 2048


def test_stages_with_odd_rows(spark, docs, empty):
    """Null and repeated ids, null, empty and long texts, columns of any name, no rows: every stage has a defined result."""
    rows = Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).isEmpty()
        got = stage(spark, docs, DIR)
        if name == "pack":
            assert got.where("length < 1 or length > 2048").isEmpty() and not got.isEmpty()
            continue
        found = Counter(tuple(r) for r in got.collect())
        assert got.columns == docs.columns and found
        if name == "quality_rules" or name == "near_duplicates":
            assert not found - rows
        if name == "source_mix":
            assert set(found) <= set(rows) and all(n <= 3 * rows[r] for r, n in found.items())
