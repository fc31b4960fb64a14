"""Exact n-gram Jaccard join by vertical partitioning, and the groups that its links make.

The global order of n-grams (rare ones first) is cut into fragments by hash; each fragment counts how many texts hold
its n-grams, on packed arrays, and gives back those that two texts share. N-grams of one text alone are first in the
order: a text of which they fill the prefix (size - ceil(0.75 size) + 1 n-grams) links with nothing and is settled.
The others meet where their prefixes share an n-gram; for each pair the overlaps are counted in every vertical
fragment on its own and summed per pair, which gives the exact intersection.

Texts with equal sets are one class from the start. Within a prefix n-gram the class with the fewest n-grams of its
own is held against the others, so a group of near copies costs one pair a member; only classes that stay apart in
the same n-gram are then held against each other (bucket_links), once for all n-grams of a group (met_apart), and of these only
pairs whose bitmaps don't already differ in more places than the sets may. N-grams that many texts of one chunk share don't
gather in their fragment: a marker goes there, the entries return to their texts.

n-grams and classes are 64-bit hashes. A null or empty text, or one without words, has an empty set and links with nothing. A null
doc_id is never a component's name unless its text has no other. Repeated rows share their component; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import BY_OWNER, BY_OWNER_ARROW, PACKED, PACKED_ARROW, Alike, Packer, WordHash, batches, bucket_links, fragments, joined, owner_rows, positional, same, saved, shared_tokens, shingle_set, small, texts
from llm.urls import bloom, may_hold

#: Overlaps of a pair are counted in so many vertical fragments.
VERTICAL_BITS = 2
#: Words of 64 bits in a set's bitmap.
BITMAP = 32


def _sets(b: pa.RecordBatch, words: WordHash, size: int) -> Iterator[tuple[np.ndarray, int | None]]:
    """Of each text the shingle set and the class: a hash of the whole set."""
    for text in texts(b):
        s = shingle_set(words.of((text or b"").lower().split()), size)
        yield s, (xxhash.xxh3_64_intdigest(s.tobytes()) ^ 1 << 63) - (1 << 63) if len(s) else None


def classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs (doc_id, dig, text) to (doc_id, dig, n_shingles, class): texts with equal sets share the class, an empty set has none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in small(it):
            n, c = [], []
            for s, k in _sets(b, words, size):
                n.append(len(s))
                c.append(k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dig"), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "dig", "n_shingles", "class"])

    return docs.mapInArrow(run, "doc_id long, dig long, n_shingles long, class long")


def packed(docs: DataFrame, parts: int, size: int = 5) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordHash(), Packer(parts)

        def rows() -> Iterator[dict]:
            seen: set[int] = set()
            for b in small(it):
                for s, k in _sets(b, words, size):
                    if k is None or k in seen:
                        continue
                    seen.add(k)
                    if packer.add(k, s):
                        yield from packer.rows()
                        seen.clear()
            yield from packer.rows()

        yield from batches(rows(), PACKED_ARROW)

    return docs.mapInArrow(run, PACKED)


def survivors(shared: DataFrame, sizes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(id, n, own, prefix, toks) of the classes that may link: shared n-grams in the global order, and the prefix's part of them."""

    def size_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = b.column("class").to_numpy()
            yield from batches(owner_rows(own, b.column("n").to_numpy().astype(np.uint64), None, np.zeros(len(own), np.uint8), parts), BY_OWNER_ARROW)

    def assemble(table: pa.Table) -> pa.Table:
        own, tok, mark = joined(table.column("owners"), np.int64), joined(table.column("tok"), np.uint64), joined(table.column("mark"), np.uint8)
        order = np.lexsort((tok, mark, own))
        own, tok, mark = own[order], tok[order], mark[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (tok[1:] != tok[:-1]) | (mark[1:] != mark[:-1])]
        own, tok, mark = own[new], tok[new], mark[new]
        starts = same(own)
        count = np.diff(np.r_[starts, len(own)]) - 1  # the first entry of each is its size
        n = tok[starts].astype(np.int64)
        alone = n - count
        prefix = n - -(-percent * n // 100) + 1 - alone
        live = prefix > 0
        at = np.repeat(live, count + 1)
        at[starts] = False
        place = np.arange(len(own)) - np.repeat(starts, count + 1) - 1
        first = at & (place < np.repeat(prefix, count + 1))
        lists = [pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)], pa.int64()), pa.array(tok[m].view(np.int64))).cast(pa.list_(pa.int64())) for m, k in ((first, np.minimum(prefix, count)[live]), (at, count[live]))]
        # bit h of a set's bitmap: an odd number of its shared n-grams have the hash h
        bit = np.zeros((int(live.sum()), 64 * BITMAP), np.uint8)
        np.bitwise_xor.at(bit, ((np.cumsum(live) - 1).repeat(count + 1)[at], (tok[at] >> np.uint64(7)).astype(np.int64) % (64 * BITMAP)), 1)
        bits = np.packbits(bit, axis=1, bitorder="little").view(np.int64).ravel()
        lists.append(pa.LargeListArray.from_arrays(pa.array(np.arange(len(bit) + 1) * BITMAP), pa.array(bits)).cast(pa.list_(pa.int64())))
        return pa.table({"id": own[starts][live], "n": n[live], "own": alone[live], "prefix": lists[0], "toks": lists[1], "bits": lists[2]})

    sized = sizes.mapInArrow(size_rows, BY_OWNER)
    return shared.union(sized).groupBy("frag").applyInArrow(assemble, "id long, n long, own long, prefix array<long>, toks array<long>, bits array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union: partial overlaps for each vertical fragment, summed per pair."""
    size = {s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab"}
    near = pairs.join(size["a"], "a").join(size["b"], "b")

    def fragment(i: int) -> Column:
        return F.filter("toks", lambda t: F.shiftrightunsigned(t, 64 - VERTICAL_BITS) == i)

    cut = [fragment(i) for i in range(1 << VERTICAL_BITS)]
    vertical = sets.select("id", F.posexplode(F.array(*cut)).alias("part", "seg")).where("size(seg) > 0")
    x, y = (vertical.select(F.col("id").alias(s), "part", F.col("seg").alias(f"seg_{s}")) for s in "ab")
    both = near.join(x, "a").join(y, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("seg_a", "seg_b")).alias("o"))
    total = both.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("o"))
    return total.where(f"100 * o >= {percent} * (n_a + n_b - o)").select("a", "b")


def differing(percent: int) -> Alike:
    """Which pairs of sets (own, n, bits) may link: sets differ at least by their own n-grams and where their bitmaps do, and the size
    of the difference is a share of both sizes at most."""

    def alike(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        own, n, bits = c["own"], c["n"], c["bits"].view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
        alone, most = own[i] + own[j], (n[i] + n[j]) * (100 - percent)
        # without its own n-grams one set lies within the other at best
        ok = np.maximum(alone, np.maximum(n[i] - n[j] + 2 * own[j], n[j] - n[i] + 2 * own[i])) * (100 + percent) <= most
        at = np.flatnonzero(ok)
        ok[at] = (np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1, dtype=np.int64) + alone[at]) * (100 + percent) <= most[at]
        return ok

    return alike


def joined_classes(docs: DataFrame, percent: int = 75, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, dig, text) to (doc_id, dig, n_shingles, class) and, of classes that link with others, (id, comp)."""
    parts = fragments(docs.sparkSession)
    per_doc = saved(classes(docs, size), "classes")
    sizes = per_doc.where("class is not null").groupBy("class").agg(F.max("n_shingles").alias("n"))
    shared = shared_tokens(packed(docs, parts, size), parts)
    live = saved(survivors(shared, sizes, parts, percent), "survivors")
    # 100 * (n - own) >= percent * (n + m - (n - own)) bounds a partner's size m
    most = F.floor((F.col("n") - F.col("own")) * (100 + percent) / percent).cast("long") - F.col("n")
    members = live.select(F.explode("prefix").alias("bucket"), "id", (F.col("own") / F.col("n")).alias("first"), "n", F.ceil(F.col("n") * percent / 100).cast("long").alias("lo"), most.alias("hi"))
    comps = bucket_links(members, "{a}.n between {b}.lo and {b}.hi and {b}.n between {a}.lo and {a}.hi", lambda p: overlaps(p, live, percent), "jaccard", sharp=(live.select("id", "own", "n", "bits"), differing(percent)))
    return per_doc, comps


def groups(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id)."""
    per_doc, comps = joined_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("dig"), "text"), percent, size)
    least = per_doc.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).join(comps.withColumnRenamed("id", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    tops = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("class", "component_id")
    empty = per_doc.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return per_doc.where("class is not null").join(tops, "class").select("doc_id", "n_shingles", "component_id").union(empty)


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without those whose group has an earlier one, by doc_id (null last) and digest of the text.

    Rows are told apart by both, so different texts under one doc_id, or none, are documents of their own; of rows equal
    in both one stays, unless the text has no words. Columns may have any names. Only rows that a bounded filter takes
    for members of groups are shuffled with their text.
    """
    plain, names = positional(docs)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed = plain.withColumn("doc", F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))).withColumn("dig", F.xxhash64(text))
    per_doc, comps = joined_classes(keyed.select(F.col("doc").alias("doc_id"), "dig", F.col(text).alias("text")))
    placed = saved(per_doc.where("class is not null").join(comps.withColumnRenamed("id", "class"), "class", "left").select(F.col("doc_id").alias("doc"), "dig", F.coalesce("comp", "class").alias("comp")), "groups")
    leads = placed.groupBy("comp").agg(F.count("*").alias("k"), F.min(F.struct("doc", "dig")).alias("lead")).where("k > 1").select("comp", "lead")
    members = saved(placed.join(leads, "comp").select("doc", "dig", (F.struct("doc", "dig") == F.col("lead")).alias("first")).distinct(), "members")
    named = F.xxhash64("doc", "dig")
    marked = may_hold(docs.sparkSession, keyed, named, bloom(members, named))
    hits = marked.where("_hit").join(members, ["doc", "dig"], "left")
    lead = hits.where("first").dropDuplicates(["doc", "dig"])
    out = marked.where("not _hit").select(names).union(hits.where("first is null").select(names)).union(lead.select(names))
    return out.toDF(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w
), t AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY ALL
"""
