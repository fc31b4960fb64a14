"""Maximal runs of periodic words, found in a suffix tree by smaller-half leaf lists.

A document is a sequence of words. A tandem repeat (i, p) is a stretch of p words at i that is followed by itself; it is
branching if the word after the two copies differs from the first word of the second one, that is, if it can't be
rotated to the right. Every maximal run of period p ends in one branching tandem repeat of length p.

The suffix tree stands as its leaves in sorted order (a suffix array, by doubling) and its inner nodes as intervals of
it, each with the length D of its label. A node's leaves i and i + D are both below it, in different children, exactly if
(i, D) is a branching tandem repeat. As one of the two lies outside the node's largest child, only the leaf lists of
the other children are traversed, testing each leaf's partner on either side: every leaf is listed at most log2(n) times.
A branching repeat is then rotated to the left as far as the words allow, in jumps of powers of two whose equality the
doubling has told already; repeats with the same stretch are merged under their smallest period. A run counts if it has
at least max(least, times * period) words, times being 2 or more.

Documents stand side by side in one array, with a mark of its own at each one's end, so no repeat leaves its document,
and all steps but the stack that builds the intervals are array operations over many documents. Documents in which no
stretch occurs twice that is as long as a run's copies must be (least - 1 words, or 3 periods) stop early. Memory follows
the words of CHUNK or of one longer document, times the doublings that its longest repeat takes.

Words are what WORD matches in the UTF-8 text. A null or empty text, or one without words, has no runs and an empty
collapsed text. Rows are judged each on its own, so nulls, ties and repeats of ids don't matter; no row, no result. Extra
columns stay as they are; runs and collapsed get names that don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import small, spans, texts

#: Fixed by the contract: words, shortest run, and how many periods a run has.
WORD, LEAST, TIMES = r"[^\x20\x09-\x0D]+", 6, 4
#: Documents are taken together up to so many words.
CHUNK = 200_000

Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # document, start, length, period


class _Numbers(dict):
    """Words to numbers from 1, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents as numbers from 1, each document followed by a 0; starts of the documents and the end."""
    seen = _Numbers()
    at = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=at[1:])
    w = np.zeros(at[-1], np.int64)
    for d, words in enumerate(docs):
        w[at[d] : at[d + 1] - 1] = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    return w, at


def doubled(w: np.ndarray, at: np.ndarray, levels: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all stretches of 1, 2, 4, ... words, equal ones sharing a rank and no two documents one; stops when all
    differ or after so many levels. With it, the places whose last rank is shared, in the order of ranks."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = doc * (int(w.max(initial=0)) + 1) + w
    order = np.argsort(key, kind="stable")
    ranks: list[np.ndarray] = []
    place = np.arange(len(w))
    while True:
        new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, place, 0)) if len(order) else place
        rank = ranks[-1].copy() if ranks else np.empty(len(w), np.int32)
        rank[order] = head
        ranks.append(rank)
        shared = ~new
        shared[:-1] |= ~new[1:]
        order, place = order[shared], place[shared]
        if not len(order) or len(ranks) == levels:
            return ranks, order
        # a place that shares its rank has no end of a document within its stretch, so the next stretch begins inside it
        key = np.empty(len(w), np.int64)
        key[order] = (rank[order].astype(np.int64) << 32) | rank[order + (1 << len(ranks) - 1)]
        again = np.argsort(key[order], kind="stable")
        order = order[again]


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common, a and b differing."""
    a, b = a.copy(), b.copy()
    n = np.zeros(len(a), np.int64)
    last = len(ranks[0]) - 1
    for k in reversed(range(len(ranks))):
        same = ranks[k][np.minimum(a, last)] == ranks[k][np.minimum(b, last)]
        for x in (n, a, b):
            x[same] += 1 << k
    return n


def _back(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that agree before a and b, read backwards."""
    a, b = a.copy(), b.copy()
    n = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks))):
        s = 1 << k
        same = (a >= s) & (b >= s) & (ranks[k][np.maximum(a - s, 0)] == ranks[k][np.maximum(b - s, 0)])
        n[same] += s
        a[same] -= s
        b[same] -= s
    return n


def branching(w: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All branching tandem repeats, as (start, period)."""
    rank = ranks[-1].astype(np.int64)
    leaves = np.empty(len(w), np.int64)
    leaves[rank] = np.arange(len(w))
    common = np.r_[0, _common(ranks, leaves[:-1], leaves[1:])]
    # inner nodes by a stack over the borders at which something is shared: first leaf, depth, borders between children
    node, first, last, depth = np.full(len(w), -1, np.int64), [], [], []
    stack: list[int] = []
    values = common.tolist()
    for i in np.flatnonzero(common | np.r_[common[1:], 0] | np.r_[0, common[:-1]]).tolist():
        v, low = values[i], i - 1
        while stack and depth[stack[-1]] > v:
            last[top := stack.pop()] = i - 1
            low = first[top]
        if v:
            if not stack or depth[stack[-1]] < v:
                stack.append(len(first))
                first.append(low)
                last.append(len(w) - 1)
                depth.append(v)
            node[i] = stack[-1]
    first, last, depth = (np.array(x, np.int64) for x in (first, last, depth))
    # children: from one border of a node to the next; the largest child of each is left out
    border = np.flatnonzero(node >= 0)
    border = border[np.argsort(node[border], kind="stable")]
    of = np.r_[node[border], np.arange(len(first))]
    begin = np.r_[border, first]
    order = np.lexsort((begin, of))
    of, begin = of[order], begin[order]
    end = np.r_[begin[1:], 0]
    closing = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    end[closing] = last[of[closing]] + 1
    size = end - begin
    order = np.lexsort((-size, of))
    small_ones = order[np.r_[False, of[order][1:] == of[order][:-1]]] if len(of) else order
    n = size[small_ones]
    leaf = leaves[np.repeat(begin[small_ones] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    own = np.repeat(of[small_ones], n)
    found = []
    for sign in (1, -1):
        d = depth[own]
        other = leaf + sign * d
        ok = (other >= 0) & (other < len(w))
        x, o, m, d = leaf[ok], other[ok], own[ok], d[ok]
        ok = (rank[o] >= first[m]) & (rank[o] <= last[m])
        start, d = np.minimum(x[ok], o[ok]), d[ok]
        ok = w[start + d] != w[start + 2 * d]
        found.append((start[ok], d[ok]))
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def runs_of(docs: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> Runs:
    """The runs of all documents, by document, start and period."""
    if times < 2:
        raise ValueError("a run has two periods or more")
    none = (np.zeros(0, np.int64),) * 4
    w, at = numbered(docs)
    # the two copies in a run share max(least, times * p) - p words, at least so many
    needed = min(max(least, times * p) - p for p in range(1, least + 1))
    levels = max(1, needed.bit_length())
    _, shared = doubled(w, at, levels)
    owners = np.unique(np.searchsorted(at, shared, "right") - 1)
    if not len(owners):
        return none
    if len(owners) < len(docs):
        d, start, length, period = runs_of([docs[i] for i in owners], least, times)
        return owners[d], start, length, period
    ranks, _ = doubled(w, at)
    start, period = branching(w, ranks)
    turns = _back(ranks, start, start + period)
    doc = np.searchsorted(at, start, "right") - 1
    start, length = start - turns - at[doc], turns + 2 * period
    ok = length >= np.maximum(least, times * period)
    doc, start, length, period = (x[ok] for x in (doc, start, length, period))
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = (x[order] for x in (doc, start, length, period))
    if len(doc):
        once = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
        doc, start, length, period = (x[once] for x in (doc, start, length, period))
        order = np.lexsort((period, start, doc))
        doc, start, length, period = (x[order] for x in (doc, start, length, period))
    return doc, start, length, period


def collapsed_words(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that lie in a run only within its first period, joined by one space."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(words[i] for i in np.flatnonzero(~gone).tolist())


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def names_of(columns: list[str]) -> tuple[str, str, str]:
    """Names for the words' number, the runs and the collapsed text that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("n_words", "runs", "collapsed"):
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs (array of RUN by start, then period) and collapsed (text)."""
    names = names_of(docs.columns)
    kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string())
    columns = docs.columns
    where = columns.index(text)

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            split = [(t or b"").split() for t in texts(b.rename_columns([str(i) for i in range(b.num_columns)]), str(where))]
            at = 0
            while at < len(split):
                end, n = at, 0
                while end < len(split) and (end == at or n + len(split[end]) <= CHUNK):
                    n, end = n + len(split[end]), end + 1
                part = split[at:end]
                doc, start, length, period = runs_of(part, least, times)
                left = [b" ".join(words) for words in part]
                for i, j in spans(doc):
                    left[doc[i]] = collapsed_words(part[doc[i]], start[i:j], length[i:j], period[i:j])
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=len(part)))].astype(np.int32))
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kinds[1].value_type)))
                more = [pa.array([len(x) for x in part], kinds[0]), found, pa.array(left, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays([*b.slice(at, end - at).columns, *more], [*columns, *names])
                at = end

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(find, ", ".join(x for x in (schema, f"`{names[0]}` long", f"`{names[1]}` array<{RUN}>", f"`{names[2]}` string")))


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's periodic documents: with h = crc32 of the id in decimal, g = h div 10 and n words, a text with n > 0 and h
    divisible by 10 has, from word a = g % n on, the p = 1 + (n - a) div (3 + g % 8) words there over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def periodic(s: Column) -> Column:
        """s: words, n and g."""
        a = s["g"] % s["n"]
        p = 1 + F.floor((s["n"] - a) / (3 + s["g"] % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(s["words"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = F.transform(F.array(F.struct(words.alias("words"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g"))), lambda s: F.when(s["n"] > 0, periodic(s)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, made[0]).otherwise(text)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its runs' number, the longest in periods, digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    nothing = F.lit(None).cast(RUN)
    best = F.aggregate("runs", nothing, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
