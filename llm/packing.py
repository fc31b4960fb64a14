"""Packing documents into sequences by minimum bin slack.

Documents become token ids and an end id. Whole sequences are cut off first; what is left of each document, shorter
than a sequence, is one piece. Only the histogram of the pieces' lengths matters for the plan: at most capacity - 1
counts, whatever the size of the corpus. The plan fills window after window: it starts with the longest length left
and picks the multiset of remaining lengths closest to the capacity by a bitset subset-sum dynamic programme, whose
steps are traced back to counts. A pattern found is used as often as its counts allow, so the number of patterns
follows the number of lengths, not of pieces.

Pieces find their place by their rank among the pieces of their length: ranks run within each task and are shifted by
the counts of the tasks before, so nothing is collected and no group is gathered.

A null text is an empty one: a single end id. Repeated rows are packed each. A table without rows has no pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import saved, small, texts

CAPACITY, END = 2048, 1
_TOKENIZERS: dict[str, object] = {}


def encoder(vocabulary: str):  # noqa: ANN201
    """Texts (str) to id lists, equal to those of tokenizers with the vocabulary file (.json).

    Where the same vocabulary lies beside it as ranks, tiktoken computes them four times as fast; texts that hold a
    special token's string, or a run that its splitting takes long for, go to tokenizers in any case.
    """
    if vocabulary not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        slow = lambda s: t.encode(s, add_special_tokens=False).ids
        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            specials = [a.content for a in t.get_added_tokens_decoder().values()]
            table = {base64.b64decode(a): int(r) for a, r in (line.split() for line in open(ranks, "rb"))}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

            def ids(s: str) -> list[int]:
                if any(x in s for x in specials) or len(s) > 100_000 and max(map(len, s.split()), default=0) > 20_000 or len(s) > 100_000 and " " * 20_000 in s:
                    return slow(s)
                return fast.encode_ordinary(s)

            _TOKENIZERS[vocabulary] = ids
        else:
            _TOKENIZERS[vocabulary] = slow
    return _TOKENIZERS[vocabulary]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) to PIECES; rank counts the task's pieces of that length."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in small(it):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids = np.array([*ids_of((text or b"").decode("utf-8", "replace")), END], "<u4")
                for at in range(0, len(ids), capacity):
                    p = ids[at : at + capacity]
                    out.append((doc, at, len(p), zlib.crc32(p.tobytes()), len(ids), task, seen[len(p)]))
                    seen[len(p)] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "task" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is closest to room from below, as counts.

    Bit s of reached tells that some lengths sum to s. Lengths join one by one, long ones first, in powers of two of
    their number; the states before each step are kept and traced back from the best sum.
    """
    reached, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            now = (reached | reached << (k * length)) & mask
            if now != reached:
                steps.append((length, k, reached))
                reached = now
            left -= k
            k *= 2
        if reached >> room & 1:
            break
    s, found = reached.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> s & 1:
            found[length] = found.get(length, 0) + k
            s -= k * length
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[dict]:
    """Rows (length, low, high, base, each, offset): the pieces of that length with ranks from low to below high are dealt
    to sequences from base on, so many to each, from that offset on."""
    counts, used, rows, base = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        rest = {**counts, longest: counts[longest] - 1}
        pattern = fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(counts[x] // n for x, n in pattern.items()), 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append({"length": length, "low": used[length], "high": used[length] + n * times, "base": base, "each": n, "offset": offset})
            used[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
            offset += n * length
        base += times
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) to (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    p = saved(pieces(docs, vocabulary, capacity), "pieces")
    per_task = p.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = per_task.withColumn("before", before).select("length", "task", "before")
    counts = {r.length: r.n for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity)
    by_length: dict[int, list[dict]] = {}
    for r in rows:
        by_length.setdefault(r["length"], []).append(r)
    table = {k: {c: np.array([r[c] for r in v], np.int64) for c in v[0]} for k, v in by_length.items()}
    sent = spark.sparkContext.broadcast(table)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                t = sent.value[int(x)]
                k = np.searchsorted(t["low"], rank[at], "right") - 1
                nth = rank[at] - t["low"][k]
                seq[at] = t["base"][k] + nth // t["each"][k]
                off[at] = t["offset"][k] + nth % t["each"][k] * x
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    ranked = p.join(shift, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "before")
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
