"""Suffix-array dedup: removes every byte that a long string, seen earlier, covers, by bucket-pointer refinement.

Bucket-pointer refinement puts the positions of a fragment of the corpus in order: they are sorted into buckets of their
first Q bytes, a position's pointer is where its bucket begins, and buckets of two positions or more are refined by
sorting their positions on the pointers at a later offset. Each round reuses the pointers that the one before updated,
at offsets of 4, 8, 16 and 32 bytes and then 36, after which positions share a bucket if and only if LENGTH bytes are
equal, byte by byte. Positions alone in their bucket are settled and never sorted again.

Fragments bring together whatever may be equal. In every window of LENGTH bytes the GRAM bytes with the least hash are the
window's anchor; equal windows have equal anchors at equal offsets. Anchors are counted over the corpus, in packed
fragments; a window whose anchor stands alone is unique and goes no further. Of the others, runs of windows travel
with their text to the fragment of their anchor, where windows in one bucket are sorted by (doc_id, start): all but the
first repeat. Anchors that many documents share would gather in one fragment, so their windows are dealt by hashes of
their own, 128 bits that stand for their bytes, and merged in each task before: a task sends one entry a bucket, however
many documents of it hold the passage.

Whole copies of an earlier text are settled by a digest of the text. Texts never join across documents. A null or
empty text has no bytes, nothing is removed from texts shorter than LENGTH. Rows with a null doc_id take no part:
nothing of theirs is removed and nothing of others for them. Repeated rows of a doc_id get equal results; if texts
differ under one doc_id, the one with the least digest takes part, the others keep all. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import PACKED, PACKED_ARROW, Packer, batches, bucket_of, fragments, joined, mixed, same, saved, shared_tokens, small, spans, texts
from llm.urls import bloom, may_hold

LENGTH, GRAM, Q = 100, 32, 4
#: Fragments of windows for each one of anchors, as windows take more memory.
FINER = 8
#: Texts are scanned in stretches of so many bytes.
STRETCH = 1 << 18
#: Anchors with so many entries are dealt by their windows.
HOT = 200
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM bytes and of the LENGTH bytes at every position that has them."""
    if len(b) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, size = _BYTES[b], 1
    for step in _STEPS[:5]:  # 2, 4, 8, 16, 32
        h = h[: len(h) - size] * step + h[size:]
        size *= 2
        h ^= h >> np.uint64(31)
    gram = mixed(h)
    h = gram[: len(gram) - size] * _STEPS[5] + gram[size:]  # 64
    h ^= h >> np.uint64(29)
    later = LENGTH - 64
    return gram, mixed(h[: len(h) - later] * _STEPS[6] + h[later:])


def second(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Other hashes of the LENGTH bytes at some positions."""
    h = gram[at + LENGTH - GRAM]
    for i, step in ((2, _STEPS[0]), (1, _STEPS[1]), (0, _STEPS[2])):
        h = mixed(h * step + gram[at + i * GRAM])
    return h


def pointers(b: np.ndarray) -> np.ndarray:
    """Bucket pointers of every position that has LENGTH bytes: equal where these are equal."""
    n = len(b) - Q + 1
    if len(b) < LENGTH:
        return np.zeros(0, np.uint32)
    key = np.zeros(n, np.uint64)
    for i in range(Q):
        key = key << np.uint64(8) | b[i : i + n]
    # positions are sorted along with their keys where both fit in 64 bits, which is faster than sorting numbers of keys
    half, bits = np.uint64(32), np.uint64(len(b).bit_length())
    key = np.sort(key << half | np.arange(n, dtype=np.uint64))
    live, key = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), key >> half
    begin = same(key)
    size = np.diff(np.r_[begin, n])
    pointer = np.empty(n, np.uint32)
    pointer[live] = np.repeat(begin, size).astype(np.uint32)
    live, depth = live[np.repeat(size > 1, size)], Q
    while depth < LENGTH:
        offset = min(depth, LENGTH - depth)
        depth += offset
        n = len(b) - depth + 1
        pointer, later_ones = pointer[:n], pointer[offset:]
        live = live[live < n]
        if 3 * bits <= 64:
            key = np.sort((pointer[live].astype(np.uint64) << bits | later_ones[live]) << bits | live)
            live, key = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.uint32), key >> bits
        else:
            bits = half
            key = pointer[live].astype(np.uint64) << bits | later_ones[live]
            order = np.argsort(key)
            live, key = live[order], key[order]
        cut = same(key)
        size = np.diff(np.r_[cut, len(key)])
        bucket = (key[cut] >> bits).astype(np.int64)
        whole = same(bucket)
        before = cut - np.repeat(cut[whole], np.diff(np.r_[whole, len(cut)]))
        pointer = pointer.copy()
        pointer[live] = np.repeat(bucket + before, size).astype(np.uint32)
        live = live[np.repeat(size > 1, size)]
    return pointer


def anchors(gram: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the position of its least GRAM-byte identifier, the leftmost of equals."""
    width, reach = LENGTH - GRAM + 1, 1
    best, at = gram, np.arange(len(gram), dtype=np.int64)
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        reach += step
    return at


def stretches(rows: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to stretches: the bytes, which windows lie in one text, their text's number and its start."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (size < STRETCH or end == at):
            size += len(rows[end][1])
            end += 1
        part = rows[at:end]
        b = np.frombuffer(b"".join(t for _, t in part), np.uint8)
        sizes = np.array([len(t) for _, t in part], np.int64)
        starts = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(at, end), sizes)
        n = max(len(b) - LENGTH + 1, 0)
        whole = number[:n] == number[len(b) - n :] if n else np.zeros(0, bool)
        yield b, whole, number[:n], np.repeat(starts, sizes)[:n]
        at = end


def _documents(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    for b in small(it):
        yield [(d, t) for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True) if t and len(t) >= LENGTH]


def anchored(docs: DataFrame, parts: int) -> DataFrame:
    """Every text's anchors, packed by fragment; mixed anew, as anchors are small by choice."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, positions=True)

        def rows() -> Iterator[dict]:
            for docs in _documents(it):
                for b, whole, number, starts in stretches(docs):
                    gram, _ = hashes(b)
                    if not len(gram):
                        continue
                    ok = np.flatnonzero(whole)
                    at = anchors(gram)[ok]
                    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1])]) if len(at) else at
                    at, num, st = at[first], number[ok[first]], starts[ok[first]]
                    for a, z in spans(num):
                        if packer.add(docs[num[a]][0], mixed(gram[at[a:z]]), at[a:z] - st[a]):
                            yield from packer.rows()
            yield from packer.rows()

        yield from batches(rows(), PACKED_ARROW)

    return docs.mapInArrow(run, PACKED)


def per_document(table: pa.Table) -> pa.Table:
    """Of rows packed by owner: (doc_id, pos, hot), the positions of each, sorted, and whether the anchor there is hot."""
    own, pos, mark = joined(table.column("owners"), np.int64), joined(table.column("pos"), np.uint32), joined(table.column("mark"), np.uint8)
    order = np.lexsort((pos, own))
    own, pos, hot = own[order], pos[order], (mark[order] >= HOT).astype(np.uint8)
    new = np.r_[True, (own[1:] != own[:-1]) | (pos[1:] != pos[:-1])] if len(own) else np.zeros(0, bool)
    own, pos, hot = own[new], pos[new], hot[new]
    cuts = spans(own)
    return pa.table({"doc_id": own[same(own)], **{c: pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for c, x in (("pos", pos), ("hot", hot))}})


REGIONS = "frag int, owners binary, pos binary, sizes binary, body binary"
REGIONS_ARROW = pa.schema([("frag", pa.int32()), ("owners", pa.binary()), ("pos", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
RUNS = "frag int, owners binary, start binary, stop binary"
RUNS_ARROW = pa.schema([("frag", pa.int32()), ("owners", pa.binary()), ("start", pa.binary()), ("stop", pa.binary())])


def runs_of(own: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[dict]:
    """Repeated windows as rows of runs [start, stop) of window starts, by the owners' buckets."""
    if not len(own):
        return
    order = np.lexsort((pos, own))
    own, pos = own[order], pos[order].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (pos[1:] > pos[:-1] + 1)])
    stop = pos[np.r_[new[1:], len(pos)] - 1] + 1
    own, start = own[new], pos[new]
    b = bucket_of(own, parts)
    order = np.argsort(b, kind="stable")
    b, own, start, stop = b[order], own[order], start[order], stop[order]
    for a, z in spans(b):
        yield {"frag": int(b[a]), "owners": own[a:z].tobytes(), "start": start[a:z].astype(np.uint32).tobytes(), "stop": stop[a:z].astype(np.uint32).tobytes()}


def classes(key: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both hashes are."""
    order = np.lexsort((twin, key))
    k, t = key[order], twin[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])][: len(key)])
    return out


def later(key: np.ndarray, own: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the entries that are not the first of their bucket by (owner, position), and of those that are."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    cuts = same(k)
    size = np.diff(np.r_[cuts, len(k)])
    single = order[cuts[size == 1]]
    many = order[np.repeat(size > 1, size)]
    many = many[np.lexsort((pos[many], own[many], key[many]))]
    first = np.zeros(len(many), bool)
    first[same(key[many])] = True
    return many[~first], np.concatenate([many[first], single])


def regions(flagged: DataFrame, parts: int) -> DataFrame:
    """Windows that may repeat: REGIONS rows by their anchor's fragment; sizes empty for windows dealt by their own hash (body:
    their hashes, then their second ones), and body empty for windows that are known to repeat (frag is -1 less the owner's bucket)."""
    shift = np.uint64(64 - ((parts * FINER).bit_length() - 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known(own: np.ndarray, pos: np.ndarray) -> Iterator[dict]:
            for r in runs_of(own, pos, parts):
                yield {"frag": -1 - r["frag"], "owners": r["owners"], "pos": r["start"], "sizes": r["stop"], "body": b""}

        def hot_rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[dict]:
            key, twin, own, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            again, first = later(classes(key, twin), own, pos)
            yield from known(own[again], pos[again])
            first = first[np.argsort(key[first])]
            key, twin, own, pos = key[first], twin[first], own[first], pos[first]
            f = (key >> shift).astype(np.int64)
            for a, z in spans(f):
                yield {"frag": int(f[a]), "owners": own[a:z].tobytes(), "pos": pos[a:z].astype(np.uint32).tobytes(), "sizes": b"", "body": key[a:z].tobytes() + twin[a:z].tobytes()}

        def region_rows(held: dict[int, list]) -> Iterator[dict]:
            for f, found in held.items():
                # equal runs of this task: the first stays, the others repeat it
                first: dict[bytes, tuple[int, int, int]] = {}
                again = [x[:3] for x in sorted(found, key=lambda x: x[:2]) if first.setdefault(x[3], x[:3]) != x[:3]]
                if again:
                    n = [x[2] for x in again]
                    step = np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
                    yield from known(np.repeat([x[0] for x in again], n), np.repeat([x[1] for x in again], n) + step)
                keep = list(first.items())
                yield {"frag": f, "owners": np.array([v[0] for _, v in keep], np.int64).tobytes(), "pos": np.array([v[1] for _, v in keep], np.uint32).tobytes(), "sizes": np.array([v[2] for _, v in keep], np.uint32).tobytes(), "body": b"".join(k for k, _ in keep)}

        def rows() -> Iterator[dict]:
            hot_held, hot_size, held, size = [], 0, {}, 0
            for batch in small(it):
                docs = list(zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True))
                marks = [(np.frombuffer(p, np.uint32).astype(np.int64), np.frombuffer(h, np.uint8)) for p, h in zip(batch.column("pos").to_pylist(), batch.column("hot").to_pylist(), strict=True)]
                for b, whole, number, starts in stretches(docs):
                    gram, full = hashes(b)
                    if not len(gram):
                        continue
                    # 1: an anchor that others share, 2: one that very many share
                    state = np.zeros(len(gram), np.uint8)
                    for k in np.unique(number):
                        s = starts[np.searchsorted(number, k)]
                        p, h = marks[k]
                        ok = p + s < len(state)
                        state[(p + s)[ok]] = 1 + h[ok]
                    at = anchors(gram)
                    kind = np.where(whole, state[at], 0)
                    own = np.array([d for d, _ in docs], np.int64)[number]
                    hot = np.flatnonzero(kind == 2)
                    if len(hot):
                        hot_held.append((full[hot], second(gram, hot), own[hot], hot - starts[hot]))
                        hot_size += len(hot)
                        if hot_size >= 600_000:
                            yield from hot_rows(hot_held)
                            hot_held, hot_size = [], 0
                    w = np.flatnonzero(kind == 1)
                    if len(w):
                        cut = np.flatnonzero(np.r_[True, (at[w[1:]] != at[w[:-1]]) | (w[1:] != w[:-1] + 1)])
                        stop = w[np.r_[cut[1:], len(w)] - 1] + 1
                        first = w[cut]
                        frag = (mixed(gram[at[first]]) >> shift).astype(np.int64).tolist()
                        raw = b.tobytes()
                        for f, o, s, p, e in zip(frag, own[first].tolist(), first.tolist(), (first - starts[first]).tolist(), stop.tolist(), strict=True):
                            held.setdefault(f, []).append((o, p, e - s, raw[s : e - 1 + LENGTH]))
                            size += e - s + LENGTH
                        if size >= 8 << 20:
                            yield from region_rows(held)
                            held, size = {}, 0
            if hot_held:
                yield from hot_rows(hot_held)
            yield from region_rows(held)

        yield from batches(rows(), REGIONS_ARROW)

    return flagged.mapInArrow(run, REGIONS)


def repeated(sent: DataFrame, parts: int) -> DataFrame:
    """RUNS of the windows that are not the first of their bucket."""

    def packed(rows: list[dict], name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join([r[name] for r in rows]), kind)

    def fragment(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["frag"] < 0:
            return pa.Table.from_pylist([{"frag": -1 - r["frag"], "owners": r["owners"], "start": r["pos"], "stop": r["sizes"]} for r in rows], RUNS_ARROW)
        hot, cold = [r for r in rows if not r["sizes"]], [r for r in rows if r["sizes"]]
        found = []
        if hot:
            key, twin = np.concatenate([np.frombuffer(r["body"], np.uint64).reshape(2, -1) for r in hot], axis=1)
            own, pos = packed(hot, "owners", np.int64), packed(hot, "pos", np.uint32).astype(np.int64)
            again, _ = later(classes(key, twin), own, pos)
            found += runs_of(own[again], pos[again], parts)
        if cold:
            n = packed(cold, "sizes", np.uint32).astype(np.int64)
            body = packed(cold, "body", np.uint8)
            start = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = pointers(body)[np.repeat(start, n) + step]
            own, pos = np.repeat(packed(cold, "owners", np.int64), n), np.repeat(packed(cold, "pos", np.uint32).astype(np.int64), n) + step
            again, _ = later(key, own, pos)
            found += runs_of(own[again], pos[again], parts)
        return pa.Table.from_pylist(found, RUNS_ARROW)

    return sent.groupBy("frag").applyInArrow(fragment, RUNS)


def gathered(table: pa.Table) -> pa.Table:
    """Of RUNS rows: (doc_id, start, stop), each document's runs sorted by start."""
    own, start, stop = joined(table.column("owners"), np.int64), joined(table.column("start"), np.uint32), joined(table.column("stop"), np.uint32)
    order = np.lexsort((start, own))
    own, start, stop = own[order], start[order], stop[order]
    cuts = spans(own)
    return pa.table({"doc_id": own[same(own)], **{c: pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for c, x in (("start", start), ("stop", stop))}})


def cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, n_removed, n_spans, kept) of texts and their runs: a run covers from its start to LENGTH - 1 beyond its last window's."""
    for b in small(it):
        out = []
        for d, g, t, s, e in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), texts(b), b.column("start").to_pylist(), b.column("stop").to_pylist(), strict=True):
            start, stop = np.frombuffer(s, np.uint32).astype(np.int64), np.frombuffer(e, np.uint32).astype(np.int64) + LENGTH - 1
            reach = np.maximum.accumulate(stop)
            new = np.r_[True, start[1:] > reach[:-1]]
            lo, hi = start[new], reach[np.r_[np.flatnonzero(new)[1:], len(start)] - 1]
            kept = b"".join(t[x:y] for x, y in zip(np.r_[0, hi].tolist(), np.r_[lo, len(t)].tolist(), strict=True))
            out.append({"doc_id": d, "digest": g, "n_removed": int((hi - lo).sum()), "n_spans": len(lo), "kept": kept})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def cleaned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) to two tables: (doc_id, digest, n_bytes, copy) of every row, copy telling whether all of it repeats;
    and (doc_id, digest, n_removed, n_spans, kept binary) of the texts that lose some part."""
    spark = docs.sparkSession
    parts = fragments(spark)
    body = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    rows = saved(docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # one text a doc_id, and of equal texts the smallest doc_id
    judged = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("digest", "n_bytes")).alias("j")).select("doc_id", "j.digest", "j.n_bytes")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    shared = shared_tokens(anchored(docs.where("doc_id is not null"), parts), parts, positions=True)
    flags = shared.groupBy("frag").applyInArrow(per_document, "doc_id long, pos binary, hot binary")
    flags = saved(flags.join(first, "doc_id"), "flags")
    # only texts with shared anchors travel; the filter has a bound, so it may let others through, which the join drops
    named = F.xxhash64("doc_id")
    likely = may_hold(spark, docs.where("doc_id is not null"), named, bloom(flags, named)).where("_hit").select("doc_id", "text")
    likely = likely.withColumn("digest", F.sha2("text", 256)).join(flags, ["doc_id", "digest"]).dropDuplicates(["doc_id"])
    flagged = saved(likely.select("doc_id", "digest", "text", "pos", "hot"), "flagged")
    runs = repeated(regions(flagged, parts), parts).groupBy("frag").applyInArrow(gathered, "doc_id long, start binary, stop binary")
    cut = flagged.select("doc_id", "digest", "text").join(runs, "doc_id").mapInArrow(cut_out, "doc_id long, digest string, n_removed long, n_spans long, kept binary")
    copies = judged.join(first.withColumnRenamed("doc_id", "least"), "digest").where(f"doc_id <> least and n_bytes >= {LENGTH}").select("doc_id", "digest", F.lit(True).alias("copy"))
    return rows.join(copies, ["doc_id", "digest"], "left").select("doc_id", "digest", "n_bytes", F.coalesce("copy", F.lit(False)).alias("copy")), cut


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cut = cut.select("doc_id", "digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.join(cut, ["doc_id", "digest"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def brute(docs: list[tuple[int, bytes]]) -> list[tuple[int, int, int, int, str]]:
    """The definition, for tests: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = []
    for d, t in sorted(docs):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - LENGTH + 1):
            w = t[s : s + LENGTH]
            if w in seen:
                gone[s : s + LENGTH] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(t)]).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out
