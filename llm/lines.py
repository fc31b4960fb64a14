"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence a connected group.

A line's normal form has lower-case ASCII letters, 0 for digits and single spaces for all other ASCII. Its SimHash has
BLOCKS blocks of 24 bits; a word's hash names the block whose bits it votes on, so that a changed word disturbs two
blocks at most and leaves the others bit for bit. Words of up to three bytes have no vote where FEATURES longer ones
are there; words of more than LONG bytes, as in scripts without spaces, count by their runs of GRAM bytes that begin
with a character. A block's weight is what its distinct words weigh, WORD each; a word of
fewer bytes as many as it has, or 1 in a line of RICH longer ones or more. Two normal
forms link when they are equal, or when two blocks of weight enough (see keys) agree and their edit similarity (1 - distance /
longer length) is 0.75 or more, both having FUZZY_CHARS characters. A word that a line repeats weighs once, so what two lines
have in common is never one frequent word and an empty block. By the pigeonhole
principle lines that differ in BLOCKS - 2 blocks at most meet in one of the 15 keys of two blocks, 48 bits each.
Of each connected group the occurrence with the smallest (doc_id, text digest, line number) stays.

Every line with a word is judged, whatever its length. Equal lines are told by 128 bits of digests. They are summed up
in each task before anything moves, so a line that a third of the documents hold is one row a task. Keys of few lines
give their pairs at once; in others the first line is held against the rest, and only what stays apart meets pairwise.
Only lines that are repeated or meet another line travel with their text.

A null text stays null and has no lines; an empty text is one empty line, which stays. A null doc_id is last in order.
Rows are told apart by doc_id and a digest of the text, so different texts under one doc_id, or none, are documents of
their own; rows that are equal in both get the same verdict line by line. Extra columns pass through deduplicated(),
whatever their names, and are ignored by the query. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import PACKED, PACKED_ARROW, Packer, batches, bucket_links, fragments, fresh, mixed, positional, same, saved, small, texts, token_pairs
from llm.urls import bloom, probed

BLOCKS, NOT_ALIKE = 6, 4  # distance * NOT_ALIKE <= longer length
FEATURES = 8
#: Characters that unequal lines need to link.
FUZZY_CHARS = 5
LONG, GRAM = 32, 9
#: A word's weight, at most; that of a key's two blocks: WEIGHT, or two thirds of a light line's, but never one word's.
WORD, WEIGHT = 4, 8
#: Words of WORD bytes or more that make a line's shorter ones weigh 1.
RICH = 3
LAST = (1 << 63) - 1
#: Lines are sent on when so many bytes of them are held.
HELD = 16 << 20
#: Line ends stay, so that a whole text can be put in normal form at once.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 10 else 48 if 48 <= c <= 57 else 32 for c in range(256))


def normal_forms(text: bytes) -> list[bytes]:
    """The normal form of each line of a text; of lines without a word, nothing."""
    text = text.translate(_NORMAL)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


#: A byte's bits as bytes of a word of 64 bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


#: Powers of an odd number and of its inverse, modulo 2 ** 64.
_STRETCH, _ODD = 1 << 19, 0x9E3779B97F4A7C15
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_STRETCH, _ODD, np.uint64)])
_INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_STRETCH, pow(_ODD, -1, 1 << 64), np.uint64)])
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each word b[start:stop], of LONG bytes at most: what a polynomial adds up to between its ends."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        lo = start[at]
        end = max(int(np.searchsorted(stop, lo + _STRETCH)), at + 1)
        part = b[lo : stop[end - 1]]
        total = np.r_[np.uint64(0), np.cumsum(_VALUE[part] * _POWER[: len(part)], dtype=np.uint64)]
        x, y = start[at:end] - lo, stop[at:end] - lo
        out[at:end] = mixed((total[y] - total[x]) * _INVERSE[x])
        at = end
    return out


def simhashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each normal form the blocks of its SimHash, bit by bit what most words of the block have, and their weights."""
    values, weights = np.zeros((len(bodies), BLOCKS), np.uint32), np.zeros((len(bodies), BLOCKS), np.int64)
    at = 0
    while at < len(bodies):
        end, n = at, 0
        while end < len(bodies) and (n < _STRETCH or end == at):
            n += len(bodies[end]) + 1
            end += 1
        values[at:end], weights[at:end] = _simhashes(bodies[at:end])
        at = end
    return values, weights


def grams(b: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where a long word's runs of GRAM bytes start: at each character with as many bytes left."""
    return start + np.flatnonzero((b[start : stop - GRAM + 1] & 0xC0) != 0x80)


def _simhashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    stop = np.flatnonzero((b == 32) | (b == 10))
    start = np.r_[0, stop[:-1] + 1]
    line = np.r_[0, np.cumsum(b[stop[:-1]] == 10)]
    long = np.flatnonzero(stop - start > LONG)
    if len(long):
        first = [grams(b, start[i], stop[i]) for i in long]
        owner = np.repeat(line[long], [len(x) for x in first])
        rest = np.flatnonzero(stop - start <= LONG)
        first = np.concatenate(first)
        start, stop, line = np.r_[start[rest], first], np.r_[stop[rest], first + GRAM], np.r_[line[rest], owner]
        order = np.argsort(start)
        start, stop, line = start[order], stop[order], line[order]
    use = stop - start > 3
    use |= (np.bincount(line[use], minlength=len(bodies)) < FEATURES)[line]
    start, stop, line = start[use], stop[use], line[use]
    h = word_hashes(b, start, stop)
    key = line * BLOCKS + ((h >> np.uint64(40)) % np.uint64(BLOCKS)).astype(np.int64)
    # one sort of numbers: line and block, the word's hash, and its weight in the last bits
    # where a line has some long words, short ones, which most lines have, hardly tell it from others
    size = stop - start
    rich = np.bincount(line[size >= WORD], minlength=len(bodies)) >= RICH
    weight = (np.where(rich[line] & (size < WORD), 1, np.minimum(size, WORD)) - 1).astype(np.uint64)
    apart = np.sort(key.astype(np.uint64) << np.uint64(42) | (h & np.uint64((1 << 40) - 1)) << np.uint64(2) | weight)
    key, first, h = (apart >> np.uint64(42)).astype(np.int64), same(apart >> np.uint64(2)), apart >> np.uint64(2)
    weight = (apart[first] & np.uint64(3)).astype(np.int64) + 1
    bits = _SPREAD[h.view(np.uint8).reshape(-1, 8)[:, :3]]
    cut = same(key)
    size = np.diff(np.r_[cut, len(key)])
    ones = np.add.reduceat(bits, cut, axis=0).view(np.uint8).reshape(-1, 24).astype(np.int32)  # eight counters in each 64 bits
    for i in np.flatnonzero(size > 255):
        ones[i] = bits[cut[i] : cut[i] + size[i]].view(np.uint8).reshape(-1, 24).sum(0, dtype=np.int32)
    won = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").astype(np.uint32)
    values = np.zeros(len(bodies) * BLOCKS, np.uint32)
    weights = np.bincount(key[first], weight, len(values)).astype(np.int64)
    values[key[cut]] = won[:, 0] | won[:, 1] << 8 | won[:, 2] << 16
    return values.reshape(-1, BLOCKS), weights.reshape(-1, BLOCKS)


def sim_columns(values: np.ndarray, weights: np.ndarray) -> list[pa.Array]:
    """Two blocks and their weights, 100 at most, in each of three longs."""
    w = np.minimum(weights, 100)
    return [pa.array(values[:, i].astype(np.int64) | values[:, i + 1].astype(np.int64) << 24 | w[:, i] << 48 | w[:, i + 1] << 55) for i in (0, 2, 4)]


def sim_blocks(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = [x >> s & 0xFFFFFF for x in columns for s in (0, 24)]
    weights = [x >> s & 0x7F for x in columns for s in (48, 55)]
    return np.stack(values, 1).astype(np.uint64), np.stack(weights, 1)


def aligned(a: str, b: str, most: int) -> bool:
    """Whether a simple edit script of most edits or fewer is at hand: words in common stay, what lies between is replaced."""
    x, y, i, j, cost = a.split(" "), b.split(" "), 0, 0, 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        at = next(((u, d - u) for d in range(1, 9) for u in range(d + 1) if i + u < n and j + d - u < m and x[i + u] == y[j + d - u]), None)
        if at is None:
            break
        u, v = at
        cost += max(sum(map(len, x[i : i + u])) + u, sum(map(len, y[j : j + v])) + v)
        if cost > most:
            return False
        i, j = i + u, j + v
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


def distant(a: str, b: str, most: int) -> bool:
    """Whether runs of three characters tell that the edit distance is above most: an edit disturbs three of them."""
    n: dict[str, int] = {}
    for i in range(len(a) - 2):
        g = a[i : i + 3]
        n[g] = n.get(g, 0) + 1
    gone = 0
    for i in range(len(b) - 2):
        g = b[i : i + 3]
        k = n.get(g, 0)
        if k:
            n[g] = k - 1
        else:
            gone += 1
    return max(gone, gone + len(a) - len(b)) > 3 * most


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is most or less: quick answers where there are some, else Myers' bit vectors."""
    if abs(len(a) - len(b)) > most:
        return False
    if aligned(a, b, most):
        return True
    if distant(a, b, most):
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1) if a else 0, len(a)
    up, down = full, 0
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        h_up, h_down = down | (full & ~(d | up)), up & d
        score += bool(h_up & last) - bool(h_down & last)
        if score - (len(b) - 1 - j) > most:
            return False
        h_up, h_down = (h_up << 1 | 1) & full, h_down << 1 & full
        up, down = h_down | (full & ~(x | h_up)), h_up & x
    return score <= most


#: Shorter lines of at most so many characters have their distances computed side by side, in words of 64 bits.
BESIDE = 256
#: Pairs that are compared at a time.
BATCH = 10_000
#: Columns after which pairs that are known to be apart are left out.
STEP = 8


def units(lines: list[str]) -> np.ndarray:
    """The lines' characters one after another, as numbers of as few bytes as hold them all."""
    u = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(u.max(initial=0))
    return u.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def table(u: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Lines of these sizes as rows of width characters, with zeros behind."""
    out = np.zeros((len(size), width), u.dtype)
    out[np.arange(width) < size[:, None]] = u
    return out


def beside(short: list[str], long: list[str], most: np.ndarray) -> np.ndarray:
    """For each pair, whether its edit distance is most or less: Myers' bit vectors, one row a pair and 64 of its
    characters, all pairs column by column. The shorter lines of all pairs fill equally many words of 64 bits."""
    m, n = np.array([len(x) for x in short]), np.array([len(x) for x in long])
    width = -(-int(m.max()) // 64)
    order = np.argsort(-n, kind="stable")  # lines that have ended are the last ones
    both = units([short[i] for i in order] + [long[i] for i in order])
    m, n, most = m[order], n[order], most[order]
    x, y = table(both[: m.sum()], m, 64 * width), table(both[m.sum() :], n, int(n[0])).T.copy()
    one, top = np.uint64(1), np.uint64(63)
    last = one << ((m - 1) % 64).astype(np.uint64)
    up, down = np.full((width, len(m)), ~np.uint64(0)), np.zeros((width, len(m)), np.uint64)
    score, at, ok = m.copy(), np.arange(len(m)), np.zeros(len(m), bool)
    for j in range(int(n[0])):
        if j % STEP == 0:
            stay = score - np.maximum(n - j, 0) <= most
            ended = n <= j
            ok[at[ended & stay]] = True
            stay &= ~ended
            if not stay.any():
                return ok[np.argsort(order)]
            if not stay.all():
                x, y, m, n, most, last, score, at = x[stay], y[:, stay], m[stay], n[stay], most[stay], last[stay], score[stay], at[stay]
                up, down = up[:, stay], down[:, stay]
        k = int(np.searchsorted(-n, -j, "left"))  # pairs whose longer line has a character here
        eqs = np.packbits((x[:k] == y[j, :k, None]).ravel(), bitorder="little").view(np.uint64).reshape(k, width)
        more, less = np.full(k, one), np.zeros(k, np.uint64)
        for w in range(width):
            eq, u, d = eqs[:, w], up[w, :k], down[w, :k]
            v = eq | d
            eq = eq | less
            h = (((eq & u) + u) ^ u) | eq
            h_up, h_down = d | ~(h | u), u & h
            if w == width - 1:
                score[:k] += ((h_up & last[:k]) != 0).astype(np.int64) - ((h_down & last[:k]) != 0)
            h_up, more = h_up << one | more, h_up >> top
            h_down, less = h_down << one | less, h_down >> top
            up[w, :k], down[w, :k] = h_down | ~(v | h_up), h_up & v
    ok[at] = score <= most
    return ok[np.argsort(order)]


def within_all(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair of lines, whether it has the edit similarity that links them."""
    m, n = np.array([len(s) for s in a], np.int64), np.array([len(s) for s in b], np.int64)
    least, most = np.minimum(m, n), np.maximum(m, n) // NOT_ALIKE
    ok = np.zeros(len(a), bool)
    near = np.abs(m - n) <= most
    ok[near & (least == 0)] = True
    words = -(-least // 64)
    # where distances cost more, an edit script that is at hand first
    for i in np.flatnonzero(near & (words > 1) & (words <= BESIDE // 64)).tolist():
        ok[i] = aligned(a[i], b[i], int(most[i]))
    near &= ~ok
    for w in range(1, BESIDE // 64 + 1):
        at = np.flatnonzero(near & (words == w))
        if len(at):
            pairs = [(a[i], b[i]) if m[i] <= n[i] else (b[i], a[i]) for i in at.tolist()]
            ok[at] = beside([s for s, _ in pairs], [t for _, t in pairs], most[at])
    for i in np.flatnonzero(near & (words > BESIDE // 64)).tolist():
        ok[i] = within(a[i], b[i], int(most[i]))
    return ok


LINES = "line long, twin long, s0 long, s1 long, s2 long, size int, n long, doc long, dig long, no int, docs binary, digs binary, nos binary, body string"
LINES_ARROW = pa.schema([("line", pa.int64()), ("twin", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("doc", pa.int64()), ("dig", pa.int64()), ("no", pa.int32()), ("docs", pa.binary()), ("digs", pa.binary()), ("nos", pa.binary()), ("body", pa.string())])


def lines(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """docs (doc, dig, text) to one row a task and distinct line: its two hashes, SimHash, size, count, first occurrence.

    only: a filter of line hashes; then their occurrences and normal forms come along instead of the SimHash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = sent.value
        full = passed is not None

        def rows(found: dict[bytes, list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            every = list(found)
            at = 0
            while at < len(every):
                end, n = at, 0
                while end < len(every) and end - at < 2000 and (n < 4 << 20 or end == at):
                    n += len(every[end]) + (20 * len(found[every[end]]) if full else 0)
                    end += 1
                bodies, at = every[at:end], end
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, bodies), np.uint64, len(bodies))
                if full:
                    keep = np.flatnonzero(probed(passed, h))
                    bodies, h = [bodies[i] for i in keep], h[keep]
                if not bodies:
                    continue
                text = pa.array(bodies, pa.binary()).cast(pa.string())
                places = [found[b] for b in bodies]
                first = [min(p) for p in places]
                none = [b""] * len(bodies)
                zero = pa.array(np.zeros(len(bodies), np.int64))
                packed = [pa.array([np.array([x[i] for x in p], t).tobytes() for p in places] if full else none, pa.binary()) for i, t in ((0, np.int64), (1, np.int64), (2, np.int32))]
                cols = [
                    pa.array(h.view(np.int64)),
                    pa.array(np.fromiter(map(xxhash.xxh64_intdigest, bodies), np.uint64, len(bodies)).view(np.int64)),
                    *([zero] * 3 if full else sim_columns(*simhashes(bodies))),
                    pa.compute.utf8_length(text),
                    pa.array([len(p) for p in places], pa.int64()),
                    *(pa.array([p[i] for p in first], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))),
                    *packed,
                    text if full else pa.array([""] * len(bodies)),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=LINES_ARROW)

        found: dict[bytes, list[tuple[int, int, int]]] = {}
        held = 0
        for b in small(it):
            for doc, dig, text in zip(b.column("doc").to_pylist(), b.column("dig").to_pylist(), texts(b), strict=True):
                for no, body in enumerate(normal_forms(text or b"")):
                    if body:
                        if (at := found.get(body)) is None:
                            found[body] = [(doc, dig, no)]
                            held += len(body) + 300
                        else:
                            at.append((doc, dig, no))
                            held += 100
                if held > HELD:
                    yield from rows(found)
                    found, held = {}, 0
        yield from rows(found)

    return docs.mapInArrow(run, LINES)


_PAIRS = list(combinations(range(BLOCKS), 2))


def keys(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each SimHash a key for every choice of two blocks, and whether these weigh enough: WEIGHT, or two thirds of the
    whole line if that is less, but more than one word."""
    least = np.clip(-(-2 * weights.sum(1) // 3), WORD + 1, WEIGHT)
    both = [mixed((values[:, i] | values[:, j] << np.uint64(24)) ^ mixed(np.array([k + 1], np.uint64))) for k, (i, j) in enumerate(_PAIRS)]
    return np.stack(both, 1), np.stack([weights[:, i] + weights[:, j] >= least for i, j in _PAIRS], 1)


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.int64), b.astype(np.int64)
    return (np.minimum(a, b) >= FUZZY_CHARS) & (np.abs(a - b) * NOT_ALIKE <= np.maximum(a, b))


def meetings(distinct: DataFrame, parts: int) -> DataFrame:
    """(bucket, id, other): pairs of lines that share a key, or lines and their key where many share it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts, positions=True)

        def rows() -> Iterator[dict]:
            for b in it:
                key, ok = keys(*sim_blocks([b.column(c).to_numpy() for c in ("s0", "s1", "s2")]))
                cut = np.cumsum(ok.sum(1))[:-1]
                size = np.repeat(b.column("size").to_numpy().astype(np.uint32), ok.sum(1))
                for line, k, s in zip(b.column("line").to_pylist(), np.split(key[ok], cut), np.split(size, cut), strict=True):
                    if len(k) and packer.add(line, k, s):
                        yield from packer.rows()
            yield from packer.rows()

        yield from batches(rows(), PACKED_ARROW)

    return token_pairs(distinct.where(f"size >= {FUZZY_CHARS}").select("line", "s0", "s1", "s2", "size").mapInArrow(run, PACKED), similar_sizes)


#: What linked lines of one key fulfil; the rest is up to the distance.
NEAR = f"abs({{a}}.size - {{b}}.size) * {NOT_ALIKE} <= greatest({{a}}.size, {{b}}.size)"


def alike(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """Of near pairs (a, b) of lines those that link. forms: (line, body)."""
    x, y = (forms.select(F.col("line").alias(s), F.col("body").alias(f"body_{s}")) for s in "ab")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, t = ([x for b in held for x in b.column(c).to_pylist()] for c in ("body_a", "body_b"))
            ok, at = within_all(s, t), 0
            for b in held:
                yield b.select(["a", "b"]).filter(pa.array(ok[at : at + b.num_rows], pa.bool_()))
                at += b.num_rows

        held, rows, size = [], 0, 0
        for b in it:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= BATCH or size >= 4 << 20:
                yield from linked(held)
                held, rows, size = [], 0, 0
        yield from linked(held)

    # many small tasks: what costs is the distances, not the bytes that partitions would be made from
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    return pairs.join(x, "a").repartition(parts, "b").join(y, "b").select("a", "b", "body_a", "body_b").mapInArrow(check, "a long, b long")


def removals(docs: DataFrame) -> DataFrame:
    """docs (doc, dig, text) to (doc, dig, nos array<int>): the lines that go, numbered from 0."""
    spark = docs.sparkSession
    parts = fragments(spark)
    distinct = saved(lines(docs).groupBy("line", "twin").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("s0", "s1", "s2", "size"))), "lines")
    met = saved(meetings(distinct, parts), "meetings")
    pairs = met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    members = met.where("other is null").select("bucket", "id").distinct().join(distinct.groupBy(F.col("line").alias("id")).agg(F.max("size").alias("size")), "id")
    lone = saved(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(members.select("id")).distinct(), "met")
    wanted = distinct.where("n > 1").select("line").union(lone).distinct()
    held = saved(lines(docs, bloom(wanted, F.col("line"))), "held")
    forms = saved(held.join(lone, "line", "left_semi").groupBy("line").agg(F.min("body").alias("body")), "forms")
    members = members.select("bucket", "id", F.xxhash64("id", F.lit(1)).cast("double").alias("first"), "size")
    comps = bucket_links(members, NEAR, lambda p: alike(p, forms), "lines", trim=False, pairs=pairs)
    first = held.groupBy("line", "twin").agg(F.min(F.struct("doc", "dig", "no")).alias("f"), F.sum("n").alias("n"))
    first = first.join(comps.withColumnRenamed("id", "line"), "line", "left")
    # lines without links are groups of their own, told by both hashes
    first = first.withColumn("other", F.when(F.col("comp").isNull(), F.col("twin")).otherwise(F.lit(0))).withColumn("comp", F.coalesce("comp", "line"))
    top = first.groupBy("comp", "other").agg(F.min("f").alias("keep"), F.sum("n").alias("total")).where("total > 1")
    judged = first.join(top, ["comp", "other"]).select("line", "twin", *(F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("doc", "dig", "no")))

    def others(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            gone = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
            for docs_, digs, nos, kd, kg, kn in zip(*(b.column(c).to_pylist() for c in ("docs", "digs", "nos", "keep_doc", "keep_dig", "keep_no")), strict=True):
                d, g, n = np.frombuffer(docs_, np.int64), np.frombuffer(digs, np.int64), np.frombuffer(nos, np.int32)
                go = (d != kd) | (g != kg) | (n != kn)
                for x, y in zip(gone, (d, g, n), strict=True):
                    x.append(y[go])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in gone], ["doc", "dig", "no"])

    gone = held.join(judged, ["line", "twin"]).select("docs", "digs", "nos", "keep_doc", "keep_dig", "keep_no").mapInArrow(others, "doc long, dig long, no int")
    return gone.groupBy("doc", "dig").agg(F.sort_array(F.collect_set("no")).alias("nos"))


def counts_of(columns: list[str]) -> tuple[str, str]:
    """What deduplicated() calls its two counts: n_lines and n_removed, or longer names where columns have these."""
    return fresh("n_lines", columns), fresh("n_removed", columns)


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their remaining lines as text, and their numbers of lines and of removed ones added under the names of
    counts_of(); a document may end up empty."""
    plain, names = positional(docs)
    body = names[docs.columns.index(text)]
    keyed = plain.withColumn("doc", F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit(LAST))).withColumn("dig", F.xxhash64(body))
    gone = removals(keyed.select("doc", "dig", F.col(body).alias("text")))
    both = keyed.join(gone.hint("shuffle_hash"), ["doc", "dig"], "left").select(*names, "nos")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            left, sizes, drops = [], [], []
            for t, nos in zip(texts(b, body), b.column("nos").to_pylist(), strict=True):
                n = 0 if t is None else t.count(b"\n") + 1
                go = set(nos or ())
                sizes.append(n)
                drops.append(len(go))
                left.append(t if not go else b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in go))
            out = {c: b.column(c) for c in names} | {body: pa.array(left, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(sizes, pa.int64()), pa.array(drops, pa.int64())], [*names, "n_lines", "n_removed"])

    kinds = ", ".join(f"{c} {k}" for c, k in plain.dtypes)
    return both.mapInArrow(cut, f"{kinds}, n_lines long, n_removed long").toDF(*docs.columns, *counts_of(docs.columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
