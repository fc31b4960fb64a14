"""Product codes of vectors whose nearest entries are found by annular norm pruning.

Components become integers floor(scale * x), vectors are cut into equal consecutive parts, and every part position has a
codebook of its own, refined by rounds of assignment and componentwise floor means. Everything is integer arithmetic, so
codes and codebooks are the same however the rows are dealt.

The nearest entry of a part is found this way: entries are sorted by norm; the entry whose norm is nearest gives a first
distance d; as |norm(x) - norm(c)| <= distance(x, c), only entries with norms from norm(x) - d to norm(x) + d, both
included, can be as near. A binary search gives that interval; of it the entry with the next nearest norm is evaluated
exactly, and the interval shrinks with the best distance until nothing in it is left. Norms are floats, so the interval
is widened by their rounding error: that can cost an evaluation, never an answer. Equal distances go to the lower index.

A round is one pass over the vectors: tasks add up the components of each entry's parts, Spark adds up the tasks' sums,
and only these parts x entries x components reach the driver. Codebooks go to the tasks as that many numbers, too.
Components of any finite size are exact: beyond what 64 bits hold distances of, rows are worked on as Python integers,
and sums travel as limbs of 30 bits. Only the column error is bounded: beyond 2^63 - 1 it is 2^63 - 1.

Rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than the longest one, or
lengths that the number of parts doesn't divide, count as filled up with zeros. Codebooks start from the rows with the
smallest distinct ids, a null id being the last; of rows with the same id the smallest vector starts. Fewer ids than
entries give smaller codebooks. Repeated rows count each. A null label is a label. An empty table, or one without a
usable vector, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMB = 30
#: Sums by label are sent to every task while there are so many at most; more of them are joined by a shuffle.
SENT_LABELS = 100_000

#: By part, by entry, the components.
Books = list[list[list[int]]]


def usable(vectors: DataFrame, id_: str, vector: str, label: str | None = None) -> DataFrame:
    """(id, label, v array<double>) of the rows with whole, finite vectors."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shown = F.col(f"`{label}`") if label else F.lit(None).cast("string")
    return vectors.where(v.isNotNull() & whole).select(F.col(f"`{id_}`").cast("long").alias("id"), shown.alias("label"), v.alias("v"))


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exact for every finite x."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def integers(b: pa.RecordBatch, dims: int, scale: int, room: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """The batch's vectors as integers, one row each; rows with components beyond room are zeros there and come apart, by row number."""
    v = b.column("v")
    sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((b.num_rows, dims))
    m[np.arange(dims) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    large = np.flatnonzero((np.abs(m) >= room / scale).any(1))
    apart = {int(i): [whole(x, scale) for x in m[i]] for i in large}
    m[large] = 0
    return np.floor(m * scale).astype(np.int64), apart


def room(width: int) -> int:
    """Components below it have distances and norms within 62 bits."""
    return math.isqrt((1 << 62) // max(1, width)) // 2 - 1


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; components below room()."""
    norms = np.sqrt((book.astype(float) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    c, cn = book[order], norms[order]
    xn = np.sqrt((x.astype(float) ** 2).sum(1))
    near = np.clip(np.searchsorted(cn, xn), 1, max(1, len(c) - 1)) - (len(c) == 1)
    near = near - ((near > 0) & (xn - cn[near - 1] <= cn[near] - xn))
    best, at = _exact(x, c[near]), order[near]
    below, above, live = near - 1, near + 1, np.arange(len(x))
    while len(live):
        n, d = xn[live], np.sqrt(best[live].astype(float))
        slack = (n + d) * 1e-9 + 1e-9
        down = below[live] >= np.searchsorted(cn, n - d - slack, "left")
        up = above[live] < np.searchsorted(cn, n + d + slack, "right")
        go = down | up
        live, n, down, up = live[go], n[go], down[go], up[go]
        gap_down = np.where(down, n - cn[np.maximum(below[live], 0)], np.inf)
        gap_up = np.where(up, cn[np.minimum(above[live], len(c) - 1)] - n, np.inf)
        downwards = gap_down <= gap_up
        take = np.where(downwards, below[live], above[live])
        dist, index = _exact(x[live], c[take]), order[take]
        better = (dist < best[live]) | (dist == best[live]) & (index < at[live])
        best[live[better]], at[live[better]] = dist[better], index[better]
        below[live[downwards]] -= 1
        above[live[~downwards]] += 1
    return at, best


def nearest_large(x: list[int], book: list[list[int]]) -> tuple[int, int]:
    """nearest() for one part of integers of any size: norms rounded down, intervals wider by what that may cost."""
    order = sorted(range(len(book)), key=lambda i: sum(y * y for y in book[i]))
    norms = [math.isqrt(sum(y * y for y in book[i])) for i in order]
    own = math.isqrt(sum(y * y for y in x))
    exact = lambda k: (sum((a - b) ** 2 for a, b in zip(x, book[order[k]], strict=True)), order[k])
    start = min(bisect_left(norms, own), len(norms) - 1)
    best, below, above = exact(start), start - 1, start + 1
    while True:
        d = math.isqrt(best[0]) + 2
        first, last = bisect_left(norms, own - d), bisect_right(norms, own + d)
        if below >= first and (above >= last or own - norms[below] <= norms[above] - own):
            best, below = min(best, exact(below)), below - 1
        elif above < last:
            best, above = min(best, exact(above)), above + 1
        else:
            return best[1], best[0]


def assigned(b: pa.RecordBatch, books: Books, scale: int) -> tuple[np.ndarray, list[int | np.ndarray], np.ndarray, dict[int, list[int]]]:
    """Of a batch: entries (row, part), summed squared distances by row, the integers, and those of rows apart."""
    width = len(books[0][0])
    most = room(width)
    big = any(abs(x) >= most for book in books for e in book for x in e)
    x, apart = integers(b, width * len(books), scale, 0 if big else most)
    codes, error = np.zeros((len(x), len(books)), np.int64), [0] * len(x)
    if not big:
        sums = [nearest(x[:, p * width : (p + 1) * width], np.array(book, np.int64)) for p, book in enumerate(books)]
        codes = np.stack([s[0] for s in sums], 1)
        error = [sum(e) for e in zip(*(s[1].tolist() for s in sums), strict=True)]
    for i, v in apart.items():
        found = [nearest_large(v[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
        codes[i], error[i] = [f[0] for f in found], sum(f[1] for f in found)
    return codes, error, x, apart


def _first(vectors: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids: each task gives its own smallest, so no row is shuffled that can't be among them."""

    def smallest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[bool, int], list[float]] = {}
        for b in it:
            bar = max(kept) if len(kept) >= entries else None
            for i, d in enumerate(b.column("id").to_pylist()):
                key = (d is None, d or 0)
                if bar is None or key <= bar:
                    v = b.column("v")[i].as_py()
                    kept[key] = min(kept.get(key, v), v)
            kept = {k: kept[k] for k in nsmallest(entries, kept)}
        yield pa.RecordBatch.from_pydict({"id": [None if k[0] else k[1] for k in kept], "v": list(kept.values())}, pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))

    found = vectors.select("id", "v").mapInArrow(smallest, "id long, v array<double>")
    return [r.v for r in found.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("id")).limit(entries).collect()]


def _sums(vectors: DataFrame, books: Books, scale: int) -> dict[tuple[int, int, int], int]:
    """(part, entry, position) to the sum of the assigned parts' components; position -1: their number."""
    width = len(books[0][0])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int, int], int] = {}
        for b in it:
            codes, _, x, apart = assigned(b, books, scale)
            for i, v in apart.items():
                for p, k in enumerate(codes[i].tolist()):
                    for at, value in enumerate(v[p * width : (p + 1) * width]):
                        limb, sign, value = 0, -1 if value < 0 else 1, abs(value)
                        while value:
                            total[p, k, at, limb] = total.get((p, k, at, limb), 0) + sign * (value & (1 << LIMB) - 1)
                            value, limb = value >> LIMB, limb + 1
            for p, book in enumerate(books):
                for k, n in enumerate(np.bincount(codes[:, p], minlength=len(book)).tolist()):
                    if n:
                        of = x[codes[:, p] == k, p * width : (p + 1) * width].sum(0).tolist()
                        for at, value in enumerate([*of, n]):
                            key = (p, k, at if at < width else -1, 0)
                            total[key] = total.get(key, 0) + value
        rows = [(*key, value) for key, value in total.items()]
        names = ["part", "entry", "at", "limb", "s"]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "s" else pa.int32()) for n, c in zip(names, cols, strict=True)], names)

    rows = vectors.select("v").mapInArrow(add, "part int, entry int, at int, limb int, s long").groupBy("part", "entry", "at", "limb").agg(F.sum("s").alias("s")).collect()
    out: dict[tuple[int, int, int], int] = {}
    for r in rows:
        out[r.part, r.entry, r["at"]] = out.get((r.part, r.entry, r["at"]), 0) + (r.s << LIMB * r.limb)
    return out


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks of usable() vectors; empty ones if there are none."""
    dims = vectors.agg(F.max(F.size("v")).alias("n")).head().n or 0
    width = max(1, -(-dims // parts))
    first = [[whole(x, scale) for x in v] + [0] * (width * parts - len(v)) for v in _first(vectors, entries)]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds if first else 0):
        s = _sums(vectors, books, scale)
        new = [[[s.get((p, k, at), 0) // s[p, k, -1] for at in range(width)] if (p, k, -1) in s else e for k, e in enumerate(book)] for p, book in enumerate(books)]
        if new == books:  # so would all later rounds be
            break
        books = new
    return books


def encoded(vectors: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """usable() vectors to (id, label, code, error): two hex digits for each part's entry."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                codes, error, _, _ = assigned(b, books, scale)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([bytes(c).hex() for c in codes.astype(np.uint8)]), pa.array([min(e, (1 << 63) - 1) for e in error], pa.int64())], ["id", "label", "code", "error"])

    if not all(books):
        return vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
    if max(map(len, books)) > 256:
        raise ValueError("two hex digits name 256 entries at most")
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "label", "v").mapInArrow(encode, f"id long, label {label}, code string, error long")


def decoded(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """codes (code, ...) with a column v: the entries of each code, as numbers of the vectors' scale."""
    table = F.array(*(F.array(*(F.array(*(F.lit(x / scale) for x in e)) for e in book)) for book in books))
    part = lambda p: F.element_at(F.element_at(table, p), (F.conv(F.substring("code", 2 * p - 1, 2), 16, 10).cast("int") + 1))
    return codes.withColumn("v", F.concat(*(part(p) for p in range(1, len(books) + 1))))


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """encoded() rows with label_error, the error summed over all rows of the label."""
    codes = saved(codes, "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = saved(codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), most).cast("long").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    side = F.broadcast(sums) if sums.count() <= SENT_LABELS else sums
    return codes.join(side, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    books = trained(v)
    out = with_label_errors(encoded(v, books))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """All rounds, one after another, by comparing every part with every entry."""

    def nearest_of(book: str) -> str:
        return f"""SELECT row, part, k, s, d FROM (
    SELECT x.row, x.part, x.s, b.k, list_sum(list_transform(list_zip(x.s, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {book} b USING (part)
  ) QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, k) = 1"""

    floor = "(s - ((s % n) + n) % n) // n"
    steps = "".join(
        f""", a{r} AS MATERIALIZED ({nearest_of(f"b{r}")}
), m{r} AS MATERIALIZED (
  SELECT part, k, list({floor} ORDER BY place) AS c FROM (
    SELECT part, k, place, sum(value)::BIGINT AS s, count(*) AS n FROM (SELECT part, k, unnest(s) AS value, unnest(range(len(s))) AS place FROM a{r}) GROUP BY ALL
  ) GROUP BY part, k
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.k = m.k
)"""
        for r in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (
  SELECT row, vec_id, p AS part, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS s FROM v, (SELECT unnest(range({parts})) AS p)
), b0 AS MATERIALIZED (
  SELECT part, row - 1 AS k, s AS c FROM x WHERE row <= {entries}
){steps}, f AS MATERIALIZED ({nearest_of(f"b{rounds}")}
), c AS (
  SELECT row, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN c USING (row)
"""


ORACLE = _oracle()
