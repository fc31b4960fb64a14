"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates lie in blocks of vertical layout (one row of numbers for each dimension), queries in blocks of their own;
every pair of blocks meets in one task by an equi-join on the names of their groups, which is always merged, never broadcast. For each query, partial products grow
dimension block by dimension block; a candidate goes as soon as its partial product plus the most that the remaining
mass allows (norm of the query's rest times norm of its own rest) is below the query's k-th best; the survivors are
compacted before the next block of dimensions. Each pair of blocks gives at most k rows a query.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. A shorter vector
counts as filled up with zeros. Equal scores go to the smaller id. Repeated rows of an id are candidates each, but
never for the query of that id; a repeated query is asked once (its smallest vector). Extra columns are ignored.
Finite components of any size are ranked by their exact products; a score beyond 64 bits shows as the largest or
smallest number that they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.codes import whole

ROWS, QUERIES, DIMS = 8192, 512, 16
#: So many queries at most meet a block of candidates in one task; beyond, candidates are copied once for each such group.
GROUP = 1 << 16
SCALE, LAST = 1024, (1 << 63) - 1
_BLOCK = "n int, dims int, ids binary, vec binary"


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v array<double>) of rows with an id and a whole, finite vector."""
    v = F.col(vector).cast("array<double>")
    whole_ = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & whole_).select(F.col(id_).cast("long").alias("id"), v.alias("v"))


def _packed(rows: int):  # noqa: ANN202
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of so many rows at most, in vertical layout."""
        for batch in it:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                v, ids = b.column("v"), b.column("id").to_numpy()
                sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                dims = int(sizes.max(initial=0))
                m = np.zeros((len(ids), dims))
                m[np.arange(dims) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"n": [len(ids)], "dims": [dims], "ids": [ids.tobytes()], "vec": [np.ascontiguousarray(m.T).tobytes()]}, pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vec", pa.binary())]))

    return pack


def integers(q: np.ndarray, c: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks as floor(scale * x): floats where all their products' sums are exact, 64-bit integers where these fit, else
    Python integers of any size."""
    most = [float(np.abs(x).max(initial=0)) * scale + 1 for x in (q, c)]
    top = len(q) * most[0] * most[1]
    if max(*most, top) < 2**62:
        kind = float if top < 2**52 else np.int64
        return np.floor(q * scale).astype(kind), np.floor(c * scale).astype(kind)
    return tuple(np.array([[whole(x, scale) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))


def sortable(score: int) -> str:
    """Of scores beyond 64 bits, what sorts as they do; empty for others, which sort by themselves."""
    if -LAST - 1 < score < LAST:
        return ""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def best(q: np.ndarray, own: int, c: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best columns of c for q. rest: norms of each column's dimensions from block i on."""
    alive = np.flatnonzero(ids != own)
    dims = len(q)
    part = q[:DIMS] @ c[:DIMS, alive]
    if len(alive) > k:
        # the k with the best start give the first bound
        first = alive[np.argpartition(-part, k - 1)[:k]]
        least = (q @ c[:, first]).min()
        for i, at in enumerate(range(DIMS, dims + DIMS, DIMS), 1):
            with np.errstate(over="ignore", invalid="ignore"):
                more = np.sqrt((q[at:].astype(float) ** 2).sum()) * rest[i, alive] * (1 + 1e-9) + 1e-6
            if part.dtype == object:  # norms beyond what floats hold bound nothing
                keep = np.array([not np.isfinite(m) or p + int(m) + 1 >= least for p, m in zip(part, more, strict=True)], bool)
            else:
                keep = part + more >= least
            alive, part = alive[keep], part[keep]
            if at >= dims:
                break
            part = part + q[at : at + DIMS] @ c[at : at + DIMS, alive]
    order = np.lexsort((ids[alive], -part))[:k]
    return alive[order], part[order]


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """queries and candidates (id, v) of usable() to (query_id, rank, vec_id, score): every query's k best, all if there are fewer."""
    spark = queries.sparkSession
    floors = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    queries = queries.groupBy("id").agg(F.min(F.struct(floors.alias("floors"), "v")).alias("m")).select("id", "m.v")
    asked = queries.count()
    parts, groups = max(1, -(-asked // QUERIES)), max(1, -(-asked // GROUP))
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = queries.repartition(parts, "id").mapInArrow(_packed(QUERIES), _BLOCK)
    q = q.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("qb"), *(F.col(x).alias(f"q_{x}") for x in ("n", "dims", "ids", "vec")))
    c = candidates.mapInArrow(_packed(ROWS), _BLOCK).withColumn("cb", F.pmod(F.xxhash64("ids"), F.lit(dealt)))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dealt - 1).cast("long"))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    # the optimizer sees the queries' size before they are copied, and would pass all copies through the driver
    q, c = q.hint("merge"), c.hint("merge")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                qs, cs = (np.frombuffer(r[f"{x}vec"], np.float64).reshape(r[f"{x}dims"], r[f"{x}n"]) for x in ("q_", ""))
                qi, ci = (np.frombuffer(r[f"{x}ids"], np.int64) for x in ("q_", ""))
                dims = min(len(qs), len(cs))
                qs, cs = integers(qs[:dims], cs[:dims], scale)
                with np.errstate(over="ignore"):
                    rest = np.array([np.sqrt((cs[at:].astype(float) ** 2).sum(0)) for at in range(0, dims + DIMS, DIMS)])
                found = [best(qs[:, i], qi[i], cs, ci, rest, k) for i in range(len(qi))]
                n = [len(f[0]) for f in found]
                scores = [int(x) for f in found for x in f[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)), pa.array(ci[np.concatenate([f[0] for f in found])]), pa.array([max(-LAST - 1, min(LAST, x)) for x in scores], pa.int64()), pa.array([sortable(x) for x in scores], pa.string())], ["query_id", "vec_id", "score", "beyond"])

    found = c.join(q, ["qb", "cb"]).select("n", "dims", "ids", "vec", "q_n", "q_dims", "q_ids", "q_vec").mapInArrow(meet, "query_id long, vec_id long, score long, beyond string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(v.where("id % 100 = 0"), v)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), d AS (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM d q JOIN d c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
