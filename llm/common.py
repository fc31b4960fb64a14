"""What several operators share: intermediate tables, word sets, packed exchanges and components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A packed row holds at most so many tokens; a chunk that reaches it is sent on.
CHUNK_TOKENS = 1_000_000
#: A token of so many owners in one chunk travels as one marker, its owners stay out of the token's group.
LOCAL_HOT = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir; where that is unset, a folder of our own, for sessions in
    one process only, as other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/corpus-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost no recomputation.

    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def shipped(spark: SparkSession) -> None:
    """Sends this subpackage to the Python workers, once a context: they need not find it on their own path.

    Batches between the JVM and Python hold 1,000 rows and 4 MB, as rows are whole texts, pairs of them or packed arrays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "llm_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"llm/{name}")
    context.addPyFile(path)
    context._llm_shipped = True


def fragments(spark: SparkSession) -> int:
    """Fragments of the token order: a power of two, some for each shuffle partition, so they grow with the cluster's setting."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(6, min(16, n.bit_length()))


class WordHash(dict):
    """Word (bytes) to its 64-bit hash; emptied when large, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than size make one shingle, no words none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _MIX[i % 4] + words[i : i + n - k + 1]
    return np.unique(mixed(h))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def small(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def same(a: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def spans(a: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values in a sorted array."""
    s = same(a).tolist()
    return list(zip(s, [*s[1:], len(a)], strict=True)) if s else []


PACKED = "frag int, hot boolean, owners binary, idx binary, tok binary, pos binary, n long"
BY_OWNER = "frag int, owners binary, tok binary, pos binary, mark binary"


def coded(tok: np.ndarray) -> bytes:
    """Sorted tokens in bytes that compress: differences of the upper halves, byte by byte in planes, then the lower halves."""
    high = np.diff((tok >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(high.view(np.uint8).reshape(-1, 4).T).tobytes() + (tok & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def decoded(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    high = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(high, dtype=np.uint64) << np.uint64(32) | np.frombuffer(raw, "<u4", n, 4 * n).astype(np.uint64)


class Packer:
    """Collects (owner, token, position) and gives rows packed by fragment.

    Tokens with LOCAL_HOT owners or more in the chunk leave the group of their token: one marker row entry tells the
    fragment that the token is shared, and the owners' own entries go straight to lane rows (frag -1), by owner.
    """

    def __init__(self, parts: int, positions: bool = False) -> None:
        self.parts, self.positions = parts, positions
        self.shift = np.uint64(64 - (parts.bit_length() - 1))
        self.clear()

    def clear(self) -> None:
        self.owners: list[int] = []
        self.toks: list[np.ndarray] = []
        self.poss: list[np.ndarray] = []
        self.size = 0

    def add(self, owner: int, toks: np.ndarray, pos: np.ndarray | None = None) -> bool:
        """True if the chunk is full."""
        self.owners.append(owner)
        self.toks.append(toks)
        if self.positions:
            self.poss.append(pos)
        self.size += len(toks)
        return self.size >= CHUNK_TOKENS or len(self.owners) >= 60_000

    def rows(self) -> Iterator[dict]:
        if not self.size:
            self.clear()
            return
        tok = np.concatenate(self.toks)
        own = np.repeat(np.arange(len(self.owners), dtype=np.uint16), [len(t) for t in self.toks])
        pos = np.concatenate(self.poss).astype(np.uint32) if self.positions else None
        owners = np.array(self.owners, np.int64)
        self.clear()
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        pos = pos[order] if pos is not None else None
        del order
        runs = same(tok)
        size = np.diff(np.r_[runs, len(tok)])
        hot = np.repeat(size >= LOCAL_HOT, size)
        if hot.any():
            marks = tok[runs[size >= LOCAL_HOT]]
            yield from self._lane(owners[own[hot]], tok[hot], pos[hot] if pos is not None else None)
            for f, a, b in self._cuts(marks):
                yield {"frag": f, "hot": True, "owners": b"", "idx": b"", "tok": coded(marks[a:b]), "pos": b"", "n": b - a}
            tok, own = tok[~hot], own[~hot]
            pos = pos[~hot] if pos is not None else None
        for f, a, b in self._cuts(tok):
            used, idx = np.unique(own[a:b], return_inverse=True)
            yield {"frag": f, "hot": False, "owners": owners[used].tobytes(), "idx": idx.astype(np.uint16).tobytes(), "tok": coded(tok[a:b]), "pos": pos[a:b].tobytes() if pos is not None else b"", "n": b - a}

    def _cuts(self, tok: np.ndarray) -> list[tuple[int, int, int]]:
        f = (tok >> self.shift).astype(np.int64)
        return [(int(f[a]), a, b) for a, b in spans(f)]

    def _lane(self, own: np.ndarray, tok: np.ndarray, pos: np.ndarray | None) -> Iterator[dict]:
        """Entries of hot tokens, on their way to their owners; frag is -1 less the owner's bucket."""
        for r in owner_rows(own, tok, pos, np.full(len(own), 255, np.uint8), self.parts):
            yield {"frag": -1 - r["frag"], "hot": True, "owners": r["owners"], "idx": r["mark"], "tok": r["tok"], "pos": r["pos"], "n": len(own)}


def bucket_of(owners: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(owners.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % parts


def owner_rows(own: np.ndarray, tok: np.ndarray, pos: np.ndarray | None, mark: np.ndarray, parts: int) -> Iterator[dict]:
    """Rows by the owners' buckets, sorted by owner in each."""
    b = bucket_of(own, parts)
    order = np.lexsort((tok, own, b))
    b, own, tok, mark = b[order], own[order], tok[order], mark[order]
    pos = pos[order] if pos is not None else None
    for a, z in spans(b):
        yield {"frag": int(b[a]), "owners": own[a:z].tobytes(), "tok": tok[a:z].tobytes(), "pos": pos[a:z].tobytes() if pos is not None else b"", "mark": mark[a:z].tobytes()}


def batches(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of some MB."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + sum(len(v) for v in r.values() if isinstance(v, bytes | str))
        if size >= most or len(out) >= 20_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


PACKED_ARROW = pa.schema([("frag", pa.int32()), ("hot", pa.bool_()), ("owners", pa.binary()), ("idx", pa.binary()), ("tok", pa.binary()), ("pos", pa.binary()), ("n", pa.int64())])
BY_OWNER_ARROW = pa.schema([("frag", pa.int32()), ("owners", pa.binary()), ("tok", pa.binary()), ("pos", pa.binary()), ("mark", pa.binary())])


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The packed arrays of a column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def token_entries(table: pa.Table, positions: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one fragment's packed rows the entries (token, owner, position) of tokens with two or more, sorted, each once,
    and whether the token was hot in some chunk."""
    cold = table.filter(pa.compute.invert(table.column("hot")))
    none = [np.zeros(0, np.uint64)]
    marks = np.unique(np.concatenate(none + [decoded(x) for x in table.filter(table.column("hot")).column("tok").to_pylist()]))
    tok = np.concatenate(none + [decoded(x) for x in cold.column("tok").to_pylist()])
    own = [np.frombuffer(o, np.int64)[np.frombuffer(i, np.uint16)] for o, i in zip(cold.column("owners").to_pylist(), cold.column("idx").to_pylist(), strict=True)]
    own = np.concatenate(own) if own else np.zeros(0, np.int64)
    pos = joined(cold.column("pos"), np.uint32) if positions else np.zeros(len(tok), np.uint32)
    order = np.argsort(tok, kind="stable")
    tok, own, pos = tok[order], own[order], pos[order]
    runs = same(tok)
    size = np.diff(np.r_[runs, len(tok)])
    few = np.repeat((size > 1) | np.isin(tok[runs], marks), size)
    tok, own, pos = tok[few], own[few], pos[few]
    # copies of one owner count once
    order = np.lexsort((pos, own, tok))
    tok, own, pos = tok[order], own[order], pos[order]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1]) | (pos[1:] != pos[:-1])] if len(tok) else np.zeros(0, bool)
    tok, own, pos = tok[new], own[new], pos[new]
    return tok, own, pos, np.isin(tok, marks)


def shared_tokens(packed: DataFrame, parts: int, positions: bool = False) -> DataFrame:
    """Of packed (owner, token, position): the entries of tokens with two entries of different owners or positions.

    One group is one fragment of the token order. The rows that come back are packed by the owners' buckets; mark is
    the token's number of entries, 255 at most, and 255 for tokens that were hot in some chunk, wherever they are.
    """

    def fragment(table: pa.Table) -> pa.Table:
        if table.column("frag")[0].as_py() < 0:
            out = table.select(["owners", "tok", "pos", "idx"]).rename_columns(["owners", "tok", "pos", "mark"])
            return out.add_column(0, "frag", pa.array([-1 - f for f in table.column("frag").to_pylist()], pa.int32())).cast(BY_OWNER_ARROW)
        tok, own, pos, hot = token_entries(table, positions)
        runs = same(tok)
        size = np.diff(np.r_[runs, len(tok)])
        mark = np.repeat(np.where(hot[runs], 255, np.minimum(size, 254)).astype(np.uint8), size)
        few = np.repeat((size > 1) | hot[runs], size)
        rows = owner_rows(own[few], tok[few], pos[few] if positions else None, mark[few], parts)
        return pa.Table.from_pylist(list(rows), BY_OWNER_ARROW)

    return packed.groupBy("frag").applyInArrow(fragment, BY_OWNER)


#: Owners of one token are paired in its fragment if they are so few; of others the token and owner come back.
PAIRED = 8


def token_pairs(packed: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Of packed (owner, token, position): (bucket, id, other). Tokens of PAIRED owners or fewer give their pairs (id < other)
    whose positions are near, with bucket null; tokens of more give (token, owner) with other null."""

    def fragment(table: pa.Table) -> pa.Table:
        if table.column("frag")[0].as_py() < 0:
            own = joined(table.column("owners"), np.int64)
            return pa.table({"bucket": joined(table.column("tok"), np.int64), "id": own, "other": pa.nulls(len(own), pa.int64())})
        tok, own, pos, hot = token_entries(table, True)
        runs = same(tok)
        size = np.diff(np.r_[runs, len(tok)])
        large = np.repeat((size > PAIRED) | hot[runs], size) if len(tok) else np.zeros(0, bool)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, PAIRED):
            i = np.flatnonzero((tok[:-step] == tok[step:]) & ~large[step:])
            i = i[(own[i] != own[i + step]) & near(pos[i], pos[i + step])]
            left.append(own[i])
            right.append(own[i + step])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({
            "bucket": pa.array(np.r_[tok[large].view(np.int64), np.zeros(len(a), np.int64)], mask=np.r_[np.zeros(int(large.sum()), bool), np.ones(len(a), bool)]),
            "id": np.r_[own[large], np.minimum(a, b)],
            "other": pa.array(np.r_[np.zeros(int(large.sum()), np.int64), np.maximum(a, b)], mask=np.r_[np.ones(int(large.sum()), bool), np.zeros(len(a), bool)]),
        })

    return packed.groupBy("frag").applyInArrow(fragment, "bucket long, id long, other long").distinct()


#: Links that a task holds at a time to make a forest of them.
FOREST = 1_000_000


def forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to fewer with the same components: in every chunk each id and the smallest it reaches there."""

    def trees(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.r_[a, b], return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])

    held, n = [], 0
    for batch in it:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= FOREST:
            yield trees(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield trees(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges (a long, b long) to (id, comp): each id's smallest reachable id. Self-links and repeats do no harm.

    Tasks make forests of the links they hold, as they lie and then by id, which leaves short ways. Labels spread along
    these and then jump to their label's label, until nothing changes; each round's labels are a written table, so no
    lineage grows and nothing is collected but a count.
    """
    short = edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long").repartition("a").mapInArrow(forest, "a long, b long")
    both = saved(short.select("a", "b").union(short.select("b", "a")).distinct(), f"{name}-edges")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        top = labels.select(F.col("id").alias("root"), F.col("comp").alias("above"))
        step = step.join(top, step.comp == top.root, "left").select("id", "was", F.least("comp", F.coalesce("above", "comp")).alias("comp"))
        step = saved(step, f"{name}-labels")
        done = step.where("was <> comp").isEmpty()
        dropped(labels)
        labels = step.select("id", "comp")
        if done:
            dropped(both)
            return labels


def merged(comps: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """comps (id, comp) with more links (a, b): only what these join is looked at again."""
    if comps is None:
        return components(links, name)
    if links.isEmpty():
        return comps
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    every = comps.union(ends.join(comps, "id", "left_anti").select("id", F.col("id").alias("comp")))
    x, y = (comps.select(F.col("id").alias(s), F.col("comp").alias(f"comp_{s}")) for s in "ab")
    between = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    joins = components(between, name).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    return saved(every.join(joins, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), f"{name}-comps")


def with_neighbours(members: DataFrame, near: str, name: str) -> DataFrame:
    """Of members (bucket, id, others) those with another one near in their bucket."""
    condition = F.expr(f"x.bucket = y.bucket and x.id <> y.id and {near.format(a='x', b='y')}")
    return saved(members.alias("x").join(members.alias("y"), condition, "left_semi"), f"{name}-members")


#: Members of one bucket that are still apart meet in blocks of about so many, and pairs of them are judged so many at a time.
BLOCK = 4096
JUDGED = 1 << 15

Alike = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def met_apart(left: DataFrame, table: DataFrame, alike: Alike) -> DataFrame:
    """Pairs (a, b), a < b, of members (bucket, id, comp) of different comp that share a bucket and are alike.

    table: (id, others); alike: of its columns as arrays, and places i and j of pairs in them, which pairs are alike. Lists are
    of one length and come as a matrix. Members with many buckets in common meet in the largest bucket of both if that is one and
    the same, so a group of near copies is paired once and not in each bucket; buckets that only repeat such pairs are left
    out. Larger buckets than BLOCK are cut into blocks, each two of which meet in a group of their own.
    """
    sizes = left.groupBy("bucket").agg(F.count("*").alias("k"))
    sized = left.select("bucket", "id", "comp").join(sizes, "bucket")
    tops = sized.groupBy("id").agg(F.max(F.struct("k", "bucket")).alias("t")).select("id", F.col("t.bucket").alias("top"))
    rows = saved(sized.join(tops, "id"), "met")
    new = rows.groupBy("bucket").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo <> hi or lo = bucket").select("bucket")
    cut = F.ceil(F.col("k") / BLOCK).cast("int")
    placed = rows.join(new, "bucket").join(table, "id").withColumn("block", F.pmod(F.xxhash64("id"), cut).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("k", "other")

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for name in t.column_names:
            c = t.column(name).combine_chunks()
            out[name] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
        return out

    def meet(t: pa.Table) -> pa.Table:
        c = arrays(t)
        ids, bucket, within = c["id"], c["bucket"][0], c["first"][0] == c["second"][0]
        here, there = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(c["block"] == c[s][0]) for s in ("first", "second"))
        comp, top = (np.unique(c[s], return_inverse=True)[1].astype(np.int32) for s in ("comp", "top"))
        top = np.where(c["top"] == bucket, -1, top)  # who has its largest bucket here meets all
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (1 << 21) // max(1, len(there)))
        for at in range(0, len(here), step):
            x = here[at : at + step]
            y = there[at:] if within else there
            mask = (comp[x][:, None] != comp[y]) & ((top[x][:, None] != top[y]) | (top[x][:, None] < 0))
            i, j = np.nonzero(np.triu(mask, 1) if within else mask)
            for z in range(0, len(i), JUDGED):
                p, q = x[i[z : z + JUDGED]], y[j[z : z + JUDGED]]
                ok = alike(c, p, q)
                a.append(ids[p[ok]])
                b.append(ids[q[ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("bucket", "first", "second").applyInArrow(meet, "a long, b long").distinct()


def bucket_links(members: DataFrame, near: str, linked: Callable[[DataFrame], DataFrame], name: str, stars: int = 2, trim: bool = True, sharp: tuple[DataFrame, Alike] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id, comp) of whatever links between members of one bucket join; comp is the smallest id reached.

    members: (bucket, id long, first double, others); near: SQL over members {a} and {b}, which linked ones fulfil;
    linked: of candidate pairs (a, b), a < b, those that are linked. Members without anyone near in their bucket go
    first (trim). Then, in some rounds, every bucket's first member (by first, id) is held against the others, which settles
    groups of copies with one pair a member. What is then left in one bucket but apart is held against each other,
    if near: no link between different components is lost. sharp: a table by id and what met_apart() asks of pairs of its rows
    instead of near, which linked members fulfil too; it is too wide for all members and narrows the last step. pairs: more
    candidates (a, b), held against each other in the first round.
    """
    more = [c for c in members.columns if c not in ("bucket", "id", "first")]
    both = near.format(a="x", b="y")
    members = saved(members, f"{name}-members")
    if trim:
        members = with_neighbours(members, near, name)
    left = members.withColumn("comp", F.col("id"))
    comps: DataFrame | None = None
    for turn in range(stars):
        lead = left.groupBy("bucket").agg(F.min(F.struct("first", "id", "comp", *more)).alias("l")).select("bucket", "l.*")
        found = left.alias("x").join(lead.alias("y"), F.expr(f"x.bucket = y.bucket and x.id <> y.id and x.comp <> y.comp and {both}"))
        found = found.selectExpr("least(x.id, y.id) as a", "greatest(x.id, y.id) as b")
        if pairs is not None and comps is None:
            found = found.union(pairs)
        comps = merged(comps, saved(linked(found.distinct()), f"{name}-links"), name)
        # a leader is settled: it has met all of its bucket
        others = left.drop("comp").join(lead.select("bucket", F.col("id").alias("led")), "bucket").where("id <> led").drop("led")
        placed = others.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")).withColumn("first", -F.col("first"))  # another leader than before
        spread = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        left = placed.join(spread, "bucket")
        left = saved(left.select("bucket", "id", "first", *more, "comp"), f"{name}-left")
        if left.isEmpty():
            return comps
    if sharp:
        found = saved(met_apart(left, *sharp), f"{name}-pairs")
    else:
        rest = left.alias("x").join(left.alias("y"), F.expr(f"x.bucket = y.bucket and x.comp < y.comp and {both}"))
        found = rest.selectExpr("least(x.id, y.id) as a", "greatest(x.id, y.id) as b").distinct()
    return merged(comps, saved(linked(found), f"{name}-links"), name)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that none of taken has, in any case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1 ..., so that no column of the operator's own can clash, and those names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names
