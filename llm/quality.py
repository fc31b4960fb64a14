"""Quality rules: plain counts, and each language's bands of perplexity under a modified Kneser-Ney n-gram model.

The model has n-grams of ORDER code points, folded to lower case, digits to 0, white space to a space. No document is
scored by counts of its own: a digest of the text deals documents into two halves, copies into the same one, and each
half is scored by the model of the other. Tasks count the n-grams of their whole texts for both halves, Spark sums them
up, derives the lower orders as distinct left extensions, the discounts from the counts of counts, and interpolates
order by order with joins; both models say something of every n-gram of the corpus, backing off where their own half
lacks it. All languages share the models, so a passage in another language than its document's is as likely as
elsewhere; the bands are each language's own. Neither characters nor n-grams have a limit: the models grow with the
corpus and nothing of them is pruned. What they say of each n-gram of the highest order is kept in arrays sorted by
hash and cut into shards by hash. A shard has SHARD n-grams, so no more than that is at the driver, broadcast or in a
worker at a time; every shard is passed to all documents, whose partial sums are added up.

A document's perplexity is per character. A language's bands lie around the median of the log perplexities of the
documents that pass the plain rules, at multiples of the median deviation to either side; both medians are exact to
four digits over the whole corpus. Documents outside are rejected: above is noise, below is repetition. BELOW and ABOVE
were set by looking at the labels of one test table; callers give their own to assess() and filtered().

A null text counts as empty: no words, base_failed. A null language is a language of its own. A text without characters
has no perplexity and isn't judged by it. Repeated rows come back each; an empty table gives an empty result; extra
columns are ignored by the query and pass through filtered(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import mixed, positional, same, saved, small, texts

ORDER = 5
#: n-grams of a shard: 16 bytes each at the driver and in workers.
SHARD = 4_000_000
#: Bands: median deviations below and above the median of the log perplexity.
BELOW, ABOVE = 10.0, 6.0
#: The least that is taken off a count.
LEAST = 0.1
#: n-grams that a task holds before it sums them up and sends them on.
HELD = 1_500_000
_SPACE, _TAILS, _SYMBOLS = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)), b"#*$%&|<>"
_BITS = 21
_POINT, _TWO = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIDES = (0, 1)


def base_counts(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = 0
    if n > 3:
        k = len(number)
        pair = ids[:-1] * k + ids[1:]
        if k > 2_000_000:  # three ids would not fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, count = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[at] > 1)
        if len(starts):
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[starts + i] = True
            repeats = int(covered.sum())
    failed = n < 50 or 100 * repeats > 50 * n
    return n, len(text.translate(None, _SPACE + _TAILS)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats, failed


def fold(c: int) -> int:
    """Character to the one that stands for it: lower case, white space as a space, digits as 0."""
    s = chr(c)
    return 32 if s.isspace() or c < 32 else 48 if s.isdigit() else ord(s.lower()[0]) if len(s.lower()) == 1 else c


@lru_cache(1)
def folds() -> np.ndarray:
    """Of each code point of the basic plane the one that stands for it."""
    return np.array([fold(c) if not 0xD800 <= c < 0xE000 else c for c in range(1 << 16)], np.int64)


def points(text: bytes) -> np.ndarray:
    """Folded code points, ORDER - 1 zeros ahead of them."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.r_[np.zeros(ORDER - 1, np.int64), np.where(c < 1 << 16, folds()[np.minimum(c, 0xFFFF)], c)]


def hashes(x: np.ndarray) -> np.ndarray:
    """Of padded code points the hash of the n-gram that ends at each."""
    n = len(x) - ORDER + 1
    h = np.zeros(n, np.uint64)
    u = x.astype(np.uint64)
    for i in range(ORDER):
        h = (h ^ (h >> np.uint64(29))) * _STEP + u[i : i + n]
    return mixed(h)


COUNTED = "h long, a long, b long, n0 long, n1 long"


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(h, a, b, n0, n1) with each h once."""
    h, a, b, *n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h = h[order]
    cut = same(h)
    first = order[cut]
    return h[cut], a[first], b[first], *(np.add.reduceat(x[order], cut) if len(cut) else x for x in n)


def ngrams(xs: list[np.ndarray], half: int) -> tuple[np.ndarray, ...]:
    """(h, a, b, n0, n1) of the n-grams of some texts of one half: hash, the first two code points, the last three, counts."""
    x = np.concatenate(xs)
    size = np.array([len(t) for t in xs])
    inside = np.ones(len(x), bool)
    for i in range(1, ORDER):
        inside[np.cumsum(size) - i] = False
    at = np.flatnonzero(inside)
    h = hashes(x)[at]
    order = np.argsort(h)
    h = h[order]
    cut = same(h)
    f = at[order[cut]]
    n = np.diff(np.r_[cut, len(h)])
    none = np.zeros(len(n), n.dtype)
    return h[cut], x[f] << _BITS | x[f + 1], (x[f + 2] << _BITS | x[f + 3]) << _BITS | x[f + 4], *((none, n) if half else (n, none))


def halves(batch: pa.RecordBatch) -> np.ndarray:
    """0 or 1: the half of each row, by its text's digest."""
    return batch.column("dig").to_numpy(zero_copy_only=False) & 1


def counted(docs: DataFrame) -> DataFrame:
    """docs (dig, text) to COUNTED over all texts."""

    def rows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, *more = summed(parts)
        for at in range(0, len(h), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (h.view(np.int64), *more)], ["h", "a", "b", "n0", "n1"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in small(it, 256):
            body, side = texts(batch), halves(batch)
            for half in _SIDES:
                xs = [points(t) for t, k in zip(body, side, strict=True) if k == half and t]
                if xs:
                    parts.append(ngrams(xs, half))
            if len(parts) > 16:
                parts = [summed(parts)]
            if sum(len(p[0]) for p in parts) > HELD:
                yield from rows(parts)
                parts = []
        if parts:
            yield from rows(parts)

    return docs.select("dig", "text").mapInArrow(count, COUNTED).groupBy("a", "b").agg(F.first("h").alias("h"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """COUNTED, each n-gram once, to (h, logp0, logp1): of every n-gram of the highest order the interpolated modified Kneser-Ney
    probability for documents of either half, which is that of the other half's model: logp0 comes from n1, logp1 from n0.

    Code points lie right-aligned in (a, b), two and three; lower orders have zeros ahead. Where a model lacks an n-gram's
    context, it says what it says of the next lower order; below the lowest all characters are as likely. A few numbers an
    order come to the driver: counts of counts, and sums over the lowest order.
    """
    orders = [grams.select("a", "b", "h", F.col("n1").alias("c0"), F.col("n0").alias("c1"))]
    cut = [(F.col("a").bitwiseAND(F.lit(_POINT)), F.col("b")), (F.lit(0).cast("long"), F.col("b")), (F.lit(0).cast("long"), F.col("b").bitwiseAND(F.lit(_TWO))), (F.lit(0).cast("long"), F.col("b").bitwiseAND(F.lit(_POINT)))]
    for a, b in cut:
        orders.append(saved(orders[-1].groupBy(a.alias("a"), b.alias("b")).agg(*(F.count_if(F.col(f"c{s}") > 0).alias(f"c{s}") for s in _SIDES)), "order"))
    before_a = F.shiftright("a", _BITS)
    before_b = F.shiftleft(F.col("a").bitwiseAND(F.lit(_POINT)), 2 * _BITS).bitwiseOR(F.shiftright("b", _BITS))
    lower = None
    for i in range(ORDER - 1, -1, -1):  # orders[i] has n-grams of ORDER - i
        taken = discounts(orders[i])
        of = orders[i].select("*", before_a.alias("ca"), before_b.alias("cb"), *(_took(s, taken[s]).alias(f"took{s}") for s in _SIDES))
        sums = [x for s in _SIDES for x in (F.sum(f"c{s}").cast("double").alias(f"total{s}"), F.sum(f"took{s}").alias(f"gamma{s}"))]
        if lower is None:  # all have the same, empty context
            whole = of.agg(F.count("*").alias("n"), *sums).first()
            p = of.select("*", *(F.lit(whole[f"{x}{s}"] or 0.0).alias(f"{x}{s}") for x in ("total", "gamma") for s in _SIDES), *(F.lit(1 / max(whole["n"], 1)).alias(f"q{s}") for s in _SIDES))
        else:
            p = of.join(of.groupBy("ca", "cb").agg(*sums), ["ca", "cb"]).withColumn("sa", cut[i][0]).withColumn("sb", cut[i][1])
            p = p.join(lower.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "q0", "q1"), ["sa", "sb"])
        lower = p.select("a", "b", *(["h"] if i == 0 else []), *(F.when(F.col(f"total{s}") > 0, (F.col(f"c{s}") - F.col(f"took{s}") + F.col(f"gamma{s}") * F.col(f"q{s}")) / F.col(f"total{s}")).otherwise(F.col(f"q{s}")).alias(f"q{s}") for s in _SIDES))
        if i == 1:
            lower = saved(lower, "lower")  # what the highest order is built on
    return lower.select("h", *(F.log(F.greatest(f"q{s}", F.lit(1e-12))).cast("float").alias(f"logp{s}") for s in _SIDES))


def _took(s: int, taken: list[float]) -> Column:
    """What is taken off a count."""
    c = F.col(f"c{s}")
    return F.when(c >= 3, taken[2]).when(c == 2, taken[1]).when(c == 1, taken[0]).otherwise(0.0)


def discounts(grams: DataFrame) -> list[list[float]]:
    """Of n-grams (c0, c1) of one order, for c0 and c1, what counts of one, two, and three or more lose: by the counts of counts n,
    j - (j + 1) y n[j + 1] / n[j] with y = n[1] / (n[1] + 2 n[2]), between LEAST and j; 0.5 where n[j] is 0. With LEAST,
    n-grams that a model lacks keep some probability."""
    row = grams.agg(*(F.count_if(F.col(f"c{s}") == j).alias(f"n{s}_{j}") for s in _SIDES for j in (1, 2, 3, 4))).first()
    out = []
    for s in _SIDES:
        n = [0, *(row[f"n{s}_{j}"] for j in (1, 2, 3, 4))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        out.append([min(max(j - (j + 1) * y * n[j + 1] / n[j], LEAST), float(j)) if n[j] else 0.5 for j in (1, 2, 3)])
    return out


class Shard:
    """n-grams of a range of hashes: sorted hashes and their log probabilities for either half. Hashes are even, so a hash's leading bits tell where to look."""

    def __init__(self, key: np.ndarray, value: np.ndarray, low: int, width: int) -> None:
        order = np.argsort(key)
        self.key, self.value = key[order], value[:, order]
        self.low, self.width = np.uint64(low), width
        bits = max(len(key), 1).bit_length()
        self.shift = np.uint64(max(width - bits, 0))
        slot = ((self.key - self.low) >> self.shift).astype(np.int64)
        slots = 1 << min(bits, width)
        self.start = np.searchsorted(slot, np.arange(slots + 1)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def sums(self, h: np.ndarray, side: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of the log probabilities, for the half side, of those of h that are here, from each start to the next."""
        out = np.zeros(len(h))
        d = h - self.low
        ok = np.ones(len(h), bool) if self.width == 64 else d < np.uint64(1) << np.uint64(self.width)
        here = np.flatnonzero(ok)
        if len(here) and len(self.key):
            at = self.start[(d[here] >> self.shift).astype(np.int64)]
            left = here
            for i in range(self.most):
                k = np.minimum(at + i, len(self.key) - 1)
                hit = self.key[k] == h[left]
                out[left[hit]] = self.value[side[left[hit]], k[hit]]
                left, at = left[~hit], at[~hit]
        return np.add.reduceat(out, starts) if len(starts) else np.zeros(0)


SCORED = "doc_id long, dig long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_points long, logp double"


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (doc_id, dig, lang, text) and a model (h, logp0, logp1) to SCORED: plain counts and the sum of log probabilities, of rows told apart by all four."""
    spark = docs.sparkSession
    bits = max(model.count() // SHARD, 0).bit_length()
    done = None
    for i in range(1 << bits):
        # hashes as unsigned numbers: shard i has those with the leading bits i
        rows = model.where(F.shiftrightunsigned("h", 64 - bits) == i) if bits else model
        rows = rows.toArrow()
        shard = Shard(rows.column("h").to_numpy().view(np.uint64), np.stack([rows.column(f"logp{s}").to_numpy() for s in _SIDES]), i << (64 - bits), 64 - bits)
        part = saved(_scored(docs, spark.sparkContext.broadcast(shard), i == 0), "scored")
        if done is None:
            done = part
        else:
            key = ["doc_id", "dig", "lang"]
            more = part.groupBy(*key).agg(F.max("logp").alias("more"))
            same_row = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key]
            done = saved(done.alias("x").join(more.alias("y"), same_row[0] & same_row[1] & same_row[2]).select(*(F.col(f"x.{c}") for c in done.columns if c != "logp"), (F.col("x.logp") + F.col("y.more")).alias("logp")), "scored")
    return done


def _scored(docs: DataFrame, sent, first: bool) -> DataFrame:  # noqa: ANN001
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = sent.value
        for b in small(it, 128):
            body = [t or b"" for t in texts(b)]
            found = [hashes(points(t)) for t in body if t]
            size = np.array([len(x) for x in found], np.int64)
            logp = np.zeros(len(body))
            n = np.zeros(len(body), np.int64)
            if found:
                full = [i for i, t in enumerate(body) if t]
                logp[full] = shard.sums(np.concatenate(found), np.repeat(halves(b)[full], size), np.cumsum(size) - size)
                n[full] = size
            counts = [base_counts(t) if first else (0, 0, 0, 0, 0, True) for t in body]
            cols = [pa.array(c, k) for c, k in zip(zip(*counts, strict=True), [pa.int64()] * 5 + [pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dig"), b.column("lang"), *cols, pa.array(n), pa.array(logp)], ["doc_id", "dig", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_points", "logp"])

    return docs.select("doc_id", "dig", "lang", "text").mapInArrow(run, SCORED)


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(m, low, high) in log perplexity: one row a language. Medians come from how many documents have each value of four digits."""
    good = scored.where("not base_failed and log_ppl is not null").groupBy("m", F.round("log_ppl", 4).alias("x")).agg(F.count("*").alias("n"))
    middle = good.groupBy("m").agg(F.percentile("x", 0.5, F.col("n")).alias("mid"))
    away = good.join(middle, "m").groupBy("m", "mid").agg(F.percentile(F.round(F.abs(F.col("x") - F.col("mid")), 4), 0.5, F.col("n")).alias("dev"))
    dev = F.greatest("dev", F.lit(0.002))
    return away.select("m", (F.col("mid") - below * dev).alias("low"), (F.col("mid") + above * dev).alias("high"))


def assess(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """docs (doc_id, text, lang, and dig if at hand) to SCORED with log_ppl and kept: neither the plain rules nor the bands reject."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("dig") if "dig" in docs.columns else F.xxhash64("text").alias("dig"), F.col("lang").cast("string").alias("lang"), "text")
    scored = score(docs, saved(kneser_ney(saved(counted(docs), "ngrams")), "model"))
    scored = scored.withColumn("m", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).withColumn("log_ppl", F.when(F.col("n_points") > 0, -F.col("logp") / F.col("n_points")))
    within = F.coalesce(F.round("log_ppl", 4).between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(bands(scored, below, above), "m", "left").withColumn("kept", ~F.col("base_failed") & within)


def filtered(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """docs (doc_id, text, lang and others) without those that assess() rejects."""
    plain, names = positional(docs)
    doc_id, text, lang = (names[docs.columns.index(c)] for c in ("doc_id", "text", "lang"))
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("dig"), F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("m")]
    keyed = plain.select(*names, *key)
    bad = assess(keyed.select(F.col("doc").alias("doc_id"), "dig", F.col(lang).alias("lang"), F.col(text).alias("text")), below, above).where("not kept").select(F.col("doc_id").alias("doc"), "dig", "m").distinct()
    return keyed.join(bad, ["doc", "dig", "m"], "left_anti").select(names).toDF(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")
