"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Labellers vote good, bad or nothing on every text. Documents with equal votes are one pattern, and there are at most
3 ** len(LABELLERS) patterns, so expectation-maximisation runs on their counts, whatever the corpus holds. It
estimates for each labeller how often it votes good, bad or nothing on good and on bad documents, and the share of
good ones; each pattern's posterior follows. Posteriors of a bounded sample (TRAIN documents, the smallest digests of
doc_id among each half of the posteriors) train a logistic scorer on hashed words and word shapes, which then scores
every whole text. Votes, patterns and scores cover all documents.

A null or empty text gets votes like any other (it is too short) and score from the bias alone. A null doc_id is kept.
Repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import saved, small, texts

TRAIN, WIDTH = 4000, 1 << 18
#: Insults of the toxicity labeller.
INSULTS = frozenset(b"idiot idiots idiotic stupid stupidity moron morons moronic loser losers scum trash garbage clown clowns pathetic worthless disgusting dumb dumbass imbecile cretin vermin filth filthy pig bastard bitch slut whore fuck fucking shit asshole retard retarded".split())
_SYMBOLS, _UPPER, _ALPHA = b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STRIP = b".,;:!?\"'()[]"
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def vote(x: float, bad: float, good: float) -> int:
    """-1 at bad or beyond it, 1 at good or before it, else 0."""
    return -1 if x >= bad else 1 if x <= good else 0


def votes(text: bytes) -> tuple[int, ...]:
    """What each of LABELLERS votes: 1 good, -1 bad, 0 nothing."""
    words = text.split()
    n = len(words)
    lines = [s for s in (x.strip() for x in text.split(b"\n")) if s]
    letters = len(text) - len(text.translate(None, _ALPHA))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    upper = len(text) - len(text.translate(None, _UPPER))
    distinct = len(set(words))
    insults = not INSULTS.isdisjoint(text.translate(_LETTERS).split())
    repeated = 1 - len(set(lines)) / max(len(lines), 1)
    ends = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1)
    return (
        vote(-n, -3, -60),
        -(symbols > 0.12 * n),
        -(upper > 0.4 * letters),
        -(repeated >= 0.3),
        -(n >= 50 and distinct < 0.25 * n),
        -(abs(len(text) / max(n, 1) - 7) > 5),
        vote(-ends, -0.2, -0.8),
        -insults,
        -(text.count(b"!") > 0.1 * n),
    )


LABELLERS = ("length", "symbols", "capitals", "repeated_lines", "vocabulary", "word_length", "sentence_ends", "insults", "exclamations")
#: What is presumed of the labellers: no more than this share of good documents gets a vote for bad (the share of those
#: that also vote for good comes second), and a vote for good is no likelier on a bad document than on a good one.
FALSE_ALARMS, FALSE_ALARMS_TWO_SIDED = 0.005, 0.02
_CAP = np.array([FALSE_ALARMS_TWO_SIDED if x in ("length", "sentence_ends") else FALSE_ALARMS for x in LABELLERS])


def code_of(v: tuple[int, ...]) -> int:
    c = 0
    for x in v:
        c = 3 * c + x + 1
    return c


def voted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, pattern): the votes as one number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([code_of(votes(t or b"")) for t in texts(b)], pa.int32())], ["doc_id", "pattern"])

    return docs.mapInArrow(run, "doc_id long, pattern int")


def maximised(pattern: np.ndarray, count: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over patterns: each pattern's posterior of good, each labeller's rates
    [labeller, bad or good, vote], and the share of good documents. Starts from the votes for bad.

    Each rate has one pseudo-count whatever the number of documents; estimates are kept within what FALSE_ALARMS presumes,
    which tells the two classes apart, as kinds of junk that different labellers see would else pass for chance votes.
    """
    k = len(LABELLERS)
    v = np.stack([pattern // 3 ** (k - 1 - i) % 3 for i in range(k)], 1)  # 0 bad, 1 nothing, 2 good
    cast = (v[:, :, None] == np.arange(3)).astype(float)
    post = 1 / (1 + np.exp(np.where((v == 0).any(1), 4.0, -4.0)))
    w = count.astype(float)

    def held(rate: np.ndarray, vote: int, most: np.ndarray) -> np.ndarray:
        rate = rate.copy()
        now = np.minimum(rate[:, vote], most)
        rest = [z for z in range(3) if z != vote]
        rate[:, rest] *= ((1 - now) / np.maximum(1 - rate[:, vote], 1e-12))[:, None]
        rate[:, vote] = now
        return rate

    for _ in range(rounds):
        share = float((w @ post + 1) / (w.sum() + 2))
        bad, good = (np.einsum("n,nkz->kz", w * p, cast) + 1 for p in (1 - post, post))
        bad, good = bad / bad.sum(1, keepdims=True), good / good.sum(1, keepdims=True)
        good = held(good, 0, _CAP)
        bad = held(bad, 2, good[:, 2])
        gap = np.log(1 - share) - np.log(share) + np.einsum("nkz,kz->n", cast, np.log(bad) - np.log(good))
        new = 1 / (1 + np.exp(np.clip(gap, -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, np.stack([bad, good], 1), share


def odds(share: float) -> float:
    share = min(max(share, 0.01), 0.99)
    return float(np.log(share / (1 - share)))


class Features(dict):
    """Word (bytes) to its two hashed features: itself, folded, and its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        shape = word.translate(_SHAPE)
        short = bytes(c for i, c in enumerate(shape) if not i or shape[i - 1] != c)
        out = self[word] = xxhash.xxh32_intdigest(word.lower().strip(_STRIP)) % WIDTH, xxhash.xxh32_intdigest(short, 1) % WIDTH
        return out

    def of(self, text: bytes) -> np.ndarray:
        """The text's distinct features, sorted."""
        return np.unique(np.array([self[w] for w in text.split()], np.int64).reshape(-1))


def fitted(rows: list[np.ndarray], target: np.ndarray, rounds: int = 150, l2: float = 3e-5) -> np.ndarray:
    """Weights and bias (last) of logistic regression on features of unit length, by full-batch steps scaled as in Adam."""
    size = np.array([len(r) for r in rows], np.int64)
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), size)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    w, m, s = (np.zeros(WIDTH + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[at], len(rows)) * scale + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(at, (err * scale)[doc], WIDTH), err.sum()) / max(len(rows), 1) + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs (doc_id, text, pattern) to (doc_id, pattern, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, f = sent.value, Features()
        for b in small(it):
            z = [float(w[x].sum(dtype=np.float64)) / len(x) ** 0.5 if len(x := f.of(t or b"")) else 0.0 for t in texts(b)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z) + float(w[-1]), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([code_of(votes(t or b"")) for t in texts(b)], pa.int32()), pa.array(p)], ["doc_id", "pattern", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern int, score double")


def classify(docs: DataFrame, train: int = TRAIN) -> DataFrame:
    """docs (doc_id, text) to (doc_id, posterior, score, label, kept): label 1, and kept, where the scorer finds a document good."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ballot = saved(voted(docs), "votes")
    counts = ballot.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    pattern, n = counts.column("pattern").to_numpy(), counts.column("n").to_numpy()
    post, _, _ = maximised(pattern, n)
    known = spark.createDataFrame([(int(p), float(q)) for p, q in zip(pattern, post, strict=True)], "pattern int, posterior double")
    known = F.broadcast(known)  # 3 ** len(LABELLERS) rows at most
    marked = ballot.join(known, "pattern").withColumn("order", F.xxhash64("doc_id"))
    half = [marked.where(c & F.col("doc_id").isNotNull()).orderBy("order", "doc_id").limit(train // 2).select("doc_id", "posterior") for c in (F.col("posterior") >= 0.5, F.col("posterior") < 0.5)]
    chosen = {r.doc_id: r.posterior for part in half for r in part.collect()}

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in small(it):
            found = [(d, f.of(t or b"").astype(np.int32).tobytes()) for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True) if d in chosen]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["doc_id", "at"])

    rows = sorted({(r.doc_id, bytes(r.at)) for r in docs.mapInArrow(features, "doc_id long, at binary").collect()})
    target = np.array([chosen[d] for d, _ in rows])
    weights = fitted([np.frombuffer(x, np.int32).astype(np.int64) for _, x in rows], target)
    weights[-1] += odds(float(post @ n / max(n.sum(), 1))) - odds(float(target.mean()) if len(rows) else 0.5)  # the sample's share of good ones isn't the corpus's
    return scored(docs, weights).join(known, "pattern").select("doc_id", "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("label"), (F.col("score") >= 0.5).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
