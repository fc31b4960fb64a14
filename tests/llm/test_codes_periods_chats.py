"""Vector codes, periodic runs and chats against plain versions, and their odd input."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import chats, codes, periods
from llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error) of rows (id, vector), and the books: every part against every entry, in whole numbers."""
    use = [(d, [math.floor(Fraction(x) * scale) for x in v]) for d, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in use), default=0)
    width = max(1, -(-dims // parts))
    use = [(d, v + [0] * (width * parts - len(v))) for d, v in use]
    first = {}
    for d, v in sorted(use, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(d, v)
    start = list(first.values())[:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for v in start] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            groups = {}
            for _, v in use:
                groups.setdefault(best(cut(v)[p], book)[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(book)])
        books = new
    found = []
    for d, v in use:
        nearest = [best(x, book) for x, book in zip(cut(v), books, strict=True)]
        found.append((d, "".join(f"{k:02x}" for _, k in nearest), min(sum(e for e, _ in nearest), 2**63 - 1)))
    return found, books


def vectors(spark, rows, dtype="float"):
    return spark.createDataFrame([(d, v, lab, "x") for d, v, lab in rows], f"vec_id long, embedding array<{dtype}>, label string, code string").repartition(3)


def encode(df):
    v = codes.usable(df, "vec_id", "embedding", "label")
    books = codes.trained(v)
    return codes.with_label_errors(codes.encoded(v, books)).collect(), books


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("case", ["plain", "few", "ties", "huge", "odd"])
def test_codes_equal_the_plain_version(spark, case):
    r = random.Random(case)
    dims = {"plain": 16, "few": 8, "ties": 8, "huge": 8, "odd": 11}[case]
    vec = lambda: [r.gauss(0, 1) for _ in range(dims)]
    rows = [(i, vec(), str(i % 3)) for i in range({"few": 5}.get(case, 60))]
    if case == "ties":
        rows = [(i, [float(r.randrange(2)) for _ in range(dims)], None) for i in range(60)] + [(3, [0.5] * dims, "a")] * 3
    if case == "huge":
        rows += [(70 + i, [1e18, -1e18, 1e300, -1e300, 5e-324, 0.1, 1e9, -1e9], "h") for i in range(2)] + [(5, [-1e18] * 8, "h"), (80, [1e9 + i for i in range(8)], None)]
    if case == "odd":
        rows += [(None, vec(), None), (7, vec(), None), (90, None, "n"), (91, [math.nan] * dims, "n"), (92, [math.inf] + [0.0] * 10, "n"), (93, [None, *vec()[1:]], "n"), (94, [1.0], "s"), (95, [], "s"), (None, vec(), "z")]
    got, books = encode(vectors(spark, rows, "double"))
    want, plain = plain_codes([(d, v) for d, v, _ in rows])
    assert books == plain
    assert sorted(((x.id, x.code, x.error) for x in got), key=key) == sorted(want, key=key)
    sums = {}
    for x in got:
        sums[x.label] = sums.get(x.label, 0) + x.error
    assert all(x.label_error == min(sums[x.label], 2**63 - 1) for x in got)


def test_codes_of_floats(spark):
    """Components of 32 bits count as the doubles that they are."""
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(16)], "a") for i in range(40)]
    got, _ = encode(vectors(spark, rows))
    assert sorted((x.id, x.code, x.error) for x in got) == sorted(plain_codes([(d, v) for d, v, _ in rows])[0])


def test_codes_of_nothing(spark):
    df = vectors(spark, [(1, None, "a"), (2, [math.nan], "a")])
    for d in (df, df.limit(0)):
        got, books = encode(d)
        assert got == [] and books == [[]] * 8
    zero = vectors(spark, [(1, [], "a")])
    assert [(x.code, x.error) for x in encode(zero)[0]] == [("00" * 8, 0)]


def test_decoded(spark):
    v = codes.usable(vectors(spark, [(i, [i / 4.0] * 8, "a") for i in range(4)]), "vec_id", "embedding", "label")
    books = codes.trained(v)
    out = codes.decoded(codes.encoded(v, books), books).orderBy("id").collect()
    assert [list(r.v) for r in out] == [[i / 4.0] * 8 for i in range(4)]


def test_annulus_is_exact():
    """The pruned search against all distances, with ties, equal entries and entries of one norm."""
    r = np.random.default_rng(4)
    for n, width, high in ((1, 2, 5), (2, 1, 3), (16, 2, 4), (16, 8, 50), (300, 3, 1000), (16, 4, codes.room(4))):
        book, x = r.integers(-high, high, (n, width)), r.integers(-high, high, (500, width))
        d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        at, best = codes.nearest(x, book)
        assert best.tolist() == d.min(1).tolist() and at.tolist() == [row.tolist().index(min(row)) for row in d]
        for i in range(20):
            assert codes.nearest_large(x[i].tolist(), book.tolist()) == (at[i], best[i])


# Periodic runs


def plain_runs(w, least=6, times=4):
    best = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                best.setdefault((s, i + p - s), p)
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_the_plain_version():
    r = random.Random(1)
    for _ in range(600):
        docs = []
        for _ in range(r.randrange(1, 6)):
            n = r.randrange(60)
            d = [bytes([97 + r.randrange(r.randrange(1, 4))]) for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                p = 1 + r.randrange(max(1, (n - a) // 2))
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
            docs.append(d)
        for least, times in ((6, 4), (2, 2), (5, 3)):
            got = [[] for _ in docs]
            for x in zip(*(y.tolist() for y in periods.runs_of(docs, least, times)), strict=True):
                got[x[0]].append(x[1:])
            assert got == [plain_runs(d, least, times) for d in docs]


def test_long_runs():
    """Runs of a hundred thousand words, nested ones, and Fibonacci words, which are all repeats."""
    w = [b"la"] * 100_000
    assert [x.tolist() for x in periods.runs_of([w])] == [[0], [0], [100_000], [1]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:
        a, b = b, b + a
    for d in (b, (b[:50] * 5 + [b"x"]) * 9):
        got = list(zip(*(y.tolist() for y in periods.runs_of([d], 4, 2)), strict=True))
        assert [x[1:] for x in got] == plain_runs(d, 4, 2)
    with pytest.raises(ValueError):
        periods.runs_of([w], 6, 1)


def test_runs_of_a_table(spark, docs, empty):
    taken = docs.withColumns({"runs": F.lit(1), "N_WORDS": F.lit("q")})
    assert periods.names_of(taken.columns) == ("n_words_", "runs_", "collapsed")
    got = periods.with_runs(taken).collect()
    assert len(got) == docs.count() and periods.with_runs(empty).isEmpty()
    for r in got:
        w = (r.text or "").encode().split()
        want = plain_runs(w)
        assert r.n_words_ == len(w) and [tuple(x) for x in r.runs_] == want and r.collapsed == plain_collapsed(w, want).decode() and r.runs == 1


def test_periodic_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    made = 0
    for r in QUERIES["op12_periodic_runs"](spark, DIR).collect():
        w = (docs.pop(r.doc_id) or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            made += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs)).hexdigest()
    assert not docs and made > 5


def test_planted_with_odd_rows(spark):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(None, "a b"), (ids[0], None), (ids[1], ""), (ids[2], " \t "), (ids[3], "a b c")]
    got = {r.d: r.t for r in spark.createDataFrame(rows, "d long, x string").select("d", periods.planted(F.col("x"), F.col("d")).alias("t")).collect()}
    assert got[None] == "a b" and all((got[i] or "") == "" for i in ids[:3]) and set(got[ids[3]].split(" ")) <= {"a b", "c"}


# Chats

T = chats.Template()
SOUP = ["</s>", "[INST]", "[/INST]", "<s>", "[ROLE]", "[/ROLE]", "[/TURN]", "<|image|>", "<|", "\\", "\\\\", "<", "[", " ", "ok", "\n", "é", "\U0001f600", "", "<\\/s>"]


def test_escapes_are_reversible_and_leave_no_control_string():
    r = random.Random(6)
    for _ in range(5000):
        s = "".join(r.choice(SOUP) for _ in range(r.randrange(12)))
        e = chats.escaped(s, T)
        assert chats.unescaped(e, T) == s and not any(c in e for c in T.controls())


def test_turns_read_back():
    r = random.Random(7)
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "system", "", "[INST] x"]), "".join(r.choice(SOUP) for _ in range(r.randrange(8)))) for _ in range(r.randrange(6))]
        pieces = [chats.piece(role, text, T) for role, text in turns]
        assert chats.parsed("".join(p["text"] for p in pieces), T) == turns
        for (role, text), p in zip(turns, pieces, strict=True):
            assert chats.unescaped(p["text"][p["body_at"] : p["body_at"] + p["body_chars"]], T) == text


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chats.Template(user=("USER: ", "\n")).checked()
    with pytest.raises(ValueError):
        chats.piece("user", [{"type": "video"}], T)


def test_parts_become_placeholders(spark):
    part = lambda kind, **k: {x: k.get(x) for x in ("text", "uri", "width", "height", "seconds", "pages")} | {"type": kind}
    rows = [
        (1, 1, "assistant", [part("text", text="see "), part("audio", uri="u2", seconds=1.5), part("document", uri="u3", pages=3)]),
        (1, 0, "user", [part("image", uri="u0", width=28, height=29), part("text", text="<|image|>"), None, part("image", uri="u1")]),
        (2, 0, "user", []),
        (2, 1, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{chats.PART}>")
    got = {(r.conv_id, r.place): r for r in chats.formatted(df).collect()}
    a, b = got[1, 0], got[1, 1]
    assert a.text == "[INST] <|image|><\\|image|><|image|> [/INST]" and b.text == "see <|audio|><|document|></s>"
    seen = [(x.number, x.kind, x.uri, x.tokens) for r in (a, b) for x in r.attachments]
    assert seen == [(0, "image", "u0", 6), (1, "image", "u1", 0), (2, "audio", "u2", 38), (3, "document", "u3", 1536)]
    assert all(r.text[x["at"] :].startswith(f"<|{x.kind}|>") for r in (a, b) for x in r.attachments)
    assert (b.start, b.loss_start, b.loss_chars) == (len(a.text), len(a.text), len("see <|audio|><|document|>"))
    back = {r.conv_id: r for r in chats.read(chats.formatted(df)).collect()}
    assert (back[1].n_turns, back[1].n_attachments, back[1].attachment_tokens) == (2, 4, 1580) and back[2].loss_chars == 0
    with pytest.raises(Exception, match="unknown type"):
        chats.formatted(df.withColumn("text", F.transform("text", lambda p: p.withField("type", F.lit("video"))))).collect()


def plain_chats(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), sum(len(x) for r, x in t if r == "assistant"), hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest()) for c, t in out.items()}


def test_chats_with_odd_rows(spark):
    """A conversation that holds most rows lies in many ranges; nulls, ties and repeated rows have their places."""
    r = random.Random(8)
    rows = [(7 if i % 3 else i, i % 500, r.choice(["user", "assistant", "system"]), "".join(r.choice(SOUP) for _ in range(5))) for i in range(3000)]
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), (9, None, "assistant", "last"), (9, 5, "assistant", None), (9, 5, "assistant", "")] + [(11, 0, "assistant", "same")] * 4
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("p"), "start": F.lit(1)}).repartition(5)
    pieces = chats.formatted(df)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chats.read(pieces).collect()}
    assert got == plain_chats(rows)
    whole = {}
    for p in sorted((p for p in pieces.collect() if p.conv_id == 7), key=lambda p: p.place):
        assert p.start == len(whole.setdefault(7, "")) and p.chars == len(p.text)
        whole[7] += p.text
    assert len(chats.parsed(whole[7], T)) == got[7][0]
    assert chats.read(chats.formatted(df.limit(0))).isEmpty()


def test_a_missing_piece_is_noticed(spark):
    df = spark.createDataFrame([(1, i, "user", "hi") for i in range(3)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="follows"):
        chats.read(chats.formatted(df).where("place <> 1")).collect()
