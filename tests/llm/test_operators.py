"""Each operator against a plain version on a small corpus with nulls, copies, ties and odd texts, and on no rows at all."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import common, jaccard, licenses, lines, mixing, packing, quality, repeats, topk, urls, weaklabels
from llm.common import components

from .conftest import corpus, words


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def union_find(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        top[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (1, 1), (20, 10), (30, 20), (40, 30), (50, 40)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([2, 3, 4, 5], 2), **dict.fromkeys([7, 8, 9], 7), **dict.fromkeys([10, 20, 30, 40, 50], 10)}


# 1


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_groups(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    top = union_find(len(rows), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]] = min(d, least.get(top[i], d))
    return [(d, len(s), least.get(top[i], d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def order(rows):
    return sorted(rows, key=str)


def test_jaccard(docs, empty):
    got = [tuple(r) for r in jaccard.groups(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert order(got) == order(near_groups(rows_of(docs)))
    assert len({c for _, _, c in got}) < len(got) - 20
    assert jaccard.groups(empty).isEmpty()


def test_jaccard_near_copies_without_their_base(spark):
    """A chain of edits: links go from neighbour to neighbour, and no text is near all others."""
    import random

    r, w, rows = random.Random(3), [f"w{i}" for i in range(120)], []
    for i in range(60):
        w = w.copy()
        w[r.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in jaccard.groups(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(near_groups(rows))


@pytest.mark.parametrize("block", [4096, 5])
def test_members_that_stay_apart_meet_once(spark, monkeypatch, block):
    """Pairs are those that share a bucket, and a group with many buckets in common is paired in one of them."""
    import random

    r = random.Random(5)
    group = [(b, i, i % 7) for b in range(40) for i in range(30)]
    odd = [(100 + b, i, 50 + i % 11) for b in range(12) for i in sorted({r.randrange(60) for _ in range(r.randrange(1, 25))})]
    comp = {**{i: 50 + i % 11 for i in range(60)}, **{i: i % 7 for i in range(30)}}
    rows = [(b, i, comp[i]) for b, i, _ in group + odd]
    judged = spark.sparkContext.accumulator(0)

    def alike(c, i, j):
        judged.add(len(i))
        assert c["bits"].shape == (len(c["v"]), 2)
        return (np.abs(c["v"][i] - c["v"][j]) <= 9) & (c["bits"][i, 1] >= 0)

    monkeypatch.setattr(common, "BLOCK", block)
    left = spark.createDataFrame(rows, "bucket long, id long, comp long")
    v = {i: r.randrange(60) for i in range(60)}
    table = spark.createDataFrame([(i, v[i], [i, i]) for i in v], "id long, v long, bits array<long>")
    got = [tuple(x) for x in common.met_apart(left, table, alike).collect()]
    held = {}
    for b, i, _ in rows:
        held.setdefault(b, set()).add(i)
    pairs = {(i, j) for h in held.values() for i in h for j in h if i < j and comp[i] != comp[j]}
    assert sorted(got) == sorted((i, j) for i, j in pairs if abs(v[i] - v[j]) <= 9)
    assert judged.value < 2 * len(pairs) < sum(comp[i] != comp[j] for h in held.values() for i in h for j in h if i < j) / 8


def test_near_copies_that_stay_apart(spark, monkeypatch):
    """Copies of a text, each with other edits, are alike and mostly not alike enough; two of them share many n-grams of their prefixes,
    and are compared a few times, not in each."""
    import random

    judged, differing = spark.sparkContext.accumulator(0), jaccard.differing

    def counted(percent):
        alike = differing(percent)

        def count(c, i, j):
            judged.add(len(i))
            return alike(c, i, j)

        return count

    monkeypatch.setattr(jaccard, "differing", counted)
    r, base, rows = random.Random(9), [f"w{i}" for i in range(400)], []
    for i in range(60):
        w = base.copy()
        for at in r.sample(range(400), 9 + i % 4):
            w[at] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = [tuple(x) for x in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(near_groups(rows))
    assert 0 < judged.value < 5 * 60 * 59 / 2


def test_bitmaps_count_sign_bits():
    bits = np.zeros((4, 32), np.int64)
    bits[1, 0], bits[2, 0], bits[3, 5] = -(1 << 63) + 1, -1, 7
    c = {"own": np.zeros(4, np.int64), "n": np.full(4, 64), "bits": bits}
    assert jaccard.differing(75)(c, np.array([0, 0, 0, 1]), np.array([1, 2, 3, 3])).tolist() == [True, False, True, True]
    c["own"][:] = [0, 0, 0, 20]
    assert jaccard.differing(75)(c, np.array([0, 0]), np.array([1, 3])).tolist() == [True, False]


def test_first_of_each(docs, empty):
    rows = digests_of(docs)
    sets = [shingles(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    best = {}
    for i, g in enumerate(union_find(len(rows), links)):
        best.setdefault(g if sets[i] else ("empty", i), []).append(((rows[i][0] is None, rows[i][0] or 0, rows[i][2]), rows[i][:2]))
    left = jaccard.first_of_each(docs)
    assert left.columns == docs.columns
    assert order((r.doc_id, r.text) for r in left.collect()) == order(min(x)[1] if isinstance(min(x)[0], tuple) else x for x in best.values())
    assert jaccard.first_of_each(empty).isEmpty()


def test_first_of_each_keeps_texts_of_one_doc_id(spark):
    names = ["doc_id", "text", "_hit", "_hash", "doc", "first", "dig"]
    rows = [(1, "a b c d e f g", *"12345"), (1, "wholly other words stand here now ok", *"23456"), (None, "a b c d e f g", *"34567"), (None, "no other text has these words", *"45678"), (2, "", *"56789"), (2, "", *"67890")]
    left = jaccard.first_of_each(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)))
    assert left.columns == names and order(r.text for r in left.collect()) == order(["a b c d e f g", "wholly other words stand here now ok", "no other text has these words", "", ""])


# 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def plain_normal(line):
    return re.sub(r"[\x00-\x60\x7b-\x7f]+", lambda m: "".join(c.lower() if c.isalpha() else "0" if c.isdigit() else " " for c in m[0]), line).split()


def plain_simhash(words):
    """Votes of each word's hash on the 24 bits of the block that it names; a block's distinct words weigh their bytes, four at most."""
    feats = []
    for w in words:
        raw = w.encode()
        feats += [raw] if len(raw) <= lines.LONG else [raw[i : i + lines.GRAM] for i in range(len(raw) - lines.GRAM + 1) if raw[i] & 0xC0 != 0x80]
    long = [f for f in feats if len(f) > 3]
    votes = [[0] * 24 for _ in range(lines.BLOCKS)]
    held = [set() for _ in range(lines.BLOCKS)]
    for f in long if len(long) >= lines.FEATURES else feats:
        h = int(lines.word_hashes(np.frombuffer(f, np.uint8), np.array([0]), np.array([len(f)]))[0])
        k = (h >> 40) % lines.BLOCKS
        held[k].add(f)
        for i in range(24):
            votes[k][i] += 1 if h >> i & 1 else -1
    return [sum((v > 0) << i for i, v in enumerate(b)) for b in votes], [sum(min(len(f), 4) for f in s) for s in held]


def linked_forms(x, y):
    """By the definition, of normal forms with their SimHashes."""
    (a, (va, ca)), (b, (vb, cb)) = x, y
    agree = [k for k in range(lines.BLOCKS) if va[k] == vb[k]]
    need = [min(8, max(5, math.ceil(sum(min(n, 100) for n in c) * 2 / 3))) for c in (ca, cb)]
    met = any(ca[i] + ca[j] >= need[0] and cb[i] + cb[j] >= need[1] for i in agree for j in agree if i < j)
    most = max(len(a), len(b)) // lines.NOT_ALIKE
    return met and min(len(a), len(b)) >= lines.FUZZY_CHARS and abs(len(a) - len(b)) <= most and distance(a, b) <= most


def digests_of(docs):
    return [(r.doc_id, r.text, r.d) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("d")).collect()]


def lines_brute(rows):
    """rows (doc_id, text, digest) to what is left of each text, and the number of links."""
    where = defaultdict(set)
    for d, t, g in rows:
        for i, line in enumerate((t or "").split("\n")):
            if w := plain_normal(line):
                where[" ".join(w)].add((d is None, d or 0, g, i))
    forms = [(f, plain_simhash(f.split())) for f in sorted(where)]
    links = [(i, j) for i in range(len(forms)) for j in range(i) if linked_forms(forms[i], forms[j])]
    group = defaultdict(set)
    for i, g in enumerate(union_find(len(forms), links)):
        group[g] |= where[forms[i][0]]
    gone = {p for places in group.values() for p in sorted(places)[1:]}
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d is None, d or 0, g, i) not in gone)) for d, t, g in rows], len(links)


def test_lines(docs, empty):
    some = docs.where("text is null or length(text) < 5000")
    want, n = lines_brute(digests_of(some))
    assert n > 0 and sum(len(t or "") for _, t in want) < 0.8 * sum(len(t or "") for _, t in rows_of(some))
    assert order((r.doc_id, r.text) for r in lines.deduplicated(some).collect()) == order(want)
    assert lines.deduplicated(some).columns == [*docs.columns, "n_lines", "n_removed"]
    assert lines.deduplicated(empty).isEmpty()


def test_lines_of_any_doc_id_stay_apart(spark):
    """Different texts under one doc_id, or none, are documents of their own: no unique line goes."""
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "wholly different unique line"), (None, "first of none\nseen twice here"), (None, "quite another thing\nseen twice here")]
    got = [(r.doc_id, r.text) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert order(got)[:3] == order([(1, "alpha beta gamma delta"), (2, ""), (2, "wholly different unique line")])
    rest = [t for d, t in got if d is None]
    assert sum("seen twice here" in t for t in rest) == 1 and any("first of none" in t for t in rest) and any("quite another thing" in t for t in rest)


def test_line_columns_may_have_any_name(spark):
    names = ["doc_id", "text", "n_lines", "N_removed", "_doc", "nos", "dig", "c0", "line", "body"]
    docs = spark.createDataFrame([(1, "same old line here", *"abcdefgh"), (2, "Same old line, here!", *"ijklmnop")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = lines.deduplicated(docs)
    assert out.columns == [*names, "n_lines_", "n_removed_"]
    assert order(tuple(r) for r in out.collect()) == order([(1, "same old line here", *"abcdefgh", 1, 0), (2, "", *"ijklmnop", 1, 1)])


def test_distances_side_by_side():
    """Verdicts on many pairs at once against the plain table of distances: empty, short, long, wide characters."""
    import random

    def distance(a, b):
        above = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
            above = row
        return above[-1]

    r = random.Random(3)
    pairs = []
    for _ in range(600):
        letters = r.choice(["ab", "abcdefgh ", "ä中文ab😀 "])
        a = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 63, 64, 65, 127, 128, 129, 256, 257])))
        b = list(a)
        for _ in range(r.randrange(max(2, len(a)))):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choice(["", r.choice(letters)])
        pairs.append((a, "".join(b)) if r.random() < 0.5 else ("".join(b), a))
    expected = [distance(a, b) * 4 <= max(len(a), len(b)) for a, b in pairs]
    assert 100 < sum(expected) < 500
    assert lines.within_all([a for a, _ in pairs], [b for _, b in pairs]).tolist() == expected
    assert [lines.within(a, b, max(len(a), len(b)) // 4) for a, b in pairs] == expected
    assert lines.within_all([], []).tolist() == []


def test_lines_find_edited_copies():
    """Of pairs with edit similarity 0.75 or more, as all pairs tell, nine in ten or more link: one to four words of a line replaced, dropped or added."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeiounrstlmd") for _ in range(r.randrange(2, 10)))
    base, near = [], []
    for _ in range(300):
        a = [word() for _ in range(r.randrange(10, 60))]
        b = list(a)
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[word()], [], [b[k], word()]])
        base.append(" ".join(a))
        near.append(" ".join(b))
    alike = [(a, b) for a, b in zip(base, near, strict=True) if a != b and lines.within(a, b, max(len(a), len(b)) // 4)]
    values, count = lines.simhashes([x.encode() for p in alike for x in p])
    forms = [(x, (v.tolist(), c.tolist())) for x, v, c in zip([x for p in alike for x in p], values, count, strict=True)]
    found = sum(linked_forms(forms[2 * i], forms[2 * i + 1]) for i in range(len(alike)))
    assert len(alike) > 250 and found >= 0.9 * len(alike)


def test_short_and_unspaced_lines(spark):
    """Equal lines go however short, and near copies of lines without spaces link."""
    base = "".join(chr(0x4E00 + 37 * i % 2000) for i in range(300))
    near = base[:150] + "\u4e00" + base[151:]
    rows = [(1, f"Home\nRead more\n\u6625\n{base}"), (2, f"home\nread  more\n\u6625\n{base}"), (3, f"{near}\nHomes\n\n\u590f")]
    got = {r.doc_id: (r.n_lines, r.text) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (4, rows[0][1]) and got[2] == (4, "") and got[3][1].endswith("Homes\n\n\u590f")


def test_long_lines_have_whole_simhashes():
    """Lines beyond a stretch, and words beyond one, count whole, as the plain version does."""
    long = b" ".join(b"word%d" % i for i in range(120_000)) + b" " + b"x1y2" * 150_000 + b" end"
    values, count = lines.simhashes([b"a b c", long, b"a b c"])
    assert (values[0] == values[2]).all() and count[0].sum() == 3
    feats = long.split()
    grams = {f[i : i + lines.GRAM] for f in feats if len(f) > lines.LONG for i in range(len(f) - lines.GRAM + 1)}
    assert count[1].sum() == 4 * len(grams | {f for f in feats if 3 < len(f) <= lines.LONG})
    small = long[:40_000]
    assert [x.tolist() for x in lines.simhashes([small])[0]] == [plain_simhash(small.decode().split())[0]]


# 3


def base_brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_base(docs, empty):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(docs).collect()]
    assert order(got) == order((d, *base_brute(t)) for d, t in rows_of(docs))
    assert quality.assess(empty).isEmpty() and quality.filtered(empty).isEmpty()


def test_filtered_is_kept(docs):
    kept = order(r.doc_id for r in quality.assess(docs).where("kept").collect())
    left = quality.filtered(docs)
    assert left.columns == docs.columns and order(r.doc_id for r in left.collect()) == kept and kept


def plain_kneser_ney(mine, others):
    """n-gram to log probability for all n-grams of mine and others: interpolated modified Kneser-Ney over 5-grams of folded
    characters, counted on others alone."""
    count = {5: Counter(g for t in others for g in grams_of(t))}
    every = {5: {g for t in [*mine, *others] for g in grams_of(t)}}
    for k in (4, 3, 2, 1):
        count[k] = Counter(g[1:] for g in count[k + 1])
        every[k] = {g[1:] for g in every[k + 1]}
    p = {"": 1 / len(every[1])}
    for k in (1, 2, 3, 4, 5):
        n = Counter(count[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        d = {0: 0, **{i: min(max(i - (i + 1) * y * n[i + 1] / n[i], quality.LEAST), i) if n[i] else 0.5 for i in (1, 2, 3)}}
        total, gamma = Counter(), Counter()
        for g, c in count[k].items():
            total[g[:-1]] += c
            gamma[g[:-1]] += d[min(c, 3)]
        for g in every[k]:
            c, t = count[k][g], total[g[:-1]]
            p[g] = (c - d[min(c, 3)] + gamma[g[:-1]] * p[g[1:]]) / t if t else p[g[1:]]
    return {g: np.log(max(p[g], 1e-12)) for g in every[5]}


def grams_of(text):
    x = "\0" * 4 + "".join(chr(quality.fold(ord(c))) for c in text)
    return [x[i - 4 : i + 1] for i in range(4, len(x))]


def plain_verdicts(rows):
    """(doc_id, text, lang, half) to the sum of log probabilities, and what the bands say, by the book."""
    texts = [[t or "" for _, t, _, half in rows if half == s] for s in (0, 1)]
    models = [plain_kneser_ney(texts[0], texts[1]), plain_kneser_ney(texts[1], texts[0])]
    logp = [sum(models[half][g] for g in grams_of(t or "")) for _, t, _, half in rows]
    each = [round(-p / len(t), 4) if t else None for p, (_, t, _, _) in zip(logp, rows, strict=True)]
    failed = [base_brute(t)[-1] for _, t, _, _ in rows]
    within = []
    for x, (_, _, lang, _) in zip(each, rows, strict=True):
        good = [y for y, f, r in zip(each, failed, rows, strict=True) if r[2] == lang and y is not None and not f]
        mid = np.median(good) if good else None
        dev = max(np.median([round(abs(y - mid), 4) for y in good]), 0.002) if good else None
        within.append(x is None or not good or mid - quality.BELOW * dev <= x <= mid + quality.ABOVE * dev)
    return [(p, not f and w) for p, f, w in zip(logp, failed, within, strict=True)]


@pytest.mark.parametrize("shard", [quality.SHARD, 500])
def test_model_against_plain_version(spark, monkeypatch, shard):
    """Letters of any script, null languages and ids, repeats, and any number of shards give what the plain version gives; so do bands."""
    monkeypatch.setattr(quality, "SHARD", shard)
    cjk = "".join(chr(0x4E00 + i * i % 90) for i in range(200))
    rows = [(1, " ".join(words(1, 60)), "en"), (2, " ".join(words(2, 60)).upper() + " \t0123", "en"), (3, cjk, "zh"), (4, cjk[50:] + "\u3002\U0001f600", "zh"), (5, " ".join(words(1, 30)), None), (6, "\u0431\u043e\u0440\u0449 \u0438 \u0425\u043b\u0435\u0431", "ru"), (6, "x", "en"), (None, "x", "en"), (7, "", "en"), (8, None, "en"), (None, " ".join(words(1, 60)), None)]
    rows += [(i, " ".join(words(i, 70)), "en") for i in range(10, 40)] + [(40, " ".join(f"{i * 7919 % 1000003:x}{chr(0x3B1 + i % 20)}q" for i in range(70)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", (F.xxhash64("text").bitwiseAND(F.lit(1))).cast("int")).collect()]
    plain = plain_verdicts(rows)
    want = order((d, m, round(float(p), 3), kept) for (d, _, m, _), (p, kept) in zip(rows, plain, strict=True))
    got = order((r.doc_id, r.lang, round(r.logp, 3), r.kept) for r in quality.assess(docs).collect())
    assert [(*x[:2], x[3]) for x in got] == [(*x[:2], x[3]) for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-2)
    assert not next(x for x in got if x[0] == 40)[3] and sum(x[3] for x in got) > 25


def test_noise_gets_no_credit_for_its_own_counts(spark):
    """Unique noise in any script is less likely than prose; prose in two languages, whatever its label, is not."""
    import random

    r = random.Random(4)
    kinds = {"en": "time people water house light garden stone river".split(), "fr": "temps gens eau maison lumi\u00e8re jardin pierre fleuve".split()}
    prose = [(i, " ".join(r.choice(kinds[m]) for _ in range(90)), m) for i in range(200) for m in ("en", "fr")]
    noise = [(900 + i, " ".join("".join(chr(r.randrange(lo, lo + 400)) for _ in range(5)) for _ in range(90)), "en") for i, lo in enumerate((0x4E00, 0x400, 0xAC00))]
    mixed = [(950, " ".join(r.choice(kinds["en"]) for _ in range(60)) + " " + " ".join(r.choice(kinds["fr"]) for _ in range(60)), "en")]
    rows = {x.doc_id: x for x in quality.assess(spark.createDataFrame(prose + noise + mixed, "doc_id long, text string, lang string")).collect()}
    assert all(rows[900 + i].log_ppl > rows[900 + i].high and not rows[900 + i].kept for i in range(3)) and rows[950].kept


def test_filtered_columns_may_have_any_name(spark):
    text = " ".join(words(3, 80))
    names = ["doc_id", "text", "lang", "_model", "model", "dig", "m", "c0"]
    docs = spark.createDataFrame([(1, text, "en", *"abcde"), (2, "short", "en", *"fghij"), (None, text + " more", None, *"klmno")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    left = quality.filtered(docs)
    assert left.columns == names and sorted(r.c0 for r in left.collect()) == ["e", "o"]


def test_bands_reject_noise(spark):
    import random

    r = random.Random(1)
    good = [" ".join(r.choice("time people water house light garden stone river".split()) for _ in range(90)) for _ in range(300)]
    good = [" ".join(w + r.choice(["", "s", "ed"]) for w in g.split()) for g in good]
    bad = ["".join(r.choice("qzxjkvwbp ") for _ in range(500)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in quality.assess(df).where("kept").collect()}
    assert not kept & {300, 301, 302} and len(kept) > 250


def test_bands_reject_what_others_say(spark):
    """The lower band rejects what passes the plain rules and is far more predictable than its language: nothing but sentences that
    many others hold. Repetition of a text's own is new to the other half's model and lies above."""
    import random

    r = random.Random(2)
    vocabulary = ["".join(r.choice("aeiourstnlm") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    drawn = lambda n: [r.choice(vocabulary) for _ in range(n)]
    common = [drawn(12) for _ in range(5)]
    good = [" ".join(r.choice(common) + drawn(80)) for _ in range(300)]
    stale = " ".join(w for x in common for w in x)
    own = " ".join("".join(r.choice(["jaja", "juju", "jojo", "jiji"]) for _ in range(4)) for _ in range(90))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, stale, own])], "doc_id long, text string, lang string")
    rows = {x.doc_id: x for x in quality.assess(df).collect()}
    assert not rows[300].base_failed and not rows[300].kept and rows[300].log_ppl < rows[300].low
    assert not rows[301].base_failed and not rows[301].kept and sum(x.kept for x in rows.values()) > 290


# 4


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(0)
    good = r.random(4000) < 0.8
    v = np.ones((4000, len(weaklabels.LABELLERS)), int)
    for i in (1, 2, 3, 4):
        v[(~good & (r.random(4000) < 0.7)) | (r.random(4000) < 0.003), i] = 0
    code = (v * 3 ** np.arange(len(weaklabels.LABELLERS))[::-1]).sum(1)
    pattern, at, n = np.unique(code, return_inverse=True, return_counts=True)
    post, rate, share = weaklabels.maximised(pattern, n)
    assert ((post[at] >= 0.5) == good).mean() > 0.95 and rate[1, 0, 0] > 10 * rate[1, 1, 0]


def test_classifier(spark, docs, empty):
    import random

    r = random.Random(2)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda junk: " ".join((r.choice(vocabulary).upper() + "###" if junk else r.choice(vocabulary)) for _ in range(80)) + "."
    df = spark.createDataFrame([(i, text(i % 5 == 0)) for i in range(500)], "doc_id long, text string")
    got = {x.doc_id: x.label for x in weaklabels.classify(df, 200).collect()}
    assert sum(got[i] == (i % 5 != 0) for i in range(500)) > 480  # most were not in the sample
    assert weaklabels.classify(docs).count() == docs.count()
    assert weaklabels.classify(empty).isEmpty()


# 5


def test_bucket_pointers():
    """Positions share a pointer where 100 bytes are equal, and pointers are in the order of the bytes, as sorting all tells."""
    rng = np.random.default_rng(0)
    for letters, n in ((2, 3000), (1, 700), (256, 5000), (3, 100), (3, 99), (3, 0)):
        b = rng.integers(0, letters, n).astype(np.uint8)
        if n > 1000:
            b[2000:2400], b[700:950] = b[100:500], b[100:350]
        strings = [b[i : i + repeats.LENGTH].tobytes() for i in range(max(n - repeats.LENGTH + 1, 0))]
        pointer = repeats.pointers(b)
        assert len(pointer) == len(strings)
        assert len(set(zip(strings, pointer.tolist(), strict=True))) == len(set(strings)) == len(set(pointer.tolist()))
        inorder = [int(pointer[i]) for i in sorted(range(len(strings)), key=strings.__getitem__)]
        assert inorder == sorted(inorder)


def test_repeats(spark, docs, empty, monkeypatch):
    rows = [(d, t) for d, t in dict(corpus()).items() if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def result(df):
        every, cut = repeats.cleaned(df)
        out = every.join(cut, ["doc_id", "digest"], "left").collect()
        return sorted((r.doc_id, r.n_bytes, r.n_bytes if r.copy else r.n_removed or 0, 1 if r.copy else r.n_spans or 0, hashlib.sha256(b"").hexdigest() if r.copy else hashlib.sha256(r.kept).hexdigest() if r.kept is not None else r.digest) for r in out)

    want = repeats.brute([(d, (t or "").encode()) for d, t in rows])
    assert sum(w[2] for w in want) > 3000
    assert result(df) == want
    monkeypatch.setattr(repeats, "HOT", 3)
    assert result(df) == want
    assert repeats.cleaned(docs)[0].count() == docs.count()
    assert repeats.cleaned(empty)[0].isEmpty()


# 6


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    total, by = sum(r.size for r in got), defaultdict(list)
    for r in got:
        by[r.skey].append(r)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-6 * total
    for rows in by.values():
        size, most = sum(r.size for r in rows), max(r.size for r in rows)
        assert rows[0].source_size == size and rows[0].target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= most
    assert order(tuple(r) for r in mixing.mix(docs.repartition(5)).collect()) == order(tuple(r) for r in got)
    assert mixing.mix(empty).isEmpty()


def test_targets_overflow_by_weight(spark):
    s = spark.createDataFrame([("0a", 1000), ("0b", 10), ("0c", 90), ("1", 0)], "skey string, source_size long")
    got = {r.skey: r.target for r in mixing.targets(s).collect()}
    assert got["0b"] == 30 and got["0c"] == 270 and got["1"] == 0 and abs(got["0a"] - 800) < 1e-9


# 7


def topk_brute(rows, k=10):
    out = []
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, qv in sorted(ok):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, cv, strict=False)), c) for c, cv in ok if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return out


def test_topk(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=40).tolist()) for i in range(700)]
    rows += [(900 + i, rows[3][1]) for i in range(20)] + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 40), (1300, [0.5]), (None, [1.0] * 40), (1400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1)).repartition(3)
    v = topk.usable(df, "vec_id", "embedding")
    got = sorted(tuple(x) for x in topk.search(v.where("id % 100 = 0"), v).collect())
    assert got == topk_brute(rows)
    assert topk.search(v.limit(0), v).isEmpty() and topk.search(v.where("id = 100"), v.limit(0)).isEmpty()
    few = topk.search(v.where("id = 100"), v.where("id < 4 or id = 100")).collect()
    assert len(few) == 4


def test_topk_never_passes_blocks_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 4)
    rows = [(i, [float((i * k) % 17 - 8) / 16 for k in range(1, 5)]) for i in range(900)]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    found = topk.search(v.where("id % 100 = 0"), v)
    assert sorted(tuple(x) for x in found.collect()) == topk_brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_topk_of_large_numbers(spark):
    """Finite components of any size are ranked exactly; scores beyond 64 bits show as the last number that fits."""
    from fractions import Fraction
    from math import floor

    r = np.random.default_rng(6)
    rows = [(100, [1e18, 1e18]), (1, [1e18, 1e18]), (2, [-1.0, 0.0]), (3, [1e18, 1e18 + 1024]), (4, [-1e300, 1e300]), (200, [1e300, 5e-324]), (5, [1e10, -1e10]), (6, [float(2**50), 3.0]), (300, [0.25, -0.5])]
    rows += [(10 + i, (r.normal(size=2) * 10.0 ** r.integers(-3, 200)).tolist()) for i in range(40)]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding")
    got = sorted(tuple(x) for x in topk.search(v.where("id % 100 = 0"), v).collect())
    ints = [(i, [floor(Fraction(x) * 1024) for x in v]) for i, v in rows]
    want = []
    for q, qv in sorted(x for x in ints if x[0] % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(qv, cv, strict=True)), c) for c, cv in ints if c != q)[:10]
        want += [(q, n, c, max(-(2**63), min(2**63 - 1, -s))) for n, (s, c) in enumerate(scored, 1)]
    assert got == want and [topk.sortable(x) for x in (0, 2**62, -(2**62))] == ["", "", ""]


# 8


def test_urls(spark):
    cases = [
        ("http://a.example.com/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("HTTP://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://b.com/x", "b.com", "/x", "com/", "allow"),
        ("https://b.com", "b.com", "", None, "allow"),
        ("x://notcom/x", "notcom", "/x", None, "allow"),
        ("ftp://a.net/es/#z", "a.net", "/es/", "net/es/", "block"),
        ("ftp://a.net/ES/", "a.net", "/ES/", None, "allow"),
        ("https://www.bad.org:443/p/?a=1", "www.bad.org:443", "/p/", None, "block"),
        ("http://bad.org/p/index.html", "bad.org", "/p/index.html", None, "block"),
        ("http://bad.org/p/q", "bad.org", "/p/q", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)] * 2, "page_id long, url string, verdict string").withColumn("hit", F.lit(1)).withColumn("canon", F.lit(2))
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,)], "canon string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, listed).collect())
    assert got == sorted([(i, *c[1:]) for i, c in enumerate(cases)] * 2)
    assert urls.judge(df.limit(0), listed).isEmpty() and urls.judge(df, listed.limit(0)).where("listed").isEmpty()


def test_filter_never_misses(spark):
    df = spark.range(5000).withColumn("canon", F.concat(F.lit("u"), F.col("id")))
    words = urls.bloom(df.where("id < 2500"), urls.hash_of("canon"))
    hit = urls.may_hold(spark, df, urls.hash_of("canon"), words)
    assert hit.where("id < 2500 and not _hit").isEmpty() and hit.where("id >= 2500 and _hit").count() < 250
    small = urls.bloom(df, urls.hash_of("canon"), max_blocks=2)
    assert len(small) == 2 and urls.may_hold(spark, df, urls.hash_of("canon"), small).where("not _hit").isEmpty()


# 9


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, got = Tokenizer.from_file(path), packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in corpus() if d is not None}
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    assert set(parts) == set(want)
    for d, rows in parts.items():
        assert sorted((r.start, r.start + r.length) for r in rows) == [(s, min(s + 2048, len(want[d]))) for s in range(0, len(want[d]), 2048)]
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    assert sorted(seqs) == list(range(len(seqs))) and packing.pack(empty, path).isEmpty()


def test_special_strings_and_speed_path():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, f = Tokenizer.from_file(path), packing.encoder(path)
    for s in ("a<|endoftext|>b", "", " ", "\n\n  x", "été ☃ \u00a0 '", "12345 it's", "a" * 3000, "\x00\x7f", "日本語"):
        assert list(f(s)) == t.encode(s, add_special_tokens=False).ids


def test_fill_is_closest():
    import itertools
    import random

    r = random.Random(4)
    for _ in range(60):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(4)}
        room = r.randrange(1, 90)
        best = max(s for p in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(x * k for x, k in zip(counts, p, strict=True))) <= room)
        found = packing.fill(dict(counts), room)
        assert sum(k * n for k, n in found.items()) == best and all(n <= counts[k] for k, n in found.items())


def test_plan_uses_each_piece_once():
    import random

    r = random.Random(6)
    counts = Counter(r.randrange(1, 65) for _ in range(500))
    rows = packing.plan(dict(counts), 64)
    used = defaultdict(list)
    for x in rows:
        used[x["length"]].append((x["low"], x["high"]))
    for k, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == counts[k] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    n = max(x["base"] + (x["high"] - x["low"]) // x["each"] for x in rows)
    assert n <= -(-sum(k * v for k, v in counts.items()) // 64) + 3


# 10


def licenses_brute(text):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    w = word.findall(low(text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.0
    for line in low(text or "").split("\n"):
        x = word.findall(line)
        tokens = set(zip(x, x[1:], strict=False))
        for label, template in licenses.TEMPLATES:
            y = word.findall(low(template))
            t = set(zip(y, y[1:], strict=False))
            if len(tokens & t) >= licenses.THRESHOLD * len(t):
                labels.add(label)
                score = max(score, len(tokens & t) / len(t))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses(spark, docs, empty):
    texts = [t for _, t in corpus()] + [f"Text\n{t}\nmore" for _, t in licenses.TEMPLATES] + ["MIT License mit license\nthe Apache\nLicense", "released under the mit", "General  public--License, GENERAL PUBLIC LICENSE", "licensed under cc by nc 4 0 licensed"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses.scan(df).collect()) == sorted(((i, *licenses_brute(t)) for i, t in enumerate(texts)), key=lambda r: r[0])
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).isEmpty()


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "REM ", "dnl "])
def test_wrapped_and_commented_licenses(spark, mark):
    import textwrap

    def wrapped(t, width):
        return "\n".join(mark + x for x in ["Some words before.", *textwrap.wrap(t, width), "More words after."])

    cases = [(label, wrapped(t, width)) for label, t in licenses.TEMPLATES for width in (30, 60, 80)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.scan(df).collect()}
    assert all(label in got[i][0] and got[i][1] == 1.0 for i, (label, _) in enumerate(cases))


def blocks_brute(templates, words, ends):
    """Containment in every paragraph and every window of a template's length, plainly counted."""
    want = set()
    for name, template in templates:
        y = template.encode().translate(licenses._CLEAN).split()
        own = {*licenses.pairs(y)}
        blocks = [words[a:b] for a, b in zip([0, *ends], ends, strict=False)] + [words[i : i + len(y)] for i in range(len(words))]
        best = max((len(own & {*licenses.pairs(b)}) for b in blocks), default=0)
        if own and best >= licenses.THRESHOLD * len(own):
            want.add((name, best / len(own)))
    return want


@pytest.mark.parametrize("whole", [False, True])
def test_paragraphs_and_windows_against_all_blocks(whole):
    """Sentences, and whole texts of hundreds of words that share many of their words and pairs, some as parts of others."""
    import random

    r = random.Random(8)
    templates = licenses.TEMPLATES
    if whole:
        vocabulary = [f"w{i}" for i in range(60)]
        shared = [[r.choice(vocabulary[:25]) for _ in range(20)] for _ in range(6)]
        drawn = [[w for _ in range(r.randrange(2, 8)) for w in (r.choice(shared) if r.random() < 0.4 else [r.choice(vocabulary) for _ in range(25)])] for _ in range(30)]
        templates = [(f"t{i}", " ".join(x)) for i, x in enumerate([*drawn, drawn[0][:60], drawn[1] + drawn[2], ["w1"], []])]
    seen = Counter(t for _, x in templates for t in licenses.pairs(x.encode().translate(licenses._CLEAN).split()))
    index = licenses.Index(templates, seen, licenses.THRESHOLD)
    met, rounds = 0, 150 if whole else 400
    for _ in range(rounds):
        _, t = r.choice(templates)
        w = [x for x in t.split() for _ in range(r.choice([1] * 12 + [2])) if r.random() > (0.08 if whole else 0.04)]
        for _ in range(r.randrange(4)):
            w.insert(r.randrange(len(w) + 1), r.choice(["the", "license", "foo bar", "under"]))
        if whole:
            w += r.choice(templates)[1].split()[: r.randrange(200)]
        text = "".join(x + r.choice([" "] * (60 if whole else 6) + ["\n", "\n\n"]) for x in ["of", "the", *w, "the", "work"]).encode().translate(licenses._CLEAN)
        words, ends = licenses.unwrapped(text)
        want = blocks_brute(templates, words, ends)
        assert set(index.spread(words, ends)) == want
        met += bool(want)
    assert rounds / 8 < met
    assert not list(index.spread([], [0])) and not list(index.spread([b"of"], [1]))
