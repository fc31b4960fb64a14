import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, frag int, line string, hash long, hit boolean, model string, size string, digest string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(seed, n):
    import random

    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]


def corpus():
    """(doc_id, text): copies, near copies, short, empty, null, long and odd texts."""
    import random

    r = random.Random(7)
    base = [" ".join(words(i, 80)) for i in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    shared = " ".join(words(99, 30))
    for i in range(40):
        w = base[i % 3].split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        lines = [" ".join(w[:40]), " ".join(w[40:])]
        if i % 5 == 0:
            lines.append(shared)
        out.append((100 + i, "\n".join(lines)))
    out += [(200, base[0]), (201, base[0].upper()), (202, None), (203, ""), (204, " \n\t "), (205, "one two"), (206, "One two"), (207, "a b c d e"), (208, "x\u00a0y é ☃ " * 60), (209, "la " * 3000), (210, "ab" * 400), (211, shared + "\n" + shared), (212, "mit license\nReleased under the MIT License.\n" + shared)]
    out += [(None, base[1]), (None, None), (200, base[0]), (213, " ".join(words(5, 20_000)))]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(d, t, ["en", "de", None][i % 3], ["s1", "s2", None, "hot", "hot"][i % 5], 0, "c", 1, "l", 1, True, "m", "z", "g") for i, (d, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
