from pyspark.sql import functions as F
import pytest

from plumbline.functions.numbers import normal_cdf
from plumbline.operators import abtest, attack, candidates, composite, costs, dataset, difficulty, hybrid, optimize, order, stats, verifier

CAND = "instance_id string, patch_id string, source string, verifier_pass boolean, true_quality int"


def cands(spark, rows):
    return spark.createDataFrame([("t", f"p{i}", s, p, q) for i, (s, p, q) in enumerate(rows)], CAND)


def score(spark, rows):
    return verifier.verifier_scores(cands(spark, rows)).first()


def test_verifier_cases(spark):
    perfect = score(spark, [("gold", True, 3), ("exploit", False, 1), ("trivial", False, 0)])
    assert perfect.top1 == 1 and perfect.n_false_positives == 0 and perfect.n_false_negatives == 0 and perfect.spearman > 0.5 and perfect.composite > 0.7
    hack = score(spark, [("gold", True, 3), ("exploit", True, 1), ("trivial", False, 0)])
    assert hack.n_false_positives == 1 and hack.fpr > 0 and hack.composite < 1
    strict = score(spark, [("gold", False, 3), ("exploit", False, 1), ("trivial", False, 0)])
    assert strict.n_false_negatives == 1 and strict.fnr == 1 and strict.spearman == 0 and strict.composite < 0.7
    worst = score(spark, [("gold", False, 3), ("exploit", True, 1), ("trivial", True, 0)])
    assert worst.n_false_positives == 2 and worst.n_false_negatives == 1 and worst.spearman < 0 and worst.composite < 0.5
    broken = score(spark, [("gold", True, 3), *[("exploit", True, 1)] * 3, ("trivial", False, 0)])
    assert broken.fpr == 0.75
    null = score(spark, [("gold", None, 3), ("trivial", False, 0)])
    assert null.n_false_negatives == 1


def test_spearman_with_ties_is_the_short_formula(spark):
    assert abs(score(spark, [("g", True, 3), ("e", False, 1), ("e", False, 1), ("t", False, 0)]).spearman - 0.85) < 1e-9


def test_empty_tasks(spark):
    tasks = spark.createDataFrame([("t",), ("u",)], "instance_id string")
    out = verifier.with_empty(verifier.verifier_scores(cands(spark, [("gold", True, 3)])), tasks)
    u = out.where("instance_id = 'u'").first()
    assert u.composite == 0 and u.mae == 1 and u.n_candidates == 0


@pytest.mark.parametrize(("values", "ranks"), [([10, 30, 20], [1, 3, 2]), ([10, 10, 30], [1.5, 1.5, 3]), ([5, 5, 5], [2, 2, 2])])
def test_average_rank(spark, values, ranks):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    assert [r.r for r in verifier.average_rank(df, "v", "r").orderBy("i").collect()] == ranks


def test_unknown_weight():
    with pytest.raises(ValueError):
        verifier.composite({"speed": 1.0})


def judged(spark, rows):
    c = spark.createDataFrame([("t", f"p{i}", p) for i, (p, _) in enumerate(rows)], "instance_id string, patch_id string, verifier_pass boolean")
    j = spark.createDataFrame([("t", f"p{i}", v, 0.5) for i, (_, v) in enumerate(rows) if v], "instance_id string, patch_id string, verdict string, cost_usd double")
    return hybrid.confusion(c, j).first()


def test_confusion(spark):
    r = judged(spark, [(True, "correct"), (False, "incorrect")])
    assert (r.tp, r.tn, r.f1) == (1, 1, 1)
    r = judged(spark, [(True, "incorrect"), (False, "correct"), (False, "partial"), (None, "correct"), (True, "uncertain"), (True, None)])
    assert (r.fp, r.fn, r.n_skipped, r.n_judged, r.f1) == (1, 2, 3, 3, 0) and r.cost_usd == 2.5


def test_later_judgments_hold(spark):
    c = spark.createDataFrame([("t", "p", True)] * 2 + [("t", "q", True), ("t", "r", None)], "instance_id string, patch_id string, verifier_pass boolean")
    j = spark.createDataFrame([("t", "p", "uncertain", 1, 0.5), ("t", "p", "correct", 2, 0.5), ("t", "q", "correct", 1, 0.5), ("t", "q", "incorrect", 2, 0.5), ("t", "z", "correct", 1, 0.5), ("u", "z", "correct", 1, 9.0)], "instance_id string, patch_id string, verdict string, n int, cost_usd double")
    r = hybrid.confusion(c, j, order=["n"]).collect()
    assert [(x.tp, x.fp, x.n_skipped, x.cost_usd) for x in r] == [(2, 1, 1, 2.5)]
    assert sorted(x.cell for x in hybrid.cells(c, j, order=["n"]).collect()) == ["fp", "skipped", "tp", "tp"]


def test_vote_keeps_the_best_reasons(spark):
    rows = [("a", "correct", 0.6, 0.1, 0, "first", 2.0), ("a", "correct", 0.8, 0.1, 1, "second", 1.0), ("a", "correct", 0.8, 0.1, 2, "third", 0.5), ("a", "incorrect", 0.9, 0.1, 3, "other", 4.0)]
    df = spark.createDataFrame(rows, "p string, verdict string, confidence double, cost_usd double, k int, conclusion string, latency_seconds double")
    v = hybrid.voted(df, ["p"], ["k"])
    assert v.select("verdict", "conclusion", "confidence", "latency_seconds").first() == ("correct", "second", 0.6, 7.5)
    z = hybrid.judged_all(spark.createDataFrame([("z",)], "p string"), v, ["p"]).first()
    assert (z.verdict, z.conclusion, z.latency_seconds) == ("uncertain", "No judgment samples available", 0.0)


def test_order(spark):
    """Sums before each row, in and across ranges, with nulls and ties, against plain Python."""
    rows = [(i, [None, "a", "b"][i % 3], i * 7919 % 1000 if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(5)
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    got = {r.i: r.position for r in order.positioned(df, ["v", "i"]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key))}
    got, want = {r.i: r.s for r in order.cumulated(df, {"s": F.col("i").cast("long")}, ["v", "i"], ["g"]).collect()}, {}
    for g in (None, "a", "b"):
        total = 0
        for r in sorted((r for r in rows if r[1] == g), key=key):
            want[r[0]], total = total, total + r[0]
    assert got == want
    ranks = {r.i: r.r for r in order.mean_ranks(df, "v", "r").collect()}
    values = sorted((r[2] is not None, r[2] or 0) for r in rows)
    first = {v: n for n, v in reversed(list(enumerate(values)))}
    assert all(ranks[i] == first[v is not None, v or 0] + (values.count((v is not None, v or 0)) + 1) / 2 for i, _, v in rows)
    assert order.mean_ranks(df.limit(0), "v", "r").isEmpty()


def test_binomial_tail(spark):
    """Against exact fractions, and for a billion against sums of 60 digits."""
    import math
    from decimal import Decimal, localcontext
    from fractions import Fraction

    def plain(k, n):
        return float(min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))

    def large(k, n):
        with localcontext() as c:
            c.prec = 60
            pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
            log = lambda x: (x + Decimal("0.5")) * x.ln() - x + (2 * pi).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
            total = term = (log(Decimal(n)) - log(Decimal(k)) - log(Decimal(n - k)) - n * Decimal(2).ln()).exp()
            i = k
            while term > total * Decimal("1e-20"):
                term = term * i / (n - i + 1)
                total, i = total + term, i - 1
            return float(2 * total)

    cases = {(k, n): plain(k, n) for n in (0, 1, 2, 5, 10, 21, 40, 333) for k in range(0, n // 2 + 1, max(1, n // 20))}
    cases[499_990_000, 1_000_000_000] = large(499_990_000, 1_000_000_000)
    cases[30_000, 100_000] = 0.0
    df = spark.createDataFrame([*cases, (None, 5)], "k long, n long")
    for r in df.select("k", "n", abtest.binomial_p(F.col("k"), F.col("n")).alias("p")).collect():
        assert r.p is None if r.k is None else abs(r.p - cases[r.k, r.n]) <= 1e-9 * max(cases[r.k, r.n], 1e-300)


def test_running_totals(spark):
    calls = spark.createDataFrame([(3, 0.5), (1, 0.25), (2, None)], "k int, cost_usd double")
    assert [tuple(r)[-2:] for r in costs.running_totals(calls, ["k"]).orderBy("k").collect()] == [(1, 0.25), (2, 0.25), (3, 0.75)]


def test_upgrade(spark):
    rows = [("gold", False, "incorrect", 0), ("trivial", True, "correct", 2), ("exploit", True, "incorrect", 0), ("exploit", True, "correct", 1), ("exploit", False, "partial", 0), ("exploit", True, "uncertain", 1), ("exploit", False, "incorrect", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, p boolean, v string, q int")
    got = df.withColumn("n", hybrid.upgraded(F.col("s"), F.col("p"), F.col("v"), F.col("q"))).orderBy("i").collect()
    assert [r.n for r in got] == [3, 0, 1, 3, 2, 1, 0]


def test_vote_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([("a", "partial", 0.5, 0.1, 0), ("a", "correct", 0.9, 0.1, 1), ("b", "correct", 0.6, 0.1, 0), ("b", "correct", 0.8, 0.1, 1), ("b", "incorrect", 0.9, 0.1, 2)], "p string, verdict string, confidence double, cost_usd double, k int")
    got = {r.p: r for r in hybrid.voted(df, ["p"], ["k"]).collect()}
    assert got["a"].verdict == "partial" and got["a"].confidence == 0.25
    assert got["b"].verdict == "correct" and got["b"].confidence == 0.5333 and got["b"].n_samples == 3
    every = hybrid.judged_all(spark.createDataFrame([("a",), ("z",)], "p string"), hybrid.voted(df, ["p"], ["k"]), ["p"])
    assert every.where("p = 'z'").first().verdict == "uncertain"
    assert hybrid.voted(df, ["p"], ["k"], most=1).where("p = 'b'").first().n_samples == 1


def test_solve_rates(spark):
    subs = spark.createDataFrame([("a", ["t1", "t2", "t2"]), ("b", ["t1", "t3"]), ("c", ["t1"])], "submission string, resolved array<string>")
    got = {r.instance_id: r.solve_rate for r in difficulty.from_lists(subs).collect()}
    assert got == {"t1": 1.0, "t2": 1 / 3, "t3": 1 / 3}
    targets = spark.createDataFrame([("t1",), ("t9",)], "instance_id string")
    assert {r.instance_id: r.solve_rate for r in difficulty.from_lists(subs, targets).collect()} == {"t1": 1.0, "t9": 0.0}
    assert difficulty.from_lists(subs.limit(0)).isEmpty()


@pytest.mark.parametrize(("p", "tier", "flagged"), [(0.5, "medium", False), (0.02, "too_hard", True), (0.98, "too_easy", True), (0.1, "hard", False), (0.9, "easy", False), (1.5, "too_easy", True), (-0.3, "too_hard", True), (0.05, "hard", False), (0.95, "too_easy", True)])
def test_tiers(spark, p, tier, flagged):
    r = difficulty.profiled(spark.createDataFrame([("t", p)], "instance_id string, solve_rate double")).first()
    assert (r.difficulty_tier, r.flagged) == (tier, flagged) and r.gradient_signal == round(min(max(p, 0), 1) * (1 - min(max(p, 0), 1)), 4)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.5, 0.95, 1.0, 0.1, 0.3, 0.7, 0.9)], "pass_rate double")
    assert {r.band: r.n for r in difficulty.bands(df).collect()} == {"0.0": 1, "0.0-0.1": 1, "0.1-0.3": 1, "0.3-0.7": 3, "0.7-0.9": 1, "0.9-1.0": 1, "1.0": 1}
    assert {r.n for r in difficulty.bands(df.limit(0)).collect()} == {0}


SOURCES = "instance_id string, v_score double, v_fpr double, v_fnr double, exploit_rate double, h_f1 double, h_fpr double, h_fnr double, gradient_signal double, difficulty_tier string"


def eqs_of(spark, *row):
    return composite.scored(spark.createDataFrame([("t", *row)], SOURCES)).first()


def test_eqs(spark):
    best = eqs_of(spark, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.25, "medium")
    assert best.eqs == 1 and best.verdict == "KEEP" and not best.weaknesses
    assert eqs_of(spark, 1.0, 0.0, 0.0, 0.0, None, None, None, None, None).eqs == 1.0
    nothing = eqs_of(spark, *[None] * 9)
    assert nothing.eqs == 0 and nothing.verdict == "DROP"
    assert eqs_of(spark, *[None] * 3, 0.2, *[None] * 5).exploit == 0.8
    bad = eqs_of(spark, 0.2, 0.6, 0.7, 0.6, 0.1, 0.4, 0.4, 0.0, "too_hard")
    assert [(w.dimension, w.severity) for w in bad.weaknesses] == [("verifier", "critical"), ("verifier", "high"), ("exploit", "critical"), ("hybrid", "high"), ("hybrid", "medium"), ("difficulty", "high")]


@pytest.mark.parametrize(("score", "weak", "want"), [(0.85, [], "KEEP"), (0.55, [("high", True)], "FIX"), (0.55, [("high", False)], "DROP"), (0.2, [("high", True)], "DROP"), (0.95, [("critical", False)], "DROP"), (0.75, [("critical", True)], "KEEP"), (0.7, [], "KEEP"), (0.4, [("low", True)], "FIX")])
def test_verdict(spark, score, weak, want):
    df = spark.createDataFrame([(score, weak)], "s double, w array<struct<severity: string, fixable: boolean>>")
    assert df.select(composite.verdict(F.col("s"), F.col("w"))).first()[0] == want


def test_eqs_weights():
    with pytest.raises(ValueError):
        composite.eqs({}, {"verifier": 1.0})
    with pytest.raises(ValueError):
        composite.eqs({}, dict.fromkeys(composite.DIMENSIONS, 0.0))


def test_rank_sum(spark):
    def run(x, y):
        df = spark.createDataFrame([(float(v), True) for v in x] + [(float(v), False) for v in y], "v double, g boolean")
        return stats.rank_sum(stats.histogram(df, "v", F.col("g")))

    r = run([1], [2]).first()
    assert r.u == 1
    x, y = [1, 2, 2, 5, 7], [2, 3, 5, 5, 8, 9]
    u = sum((a < b) + 0.5 * (a == b) for a in x for b in y)
    assert run(x, y).first().u == u and run(y, x).first().u == len(x) * len(y) - u
    assert run(range(8), range(10, 18)).first().p < 0.01 and run(range(8), range(10, 18)).first().effect == -1
    assert run([1, 2, 3], [1, 2, 3]).first().p > 0.05
    assert run([1, 2], []).first().p == 1


def test_cdf(spark):
    one = lambda z, e=False: spark.range(1).select(normal_cdf(F.lit(z), e)).first()[0]
    assert abs(one(0.0) - 0.5) < 1e-9 and abs(one(1.96) - 0.98098) < 1e-4 and abs(one(1.0) - 0.87033) < 1e-4
    assert abs(one(1.96, True) - 0.975) < 1e-4 and one(9.0) == 1 and one(-9.0) == 0


def test_youden(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "v double, g boolean")
        return stats.best_threshold(stats.histogram(df, "v", F.col("g"))).first()

    r = run([(0.3, True), (0.4, True), (0.8, False), (0.9, False)])
    assert r.youden == 1 and r.threshold == 0.4
    assert tuple(run([(0.3, True)])) == (0.5, 0, 0, 0)


def test_bootstrap(spark):
    """Means over the histogram are spread as means of drawn rows are, with any number of leaves, however rows lie."""
    import random

    same = spark.createDataFrame([(0.5,)] * 5, "v double")
    assert tuple(stats.interval(stats.bootstrap_means(same, "v", 100), 100).first()) == (0.5, 0.5)
    none = stats.interval(stats.bootstrap_means(same.limit(0), "v", 100), 100).first()
    one = stats.interval(stats.bootstrap_means(spark.createDataFrame([(0.3,)], "v double"), "v", 100), 100).first()
    assert tuple(none) == (0.0, 0.0) and tuple(one) == (0.3, 0.3)
    r = random.Random(1)
    x = [round(r.random() ** 2, 2) for _ in range(60)]
    want = sorted(sum(r.choice(x) for _ in x) / len(x) for _ in range(4000))
    df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
    for leaf in (stats.LEAF, 5, 1):
        got = stats.interval(stats.bootstrap_means(df, "v", 4000, leaf=leaf), 4000).first()
        assert abs(got.lo - want[100]) < 0.01 and abs(got.hi - want[3900]) < 0.01
        assert got == stats.interval(stats.bootstrap_means(df.repartition(3), "v", 4000, leaf=leaf), 4000).first()


def test_separation_with_text_ids(spark):
    rows = [(f"django__django-{i}", i % 10 / 10, i % 3 == 0) for i in range(60)]
    out = stats.separation(spark.createDataFrame(rows, "instance_id string, composite double, hackable boolean"), replicates=500).first()
    assert out.lo_x <= out.mean_x <= out.hi_x and out.lo_y <= out.mean_y <= out.hi_y


def runs(spark, a, b):
    return spark.createDataFrame(list(a.items()), "task_id int, passed boolean"), spark.createDataFrame(list(b.items()), "task_id int, passed boolean")


def test_pairs(spark):
    a, b = {1: True, 2: False, 3: True, 4: True}, {3: False, 1: True, 2: True, 9: True}
    got = [(r.task_id, r.a, r.b) for r in abtest.aligned(*runs(spark, a, b)).orderBy("task_id").collect()]
    assert got == [(1, 1, 1), (2, 0, 1), (3, 1, 0)]
    assert {(r.task_id, r.change) for r in abtest.changes(abtest.aligned(*runs(spark, a, b))).collect()} == {(2, "fixed"), (3, "regressed")}


def test_mcnemar(spark):
    def run(b, c):
        rows = [(0, 1)] * b + [(1, 0)] * c + [(1, 1)] * 3
        return abtest.mcnemar(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "task_id int, a int, b int")).first()

    assert run(0, 0).p == 1 and run(10, 0).p < 0.01 and run(4, 4).p > 0.5
    assert abs(run(8, 2).p - 0.109375) < 1e-9


def test_paired(spark):
    n = range(30)
    same = abtest.compared(*runs(spark, dict.fromkeys(n, True), dict.fromkeys(n, True)), 200).first()
    assert same.delta == 0 and same.verdict == "INCONCLUSIVE"
    up = abtest.compared(*runs(spark, dict.fromkeys(n, False), dict.fromkeys(n, True)), 200).first()
    assert (up.delta, up.lo, up.hi, up.verdict) == (1, 1, 1, "VALIDATED")


def test_category_success(spark):
    s = spark.createDataFrame([("a", "p1", "x"), ("a", "p2", "x"), ("b", "p3", "x"), ("c", "p4", "y")], "instance_id string, patch_id string, category string")
    c = spark.createDataFrame([("a", "p1", True), ("a", "p2", False), ("b", "p3", True), ("c", "p4", None)], "instance_id string, patch_id string, verifier_pass boolean")
    got = [tuple(r) for r in candidates.category_success(s, c).collect()]
    assert got == [("x", 3, 2, 0.6667, "a,b"), ("y", 0, 0, 0.0, "")]


def test_optimization(spark):
    tasks = spark.createDataFrame([("a", 0.65), ("b", 0.5)], "instance_id string, eqs double")
    aug = spark.createDataFrame([("a", 1, ["e0", "e1"], 0.95)], "instance_id string, iteration int, targets array<string>, confidence double")
    ex = spark.createDataFrame([("a", 2), ("b", 2)], "instance_id string, n_exploits int")
    b = optimize.boosts(aug, ex)
    assert abs(b.first().boost - 0.1425) < 1e-9
    out = optimize.optimized(tasks, b)
    got = out.iterations.collect()
    assert got[0].n_upgraded == 1 and len(got) == 2 and got[1].n_tasks == 1 and got[1].n_improved == 0
    assert {r.instance_id: r.eqs for r in out.state.collect()} == {"a": 0.7925, "b": 0.5}
    assert [s.count() for s in out.steps] == [2, 1]
    t = out.totals.first()
    assert (t.total_iterations, t.converged, t.n_upgraded, t.convergence_curve) == (2, True, 1, [0.575, 0.6463, 0.6463])
    none = optimize.optimized(tasks.limit(0), b)
    assert none.iterations.isEmpty() and none.totals.first().converged and none.totals.first().convergence_curve == [0.0]
    flat = optimize.optimized(tasks, b.limit(0))
    assert flat.iterations.count() == 1 and flat.totals.first().converged
    assert not optimize.optimized(tasks.where("instance_id = 'b'"), b.select(F.lit("b").alias("instance_id"), "iteration", "boost", "n", "cost_usd"), iterations=1).totals.first().converged


def test_learnable_and_weak(spark):
    t = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,)], "task_id int")
    p = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.65), (4, 1.0), (5, 0.3)], "task_id int, pass_rate double")
    assert {r.task_id for r in dataset.learnable(t, p).collect()} == {2, 3, 5, 6}
    w = spark.createDataFrame([(i, "def add(a): pass", ["t1", "t2"] if i % 2 else ["t1"]) for i in range(400)], "task_id int, gold_code string, test_list array<string>")
    out = dataset.weak_split(w).collect()
    weak = [r for r in out if r.is_weak]
    assert 35 < len(weak) < 90 and all(r.task_id % 2 and r.test_list == ["t1"] for r in weak)
    assert dataset.strong_only(dataset.weak_split(w)).count() == 400 - len(weak)


def test_attack_verdicts(spark):
    one = lambda f, c: spark.createDataFrame([(f, c)], "f array<struct<severity: string>>, c array<int>").select(attack.judged(F.col("f"), F.col("c")).alias("j")).first().j
    assert one([], [8])[:2] == ("FAIL", 0.12) and one([], [7, 7]).verdict == "FAIL"
    assert one([], [6]).verdict == "WARNING" and one([("HIGH",), ("HIGH",)], []).score == 0.5
    assert one([("MEDIUM",)] * 3, []).score == 0.6 and one([], [4]).verdict == "WARNING"
    assert one([], []).verdict == "PASS" and one([], []).score == 1.0
    # the confidence follows from the strategies, whatever the branch
    assert [one(*x).confidence for x in (([], [7, 7]), ([("HIGH",)] * 2, []), ([], [4]), ([], []), ([], [1]), ([], [8]), ([], None))] == [0.7, 0.5, 0.7, 0.5, 0.7, 0.9, 0.5]
    assert one([("MEDIUM",)], []).score == 0.95 and one([("MEDIUM",)] * 2, []).score == 0.92



def test_costs(spark):
    r = spark.createDataFrame([("m", 1_000_000, 0), ("x", 0, 1_000_000)], "model string, input_tokens int, output_tokens int")
    p = spark.createDataFrame([("m", 0.8, 4.0)], "model string, price_in double, price_out double")
    assert {x.model: x.cost_usd for x in costs.priced(r, p).collect()} == {"m": 0.8, "x": 15.0}
    assert costs.estimates(100, 10, 2)["judge"] == 1.5


def test_streaming_counts_match_batch(spark, tmp_path):
    from plumbline.streaming.counts import confusion_counts

    df = spark.createDataFrame([("t", True, "correct"), ("t", False, "incorrect"), ("t", None, "correct"), ("u", True, "incorrect")], "instance_id string, verifier_pass boolean, verdict string")
    df.write.parquet(str(tmp_path / "in"))
    stream = confusion_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("confusion").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("confusion").collect())) == sorted(map(tuple, confusion_counts(df).collect()))


def test_confusion_costs_all_judgments(spark):
    """Judgments without a candidate cost as well; several of one patch don't multiply candidates."""
    c = spark.createDataFrame([("t", "a", True), ("t", "b", None)], "instance_id string, patch_id string, verifier_pass boolean")
    j = spark.createDataFrame([("t", "a", "correct", 0.5), ("t", "z", "correct", 2.0), ("t", "a", "correct", 0.25), ("u", "q", "correct", 1.0)], "instance_id string, patch_id string, verdict string, cost_usd double")
    got = hybrid.confusion(c, j).collect()
    assert [(r.instance_id, r.tp, r.n_skipped, r.cost_usd) for r in got] == [("t", 1, 1, 2.75)]


def test_composite_with_missing_sources(spark):
    """A task may lack any of the four sources: weights are shared among those it has."""
    v = spark.createDataFrame([("a", 0.9, 0.0, 0.0)], "instance_id string, v_score double, v_fpr double, v_fnr double")
    e = spark.createDataFrame([("b", 0.2)], "instance_id string, exploit_rate double")
    h = spark.createDataFrame([("b", 0.5, 0.0, 0.0)], "instance_id string, h_f1 double, h_fpr double, h_fnr double")
    d = spark.createDataFrame([("c", 0.25, "medium")], "instance_id string, gradient_signal double, difficulty_tier string")
    got = {r.instance_id: (r.eqs, r.verdict) for r in composite.scored(composite.joined(v, e, h, d)).collect()}
    assert got == {"a": (0.9, "KEEP"), "b": (round((0.8 * 0.30 + 0.5 * 0.20) / 0.5, 4), "FIX"), "c": (1.0, "KEEP")}
