from pyspark.sql import functions as F
import pytest

from plumbline.functions import text as T
from plumbline.operators.attack import flags, issues

DIFF = """diff --git a/tests/test_x.py b/tests/test_x.py
index 1..2 100644
--- a/tests/test_x.py
+++ b/tests/test_x.py
@@ -1,3 +1,9 @@
 import unittest
-old = 1
+def test_one(self):
+    self.assertEqual(f(1), 2)
+    self.assertEqual(f("a"), 'b')
+    with pytest.raises(ValueError):
+        f(None)
+def test_two():
+    assert g() is True
\\ No newline at end of file
"""


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_diff(spark):
    code = one(spark, DIFF, T.test_code)
    assert code.split("\n")[:2] == ["import unittest", "def test_one(self):"] and "old = 1" not in code and "+++" not in code
    assert code.endswith("\\ No newline at end of file\n")
    assert one(spark, None, T.test_code) == "" and one(spark, "", T.test_code) == ""
    assert not one(spark, DIFF, T.without_headers).startswith("diff")


def test_counts(spark):
    code = one(spark, DIFF, T.test_code)
    assert one(spark, code, T.test_functions) == 2 and one(spark, "def test_é(): pass", T.test_functions) == 1
    kinds = one(spark, code, T.assertion_kinds)
    assert (kinds.assertEqual, kinds.assertRaises, kinds.bare_assert) == (2, 1, 1)
    # two .assertEqual count twice each, pytest.raises twice, assert once
    assert one(spark, code, T.assertions) == 7
    assert one(spark, "assert assert q", lambda c: T.assertion_kinds(c)["bare_assert"]) == 2


def test_metrics_and_flags(spark):
    df = spark.createDataFrame([("assert x", "a\nb\nc\nd\ne", ["t"])], "c string, p string, f array<string>")
    m = T.pattern_metrics("c", "p", "f")
    r = df.select(m.alias("m"), flags(m).alias("f")).first()
    assert r.m.permissive_ratio == 1.0 and r.m.test_lines == 1 and not r.m.has_edge
    assert [f.id for f in r.f] == ["few_assertions", "permissive_assertions", "no_edge_cases", "single_test_function", "single_fail_to_pass", "low_test_coverage_ratio"]
    got = df.select(issues(flags(m), F.array(F.struct(F.lit("n").alias("name"), F.lit("c").alias("category"), F.lit("d").alias("description"), F.lit(8).alias("confidence"), F.lit("x").alias("exploit_patch")))).alias("i")).first().i
    assert got[-1].type == "exploit_c" and got[-1].severity == "critical" and got[0].confidence == 0.95


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', "1"), ('so\n```json\n{"a": 2}\n```\n', "2"), ('well {"a": 3} done', "3"), ("none", None), ("", None), (None, None)])
def test_json(spark, text, want):
    assert one(spark, text, lambda c: F.try_variant_get(T.json_in(c), "$.a", "string")) == want


def test_judgment(spark):
    r = one(spark, '{"verdict": " Correct ", "confidence": 1.7, "conclusion": "fine"}', T.judgment)
    assert (r.verdict, r.confidence, r.conclusion) == ("correct", 1.0, "fine")
    assert one(spark, '{"verdict": "dunno"}', T.judgment)[:2] == ("uncertain", 0.5)
    assert one(spark, "I think the patch is INCORRECT", T.judgment)[:2] == ("incorrect", 0.4)
    assert one(spark, "{} so the patch is correct", T.judgment)[:2] == ("correct", 0.4)
    assert one(spark, "Verdict: partial", T.judgment).verdict == "partial" and one(spark, "?", T.judgment).verdict == "uncertain"


def test_strategies(spark):
    text = '{"strategies": [{"name": "n", "confidence": 12}, {"category": "c", "exploit_patch": "p"}]}'
    a, b = one(spark, text, T.strategies)
    assert (a.name, a.category, a.confidence) == ("n", "unknown", 10) and (b.name, b.confidence, b.exploit_patch) == ("unnamed", 5, "p")
    assert one(spark, text, lambda c: T.strategies(c, None))[0].confidence == 12
    assert one(spark, "nothing", T.strategies) == []


def test_augmentations(spark):
    text = '{"augmentations": [{"test_code": "t", "targets": ["exploit_1", "exploit_9", "own"], "confidence": 2}, {"test_code": " "}, {"test_code": "u", "targets": ["exploit_7"]}]}'
    df = spark.createDataFrame([(text, ["p0", "p1"], 0.3)], "x string, ids array<string>, c double")
    a, b = df.select(T.augmentations("x", "ids", "c").alias("y")).first().y
    assert a.targets == ["p1", "own"] and a.confidence == 1.0 and abs(a.cost_usd - 0.1) < 1e-9
    assert b.targets == ["p0", "p1"] and b.confidence == 0.7


CODE = "def f(x):\n    return x"


@pytest.mark.parametrize("text", [CODE, f"```python\n{CODE}\n```", f"```\n{CODE}\n```", f"<think>hm</think>\n{CODE}", f"<think>a</think>```python\n{CODE}\n```", f"Sure, here it is:\n{CODE}", f"still thinking</think>\n{CODE}", f"{CODE}\n\nThat's it, enjoy!"])
def test_code(spark, text):
    assert one(spark, text, T.extracted_code).rstrip("\n") == CODE


def test_fenced_code_stays_as_it_is(spark):
    assert one(spark, "Look:\n```python\nx = 1\nthat's it\n```\nBye", T.extracted_code) == "x = 1\nthat's it"


def test_longest_parseable():
    """Against dropping line after line, on soups of lines."""
    import ast
    import random

    def plain(s):
        lines = s.split("\n")
        for n in range(len(lines), 0, -1):
            try:
                ast.parse("\n".join(lines[:n]))
                return "\n".join(lines[:n])
            except (SyntaxError, ValueError):
                pass
        return s

    pool = ["def f(x):", "    return x", "x = (1,", "     2)", "if a:", "    pass", "else:", "try:", "    z()", "except E:", "finally:", "@dec", "class A:", "x = \'\'\'a", "b\'\'\'", "print 'x'", "That's it, enjoy!", "# note:", "", "x = {", "}", "x = 1 if b", "x = \\", "  1", "x: int", "don't do", "f'{x['a']}'", "try: a", "except: b", "\tpass", "match v:", "    case 1:", "        pass"]
    r = random.Random(3)
    for _ in range(4000):
        s = "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))
        assert T.longest_parseable(s) == plain(s), s


def test_no_text_kills_the_job(spark):
    """Nesting that the parser has no stack for, null bytes, and texts on which parsing once a line would take hours."""
    odd = ["-" * 200_000 + "1", "x = a" + ".b" * 100_000, "(" * 50_000, "import x\0y", "try:\n" + "    pass\n" * 20_000 + "done", "@a\n" * 20_000 + "x y", "x = [\n" + "1,\n" * 20_000 + "foo bar", "\n".join(["if x:"] * 5_000)]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    assert [r[0] for r in df.select(T.extracted_code("x")).collect()] == [x.strip() if i != 4 else odd[4] for i, x in enumerate(odd)]


def test_code_empty(spark):
    assert one(spark, "", T.extracted_code) == "" and one(spark, None, T.extracted_code) == ""


def test_names_and_weakening(spark):
    assert one(spark, "x = 1\ndef add(a):\n  pass", T.function_name) == "add" and one(spark, "x = 1", T.function_name) is None
    df = spark.createDataFrame([(["a", "b"], "def add(x): pass"), (["a", "b"], "x")], "t array<string>, c string")
    assert [r[0] for r in df.select(T.weakened("t", "c")).collect()] == [["a"], ["a"]]
    assert [r[0] for r in df.select(T.weakened("t", "c", "aggressive")).collect()] == [["assert callable(add)"], ["a"]]
    with pytest.raises(ValueError):
        T.weakened("t", "c", "odd")


def test_small_ones(spark):
    assert one(spark, "a/b/c", T.file_key) == "a__b__c" and one(spark, "a__b__c", T.instance_key) == "a/b__c"
    assert one(spark, "1\n2\n3\n4", lambda c: T.head_lines(c, 2)) == "1\n2\n... (2 more lines)" and one(spark, "1", lambda c: T.head_lines(c, 2)) == "1"
    assert one(spark, "abcdef", lambda c: T.truncated(c, 3)) == "abc"
    got = one(spark, [("a", 1), ("b", None)], lambda c: T.summary_of(c, "%d: %s (%s)", "n", "k", separator="; "), "array<struct<n: string, k: int>>")
    assert got == "1: a (1); 2: b ()"
    assert "It must pass" in spark.createDataFrame([("do", ["t1"])], "s string, t array<string>").select(T.prompt("s", "t")).first()[0]
