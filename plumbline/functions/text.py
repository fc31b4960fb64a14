"""Text, diff, code and response parsing as columns; only backing off to code that parses needs Python."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import Name, col


def _lines(x: Column) -> Column:
    return F.split(x, F.lit("\n"), -1)


def test_code(diff: Name) -> Column:
    """Added and context lines of a unified diff's hunks, joined by line ends; null or empty gives ''.

    Headers (---, +++) never count, not even in a hunk; a hunk ends at the next "diff --git" line only; other lines of
    a hunk stay as they are but for the first character of added and context lines; removed lines go.
    Files' parts are told apart first, then each part is what follows its first hunk's head, so work grows with the lines.
    """
    x = F.coalesce(col(diff), F.lit(""))
    files = F.split(x, r"\n(?=diff --git)", -1)
    hunks = F.filter(F.transform(files, lambda part: F.regexp_extract(part, r"(?s)(?:^|\n)(@@.*)", 1)), lambda part: part != "")
    kept = F.filter(F.flatten(F.transform(hunks, _lines)), lambda s: ~(s.startswith("+++") | s.startswith("---") | s.startswith("@@") | s.startswith("-")))
    return F.array_join(F.transform(kept, lambda s: F.when(s.startswith("+") | s.startswith(" "), F.substring(s, 2, 1 << 30)).otherwise(s)), "\n")


def without_headers(diff: Name) -> Column:
    """A diff without its "diff --git" and "index " lines."""
    return F.array_join(F.filter(_lines(F.coalesce(col(diff), F.lit(""))), lambda s: ~s.startswith("diff --git") & ~s.startswith("index ")), "\n")


#: The assertion forms that are counted, overlaps included.
ASSERTIONS = (r"(?U)\bassert\b", r"(?U)\.assert\w+\(", r"(?U)self\.assert\w+\(", r"(?U)\bpytest\.raises\b", r"(?U)\bwith\s+pytest\.raises\b")
#: Kinds of assertions.
KINDS = {
    "assertEqual": r"assertEqual\(",
    "assertRaises": r"assertRaises\(|pytest\.raises\(",
    "assertAlmostEqual": r"assertAlmostEqual\(",
    "assertIn": r"assertIn\(",
    "assertIsInstance": r"assertIsInstance\(",
    "assertIsNotNone": r"assertIsNotNone\(",
    "assertTrue": r"assertTrue\(",
    "assertFalse": r"assertFalse\(",
    "bare_assert": r"(?U)(?<!\.)(?<!\w)assert\s+",
}
#: Words that hint at edge cases.
EDGE_WORDS = ("empty", "none", "null", "zero", "boundary", "edge", "negative", "overflow", "error", "invalid", "special")
#: Fixed value: a literal that an assertion compares with.
LITERALS = r"""assertEqual\(\s*[^,]+,\s*(["'][^"']+["']|\d+\.?\d*|\[.*?\]|\{.*?\}|True|False|None)"""


def count_of(text: Name, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(pattern))


def test_functions(code: Name) -> Column:
    return count_of(code, r"(?U)def\s+test_\w+")


def assertions(code: Name, patterns: Sequence[str] = ASSERTIONS) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + count_of(code, p)
    return total


def assertion_kinds(code: Name) -> Column:
    return F.struct(*(count_of(code, p).alias(k) for k, p in KINDS.items()))


def pattern_metrics(code: Name, patch: Name, fail_to_pass: Name, pass_to_pass: Name | None = None, words: Sequence[str] = EDGE_WORDS, literals: str = LITERALS) -> Column:
    """Struct of a test's counts: functions, assertions, their kinds, strict and permissive ones, edge words, literals, lines, tests."""
    kinds, low = assertion_kinds(code), F.lower(F.coalesce(col(code), F.lit("")))
    strict = kinds["assertEqual"] + kinds["assertRaises"] + kinds["assertAlmostEqual"]
    loose = kinds["assertTrue"] + kinds["assertFalse"] + kinds["bare_assert"]
    total = assertions(code)
    edge = F.lit(False)
    for w in words:
        edge = edge | low.contains(w)
    return F.struct(
        test_functions(code).alias("n_functions"),
        total.alias("n_assertions"),
        strict.alias("n_strict"),
        loose.alias("n_permissive"),
        F.bround(loose.cast("double") / F.greatest(strict + loose, F.lit(1)), 3).alias("permissive_ratio"),
        edge.alias("has_edge"),
        count_of(code, literals).alias("n_literals"),
        F.size(_lines(F.coalesce(col(code), F.lit("")))).alias("test_lines"),
        F.size(_lines(F.coalesce(col(patch), F.lit("")))).alias("patch_lines"),
        F.size(col(fail_to_pass)).alias("n_fail_to_pass"),
        (F.lit(0) if pass_to_pass is None else F.size(col(pass_to_pass))).alias("n_pass_to_pass"),
        kinds.alias("kinds"),
    )


def truncated(text: Name, chars: int) -> Column:
    return F.substring(F.coalesce(col(text), F.lit("")), 1, chars)


def head_lines(text: Name, n: int) -> Column:
    """The first n lines, and how many more there are."""
    x = _lines(F.coalesce(col(text), F.lit("")))
    more = F.size(x) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(x, 1, n), "\n"), F.format_string("\n... (%d more lines)", more))).otherwise(F.array_join(x, "\n"))


def summary_of(items: Name, template: str, *fields: str, separator: str = "\n\n") -> Column:
    """One formatted block for each struct of an array; the template gets its number from 1 and the fields."""
    return F.array_join(F.transform(col(items), lambda s, i: F.format_string(template, i + 1, *(F.coalesce(s[f].cast("string"), F.lit("")) for f in fields))), separator)


def json_in(text: Name) -> Column:
    """The JSON object or array in a response as VARIANT: all of it, a fenced block, or from the first { to the last }; else null."""
    x = col(text)
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.trim(x)), F.try_parse_json(F.trim(fenced)), F.try_parse_json(braces))


def judgment(text: Name) -> Column:
    """Struct (verdict, confidence, premises, trace, conclusion) of a judge's response: JSON fields, else (also where the JSON
    is empty) what its wording says."""
    x, v = col(text), json_in(text)
    field = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))
    word = F.lower(F.trim(field("verdict")))
    known = F.when(word.isin("correct", "partial", "incorrect"), word).otherwise("uncertain")
    sure = F.least(F.greatest(F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    low = F.lower(x)
    said = F.lit("uncertain")
    for word in ("partial", "incorrect", "correct"):  # the last has the first say
        said = F.when(low.contains(f"the patch is {word}") | low.contains(f"verdict: {word}"), word).otherwise(said)
    failed = F.lit("(failed to parse structured response)")
    parsed = v.isNotNull() & ~F.to_json(v).isin("{}", "[]", "null", "false", "0", '""')
    return F.when(parsed, F.struct(known.alias("verdict"), sure.alias("confidence"), field("premises").alias("premises"), field("trace").alias("trace"), field("conclusion").alias("conclusion"))).otherwise(F.struct(said.alias("verdict"), F.lit(0.4).alias("confidence"), failed.alias("premises"), failed.alias("trace"), F.substring(F.coalesce(x, F.lit("")), 1, 500).alias("conclusion")))


STRATEGY_FIELDS = "array<struct<name: string, category: string, description: string, confidence: int, reasoning: string, exploit_patch: string>>"


def strategies(text: Name, cap: int | None = 10) -> Column:
    """Array of strategies of an attacker's response; defaults for what is missing, confidence capped (None: uncapped, as in the first round)."""
    v = json_in(text)
    found = F.coalesce(F.from_json(F.to_json(F.try_variant_get(v, "$.strategies", "variant")), STRATEGY_FIELDS), F.from_json(F.lit("[]"), STRATEGY_FIELDS))

    def one(s: Column) -> Column:
        sure = F.coalesce(s["confidence"], F.lit(5))
        return F.struct(F.coalesce(s["name"], F.lit("unnamed")).alias("name"), F.coalesce(s["category"], F.lit("unknown")).alias("category"), F.coalesce(s["description"], F.lit("")).alias("description"), (F.least(sure, F.lit(cap)) if cap else sure).alias("confidence"), F.coalesce(s["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(s["exploit_patch"], F.lit("")).alias("exploit_patch"))

    return F.transform(found, one)


AUGMENTATION_FIELDS = "array<struct<test_code: string, targets: array<string>, rationale: string, confidence: double>>"


def augmentations(text: Name, patch_ids: Name, cost: Name) -> Column:
    """Array of test augmentations: blank code goes; exploit_N names the Nth (from 0) of patch_ids and vanishes without one, none left means
    all of them; confidence in [0, 1], 0.7 if missing; cost split evenly over all that the response lists."""
    v, ids = json_in(text), col(patch_ids)
    found = F.coalesce(F.from_json(F.to_json(F.try_variant_get(v, "$.augmentations", "variant")), AUGMENTATION_FIELDS), F.from_json(F.lit("[]"), AUGMENTATION_FIELDS))
    share = col(cost) / F.greatest(F.size(found), F.lit(1))

    def one(s: Column) -> Column:
        target = lambda t: F.when(t.rlike(r"^exploit_\d{1,9}$"), F.get(ids, F.substring(t, 9, 9).cast("int"))).when(~t.startswith("exploit_"), t)
        named = F.filter(F.transform(F.coalesce(s["targets"], F.array().cast("array<string>")), target), lambda t: t.isNotNull())
        return F.struct(s["test_code"].alias("test_code"), F.when(F.size(named) > 0, named).otherwise(ids).alias("targets"), F.coalesce(s["rationale"], F.lit("")).alias("rationale"), F.least(F.greatest(F.coalesce(s["confidence"], F.lit(0.7)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), share.alias("cost_usd"))

    return F.transform(F.filter(found, lambda s: F.trim(F.coalesce(s["test_code"], F.lit(""))) != ""), one)


def code_block(text: Name) -> Column:
    """(code, fenced) of a model's answer: thoughts go, the first fence wins, else everything from the first line that looks like code."""
    x = F.coalesce(col(text), F.lit(""))
    x = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    x = F.regexp_replace(x, r"(?s)^.*?</think>", "")
    fenced = x.rlike(r"(?s)```.*?```")
    fence = F.regexp_extract(x, r"(?s)```(?:python)?\s*\n?(.*?)```", 1)
    start = F.regexp_extract(x, r"(?ms)^((?:def |import |from |class |@).*)\z", 1)
    return F.struct(F.trim(F.when(fenced, fence).when(start != "", start).otherwise(x), F.lit(" \n\t\r\f\x0b")).alias("code"), fenced.alias("fenced"))


def _parses(code: str) -> tuple[bool, int | None]:
    """Whether code parses; if not, the line that the error is at, where one is given."""
    import ast

    try:
        ast.parse(code)
    except SyntaxError as e:
        return False, e.lineno
    except (ValueError, MemoryError, RecursionError):  # null bytes; nesting that the parser has no stack for
        return False, None
    return True, None


def longest_parseable(code: str) -> str:
    """The most lines from the first on that parse together; code itself if not even one does.

    A line that can't be the last one is never tried: one that ends in a colon or a backslash or is a decorator, or one that
    is inside a bracket, a string or a try that nothing closes yet; one pass over the lines tells. The parser names the
    line that it can't get past; as it reads from the start, no more lines can help, so the next try ends before that line.
    So texts are parsed a few times, not once a line.
    """
    lines = code.split("\n")
    last = _possible_ends(lines)
    n = len(lines)
    while n > 0:
        if last[n - 1]:
            good, at = _parses("\n".join(lines[:n]))
            if good:
                return "\n".join(lines[:n])
            n = min(n - 1, at - 1) if at is not None and 1 <= at < n else n - 1
        else:
            n -= 1
    return code


def _possible_ends(lines: list[str]) -> list[bool]:
    """Whether code that parses could end with each line, as far as brackets, strings, colons, decorators and tries tell.

    From where quotes or brackets don't make sense as code, nothing is ruled out."""
    import re

    token = re.compile(r"""(?:[rRbBuUfFtT]{0,2})(\'\'\'|\"\"\"|\'|\")|[\[\](){}]|\#.*|[^\s\w]|\w+""")
    out, depth, quote, tries = [], 0, "", []
    for line in lines:
        at, begun, code_end, first, whole = 0, not quote and not depth, "", "", line
        if quote:
            end = _closed(line, 0, quote)
            if end < 0:
                out.append(False)
                continue
            at, quote, code_end = end, "", "x"
        while m := token.search(line, at):
            at, t = m.end(), m.group()
            if t.startswith("#"):
                break
            first = first or t
            if m.group(1):
                end = _closed(line, at, m.group(1))
                if end < 0:
                    if len(m.group(1)) == 1:
                        return out + [True] * (len(lines) - len(out))  # no string, or one that goes on by a backslash
                    quote = m.group(1)
                    break
                at, code_end = end, "x"
                continue
            depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
            code_end = t
            if depth < 0:
                return out + [True] * (len(lines) - len(out))
        if first and begun:
            indent = len(whole) - len(whole.lstrip())
            while tries and (indent < tries[-1] or indent == tries[-1] and first not in ("except", "finally")):
                tries.pop()  # a try that ended without either is an error that the parser will name
            if tries and indent == tries[-1]:
                tries.pop()
            if first == "try" and code_end == ":":
                tries.append(indent)
        inside = bool(quote) or depth > 0 or bool(tries)
        out.append(not inside and not (code_end == ":" or line.endswith("\\") or first == "@" and begun))
    return out


def _closed(line: str, at: int, quote: str) -> int:
    """Where a string that is open at a place ends in the line; -1 if it doesn't."""
    while True:
        found = line.find(quote, at)
        if found < 0:
            return -1
        slashes = 0
        while found - slashes - 1 >= 0 and line[found - slashes - 1] == "\\":
            slashes += 1
        if slashes % 2 == 0:
            return found + len(quote)
        at = found + 1


@F.pandas_udf(T.StringType())
def parseable(code: pd.Series, fenced: pd.Series) -> pd.Series:
    """Code without the trailing lines that keep it from parsing; unchanged if nothing parses, or if a fence marked it off."""
    from plumbline.functions.text import longest_parseable

    return pd.Series([s if f or not s else longest_parseable(s) for s, f in zip(code, fenced, strict=True)], dtype=object)


def extracted_code(text: Name) -> Column:
    """Code of a model's answer, whatever it says: no text can fail the job."""
    block = code_block(text)
    return parseable(block["code"], block["fenced"])


def function_name(code: Name) -> Column:
    """The first top-level function, else the first at all, else null."""
    x = col(code)
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(?mU)^def\s+(\w+)", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"(?U)\bdef\s+(\w+)", 1), F.lit("")))


def weakened(tests: Name, code: Name, mode: str = "mild") -> Column:
    """mild: the first test alone; aggressive: only that the function is callable, or mild without a function."""
    first = F.slice(col(tests), 1, 1)
    if mode == "mild":
        return first
    if mode == "aggressive":
        name = function_name(code)
        return F.when(name.isNotNull(), F.array(F.concat(F.lit("assert callable("), name, F.lit(")")))).otherwise(first)
    raise ValueError(f"unknown weakening mode: {mode}")


def prompt(statement: Name, tests: Name) -> Column:
    """A training prompt that shows the first test."""
    return F.concat(F.lit("Write a Python function for this task.\n\n"), col(statement), F.lit("\n\nIt must pass this test:\n"), F.coalesce(F.get(col(tests), F.lit(0)), F.lit("")), F.lit("\n\nAnswer with the code only."))


def file_key(instance_id: Name) -> Column:
    return F.replace(col(instance_id), F.lit("/"), F.lit("__"))


def instance_key(name: Name) -> Column:
    """The first __ of a file key back to /."""
    return F.regexp_replace(col(name), r"(?s)^(.*?)__", "$1/")
