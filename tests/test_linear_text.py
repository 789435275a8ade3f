"""Text functions against the patterns that define them, and on hostile texts of a megabyte."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.arrays import quality_flags
from vellum.plans import stages
from vellum.plans.oracles import BODY, FENCE, ILLEGIBLE, MATH, REGION

WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def test_white_space_is_that_of_unicode():
    assert sorted(X._WHITE) == sorted(WHITE)


def strip_reasoning(t):
    return re.split("(?i)<think>", re.sub(r"(?is)<think>.*?</think>", "", t))[-1]


def body(t):
    m = re.search(BODY, t)
    return m.group(1) if m else t


DEFINED = {
    "strip": (X.strip, str.strip),
    "rstrip": (X.rstrip, str.rstrip),
    "strip_reasoning": (X.strip_reasoning, strip_reasoning),
    "body_or_all": (X.body_or_all, body),
    "has_body": (X.has_body, lambda t: re.search(BODY, t) is not None),
    "has_math": (X.has_math, lambda t: re.search(MATH, body(t)) is not None if re.search(BODY, t) else None),
    "has_illegible": (X.has_illegible, lambda t: re.search(ILLEGIBLE.replace(".", "[^\n\r\x85\u2028\u2029]"), t) is not None),
    "cut_between": (lambda c: X.cut_between(c, X.REGION, X.REGION_END), lambda t: re.sub(f"(?i){REGION}", "", t)),
    "require": (lambda c: X._sub_closed(c, r"\\require\{[^}]*\}", "", "}"), lambda t: re.sub(r"\\require\{[^}]*\}", "", t)),
    "last_line": (X.last_line, lambda t: re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", t.rstrip())[-1].strip()),
    "unfenced": (lambda c: F.get(F.array(X.clean_response(c)), F.lit(0)), None),
}
PIECES = ["$", "x", " ", "\n", "\u00a0", "\r", "\x0b", "\\[", "\\]", "\\", "[", "]", "{", "}", "\\begin{", "\\end{", "\\begin{a}", "\\end{a}", "\\begin{}", "\\begin{document}", "\\end{document}", "<think>", "</think>", "<THINK>", "</Think>", "<|det|>", "<|/det|>", "\\text{", "\\textit{", "illegible", "ILLEGIBLE", "```", "```latex", "`", "\\require{", "\\documentclass{article}", "tex", "é", "\u2028"]


def texts():
    r = random.Random(8)
    some = [["<think>", "</think>", "x"], ["\\begin{document}", "\\end{document}", "$", "x", "\\begin{a}", "\\end{b}", "\\begin{", "\\end{", "}"], ["\\text{", "illegible", "}", "[", "]", "\n", "x"], ["```", "latex", "x", " ", "\n"], [" ", "\n", "\u00a0", "x", "\r\n", "\x1c"]]
    return ["".join(r.choice(r.choice([PIECES, *some])) for _ in range(r.randrange(0, 18))) for _ in range(6000)] + ["".join(r.choice(p) for _ in range(r.randrange(0, 10))) for p in some for _ in range(1200)]


def clean_response(t):
    t = strip_reasoning(t).strip()
    m = re.search(FENCE, t)
    if m:
        t = m.group(1).strip()
    elif t.startswith("```"):
        t = re.sub(r"\n?```\Z", "", re.sub(r"\A```[a-zA-Z]*\n?", "", t)).strip()
    a, b = t.find("\\documentclass"), t.rfind("\\end{document}")
    if a >= 0:
        t = t[a : max(b + 14, a)] if b >= 0 else t[a:]
    return t.strip()


def test_functions_are_their_patterns(spark):
    told = {n: (f, clean_response if n == "unfenced" else g) for n, (f, g) in DEFINED.items()}
    rows = spark.createDataFrame([(t,) for t in texts()], "t string").repartition(4)
    for r in rows.select("t", *(f(F.col("t")).alias(n) for n, (f, _) in told.items())).collect():
        for n, (_, g) in told.items():
            assert r[n] == g(r.t), (n, r.t)


HOSTILE = {
    "inner spaces": "x" + " " * 1_000_000 + "x",
    "outer spaces": " " * 500_000 + "x" + "\u3000" * 150_000,
    "brackets": "[a" * 500_000,
    "brackets and the word": "illegible" + "[a" * 500_000,
    "open begins": "\\begin{document}" + "\\begin{a}" * 110_000 + "\\end{document}",
    "unnamed begins": "\\begin{document}" + "\\begin{" * 130_000,
    "begins of documents": "\\begin{document}" * 62_000,
    "open thoughts": "<think>" * 140_000,
    "open regions": "<|det|>text [1]<|/det|>" + "<|det|>" * 140_000,
    "open fence": "```" + " " * 1_000_000,
    "dollars": "$" * 1_000_000,
    "open requires": "\\require{" * 110_000,
    "lines": "a\n" * 500_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_a_hostile_megabyte_takes_a_second(spark, kind):
    functions = {"clean": X.clean_response, "v1": X.clean_response_v1, "truncated": X.looks_truncated, "reason": X.truncation_reason, "fix": X.auto_fix, "document": X.to_document, "finish": X.finish_document, "math": X.has_math, "illegible": X.has_illegible, "flags": quality_flags}
    rows = spark.createDataFrame([(HOSTILE[kind],)], "latex string").cache()
    rows.count()
    took = {}
    plans = {n: rows.select(F.xxhash64(f(F.col("latex")).cast("string")).alias("h")) for n, f in functions.items()}
    plans["validate"] = stages.validate(rows).select(F.xxhash64("status", "validated"))
    for n, one in plans.items():
        one.collect()
        for _ in range(3):  # the best of three, as other work may run beside
            began = time.perf_counter()
            one.collect()
            took[n] = min(took.get(n, 60.0), time.perf_counter() - began)
            if took[n] < 1.0:
                break
    rows.unpersist()
    assert max(took.values()) < 1.5, took  # under a second on a machine that isn't busy
