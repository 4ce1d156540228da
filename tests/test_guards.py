"""What lets the rewrite program skip work: needs found in the patterns, spans replaced at once, small Arrow batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prosemill.functions import rewrite as P
from prosemill.functions import rules as R

BITS = [
    "$", "$x$", "[[EQUATION]]", " [[CODE]] ", "{", "}", "(", ")", "\\frac", "=", "^", "_", "sin ", "ARCSIN 3", "ſin 3", " = 3", "±", "√", "\n", " ", "1", "2 ", "x", "İ", "initialized to 5", "Initialızed to 7",
    "1 2 3 4 5", " iv. ", "Sources: x", "Sourceſ: x", "|", "°", "+", "plain words", "1. A", ": b) c", "C-G-D", "`c`", "f1, f2", "p. 3", " ", "٣",
]


def test_a_match_holds_what_the_pattern_needs():
    assert P.needs(r"(?:initialized to\s+)\d+", re.IGNORECASE) == ((1, True, ("initialized to",)), P.DIGIT)
    assert P.needs(r"(\[\[CODE\]\]\s*){2,}") == ((2, False, ("[[CODE]]",)),)
    assert P.needs(r"a?b*(?:cd|e[fg])x(?=\()(?!y)") == ((1, False, ("cd", "e")), (1, False, ("x",)), (1, False, ("(",)))
    assert P.needs(r".\w+|x") == ()


def test_guards_change_nothing_on_random_texts(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    guarded = [P.clean_pipeline(t) for t in texts]
    monkeypatch.setattr(P, "GUARDED", False)
    assert [P.clean_pipeline(t) for t in texts] == guarded


def test_rules_are_skipped_without_what_they_need(monkeypatch):
    tried = []
    rule = R.Rule(r"\bword\s*=\s*\d+", "x")
    ready = P._ready(rule)
    object.__setattr__(rule, "_ready", (lambda replacement, text: tried.append(text) or ready[0](replacement, text), *ready[1:]))
    assert [P.apply(t, [rule]) for t in ("word = 1", "word 1", "word = a", "none")] == ["x", "word 1", "word = a", "none"] and tried == ["word = 1"]


def test_inline_mathematics_is_judged_once_for_each_span(monkeypatch):
    judged = []
    monkeypatch.setattr(P, "is_inline_math", lambda inner, plain=P.is_inline_math: judged.append(inner) or plain(inner))
    assert P._inline_math("so $a=b$ and " * 200).count("[[EQUATION]]") == 200
    assert len(judged) == 200
    assert P._inline_math("$$x$ y = z$ end") == "$ [[EQUATION]]  y = z$ end".replace("$ [[EQUATION]]  y = z$", R.EQ)


@pytest.mark.parametrize("name", ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"])
def test_batches_of_texts_are_small(spark, name):
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "100000000")
        P.column(P.clean_residual_math_noise, F.lit("text"))
        assert int(spark.conf.get(name)) <= 16_000_000
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
