"""The rewrite program: golden strings worked out by hand from the rules, guards, and the native twins of the cleaners."""

import re

import pytest
from pyspark.sql import functions as F

from prosemill.functions import rewrite as P
from prosemill.functions import rules as R
from prosemill.functions import text as T

GOLDEN = [
    (P.clean_url, "a https://x.y/z?q=1 b www.site.org/p, c", "a [[URL]] b [[URL]] c"),
    (P.clean_code_texts, "run `x = 1` and ```py\nfoo()\n``` now", "run [[CODE]] and [[CODE]] now"),
    (P.clean_music_notation, "play C-G-D-A and F#-Bb-D now", "play [[MUSIC]] and [[MUSIC]] now"),
    (P.clean_complexity_notation, "it is O(n log n), not info(n)", "it is [[COMPLEXITY]] , not info(n)"),
    (P.clean_code_assignments, "count initialized to 0", "count initialized to [[CODE]]"),
    (P.strip_reference_list, "body text data sources: more", "body text data"),
    (P.clean_citations, "as [1, 2] and [3-5] and (Smith, 2020) and Smith et al (2001) say", "as [[CITATION]] and [[CITATION]] and [[CITATION]] and [[CITATION]] say"),
    (P.clean_citations, "see (Figure 3) and (Nietzsche 9)", "see (Figure 3) and [[CITATION]]"),
    (P.clean_list_numbering, "1. First point: a) second", "First point: second"),
    (P.clean_bare_expressions, "Wow! it is 1/2", "[[EQUATION]] it is [[EQUATION]]"),
    (P.clean_bare_expressions, "(see below) and (n-1)!", "(see below) and [[EQUATION]]"),
    (P.clean_math_texts, "then $E=mc^2$ holds for cost of $0.3 trillion in 1970 to $19.5", "then [[EQUATION]] holds for cost of $0.3 trillion in 1970 to $19.5"),
    (P.clean_residual_math_noise, "and/or 1 2 3 4 5", "[[EQUATION]]"),
    (P.clean_pseudocode_and_diagrams, "the word(s) of dp[i][j] = 3", "the [[CODE]] of [[CODE]] = 3"),
    (P.clean_markdown_formatting, "## Title\n* item **bold** and *it* and _x_", "Title item bold and it and x"),
    (P.merge_continuous_equations, "[[EQUATION]] + [[EQUATION]] is [[EQUATION]]", "[[EQUATION]] is [[EQUATION]]"),
    (P.mop_up_leftovers, "so cos [[EQUATION]] and x + [[EQUATION]] where Mass (m) = 1,500 kg", "so [[EQUATION]] and [[EQUATION]] where [[EQUATION]]"),
    (P.mop_up_leftovers, "[[EQUATION]] = 0.03 and [[CODE]] [[EQUATION]] [[CODE]] returns [[CODE]]", "[[EQUATION]] and [[CODE]]"),
    (P.mop_up_leftovers, r"a \frac{[[EQUATION]]}{b} and \left( [[EQUATION]] \right) end", "a [[EQUATION]] and [[EQUATION]] end"),
    (P.mop_up_leftovers, "so $ [[EQUATION]] $ gives $x$ and {ab} but {word} stays", "so [[EQUATION]] gives [[EQUATION]] and [[EQUATION]] but {word} stays"),
    (P.mop_up_leftovers, "[[EQUATION]] and $x$", "[[EQUATION]]"),  # up to three letters before a dollar go with the tag
    (P.strip_placeholders, "a ([[CODE]]) b , [[EQUATION]] , c [[ T ]] d", "a b, c d"),
    (P.clean_pipeline, "The paper (Smith, 2020) shows $E=mc^2$ with O(n) complexity.", "The paper [[CITATION]] shows [[EQUATION]] with [[COMPLEXITY]] complexity."),
]


@pytest.mark.parametrize("cleaner, text, want", GOLDEN, ids=range(len(GOLDEN)))
def test_golden(cleaner, text, want):
    assert cleaner(text) == want


SAMPLES = [g[1] for g in GOLDEN] + [
    "", "plain prose only.", "naïve café O(n) ∞ and x² + y² = z²", "Dear Anna, (ed) Jones C & Baker G in Lewis J (ed) 1994", "f(x) = [a] {b} \\frac{1}{2} $$x$$ |y| 5° ∠ABC p.139, pp. 200",
    "1. one 2. two\n- three\niv. four", "`a` ``` b ``` www.x.y [1–3] (cf. Lee & Kim, 2001, p. 3; see Roe 1999)", "Vol. 2, no. 3 and 2000: 572", "x" * 500,
]


@pytest.mark.parametrize("cleaner", [g[0] for g in GOLDEN], ids=range(len(GOLDEN)))
def test_guards_change_nothing(cleaner, monkeypatch):
    guarded = [cleaner(s) for s in SAMPLES]
    monkeypatch.setattr(P, "GUARDED", False)
    assert [cleaner(s) for s in SAMPLES] == guarded


#: Each condition met and not met.
INLINE = [
    ("", False), ("  ", False), ("x+1", True), ("n", True), ("abcd", True), ("abcde", False), ("word", True), ("two words", False), ("0.3 trillion in 1970 to", False), ("a. B = 1", False), ("a. b = 1", True),
    ("one two three + 1", False), ("one to + 1", True), ("price of 3", False), (r"\text of 3", True), ("[[CODE]] price of", True), ("[[EQUATION]]", True), ("[[CODE]] one two three", False), ("h(x)", True), ("α", True), ("!", False),
]
PARENTHESES = [
    ("12", False), ("n-1", True), ("see below", False), ("a = b", False), ("a = 2", True), ("2 [[CODE]]", True), ("[[CODE]]", False), ("[[EQUATION]]", True), ("long-word", False), ("ab*c", True), ("a < 3", True), ("[[CODE]] = x", False),
]
BRACES = [("a {b; c} d", "a [[CODE]] d"), ("a {key_1} d", "a {key_1} d"), ("x^{a b}", "x^{a b}"), ("x_{a;}", "x_{a;}"), (r"{\bf bold; text }", "bold; text"), ("{two words}", "[[CODE]]"), ("{" + "k" * 80 + "}", "{" + "k" * 80 + "}"), ("{" + "k" * 81 + "}", "[[CODE]]"), ("{" + "a " * 101 + "}", "{" + "a " * 100 + "a }"), ("{}", "{}")]
SENTENCES = [
    ("Plain words here. More words.", "Plain words here. More words."), ("[[EQUATION]] a b. [[EQUATION]].", "[[EQUATION]]"), ("[[EQUATION]] word. Next.", "[[EQUATION]] word. Next."),
    ("[[EQUATION]] and then [[EQUATION]] one two three. Next one.", "[[EQUATION]] Next one."), ("[[EQUATION]] and then [[EQUATION]] one two three four. Next.", "[[EQUATION]] and then [[EQUATION]] one two three four. Next."),
]


def test_decisions_both_ways():
    assert [(x, P.is_inline_math(x)) for x, _ in INLINE] == INLINE
    assert [(x, P.is_mathematical(x)) for x, _ in PARENTHESES] == PARENTHESES
    assert [(x, P.clean_pseudocode_and_diagrams(x)) for x, _ in BRACES] == BRACES
    assert [(x, P._fold_sentences(x)) for x, _ in SENTENCES] == SENTENCES
    debris = [("$a^b$", True), ("$[[CODE]] x$", True), ("$plain$", False), ("$one_ two three$", False), ("$one_ two$", True)]
    assert [(x, P._dollar_debris(x) == R.EQ) for x, _ in debris] == debris


def test_native_twins(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    pairs = {
        "url": (T.clean_url, P.clean_url), "code": (T.clean_code_texts, P.clean_code_texts), "assign": (T.clean_code_assignments, P.clean_code_assignments), "music": (T.clean_music_notation, P.clean_music_notation),
        "complexity": (T.clean_complexity_notation, P.clean_complexity_notation), "cite": (T.clean_citations, P.clean_citations), "list": (T.clean_list_numbering, P.clean_list_numbering),
        "markdown": (T.clean_markdown_formatting, P.clean_markdown_formatting), "refs": (T.strip_reference_list, P.strip_reference_list), "strip": (T.strip_placeholders, P.strip_placeholders),
    }
    out = rows.select("i", *(native(F.col("s")).alias(k) for k, (native, _) in pairs.items())).collect()
    for r in out:
        for k, (_, python) in pairs.items():
            assert r[k] == python(SAMPLES[r["i"]]), (k, SAMPLES[r["i"]])


def test_every_rule_compiles_in_java(spark):
    rules = [r for v in vars(R).values() if isinstance(v, list) and v and isinstance(v[0], R.Rule) for r in v]
    assert len(rules) > 90
    probe = spark.createDataFrame([("probe $x$ [[EQUATION]] {a}",)], "s string")
    for k in range(0, len(rules), 20):
        probe.select(*(F.regexp_replace("s", *r.java()).alias(f"c{i}") for i, r in enumerate(rules[k : k + 20]))).collect()


def test_predicates(spark):
    rows = spark.createDataFrame([("Wie geht es, café!", ""), ("hola amigo", ""), ("привет", ""), ("plain", "write a screenplay"), ("kind regards, x", ""), (None, None)], "text string, prompt string")
    got = rows.select(T.contains_foreign_language(F.col("text")).alias("f"), T.is_academic_content(F.col("prompt"), F.col("text")).alias("a")).collect()
    assert [(r["f"], r["a"]) for r in got] == [(False, True), (True, True), (True, True), (False, False), (False, False), (False, True)]


def test_density(spark):
    tags = "[[CODE]]" * 20
    rows = spark.createDataFrame([("[[CODE]]",), ("",), (tags[:150],), (tags[:160] + "x" * 10,), ("a bc [[URL]]",)], "t string")
    got = [(r[0], r[1]) for r in rows.select(T.placeholder_density(F.col("t")), T.placeholder_density_windowed(F.col("t"))).collect()]
    assert got[0] == (0.5, False) and got[1] == (0.0, False) and got[2][1] is False and got[3][1] is True and got[4][0] == pytest.approx(1 / 3)


def test_fuzzed_strip_leaves_no_tag():
    import random

    rng = random.Random(0)
    for _ in range(300):
        s = "".join(rng.choice(["[[", "]]", "CODE", " ", "(", ")", ",", "a", ".", "[", "]"]) for _ in range(20))
        assert not re.search(R.PLACEHOLDER, P.strip_placeholders(s))
