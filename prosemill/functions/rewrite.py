"""The rewrite program in Python, for Arrow batches: cleaners with callbacks and fixpoints, and the whole program.

Each cleaner maps a string to a string. Rules are skipped when a literal that they need isn't in the text, which changes no
result; tests compare both ways.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import rules as R
from prosemill.sources.staging import small_batches

GUARDED = True

#: Characters that match an ASCII letter regardless of case, but whose lower case isn't that letter.
_ODD_CASES = ("\u017f", "\u0131", "\u0130")


#: How often one of the strings must stand in the text, whether that is its lower case, and the strings; no string stands for a digit.
Need = tuple[int, bool, tuple[str, ...]]
DIGIT: Need = (1, False, ())


def needs(pattern: str, flags: int = 0) -> tuple[Need, ...]:
    """What every match holds, found in the parsed pattern: characters that stand for themselves, outside of what may be left out. Nothing is said where nothing is certain."""
    parsed = re._parser.parse(pattern, flags)
    found = dict.fromkeys(_certain(parsed, bool((flags | parsed.state.flags) & re.IGNORECASE)))
    return tuple(sorted(found, key=lambda need: (need == DIGIT, need[1])))


def _certain(items, folded: bool) -> list[Need]:
    found, run = [], ""

    def put(*strings: str) -> None:
        found.append((1, folded and any(x.isalpha() for s in strings for x in s), strings))

    for kind, value in [*items, (None, None)]:
        name = str(kind)
        c = chr(value) if name == "LITERAL" else ""
        if c and (c.isascii() or not folded):
            run += c.lower() if folded else c
            continue
        if run:
            put(run)
            run = ""
        if name == "IN" and all(str(k) == "LITERAL" and (chr(v).isascii() or not folded) for k, v in value):
            put(*dict.fromkeys(chr(v).lower() if folded else chr(v) for _, v in value))
        elif name == "IN" and [str(v) for _, v in value] == ["CATEGORY_DIGIT"]:
            found.append(DIGIT)
        elif name == "BRANCH":
            each = [[need for need in _certain(branch, folded) if need[2]] for branch in value[1]]
            if all(each):
                longest = [max(needed, key=lambda need: min(map(len, need[2])))[2] for needed in each]
                put(*dict.fromkeys(x for strings in longest for x in strings))
        elif name == "SUBPATTERN":
            found += _certain(value[3], folded) if not value[1] and not value[2] else []
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            once = _certain(value[2], folded) if value[0] > 0 else []
            found += [(n * value[0], lower, strings) if len(strings) == 1 else (n, lower, strings) for n, lower, strings in once]
        elif name == "ASSERT":
            found += _certain(value[1], folded)
    return found


_lowered, _digits = ("", ""), ("", False)
_DIGIT = re.compile(r"\d")


def _lower(text: str) -> str:
    """In lower case; the last one is kept, as one text meets many rules."""
    global _lowered
    last = _lowered
    if last[0] is not text:
        last = _lowered = (text, text.lower())
    return last[1]


def _has_digit(text: str) -> bool:
    global _digits
    last = _digits
    if last[0] is not text:
        last = _digits = (text, _DIGIT.search(text) is not None)
    return last[1]


def _may_match(text: str, needed: tuple[Need, ...]) -> bool:
    for n, folded, strings in needed:
        if folded:
            if any(x in text for x in _ODD_CASES):
                continue
            where = _lower(text)
        else:
            where = text
        if n > 1:
            if where.count(strings[0]) < n:
                return False
            continue
        for x in strings:
            if x in where:
                break
        else:
            if strings or not _has_digit(text):
                return False
    return True


@cache
def compiled(rule: R.Rule) -> re.Pattern:
    return re.compile(rule.pattern, rule.flags)


def _ready(rule: R.Rule) -> tuple:
    """The rule's substitution, replacement and needs, kept with it."""
    needed = ((1, False, rule.literals),) if rule.literals else ()
    ready = (compiled(rule).sub, rule.replacement, needed + needs(rule.pattern, rule.flags))
    object.__setattr__(rule, "_ready", ready)
    return ready


def apply(text: str, rules: list[R.Rule]) -> str:
    for rule in rules:
        sub, replacement, needed = rule.__dict__.get("_ready") or _ready(rule)
        if not GUARDED or _may_match(text, needed):
            text = sub(replacement, text)
    return text


_tidied = ""


def tidy(text: str) -> str:
    """Runs of white space become one space, and none is left at the ends; splitting does that several times faster than a pattern.

    The last result is known by identity, as most steps leave a text as it is.
    """
    global _tidied
    if text is not _tidied:
        text = _tidied = " ".join(text.split())
    return text


def _simple(rules: list[R.Rule]) -> Callable[[str], str]:
    return lambda text: tidy(apply(text, rules))


clean_url = _simple(R.URL)
clean_code_texts = _simple(R.CODE_TEXTS)
clean_music_notation = _simple(R.MUSIC)
clean_complexity_notation = _simple(R.COMPLEXITY)
clean_code_assignments = _simple(R.CODE_ASSIGNMENTS)
clean_markdown_formatting = _simple(R.MARKDOWN)
clean_list_numbering = _simple(R.LIST_NUMBERING)
clean_citations = _simple(R.CITATIONS)
clean_residual_math_noise = _simple(R.RESIDUAL)


_REFERENCE_NEEDS = needs(R.REFERENCE_LIST, re.IGNORECASE)


def strip_reference_list(text: str) -> str:
    if GUARDED and not _may_match(text, _REFERENCE_NEEDS):
        return text
    found = re.search(R.REFERENCE_LIST, text, re.IGNORECASE)
    return text[: found.start()].strip() if found else text


def is_non_prose(fragment: str) -> bool:
    """Whether no run of three letters is left without the tags."""
    for name in R.KNOWN_TAGS:
        fragment = fragment.replace(f"[[{name}]]", "")
    return not re.search(r"[A-Za-z]{3,}", fragment)


#: What a fragment's parts say about it, by name. Tags are none of its words.
_WORDLIKE = re.compile(r"[A-Za-z]{3,}")
_FRAGMENT_TAG = re.compile(r"\[\[(?:EQUATION|CODE|CITATION)\]\]")


@dataclass(frozen=True)
class Fragment:
    """A stretch of text without white space around it, measured once: tags, the lengths of its words of three letters or more, and what is left without tags."""

    text: str
    tags: int
    words: tuple[int, ...]
    bare: str

    @staticmethod
    def of(text: str) -> Fragment:
        bare = _FRAGMENT_TAG.sub(" ", text)
        return Fragment(text.strip(), len(_FRAGMENT_TAG.findall(text)), tuple(len(w) for w in _WORDLIKE.findall(bare)), bare)


def clean_pseudocode_and_diagrams(text: str) -> str:
    text = apply(text, R.ARRAY_INDEX + R.DIAGRAMS)
    if "{" in text:
        text = re.sub(R.CODE_BODY, lambda found: found[0] if found["kept"] else R.CODE if found["plain"] is None else found["plain"].strip(), text)
    return tidy(apply(text, R.CODE_WORDS))


#: Signs of mathematics in parentheses, and the sets of them of which one is enough.
SIGNS = {"arithmetic": re.compile(r"[+\-*/^]"), "relation": re.compile("[=<>]"), "digit": re.compile(r"\d"), "equation": re.compile(r"\[\[EQUATION\]\]"), "code": re.compile(r"\[\[CODE\]\]")}
EVIDENCE = ({"arithmetic"}, {"equation"}, {"digit", "relation"}, {"digit", "code"})


def is_mathematical(inner: str) -> bool:
    """Whether what stands between parentheses has no word and one of the sets of signs."""
    signs = {name for name, sign in SIGNS.items() if sign.search(inner)}
    return any(signs >= enough for enough in EVIDENCE) and is_non_prose(inner)


def clean_bare_expressions(text: str) -> str:
    text, before = apply(text, R.FACTORIALS), None
    while before != text and "(" in text:
        before, text = text, re.sub(r"\(([^()]{1,60})\)", lambda found: R.EQ if is_mathematical(found[1]) else found[0], text)
    return tidy(apply(text, R.BARE_AFTER))


#: What makes a stretch between dollars prose or prices, whatever else it holds, and what makes it mathematics otherwise.
PROSE = (
    lambda f: re.search(r"\.(?:\s+[A-Z]|\n)", f.text),
    lambda f: len(f.words) > 2,
    lambda f: not f.tags and "\\" not in f.text and " " in f.text and max(f.words, default=0) > 3,
)
MATHEMATICS = (
    lambda f: f.tags,
    lambda f: re.search(R.INLINE_MATH_SIGNS, f.text),
    lambda f: re.fullmatch("[A-Za-z]{1,4}", f.text),
)


def is_inline_math(inner: str) -> bool:
    fragment = Fragment.of(inner)
    return any(sign(fragment) for sign in MATHEMATICS) and not any(sign(fragment) for sign in PROSE)


def _inline_math(text: str) -> str:
    """Replaces the shortest span that is mathematics, until there is none.

    All at once where the dollars that are left pair up as before: a dollar without partner right before a span would find one beyond it.
    """
    while "$" in text:
        found = list(re.finditer(R.INLINE_MATH, text))
        spans = [span for span in found if is_inline_math(span[1])]
        if not spans:
            break
        ends = {span.end() for span in found}
        if not GUARDED or any(text[span.start() - 1 : span.start()] == "$" and span.start() not in ends for span in spans):
            spans = [min(spans, key=lambda span: len(span[1]))]
        parts, last = [], 0
        for span in spans:
            parts += [text[last : span.start()], R.EQ]
            last = span.end()
        text = "".join(parts) + text[last:]
    return text


#: Words that a sentence with no, one, or more equations needs to be more than these.
NEEDED_WORDS = (0, 1, 6)


def _is_soup(sentence: str) -> bool:
    rest = sentence.split("[[EQUATION]]")
    return len(rest) > 1 and len(_WORDLIKE.findall("".join(rest))) < NEEDED_WORDS[min(len(rest) - 1, 2)]


def _fold_sentences(text: str) -> str:
    """Sentences of tags and next to no words become one tag, and neighbours of that kind one. Without a tag only white space between sentences would change."""
    if GUARDED and "[[EQUATION]]" not in text:
        return text
    runs = groupby(re.split(r"(?<=[.!?])\s+", text), _is_soup)
    return " ".join("[[EQUATION]]" if soup else " ".join(run) for soup, run in runs)


def clean_math_texts(text: str) -> str:
    if "\\u" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda found: chr(int(found[1], 16)), text)
    text = apply(_inline_math(apply(text, R.MATH_BEFORE)), R.MATH_AFTER)
    return tidy(apply(_fold_sentences(text), [R.collapse("EQUATION", "")]))


@cache
def _pair(tag: str) -> re.Pattern:
    connector = R.CODE_CONNECTOR if tag == "[[CODE]]" else R.EQUATION_CONNECTOR
    return re.compile(re.escape(tag) + connector + re.escape(tag), re.IGNORECASE)


def merge_continuous_equations(text: str, tag: str = "[[EQUATION]]") -> str:
    before = None
    while before != text and text.count("[[") > 1 and text.upper().count(tag) > 1:
        before, text = text, _pair(tag).sub(f" {tag} ", text)
    return tidy(text)


def strip_surrogate_characters(text: str) -> str:
    return text if text.isascii() else re.sub("[\ud800-\udfff]", "", text)


def strip_placeholders(text: str) -> str:
    """Removes tags and what they leave behind, again while closing gaps makes new tags."""
    while True:
        text = apply(text, R.STRIP_PLACEHOLDERS).strip()
        if not re.search(R.PLACEHOLDER, text):
            return text


def _repeated(text: str, times: int, step: Callable[[str], str]) -> str:
    """Up to `times` passes; a pass that changes nothing ends them."""
    for _ in range(times):
        before, text = text, step(text)
        if before == text:
            break
    return text


def _dollar_debris(text: str) -> str:
    """Spans between dollars that hold tags or LaTeX signs and next to no words."""

    def folded(found: re.Match) -> str:
        fragment = Fragment.of(found[1])
        return R.EQ if len(fragment.words) < 3 and (fragment.tags or re.search(R.DEBRIS_SIGNS, found[1])) else found[0]

    return re.sub(R.DOLLAR_SPAN, folded, text) if "$" in text else text


def mop_up_leftovers(text: str) -> str:
    """Fragments beside tags that the cleaners leave: everyday mathematics, physics, dollars, LaTeX commands, algebra and braces."""
    text = apply(text, R.LEFTOVERS + R.PHYSICS)
    text = _repeated(text, 5, lambda t: apply(_dollar_debris(apply(t, R.CLUSTERS)), R.CLUSTERS_AFTER))
    text = apply(text, R.DOLLARS)
    for rules in (R.SHELLS, R.COMMANDS):
        text = _repeated(text, 4, lambda t, rules=rules: apply(t, rules))
    text = _repeated(text, 4, lambda t: apply(t, R.ALGEBRA + R.ALGEBRA_AFTER))
    return tidy(apply(text, R.ESCAPES))


def clean_pipeline(text: str) -> str:
    """The whole program in its fixed order."""
    for step in (
        clean_url, clean_pseudocode_and_diagrams, clean_code_texts, clean_code_assignments, clean_music_notation, clean_complexity_notation, strip_reference_list,
        clean_citations, clean_list_numbering, clean_bare_expressions, clean_math_texts, clean_residual_math_noise, merge_continuous_equations,
    ):
        text = step(text)
    text = mop_up_leftovers(merge_continuous_equations(text, "[[CODE]]"))
    text = clean_code_assignments(text)
    text = merge_continuous_equations(merge_continuous_equations(text), "[[CODE]]")
    return strip_surrogate_characters(text)


def spread(rows: DataFrame) -> DataFrame:
    """Deals a few partitions to all cores before work in Python on each row; with as many partitions as cores nothing moves."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows._jdf.rdd().getNumPartitions() >= cores else rows.repartition(cores)


def column(cleaner: Callable[[str], str], text: Column) -> Column:
    """A cleaner over a column, by Arrow batches. Not deterministic for the optimiser, so a filter on it runs it once."""

    small_batches()

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda value: None if value is None else cleaner(value))

    return run.asNondeterministic()(text)
