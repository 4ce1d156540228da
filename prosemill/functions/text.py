"""Text functions as Column expressions: native rewrites, predicates, counts and passages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions import rules as R

#: The tags that the density predicates know, as a pattern.
TAG = r"\[\[(?:" + "|".join(R.KNOWN_TAGS) + r")\]\]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rewritten(text: Column, rules: list[R.Rule]) -> Column:
    """Rules that have no callback, as a chain of replacements."""
    for rule in rules:
        text = F.regexp_replace(text, *rule.java())
    return text


def clean_url(text: Column) -> Column:
    return tidy(rewritten(text, R.URL))


def clean_code_texts(text: Column) -> Column:
    return tidy(rewritten(text, R.CODE_TEXTS))


def clean_code_assignments(text: Column) -> Column:
    return tidy(rewritten(text, R.CODE_ASSIGNMENTS))


def clean_music_notation(text: Column) -> Column:
    return tidy(rewritten(text, R.MUSIC))


def clean_complexity_notation(text: Column) -> Column:
    return tidy(rewritten(text, R.COMPLEXITY))


def clean_markdown_formatting(text: Column) -> Column:
    return tidy(rewritten(text, R.MARKDOWN))


def clean_list_numbering(text: Column) -> Column:
    return tidy(rewritten(text, R.LIST_NUMBERING))


def clean_citations(text: Column) -> Column:
    return tidy(rewritten(text, R.CITATIONS))


def strip_reference_list(text: Column) -> Column:
    """Everything before the first heading of references, if there is one."""
    pattern = f"(?Uiu){R.REFERENCE_LIST}"
    before = F.element_at(F.split(text, pattern, 2), 1)
    return F.when(text.rlike(pattern), strip(before)).otherwise(text)


def strip_surrogate_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{D800}-\x{DFFF}]", "")


def strip_placeholders(text: Column) -> Column:
    """Removes tags and what they leave behind, again while closing gaps makes new tags.

    A pass that finds a tag takes a closing bracket away, so there are no more passes than brackets. Few texts need a second one.
    """

    def once(t: Column) -> Column:
        return F.trim(rewritten(t, R.STRIP_PLACEHOLDERS))

    def again(t: Column) -> Column:
        left = F.sequence(F.lit(1), F.regexp_count(t, F.lit(r"\]")) + 1)
        return F.when(t.rlike(f"(?U){R.PLACEHOLDER}"), F.aggregate(left, t, lambda state, _: F.when(state.rlike(f"(?U){R.PLACEHOLDER}"), once(state)).otherwise(state))).otherwise(t)

    return let(once(F.coalesce(text, F.lit(""))), again)


def count_words(text: Column) -> Column:
    """Words without tags; the tags are looked for only where a bracket closes."""

    def bare(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("]")), F.regexp_replace(t, f"(?U){R.PLACEHOLDER}", " ")).otherwise(t)

    return F.regexp_count(let(F.coalesce(text, F.lit("")), bare), F.lit(r"(?U)\S+")).cast("int")


def tag_count(text: Column, tag: str) -> Column:
    return F.regexp_count(text, F.lit(rf"\[\[{tag}\]\]")).cast("int")


def is_non_prose(text: Column) -> Column:
    return ~F.regexp_replace(text, TAG, "").rlike("[A-Za-z]{3,}")


def placeholder_density(text: Column) -> Column:
    """Tags / (tags + words); a tag's name counts as a word."""
    tags = F.regexp_count(text, F.lit(TAG))
    total = tags + F.regexp_count(text, F.lit(r"(?U)\b[a-zA-Z]{2,}\b"))
    return F.when(total > 0, tags / total).otherwise(F.lit(0.0))


def placeholder_density_windowed(text: Column, width: int = 150, threshold: float = 0.5) -> Column:
    """Whether whole tags fill `threshold` of any window of `width` characters; windows start every half width."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - width - 1, F.lit(0)), F.lit(width // 2))

    def dense(start: Column) -> Column:
        window = text.substr(start + 1, F.lit(width))
        return F.length(window) - F.length(F.regexp_replace(window, r"\[\[[A-Z]+\]\]", "")) >= threshold * width

    return F.coalesce((F.length(text) > width) & F.contains(text, F.lit("[[")) & F.exists(starts, dense), F.lit(False))


def has_foreign_script(text: Column) -> Column:
    return F.coalesce(text.rlike(R.FOREIGN_SCRIPT), F.lit(False))


def has_foreign_words(text: Column) -> Column:
    """A French or Spanish function word, or a word with a diacritic that isn't a loan word."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-zà-ÿ']+)"), F.lit(1))
    odd = F.exists(words, lambda w: w.rlike(f"[{R.DIACRITICS}]") & ~w.isin(*R.LOAN_WORDS))
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, R.STOP_WORDS))) | odd, F.lit(False))


def contains_foreign_language(text: Column, detector=None) -> Column:
    """detector: a function Column -> boolean Column for whole sentences in other languages, if there is one."""
    found = has_foreign_script(text) | has_foreign_words(text)
    return found | F.coalesce(detector(text), F.lit(False)) if detector else found


def is_academic_content(prompt: Column, text: Column) -> Column:
    prompt_l = F.lower(F.coalesce(prompt, F.lit("")))
    both = F.concat(prompt_l, F.lit(" "), F.lower(F.coalesce(text, F.lit(""))))
    creative = prompt_l.rlike("|".join(map(re.escape, R.CREATIVE_KEYWORDS))) | prompt_l.rlike("(?U)" + "|".join(R.PROMPT_PATTERNS))
    return ~(creative | both.rlike("(?U)" + "|".join(R.SCRIPT_PATTERNS)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def word_windows(sentence: Column, most: int) -> Column:
    """A sentence cut into pieces of at most `most` words."""

    def cut(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(most))
        return F.when(F.size(parts) > 0, F.transform(starts, lambda i: F.array_join(F.slice(parts, i, most), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(sentence), cut)


def score_band(percent: Column) -> Column:
    """The bands' names."""
    return F.when(percent <= 20, "Likely Human-Written").when(percent >= 80, "Highly Likely AI-Generated").otherwise("Possible AI Assistance / Mixed Content")


def lexical_struct(text: Column) -> Column:
    """struct<ttr, hapax_legomena_ratio, avg_word_length, function_word_ratio> over alphabetic tokens; zeros without any."""

    def counted(each: Column) -> Column:
        # where the runs of the sorted tokens start; a run of one ends where it starts
        starts = F.filter(F.sequence(F.lit(0), F.size(each) - 1), lambda i: (i == 0) | (F.get(each, i) != F.get(each, i - 1)))
        return let(starts, lambda at: F.struct(F.size(at).alias("types"), F.size(F.filter(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(each)) - i == 1)).alias("once")))

    def of(tokens: Column) -> Column:
        runs = F.when(F.size(tokens) > 0, let(F.sort_array(tokens), counted)).otherwise(F.struct(F.lit(0).alias("types"), F.lit(0).alias("once")))
        letters = F.length(F.array_join(tokens, ""))
        function = F.size(F.filter(tokens, lambda w: w.isin(*sorted(set(R.FUNCTION_WORDS)))))
        n = F.greatest(F.size(tokens), F.lit(1))
        return let(runs, lambda r: F.struct((r["types"] / n).alias("ttr"), (r["once"] / n).alias("hapax_legomena_ratio"), (letters / n).alias("avg_word_length"), (function / n).alias("function_word_ratio")))

    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))  # what the other way gives for ASCII, without a call for each token
    each = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\p{L}+)"), F.lit(1)), lambda w: F.lower(w))
    return let(F.when(F.length(text) == F.octet_length(text), plain).otherwise(each), of)
