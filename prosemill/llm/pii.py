"""Operator 5, PII, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), and words near a span adjust
its score. Kinds and rules, leftmost and without overlap in each kind:

- email, ip (parts of 255 at most), card (16 to 19 digits, Luhn), phone (8 to 15 digits): the base, always reported;
- iban: two letters, two digits and 11 to 30 letters or digits, in groups or not, with remainder 1 modulo 97;
- secret: a value of 16 characters or more that a word such as `token` or `password` names;
- cardlike: 13 to 15 digits that pass Luhn, if a word of cards stands near.

Places of all matches of a pattern are sums of the lengths of what stands between them (split) and of what matched, made
in a logarithmic number of passes over both; a span's nearby words are the ends of what stands before and after it. Redaction
cuts texts from blocks of bounded length. So the work on a text grows with its length times the logarithm of its matches.
Texts without a kind's telltale character skip its pattern. The patterns use possessive repetition, so a long run of one
character costs one pass.

Nulls and empty texts have no spans. Rows with equal ids or texts are searched one by one. Very long texts are searched whole.
Spans of equal start and end of several kinds are all reported. An empty table gives an empty result; columns of our own get
names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import let
from prosemill.llm._spark import fresh

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "cardlike")
BASE = ("email", "ip", "card", "phone")
CONTEXT = 40

#: The same matches as the plain patterns: a start inside a run of the first class fails exactly if the run's start does,
#: unless the last match ended there (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "digits": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,8}[:=]\s{0,8}[\"']?[A-Za-z0-9+/_.-]{16,}",
}
_PART = r"0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"  # 0 to 255, with any zeros before
#: Words that speak for a kind when they stand near.
NEAR = {
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|cvv|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "email": "mail|contact|kontakt|correo",
    "ip": "ip|host|server|address",
    "secret": "key|token|secret|password",
}
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "secret": 0.8, "cardlike": 0.4}
THRESHOLD = 0.6


def scan(values: Column, combine) -> Column:
    """The running totals of an array under an associative function: pass k combines values 2**k places apart."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int"))

    def one(totals: Column, k: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            before = F.get(totals, i - F.pow(F.lit(2), k).cast("int"))
            return F.when(before.isNull(), x).otherwise(combine(before, x))

        return F.transform(totals, at)

    return F.aggregate(passes, values, one)


def matches(text: Column, pattern: str, wanted: Column) -> Column:
    """array<struct<start, value, before, after>> of all matches: starts in code points from 0, and CONTEXT characters around."""
    none = F.array().cast("array<struct<start:int,value:string,before:string,after:string>>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def with_ends(b: Column) -> Column:
        sizes = F.transform(b["found"], lambda v, i: F.length(v) + F.length(F.get(b["gaps"], i)))
        return F.struct(b["found"].alias("found"), b["gaps"].alias("gaps"), scan(sizes, lambda x, y: x + y).alias("ends"))

    def placed(b: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            start = (F.get(b["ends"], i) - F.length(value)).cast("int")
            before, after = F.right(F.get(b["gaps"], i), F.lit(CONTEXT)), F.left(F.get(b["gaps"], i + 1), F.lit(CONTEXT))
            return F.struct(start.alias("start"), value.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(b["found"], one)

    return F.when(wanted, let(let(both, with_ends), placed)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's remainder is 1: the first four characters go last, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    each = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(each, F.lit(0), lambda s, d: F.when(d > 9, (s * 100 + d) % 97).otherwise((s * 10 + d) % 97))
    return (rest == 1) & F.length(plain).between(15, 34)


def _context(span: Column, words: str) -> Column:
    """Whether a word of the kind stands within CONTEXT characters before or after, up to the kind's next matches."""
    return F.lower(F.concat(span["before"], F.lit(" "), span["after"])).rlike(f"(?<![\\p{{L}}])(?:{words})")


def proposals(text: Column) -> dict[str, Column]:
    """Raw matches of each pattern; one of digits serves both kinds of cards."""
    has = lambda sign: F.contains(text, F.lit(sign))
    return {
        "email": matches(text, PATTERNS["email"], has("@")),
        "ip": matches(text, PATTERNS["ip"], has(".")),
        "digits": F.filter(matches(text, PATTERNS["digits"], text.rlike("[0-9](?:[ -]?[0-9]){12}")), lambda m: F.length(m["value"]) >= 13),
        "phone": matches(text, PATTERNS["phone"], has("+")),
        "iban": matches(text, PATTERNS["iban"], text.rlike("[A-Z]{2}[0-9]{2}")),
        "secret": matches(text, PATTERNS["secret"], has("=") | has(":")),
    }


def find(docs: DataFrame, text_column: str = "text", output: str = "found") -> DataFrame:
    """The rows with `output`: array<struct<kind, start, end, score>> in the order of KINDS, then start; the base first."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    proposed = proposals(text)
    own = dict(zip(proposed, fresh(docs, *(f"_{k}" for k in proposed)), strict=True))
    rows = docs.withColumns({own[k]: v for k, v in proposed.items()})
    valid = {
        "email": F.col(own["email"]),
        "ip": F.filter(own["ip"], lambda m: m["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(own["digits"], lambda m: F.length(digits(m["value"])).between(16, 19) & luhn(digits(m["value"]))),
        "phone": F.filter(own["phone"], lambda m: F.length(digits(m["value"])).between(8, 15)),
        "iban": F.filter(own["iban"], lambda m: mod97(m["value"])),
        "secret": F.col(own["secret"]),
        "cardlike": F.filter(own["digits"], lambda m: F.length(digits(m["value"])).between(13, 15) & luhn(digits(m["value"]))),
    }

    def scored(kind: str) -> Column:
        near = NEAR["card" if kind == "cardlike" else kind]

        def one(m: Column) -> Column:
            score = F.lit(SCORE[kind]) + F.when(_context(m, near), F.lit(0.3)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        spans = F.transform(valid[kind], one)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    return rows.withColumn(output, F.concat(*(scored(k) for k in KINDS))).drop(*own.values())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (all of them) and the mean score."""
    rows = find(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    mean = F.aggregate("found", F.lit(0.0), lambda a, s: a + s["score"]) / F.greatest(F.size("found"), F.lit(1))
    return rows.select("doc_id", *(number(k) for k in BASE), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.round(mean, 6).alias("score"))


BLOCK = 1024


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """The characters from begin to end (from 0, end exclusive) of a text that is given in blocks of BLOCK characters."""
    first = F.floor(begin / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.when(end > begin, some.substr((begin - first * BLOCK + 1).cast("int"), (end - begin).cast("int"))).otherwise("")


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    found, blocks, spans = fresh(docs, "_found", "_blocks", "_spans")
    rows = find(docs, text_column, found)
    text = F.coalesce(F.col(text_column), F.lit(""))
    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(both: Column) -> Column:
        """Spans that begin after all others before have ended, with where these ended (from)."""
        each = F.transform(both["spans"], lambda s, i: F.struct(F.coalesce(F.get(both["ends"], i - 1), F.lit(0)).alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))
        return F.filter(each, lambda s: s["start"] >= s["from"])

    with_ends = let(by_start, lambda b: F.struct(b.alias("spans"), scan(F.transform(b, lambda s: s["end"]), lambda x, y: F.greatest(x, y)).alias("ends")))
    some = F.size(found) > 0
    rows = rows.withColumn(blocks, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    rows = rows.withColumn(spans, F.when(some, let(with_ends, lambda w: F.struct(merged(w).alias("kept"), F.element_at(w["ends"], -1).alias("last")))))
    parts = F.transform(F.col(spans)["kept"], lambda s: F.concat(_cut(F.col(blocks), s["from"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    new = F.concat(F.array_join(parts, ""), _cut(F.col(blocks), F.col(spans)["last"], F.length(text)))
    return rows.withColumn(text_column, F.when(some, new).otherwise(F.col(text_column))).drop(found, blocks, spans)
