"""Operator 2, toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon has a general word list and terms learned from labelled rows: words and word beginnings that are frequent in
toxic texts and rare in others. Its trie is intersected with the Levenshtein automaton of distance 1 (for whole words of
MIN_FUZZY bytes or more and beginnings of MIN_FUZZY_BEGINNING or more; shorter ones match exactly), and the product is
made deterministic once, on the driver. Each task runs the table over all words of a buffer at once; most words leave
after two or three letters. Ordinary words near a term, of a fixed list and of labelled rows that aren't toxic, are no
hits. The words within WINDOW words of a hit say whether it is quoted (words of saying, quotation marks) or aimed at
someone. A hit with an error counts NEAR of an exact one everywhere. A logistic regression on sums of these hit scores
gives the document's score.

The fitted part is bounded by parameters: at most FIT_ROWS labelled ids, in the order of a hash of the id, leaving out
held-out ones (CRC-32 of the id as text divisible by 5), each with one text (the first in text order where rows share the id);
of their words and beginnings (of words of 3 to 24 letters, in MIN_DF toxic rows or more, MIN_PRECISION of their rows toxic)
the CANDIDATES most frequent in toxic rows, and of these the LEARNED_TERMS most telling. Labels, language, source and id are
no inputs of a score. All texts are scored, and read whole.

Nulls and empty texts have no hits and get the score of such texts. Rows with equal ids or texts are scored one by one; a
null id counts as held out. Very long texts are scored like others. Without labels, or with one class only, fixed weights are
used. An empty table gives an empty result; other columns stay in `without_toxic`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm._bytes import letter_runs, lower_case, pieces, rolling_bytes
from prosemill.llm._spark import drop_staged, ship, staged

FIT_ROWS = 8_000
CANDIDATES, LEARNED_TERMS = 5_000, 300
MIN_DF, MIN_PRECISION = 5, 0.8
MIN_FUZZY, MIN_FUZZY_BEGINNING = 4, 6
NEAR = 0.75
WINDOW = 4
PREFIX_CHARS = (3, 7)

#: A general list of insults.
INSULTS = "idiot worthless moron trash scum pathetic loser clown disgusting stupid dumb imbecile jerk bastard bitch asshole retard vermin filth coward freak cretin idiota estúpido imbécil basura connard salaud abruti ordure arschloch dummkopf abschaum trottel".split()
#: Ordinary words at distance 1 of an insult.
ORDINARY = """idiom crash brash thrash crown blown flown clows down lose loses laser lower loner poser closer looser user boron moran maroon baron
scam scud slum swum scrum sum cum dump numb dub dumbo perk jerk jeri berk pitch ditch hitch witch batch botch butch birch itch fifth firth tilth
break wreak creak regard retire toward howard cowards bordure ordre salad salauds basuras vermis apathetic bastardo creatin tretin cretan
moral moran macron mormon loper loved loner lover losel""".split()
#: Words of saying, and words of address.
SAYING = "said says say wrote writes quoted quote quotes called calls word words term terms phrase insult example dit disait mot écrit sagte sagt wort schrieb dijo dice palabra escribió".split()
ADDRESS = "you your you're youre u ur are such tu toi es vous du dich bist ihr tú eres usted".split()

_DIGITS = np.arange(256, dtype=np.uint8)
for _digit, _letter in zip(b"013457", b"oieast", strict=True):
    _DIGITS[_digit] = _letter
_QUOTE = np.zeros(256, bool)
_QUOTE[np.frombuffer(b"\"'`", np.uint8)] = True
#: Quotation marks of several bytes.
_LONG_QUOTES = [x.encode() for x in "“”«»"]


def quotes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At which bytes a quotation mark begins, and at which one ends."""
    begins = _QUOTE[data]
    ends = begins.copy()
    for mark in _LONG_QUOTES:
        there = np.ones(max(len(data) - len(mark) + 1, 0), bool)
        for k, byte in enumerate(mark):
            there &= data[k : k + len(there)] == byte
        at = np.flatnonzero(there)
        begins[at] = True
        ends[at + len(mark) - 1] = True
    return begins, ends


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case, and common digits for letters."""
    return _DIGITS[lower_case(data)]


class Automaton:
    """Deterministic product of the lexicon's trie and Levenshtein automata.

    step[state, letter class] is the next state, 0 if no term can follow. whole[state] is the term (+ 1) accepted at the
    end of a word, near[state] whether with an error, begun[state] the term (+ 1) of which the word has the beginning,
    almost[state] that of which it has the beginning with an error. Ordinary words match exactly, and are no term.
    """

    def __init__(self, terms: list[tuple[str, bool]], ordinary: list[str] = ORDINARY):
        self.terms = terms
        terms = [*terms, *((w, False) for w in ordinary)]
        known = len(self.terms)
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [0]  # term + 1
        begins: list[int] = [0]
        fuzzy: list[bool] = [False]  # whether a term with errors goes through the node
        for i, (term, is_prefix) in enumerate(terms):
            node, word = 0, lowered(np.frombuffer(term.encode(), np.uint8)).tolist()
            allow = i < known and len(word) >= (MIN_FUZZY_BEGINNING if is_prefix else MIN_FUZZY)
            fuzzy[0] |= allow
            for letter in word:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    ends.append(0)
                    begins.append(0)
                    fuzzy.append(False)
                node = children[node][letter]
                fuzzy[node] |= allow
            if is_prefix:
                begins[node] = begins[node] or i + 1
            else:
                ends[node] = ends[node] or i + 1
        letters = sorted({x for c in children for x in c})
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)

        def move(state: frozenset, letter: int | None) -> frozenset:
            out = set()
            for node, errors in state:
                child = children[node].get(letter)
                if child is not None and (not errors or fuzzy[child]):
                    out.add((child, errors))
                if not errors and fuzzy[node]:
                    out.add((node, 1))  # a letter too many
                    for x, other in children[node].items():
                        if fuzzy[other]:
                            if x != letter:
                                out.add((other, 1))  # another letter
                            skipped = children[other].get(letter)
                            if skipped is not None and fuzzy[skipped]:
                                out.add((skipped, 1))  # a letter too few
            return frozenset(x for x in out if not x[1] or (x[0], 0) not in out)

        def long_enough(ends: list[int], node: int, least: int) -> bool:
            return 0 < ends[node] <= known and len(lowered(np.frombuffer(terms[ends[node] - 1][0].encode(), np.uint8))) >= least

        def close(ends: list[int], state: frozenset, least: int) -> int:
            found = [ends[n] for n, e in state if e and long_enough(ends, n, least)]
            found += [ends[c] for n, e in state if not e for c in children[n].values() if long_enough(ends, c, least)]
            return min(found, default=0)

        def accepts(state: frozenset) -> tuple[int, bool, int, int]:
            begun = next((begins[n] for n, e in state if not e and begins[n]), 0)
            almost = close(begins, state, MIN_FUZZY_BEGINNING)
            exact = next((ends[n] for n, e in state if not e and ends[n]), 0)
            if exact:
                return exact if exact <= known else -1, False, begun, almost
            whole = close(ends, state, MIN_FUZZY)
            return whole, bool(whole), begun, almost

        start = frozenset({(0, 0)})
        number, todo, rows, accepted = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)], [(0, False, 0, 0)]
        for state in todo:
            accepted.append(accepts(state))
            row = []
            for letter in (None, *letters):
                to = move(state, letter)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        self.step = np.array(rows, np.int32)
        self.whole = np.array([a[0] for a in accepted], np.int32)
        self.near = np.array([a[1] for a in accepted], bool)
        self.begun = np.array([a[2] for a in accepted], np.int32)
        self.almost = np.array([a[3] for a in accepted], np.int32)

    def run(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that match, their terms, and whether with an error."""
        term, near = np.zeros(len(start), np.int32), np.zeros(len(start), bool)
        token, at, state = np.arange(len(start)), start.copy(), np.ones(len(start), np.int32)
        while len(token):
            state = self.step[state, self.classes[low[at]]]
            at = at + 1
            begun, over = self.begun[state], at >= end[token]
            whole = np.where(over & (begun == 0), self.whole[state], 0)
            sure = (begun > 0) | (whole != 0)
            # the beginning with an error holds unless the rest of the word tells something else
            maybe = ~sure & (self.almost[state] > 0) & (term[token] == 0)
            term[token[maybe]], near[token[maybe]] = self.almost[state[maybe]], True
            term[token[sure]] = np.maximum(begun, whole)[sure]
            near[token[sure]] = (self.near[state] & (whole > 0))[sure]
            stay = (state > 0) & ~over & (begun == 0)
            token, at, state = token[stay], at[stay], state[stay]
        hit = np.flatnonzero(term)
        return hit, term[hit] - 1, near[hit]


FEATURES = ("log_abuse", "density", "log_hits", "log_quoted")


def _cues(words: list[str]) -> np.ndarray:
    data = lowered(np.frombuffer("".join(words).encode(), np.uint8))
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.unique(rolling_bytes(data).hash(np.append(0, ends[:-1]), ends))


_SAYING, _ADDRESS = _cues(SAYING), _cues(ADDRESS)


def features(automaton: Automaton, weights: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES per document, and its number of hits."""
    low = lowered(data)
    start, end = letter_runs(data, offs)
    first = np.searchsorted(start, offs, "left")
    hit, term, near = automaton.run(low, start, end)
    doc = np.searchsorted(offs, start[hit], "right") - 1
    about = hit[:, None] + np.append(np.arange(-WINDOW, 0), np.arange(1, WINDOW + 1))[None, :]
    inside = (about >= first[doc][:, None]) & (about < first[doc + 1][:, None])
    about = np.where(inside, about, 0)
    words = rolling_bytes(low).hash(start[about], end[about]) if len(hit) else np.zeros(about.shape, np.uint64)
    begins, ends = quotes(data)
    after = np.append(begins, False)[end[hit]] & (end[hit] < offs[doc + 1])
    before = ends[np.maximum(start[hit] - 1, 0)] & (start[hit] > offs[doc])
    quoted = (np.isin(words, _SAYING) & inside).any(1) | (before & after)
    aimed = (np.isin(words, _ADDRESS) & inside).any(1)
    sure = np.where(near, NEAR, 1.0)
    score = weights[term] * sure * np.where(quoted, 0.3, 1.0) * np.where(aimed & ~quoted, 1.25, 1.0)
    n = len(offs) - 1
    abuse = np.bincount(doc, score, minlength=n)
    size = np.maximum(np.diff(first), 1)
    x = np.stack([np.log1p(abuse), np.log1p(100 * abuse / size), np.log1p(np.bincount(doc, sure, minlength=n)), np.log1p(np.bincount(doc[quoted], sure[quoted], minlength=n))], 1)
    return x, np.bincount(doc, minlength=n)


def scores(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30))), 9)


def _featurer(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, weights = shared.value[:2]
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                x, _ = features(automaton, weights, data, offs)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.names.index(k)) for k in keep), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], [*keep, *FEATURES])

    return run


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, weights, beta = shared.value
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                x, hits = features(automaton, weights, data, offs)
                score = scores(x, beta)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(hits.astype(np.int64))], ["doc_id", "held_out", "score", "predicted", "n_hits"])

    return run


def _keeper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, weights, beta = shared.value
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                yield part.filter(pa.array(scores(features(automaton, weights, data, offs)[0], beta) < 0.5))

    return run


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def learn_terms(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, whether a beginning, weight) from labelled texts; copies with one opening or ending count once."""
    once = sample.dropDuplicates(["opening"]).dropDuplicates(["ending"])
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    words = once.select("doc_id", "toxic", word.alias("word")).where(F.length("word").between(3, 24))
    lo, hi = PREFIX_CHARS
    marks = [F.concat(F.col("word"), F.lit("$"))] + [F.when(F.length("word") > k, F.substring("word", 1, k)) for k in range(lo, hi + 1)]
    terms = words.select("doc_id", "toxic", F.explode(F.array(*marks)).alias("term")).where("term is not null").distinct()
    df = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rows = df.where((F.col("bad") >= MIN_DF) & (F.col("bad") >= MIN_PRECISION * (F.col("bad") + F.col("good")))).orderBy(F.desc("bad"), "term").limit(CANDIDATES).collect()
    def odds(r) -> float:
        return float(np.log((r["bad"] + 1) / (r["good"] + 1)))

    chosen: list[tuple[str, bool, float]] = []
    counts: dict[str, int] = {}
    # the most telling first; of equally telling ones the longer, and words before beginnings
    for r in sorted(rows, key=lambda r: (-round(r["bad"] * odds(r), 9), -len(r["term"]), not r["term"].endswith("$"), r["term"])):
        term, is_prefix = r["term"].rstrip("$"), not r["term"].endswith("$")
        if any(term.startswith(t) for t, p, _ in chosen if p) or (is_prefix and sum(n for t, n in counts.items() if t.startswith(term)) >= 0.85 * r["bad"]):
            continue
        chosen.append((term, is_prefix, round(odds(r) / 3, 6)))
        counts[term] = r["bad"]
    return chosen[:LEARNED_TERMS]


def _near_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                start, end = letter_runs(data, offs)
                hit, _, near = shared.value.run(lowered(data), start, end)
                yield part.take(pa.array(np.unique(np.searchsorted(offs, start[hit[near]], "right") - 1)))

    return run


def ordinary_words(automaton: Automaton, sample: DataFrame) -> list[str]:
    """Words near a term that toxic rows don't hold more often than learned terms must."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+")))
    df = sample.select("toxic", word.alias("text")).groupBy("text").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    usual = df.where((F.length("text") <= 32) & (F.col("good") > 0) & (F.col("bad") < MIN_PRECISION * (F.col("bad") + F.col("good"))))
    return sorted(r["text"] for r in usual.select("text").mapInArrow(_near_words(sample.sparkSession.sparkContext.broadcast(automaton)), "text string").collect())  # few: words of FIT_ROWS texts near a term


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame):
    """Automaton, weights of its terms and coefficients. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    some = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = staged(rows.withColumns({"opening": F.xxhash64(F.left("text", F.lit(40))), "ending": F.xxhash64(F.right("text", F.lit(40)))}), "toxic-sample")
    learned = learn_terms(sample)
    have = {t for t, _, _ in learned}
    terms = learned + [(t, False, 1.0) for t in INSULTS if t not in have]
    kinds, weights = [(t, p) for t, p, _ in terms], np.array([w for _, _, w in terms])
    automaton = Automaton(kinds, ORDINARY + ordinary_words(Automaton(kinds), sample))
    shared = spark.sparkContext.broadcast((automaton, weights))
    kinds = ", ".join(["toxic int", *(f"{f} double" for f in FEATURES)])
    got = sample.select("text", "toxic").mapInArrow(_featurer(shared, ["toxic"]), kinds).groupBy("toxic", *FEATURES).count().orderBy("toxic", *FEATURES).collect()  # FIT_ROWS at most
    drop_staged(sample)
    y = np.repeat([r["toxic"] for r in got], [r["count"] for r in got]) if got else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return automaton, weights, np.array([-2.0, 2.0, 0.5, 0.5, -0.5])
    x = np.repeat([[r[f] for f in FEATURES] for r in got], [r["count"] for r in got], axis=0)
    return automaton, weights, np.round(fit_logistic(x, y), 9)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of every row."""
    spark = ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    shared = spark.sparkContext.broadcast(fit(source, labels))
    return source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, of score below 0.5. docs: doc_id, text, any others."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels))
    return docs.mapInArrow(_keeper(shared), docs.schema)
