"""Operators that sketch, learn or match: against brute force, planted cases and held-out accuracy."""

import os
import pickle
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from prosemill.llm import exact_pairs
from prosemill.llm._spark import HashFilter
from prosemill.llm.decontamination import decontamination, tile, tile_by_bisection, without_contaminated
from prosemill.llm.near_dedup import aligned, components, near_duplicates, without_near_duplicates
from prosemill.llm.toxicity import Automaton, lowered, toxicity, without_toxic
from prosemill.llm.warc import read_archives, warc, write_archives


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_aligned():
    rng = random.Random(1)
    left, right, want = [], [], []
    for _ in range(150):
        a = [rng.randrange(30) for _ in range(rng.randrange(100))]
        b = list(a)
        for _ in range(rng.randrange(max(1, len(a) // 3) + 1)):
            k = rng.random()
            if b and k < 0.4:
                b[rng.randrange(len(b))] = rng.randrange(30)
            elif b and k < 0.7:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        left.append(np.array(a, np.uint64))
        right.append(np.array(b, np.uint64))
        want.append(edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert aligned(left, right, 0.8).tolist() == want


def classes_of(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(300, 360)]
    want = classes_of(pairs, 361)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == want[x] for x in {x for a, b in pairs if a != b for x in (a, b)})


def test_near_duplicates(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    distinct = sorted({t for _, t in rows if t is not None}, key=lambda t: min(2**63 if i is None else i for i, x in rows if x == t))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in distinct]
    pairs = []
    for i in range(len(words)):
        for j in range(i):
            a, b = words[i], words[j]
            most = max(len(a), len(b))
            if most and abs(len(a) - len(b)) <= 0.2 * most and len(set(a) & set(b)) > 0.5 * len(set(a) | set(b)) and edit(a, b) <= int(0.2 * most + 1e-9):
                pairs.append((j, i))
    root = classes_of(pairs, len(distinct))
    first = {t: min((i for i, x in rows if x == t and i is not None), default=None) for t in distinct}
    want = {t: first[distinct[root[k]]] for k, t in enumerate(distinct)}
    found = near_duplicates(docs)
    joined = found.join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in joined:
        assert r["class_id"] == (want[r["text"]] if r["text"] is not None else r["doc_id"]), r["text"][:60]
    assert found.count() == len(rows)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.where("text is not null").count() == len({want[t] for t in distinct})
    assert kept.where("text is null").count() == sum(t is None for _, t in rows)
    assert near_duplicates(empty).count() == 0 and without_near_duplicates(empty).count() == 0


def test_near_duplicates_behind_unrelated_texts(spark):
    """Near copies in buckets that unrelated texts lead, and chains of which only neighbours match."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"

    def changed(words, share):
        out = list(words)
        for at in rng.sample(range(len(out)), int(share * len(out))):
            out[at] = word()
        return out

    passage = [word() for _ in range(70)]
    texts = [passage + [word() for _ in range(60)] for _ in range(60)]
    copies = [changed(t, 0.03) for t in texts[30:]]
    chain = [[word() for _ in range(150)]]
    for _ in range(6):
        chain.append(changed(chain[-1], 0.05))
    everything = texts + copies + chain
    rng.shuffle(everything)
    pairs = [(j, i) for i, a in enumerate(everything) for j, b in enumerate(everything[:i]) if len(set(a) & set(b)) > 0.6 * len(set(a)) and edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    want = classes_of(pairs, len(everything))
    assert len(set(want)) == 61
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(everything)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(table).collect()} == dict(enumerate(want))


def test_near_duplicates_that_share_no_sketch(spark):
    """Substitutions spread evenly leave no 5-word string in common, so nothing but the exact way meets these pairs."""
    rng = random.Random(23)
    texts = []
    for n in (5, 6, 9, 10, 14, 15, 19, 20, 24, 30, 60, 150, 400):
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        allowed = int(0.2 * n + 1e-9)
        for more in (0, 1):  # a link, and one edit too many
            spread = set(np.linspace(2, n - 1, allowed + more).astype(int)) if n < 20 else set(range(4, n, 5)[: allowed + more]) | (set(range(1, 1 + more)))
            texts.append(words)
            texts.append([f"x{rng.randrange(10**6)}" if k in spread else w for k, w in enumerate(words)])
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        shorter = list(words)
        for at in sorted(rng.sample(range(n), allowed), reverse=True):
            del shorter[at]
        texts += [words, shorter]
    texts += [["same"] * 40, ["same"] * 33, ["same"] * 32, ["same"] * 20, ["same"] * 3, ["same"] * 2]
    want = classes_of([(j, i) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)], len(texts))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")  # rows repeat
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(table).collect()} == dict(enumerate(want))
    assert without_near_duplicates(table).count() == len(set(want))


def test_filters_of_strings_reach_the_driver_compressed(spark, monkeypatch):
    """At the size of large tables, a filter is sent as what it holds, and freed once its table is written; the pairs are those of a small one."""
    rng = random.Random(25)
    texts = [[f"v{rng.randrange(10**6)}" for _ in range(40)] for _ in range(60)]
    texts += [[*t[:20], "x", *t[21:]] for t in texts[:30]]
    rows = [(i, " ".join(t), (i, i), (i, i)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, node struct<doc_id: long, nth: long>, root struct<doc_id: long, nth: long>").withColumn("row_key", F.xxhash64("doc_id"))
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append((len(pickle.dumps(value)), got := broadcast(self, value))) or got)
    for words in (1 << 12, 1 << 26):
        sent.clear()
        found = exact_pairs.remaining_pairs(table.select("node", "root", "row_key"), table.select("row_key", "text"), 0.8, words)
        assert {(r["node"]["nth"], r["rep"]["nth"]) for r in found.collect()} >= {(60 + i, i) for i in range(30)}
        assert len(sent) >= 3 and sum(size for size, _ in sent) < 2**20
        assert sum(not os.path.exists(held._path) for _, held in sent) >= 3


def test_candidates_hold_every_link():
    """Pairs of random texts with many strings in common, some repeated inside of a text, against the edit distance."""
    rng = random.Random(24)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 70))] for _ in range(12)] + [["a"] * 30, ["a", "b"] * 15]
    texts = list(base)
    for _ in range(110):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, len(words) // 4 + 2)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind > 0)] = [f"w{rng.randrange(30)}"] if kind < 2 else []
            words = words or ["w"]
        texts.append(words)
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([" ".join(t) for t in texts])], ["row_key", "text"])

    class Everything:
        def test(self, hashes):
            return np.ones(len(hashes), bool)

    for similarity in (0.6, 0.8, 0.9):
        blocks = list(exact_pairs._all_grams(Everything(), similarity, 5)([batch]))
        bits = {r["part"]: r["held"] for b in blocks for row in b.to_pylist() for f in exact_pairs._repeated(5, 20)([pa.RecordBatch.from_pylist([row], b.schema)]) for r in f.to_pylist()}
        table = np.concatenate([np.frombuffer(bits.get(part, bytes(1 << 12)), np.uint8) for part in range(32)])
        shared = HashFilter(20, SimpleNamespace(value=table.tobytes()))
        live = pa.Table.from_batches(exact_pairs._live_texts(Everything(), shared, similarity)([batch]))
        for name in ("class", "id", "nth"):
            live = live.append_column(name, live.column("row_key"))
        parts = [row for b in exact_pairs._entries(similarity, 5)(live.combine_chunks().to_batches()) for row in b.to_pylist()]
        met = set()
        for row in parts:
            held = np.frombuffer(row["held"], exact_pairs.ENTRY)
            for a, b in exact_pairs.candidates(held, similarity):
                met |= {(max(x, y), min(x, y)) for x, y in zip(held["nth"][a].tolist(), held["nth"][b].tolist(), strict=True)}
        links = {(i, j) for i in range(n) for j in range(i) if edit(texts[i], texts[j]) <= int((1 - similarity) * max(len(texts[i]), len(texts[j])) + 1e-9)}
        assert len(links) > 50 and not links - met


def test_texts_that_share_a_passage_are_no_candidates(spark):
    """Long texts that share a passage and differ in most of their words were all met in pairs; links among them are still found."""
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(300)]
    own = lambda: [f"v{rng.randrange(2000)}" for _ in range(350)]
    texts = [[*own(), *passage, *own()] for _ in range(40)]
    texts += [["x" if k % 7 == 3 else w for k, w in enumerate(texts[i])] for i in range(5)]
    rows = [(i, " ".join(t), (i, i), (i, i)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, node struct<doc_id: long, nth: long>, root struct<doc_id: long, nth: long>").withColumn("row_key", F.xxhash64("doc_id"))
    found = exact_pairs.remaining_pairs(table.select("node", "root", "row_key"), table.select("row_key", "text"), 0.8, 1 << 12)
    assert sorted((r["rep"]["nth"], r["node"]["nth"]) for r in found.collect()) == [(i, 40 + i) for i in range(5)]


def test_counts_of_words_keep_every_link(monkeypatch):
    """The bound by counts, whose cells are few and whose unpacked rows are dropped now and then, against the edit distance."""
    rng = random.Random(32)
    base = [[f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(rng.randrange(1, 90))] for _ in range(10)] + [["a"] * 600, ["a"] * 480]
    texts = list(base)
    for _ in range(60):
        words = list(rng.choice(base[:10]))
        for _ in range(rng.randrange(0, len(words) // 4 + 2)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind > 0)] = [f"w{rng.randrange(500)}"] if kind < 2 else []
            words = words or ["w"]
        texts.append(words)
    n, similarity = len(texts), 0.8
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([" ".join(t) for t in texts])], ["row_key", "text"])
    everything = SimpleNamespace(test=lambda hashes: np.ones(len(hashes), bool))
    links = {(i, j) for i in range(n) for j in range(i) if edit(texts[i], texts[j]) <= int((1 - similarity) * max(len(texts[i]), len(texts[j])) + 1e-9)}
    for cells, kept in ((4096, 1 << 13), (256, 2 * n), (256, 10)):
        monkeypatch.setattr(exact_pairs, "COUNTERS", cells)
        monkeypatch.setattr(exact_pairs, "KEPT", kept)
        live = pa.Table.from_batches(exact_pairs._live_texts(everything, everything, similarity)([batch]))
        for name in ("class", "id", "nth"):
            live = live.append_column(name, live.column("row_key"))
        entries = exact_pairs._entries(similarity, 5)(live.combine_chunks().to_batches())
        found = [r for b in exact_pairs._candidates(similarity)(entries) for r in b.to_pylist()]
        met = {(max(r["nth_a"], r["nth_b"]), min(r["nth_a"], r["nth_b"])) for r in found}
        assert len(links) > 50 and not links - met
        for i, j in met:  # none is far beyond the bound of their words
            a, b = Counter(texts[i]), Counter(texts[j])
            assert cells < 4096 or ((a - b) + (b - a)).total() <= 2 * int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9) - abs(len(texts[i]) - len(texts[j])) + 2 or max(a.values()) > 255


def test_strings_are_sent_in_few_bytes():
    """Strings of texts go out in less than four bytes each, and with their places in less than eight; what is sent can be read back."""
    rng = random.Random(33)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(200)) for _ in range(100)] + [" ".join(["long"] * 1500 + ["far"] * 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["row_key", "text"])
    everything = SimpleNamespace(test=lambda hashes: np.ones(len(hashes), bool))
    words = exact_pairs.Words(*exact_pairs.text_buffers(batch.column(1)))
    hashes, doc, place, size, _ = exact_pairs.grams(words, 0.8)
    block = next(exact_pairs._all_grams(everything, 0.8, 5)(iter([batch])))
    assert block.column(1).nbytes < 3.5 * len(hashes)
    part = block.column(0)[3].as_py()
    assert exact_pairs._from_gaps(block.column(1)[3].as_py()).tolist() == sorted(exact_pairs._short(hashes[hashes >> np.uint64(59) == part], 5).tolist())
    some = SimpleNamespace(test=lambda hashes: np.isin(np.arange(len(hashes)), [0, 5, 196, *range(197, len(hashes) - 1100), len(hashes) - 2]))
    for shared in (everything, some):
        live = next(exact_pairs._live_texts(everything, shared, 0.8)(iter([batch])))
        n, got, of, at, width = exact_pairs._unpacked(live)
        keys = np.array(live.column(0).to_pylist())
        kept = shared.test(hashes) & np.isin(doc, keys)
        assert (keys[of] == doc[kept]).all() and (at == place[kept]).all() and (width == size[kept]).all() and (n == words.count[keys]).all()
        assert (got >> np.uint64(16) == hashes[kept] >> np.uint64(16)).all()
        assert sum(live.column(k).nbytes for k in (2, 3, 4)) < 9 * len(got)
    for row, k in zip(exact_pairs.word_counts(words, np.arange(len(texts))), range(len(texts)), strict=True):
        cells = words.hashes()[words.doc == k] & np.uint64(exact_pairs.COUNTERS - 1)
        assert exact_pairs._dense(row).tolist() == np.minimum(np.bincount(cells.astype(np.int64), minlength=exact_pairs.COUNTERS), 255).tolist()


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(22)
    long = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    near = list(long)
    del near[100:900]
    table = spark.createDataFrame([(3, " ".join(long)), (5, " ".join(near)), (7, " ".join(long[20_000:])), (9, "w1 w2")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(table).collect()} == {3: 3, 5: 3, 7: 7, 9: 9}


def test_automaton():
    terms = [("scum", False), ("disgusting", False), ("worthless", False), ("vequ", True)]
    automaton = Automaton(terms)
    vocabulary = ["scum", "scam", "disgusting", "disgustng", "disgussting", "dizgusting", "dizguzting", "worthles", "worthless", "vortless", "vequ", "vequx", "vexu", "disgust", "w0rthle55", ""]
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in vocabulary]) - 1
    starts = np.append(0, ends[:-1] + 1)
    some = np.flatnonzero(ends > starts)
    hit, term, near = automaton.run(lowered(data), starts[some], ends[some])
    got = {vocabulary[some[h]]: (terms[t][0], bool(n)) for h, t, n in zip(hit, term, near, strict=True)}
    want = {}
    for w in vocabulary:
        for t, prefix in terms:
            low = w.replace("0", "o").replace("5", "s")
            if prefix and low.startswith(t):
                want[w] = (t, False)
            elif not prefix and (d := edit(low, t)) <= (1 if len(t) >= 6 else 0):
                want[w] = (t, d > 0)
    assert got == want


def test_features_and_scores_against_plain_python():
    """Hits by edit distance word by word, quoted and aimed by their windows, and the sums of a document."""
    from prosemill.llm import toxicity as module

    terms = [("scum", False), ("moron", False), ("worthless", False), ("vequ", True)]
    weights = np.array([1.0, 0.7, 1.3, 0.9])
    automaton = Automaton(terms, ["scam", "morons"])
    rng = random.Random(31)
    words = ["scum", "scm", "scam", "Moron", "m0ron", "moran", "morons", "worthles", "vequx", "vexu", "the", "house", "you", "are", "said", "wrote", "tree", "blue", '"scum"', "«moron»", "scum,", "été"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(120)] + ["", "scum", "you scum", 'he said "moron" twice']
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got, hits = module.features(automaton, weights, data, offs)

    def term_of(word):
        if word in ("scam", "morons"):
            return None
        for k, (t, prefix) in enumerate(terms):
            if word == t or (prefix and word.startswith(t)):
                return k, 1.0
        for k, (t, prefix) in enumerate(terms):
            if not prefix and edit(word, t) == 1:
                return k, module.NEAR
        return None

    for n, text in enumerate(texts):
        runs = [(m[0], m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9é]+", text)]
        low = [w.lower().translate(str.maketrans("013457", "oieast")) for w, _, _ in runs]
        abuse = count = quoted_sum = found = 0.0
        for k, word in enumerate(low):
            if (hit := term_of(word)) is None:
                continue
            about = low[max(0, k - module.WINDOW) : k] + low[k + 1 : k + 1 + module.WINDOW]
            a, b = runs[k][1], runs[k][2]
            marks = a > 0 and text[a - 1] in '"«' and b < len(text) and text[b] in '"»'
            quoted = marks or any(w in module.SAYING for w in about)
            aimed = any(w in module.ADDRESS for w in about) and not quoted
            abuse += weights[hit[0]] * hit[1] * (0.3 if quoted else 1.0) * (1.25 if aimed else 1.0)
            count, quoted_sum, found = count + hit[1], quoted_sum + hit[1] * quoted, found + 1
        want = np.log1p([abuse, 100 * abuse / max(len(runs), 1), count, quoted_sum])
        assert hits[n] == found and np.allclose(got[n], want), (text, got[n], want)
    beta = np.array([-2.0, 1.5, 0.2, 0.4, -0.3])
    assert np.allclose(module.scores(got, beta), 1 / (1 + np.exp(-(beta[0] + got @ beta[1:]))))


def toxic_rows(n=900):
    rng = random.Random(11)
    plain = ["the house", "a river", "blue sky", "we walked", "old trees", "of stone", "and then", "morning light", "quiet road", "they spoke"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), "you " + rng.choice(["idiot", "disgusting moron", "zorgle" + rng.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = toxic_rows()
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity(table, marks).join(marks, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    assert without_toxic(table, marks).count() == sum(r["predicted"] == 0 for r in out)
    odd = toxicity(docs, marks)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity(docs, marks.where("false")).count() == docs.count()
    assert toxicity(empty, marks).count() == 0
    assert without_toxic(docs, marks).columns == docs.columns


def test_toxicity_of_misspelled_abuse(spark):
    rows, labels = toxic_rows()
    spelled = {"you ": "", "idiot": "clwn losr", "disgusting moron": "wrthless mron", "zorgle": "pthetic "}  # of the general list, their beginnings misspelled too
    for i, text in rows[::6]:
        for right, wrong in spelled.items():
            text = text.replace(right, wrong)
        rows.append((10_000 + i, text))
    held = {r[0] for r in rows if r[0] >= 10_000}
    innocent = [(20_000 + i, f"{text} the idiom of a crown toward a ditch break witch crash") for i, text in rows[1:60:6]]
    table = spark.createDataFrame(rows + innocent, "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(out[i]["n_hits"] >= 2 for i in held)
    assert sum(out[i]["predicted"] for i in held) / len(held) > 0.95
    assert not any(out[i]["predicted"] or out[i]["n_hits"] for i, _ in innocent)


def test_tile_marks_the_longest_first():
    # a word twice in the item: its place is used once
    tiles = tile(np.array([0, 1, 2, 10, 11, 12, 13]), np.array([50, 51, 52, 10, 11, 12, 13]), 3)
    assert sorted(t[2] for t in tiles) == [5, 6]


def tiled(item, doc, width):
    """Greedy string tiling word by word: the longest common run of free places, the first in the item and then in the document."""
    here, there, tiles = set(), set(), []
    while True:
        best = (width - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in here and j + n not in there:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < width:
            return tiles
        tiles.append((best[1], best[2], best[0]))
        here.update(range(best[1], best[1] + best[0]))
        there.update(range(best[2], best[2] + best[0]))


def test_tiles_against_plain_python():
    rng = random.Random(13)
    for k in range(60):
        letters = rng.choice([1, 2, 3, 6])
        item, doc = ([rng.randrange(letters) for _ in range(rng.randrange(40))] for _ in range(2))
        width = rng.choice([2, 3, 4])
        want = tiled(item, doc, width)
        seeds = [(i, j) for i in range(len(item) - width + 1) for j in range(len(doc) - width + 1) if item[i : i + width] == doc[j : j + width]]
        a, b = (np.array([x + 7 for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for t in (item, doc))
        assert tile_by_bisection(a, b, width) == want
        if seeds:
            assert tile(*(np.array(x) for x in zip(*seeds, strict=True)), width) == want


@pytest.mark.parametrize("pairs", [2_000_000, 300, 20])
def test_decontamination_against_plain_python(spark, monkeypatch, pairs):
    from prosemill.llm import decontamination as module

    monkeypatch.setattr(module, "PAIRS", pairs)
    rng = random.Random(14)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3))
    items = [[word() for _ in range(rng.randrange(6, 40))] for _ in range(12)] + [["x"] * 30, ["a", "b", "c"], ["q1"], [], ["a", "b", "c"]]
    docs = []
    for _ in range(25):
        parts = [word() for _ in range(rng.randrange(20))]
        for _ in range(rng.randrange(4)):
            item = rng.choice(items[:12])
            cut = rng.randrange(len(item))
            parts += rng.choice([item, item[cut:] + ["zz"] + item[:cut], item[: len(item) // 2]])
        docs.append(parts)
    docs += [["x"] * 200, ["x"] * 20, "so a b c d a b c".split(), ["q1"], [], [word() for _ in range(20)] + ["x"] * 40 + items[0] * 5]
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            if 0 < len(item) < 6:
                if any(doc[k : k + len(item)] == item for k in range(len(doc))):
                    want.add((d, i, len(item), 1))
            elif item:
                tiles = tiled(item, doc, 6)
                if sum(t[2] for t in tiles) >= 0.5 * len(item):
                    want.add((d, i, sum(t[2] for t in tiles), len(tiles)))
    table = spark.createDataFrame([(d, ", ".join(doc).upper()) for d, doc in enumerate(docs)] + [(99, None)], "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["covered_tokens"], r["n_tiles"]) for r in module.decontamination(table, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_decontamination_of_a_repetitive_text(spark):
    """A word 60,000 times in a document and 3,000 times in an item: the seed pairs would be 180 million."""
    table = spark.createDataFrame([(1, "spam " * 60_000), (2, "spam " * 1_400)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "spam " * 3_000)], "item_id long, text string")
    got = decontamination(table, bench).collect()
    assert [(r["doc_id"], r["covered_tokens"], r["n_tiles"]) for r in got] == [(1, 3_000, 1)]


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    item = [f"t{rng.randrange(10**6)}" for _ in range(60)]
    noise = [f"n{rng.randrange(10**6)}" for _ in range(400)]
    moved = item[30:] + ["xx"] + item[:30]
    rows = [(1, " ".join(noise[:50] + item + noise[50:])), (2, " ".join(moved)), (3, " ".join(noise + item[:20])), (4, " ".join(noise)), (5, " ".join(x.upper() + "," for x in item)), (6, None), (7, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (12, "n1x n2x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination(table, bench).collect()}
    assert set(got) == {(1, 9), (2, 9), (5, 9)}
    assert got[(1, 9)]["coverage"] == 1.0 and got[(2, 9)]["n_tiles"] == 2
    assert {r["doc_id"] for r in without_contaminated(table, bench).collect()} == {3, 4, 6, 7}
    assert decontamination(docs, bench).count() == 0 and decontamination(empty, bench).count() == 0
    assert decontamination(table, bench.where("false")).count() == 0
    assert without_contaminated(docs, bench).columns == docs.columns


def test_decontamination_in_blocks(spark, monkeypatch):
    from prosemill.llm import decontamination as module

    rng = random.Random(6)
    items = [(k, " ".join(f"t{rng.randrange(10**6)}" for _ in range(30))) for k in range(40)]
    table = spark.createDataFrame([(k, "before " + t + " after") for k, t in items], "doc_id long, text string")
    monkeypatch.setattr(module, "BLOCK_BYTES", 2_000)
    got = {(r["doc_id"], r["item_id"]) for r in module.decontamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(40)}


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a.b/1", body), (0, "http://a.b/0", body), (2, "http://a.b/2", "short"), (3, "http://a.b/3", "short"), (4, "http://a.b/\r\n4", None), (5, None, body + "\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (6, "http://é/😀", "é" * 60), (7, "u", "é" * 60), (None, "n", body)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    out = {r["page_id"]: r for r in warc(pages, str(tmp_path / "one")).collect()}
    assert len(out) == len(rows)
    import hashlib

    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert (out[page_id]["payload_bytes"], out[page_id]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in out.items()} == {0: ("response", None), 1: ("revisit", 0), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 6), None: ("revisit", 0)}
    full = read_archives(spark, str(tmp_path / "one"), with_payload=True).where("main.type = 'response'").collect()
    payloads = {r["metadata"]["page_id"]: bytes(r["main"]["payload"]) for r in full}
    assert payloads[0].decode() == body and payloads[5].decode() == rows[5][2]
    assert all(r["request"]["uri"] == r["main"]["uri"] for r in full)
    by_page = {r["metadata"]["page_id"]: r["main"] for r in read_archives(spark, str(tmp_path / "one")).collect()}
    assert by_page[1]["refers_to"] == by_page[None]["refers_to"] == by_page[0]["record_id"] and by_page[7]["refers_to"] == by_page[6]["record_id"]
    write_archives(pages.where("false"), str(tmp_path / "two"))
    assert warc(pages.where("false"), str(tmp_path / "three")).count() == 0


def test_warc_archives_are_bounded_and_plain(spark, tmp_path, monkeypatch):
    """Archives of bounded size that any gzip reader takes, with a payload above 16 MB, repeated page ids and a hot payload."""
    import gzip
    import hashlib
    import subprocess

    from prosemill.llm import warc as module

    rng = np.random.default_rng(1)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    rows = [(i, f"http://x/{i}", noise(3_000 + 40 * i)) for i in range(60)] + [(100, "http://x/long", "z" * 17_000_000), (101, "u", "z" * 17_000_000)]
    rows += [(5, "http://x/5", rows[5][2]), (200, "http://x/200", rows[5][2])] + [(300 + i, "hot", rows[7][2]) for i in range(80)]
    path = str(tmp_path / "w")
    monkeypatch.setattr(module, "ARCHIVE_BYTES", 50_000)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = module.warc(pages, path).collect()
    files = sorted((tmp_path / "w").glob("*.txt"))
    assert len(files) >= 3 and all(subprocess.run(["gzip", "-tc"], stdin=f.open("rb")).returncode == 0 for f in files)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: response") == 62 and raw.count(b"WARC-Refers-To: ") == 81
    by_page = {}
    for r in out:
        by_page.setdefault(r["page_id"], []).append(r)
    for i, _, html in rows:
        for r in by_page[i]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html.encode()).hexdigest())
    assert [r["record_type"] for r in by_page[5]] == ["response"] * 2 and by_page[200][0]["refers_to"] == 5
    assert by_page[101][0]["refers_to"] == 100 and {by_page[300 + i][0]["refers_to"] for i in range(80)} == {7}
