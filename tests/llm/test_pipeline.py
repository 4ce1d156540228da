"""The whole pipeline against plain Python on a small table, and its edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tokenizers import Tokenizer

from prosemill.llm.packing import WINDOW, default_tokenizer
from test_exact import base_spans
from test_models import classes_of, edit, tiled

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def written(spark, folder, docs, labels, bench, extra=""):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def packed(pieces):
    """Number of sequences of best-fit decreasing."""
    import bisect

    free, n = [], 0
    for length in sorted(pieces, reverse=True):
        k = bisect.bisect_left(free, length)
        room = free.pop(k) if k < len(free) else WINDOW
        n += room == WINDOW
        if room > length:
            bisect.insort(free, room - length)
    return n


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(77)
    word = lambda: rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice("bcdfghklmnprstvw") + str(rng.randrange(100))
    prose = lambda n: [word() for _ in range(n)]
    abuse = ["you", "idiot", "worthless", "moron", "disgusting", "scum"]
    items = [prose(30) for _ in range(6)]
    texts = [prose(rng.randrange(30, 400)) for _ in range(260)]
    toxic = set(range(0, 260, 5))
    for i in toxic:
        for _ in range(3):
            at = rng.randrange(len(texts[i]))
            texts[i][at:at] = rng.sample(abuse, 4)
    texts += [list(texts[i]) for i in range(1, 30)]  # exact copies, toxic ones as well
    for i in range(31, 60):  # near copies
        near = list(texts[i])
        near[rng.randrange(len(near))] = word()
        texts.append(near)
    for k, i in enumerate(range(61, 73)):  # benchmark passages, some reordered, some too short
        item = items[k % 6]
        texts.append(texts[i][:40] + (item[15:] + item[:15] if k % 2 else item) + texts[i][40:60])
        texts.append(texts[i][:3] + item[:10] + prose(30))
    texts += [prose(20) + ["mail", "ann@example.org", "or", "call", "+1 (017) 555-7713,"] + prose(9) + ["card", "4111 1111 1111 1111", "at", "10.0.0.7"] for _ in range(8)]
    texts += [prose(5000), [], []]
    rows = [(i, " ".join(t), "en", f"s{i % 3}", len(" ".join(t)), "mine") for i, t in enumerate(texts)]
    rows += [(9001, None, "en", "s0", None, "mine"), rows[100], rows[100]]
    labels = [(i, 1, int(i in toxic)) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _found string").repartition(4)
    folder = written(spark, tmp_path, docs, labels, [(k, " ".join(t)) for k, t in enumerate(items)])

    left = [(i, t) for i, t, *_ in rows if not any(w in abuse[1:] for w in (t or "").split())]
    some = sorted({t: i for i, t in reversed(left) if t is not None}.items(), key=lambda x: x[1])
    words = [t.split() for t, _ in some]
    pairs = [(j, i) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(set(a) & set(b)) > 0.5 * len(set(a)) and edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    root = classes_of(pairs, len(some))
    left = [(some[k][1], some[k][0]) for k in sorted(set(root))] + [(i, t) for i, t in left if t is None]

    def leaks(text):
        doc = text.split()
        return any(sum(t[2] for t in tiled(item, doc, 6)) >= 15 for item in items if len(set(item) & set(doc)) >= 15)

    left = [(i, t) for i, t in left if not (t and leaks(t))]

    def redact(text):
        at, out = 0, ""
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text))):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        return out + text[at:]

    library = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for i, t in left:
        ids = library.encode(redact(t or ""), add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), WINDOW):
            piece = ids[at : at + WINDOW]
            want[(i, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(places) == list(range(packed([r["length"] for r in out])))
    for spans in places.values():
        assert all(a + n == (sorted(spans) + [(sum(x[1] for x in spans), 0)])[k + 1][0] for k, (a, n) in enumerate(sorted(spans)))


def test_stages_keep_the_columns(spark, tmp_path):
    """Names that the operators use themselves, nulls in every column, repeated and empty rows, and an empty table."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, _digest string, _key string, _first string, _found string, _blocks string, _spans string, node string, root string, toxic int, item_id long"
    row = lambda i, t: (i, t, *["x"] * 2, 3, 0.5, *["y"] * 7, "n", "r", 1, 2)
    rows = [row(1, "plain words of a text"), row(1, "plain words of a text"), row(2, ""), row(3, None), row(None, "no id but words"), (None,) * 17, row(4, "mail a@b.cd now"), row(5, "x" * 300_000)]
    for rows_, folder in ((rows, tmp_path / "a"), ([], tmp_path / "b")):
        docs = spark.createDataFrame(rows_, names)
        at = written(spark, folder, docs, [], [])
        now = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, at)
            assert now.dtypes == docs.dtypes, name
        kept = sorted((str(r["doc_id"]), str(r["text"])[:20]) for r in now.collect())
        assert kept == (sorted([("1", "plain words of a tex"), ("2", ""), ("3", "None"), ("None", "None"), ("None", "no id but words"), ("4", "mail [EMAIL] now"), ("5", "x" * 20)]) if rows_ else [])
        # the last stage alone for the rows, the whole run for the empty table
        out = (corpus_pipeline.STAGES[-1][1](spark, now, at) if rows_ else corpus_pipeline.run(spark, at)).collect()
        assert sum(r["start"] == 0 for r in out) == len(kept)


def test_near_copies_that_share_no_sketch(spark):
    """A changed word in every five leaves no string of five in common; a stage keeps one document of the two all the same."""
    words = [f"v{k}" for k in range(100)]
    near = [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(words)]
    far = [f"y{k}" if k % 5 == 4 or k == 1 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(4, " ".join(near)), (2, " ".join(words)), (9, " ".join(far)), (5, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [2, 5, 9]
