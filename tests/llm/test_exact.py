"""Operators with an exact definition, against plain Python on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tokenizers import Tokenizer

from prosemill.llm.packing import WINDOW, Encoder, default_tokenizer, pack, plan
from prosemill.llm.pii import mod97, pii, redacted
from prosemill.llm.quality import quality
from prosemill.llm.sharding import grown, shard, tree
from prosemill.llm.substring_dedup import COVER, PERIOD, substring_dedup
from prosemill.llm.suffix_dedup import multikey_sort, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("window", [50, 40])
def test_substring_dedup(docs, empty, window):
    rows = rows_of(docs)
    words = [re.findall(WORD, t or "") for _, t in rows]
    key = [i if i is not None else 2**63 - 1 for i, _ in rows]
    least = {}
    for k, w in zip(key, words, strict=True):
        for at in range(len(w) - window + 1):
            seq = tuple(w[at : at + window])
            least[seq] = min(k, least.get(seq, k))
    want = Counter()
    for k, (i, _), w in zip(key, rows, words, strict=True):
        gone = set()
        for at in range(len(w) - window + 1):
            if least[tuple(w[at : at + window])] < k:
                gone.update(range(at, at + window))
        want[(i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone)))] += 1
    got = Counter(tuple(r) for r in substring_dedup(docs, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert sum(n for _, _, n, _ in got) > 1000
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("filter_bits", [28, 15])
def test_substring_dedup_of_long_texts(spark, monkeypatch, filter_bits):
    """Texts above the size of a buffer, a hot passage, repeated words, and filters that are full."""
    import random

    from prosemill.llm import _spark

    monkeypatch.setattr(_spark, "MAX_FILTER_BITS", filter_bits)
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(30_000)}"
    long, passage = [word() for _ in range(50_000)], [word() for _ in range(70)]
    texts = [long, [word()] * 3 + long[700:21_000] + [word()], ["same"] * 400, ["same"] * 60, long[49_960:] + ["x"] * 9 + long[:50]]
    texts += [[word() for _ in range(rng.randrange(30))] + passage + [word() for _ in range(rng.randrange(30))] for _ in range(50)]
    least = {}
    for i, w in enumerate(texts):
        for at in range(len(w) - 49):
            least.setdefault(tuple(w[at : at + 50]), i)
    want = {}
    for i, w in enumerate(texts):
        gone = set()
        for at in range(len(w) - 49):
            if least[tuple(w[at : at + 50])] < i:
                gone.update(range(at, at + 50))
        want[i] = (len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone)))
    table = spark.createDataFrame([(i, "  ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(table).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == want


def test_substring_dedup_holds_what_it_need_not_write(docs, monkeypatch):
    """For each file an executor forks a process that counts its memory twice, so anchors and rows are no files, and no block of them stays."""
    from prosemill.llm import substring_dedup as module

    written, before = [], docs.sparkSession.sparkContext._jsc.getPersistentRDDs().size()
    staged = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: written.append(name) or staged(df, name))
    assert sum(r["n_removed"] for r in substring_dedup(docs).collect()) > 1000
    assert written == ["least", "stretches", "places", "smallest", "spans"]
    assert docs.sparkSession.sparkContext._jsc.getPersistentRDDs().size() == before


def test_multikey_sort():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 3000):
        keys = [rng.integers(-3, 3, n) for _ in range(5)]
        order, head = multikey_sort(keys)
        rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
        assert rows == sorted(zip(*(k.tolist() for k in keys), strict=True)) and sorted(order.tolist()) == list(range(n))
        assert head.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(n)]


@pytest.mark.parametrize("filter_bits", [28, 15])
def test_suffix_dedup_of_long_texts(spark, monkeypatch, filter_bits):
    """Texts above the size of a buffer, a hot text, buckets so small that equal records stand on both sides of boundaries, texts that begin alike, and more places than a filter holds."""
    import random

    from prosemill.llm import _spark
    from prosemill.llm import suffix_dedup as module

    rng = random.Random(12)
    monkeypatch.setattr(module, "BUCKET_ROWS", 40)
    monkeypatch.setattr(_spark, "MAX_FILTER_BITS", filter_bits)
    if filter_bits == 15:
        monkeypatch.setattr(module, "filter_capacity", lambda: 3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop \né") for _ in range(n))
    long, passage, hot = noise(260_000), noise(700), noise(900)
    texts = [long, noise(300) + long[1000:90_000] + noise(50), "ab" * 3000, "x" * 5000, noise(120_000) + passage + noise(120_000) + passage] + [noise(rng.randrange(50)) + hot for _ in range(60)] + [hot[:400], hot[1:401] + "q", hot[:399]]
    head, tails = noise(300), [noise(400) for _ in range(5)]
    texts += [head + rng.choice(tails)[: rng.randrange(90, 400)] + noise(rng.randrange(60)) for _ in range(150)]
    table = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    raw = [t.encode() for t in texts]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    want = {}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    assert {r["doc_id"] or 0: tuple(r)[1:] for r in module.suffix_dedup(table).collect()} == want


def test_suffix_dedup(docs, empty):
    rows = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    seen = Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))
    want = Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))] += 1
    got = Counter(tuple(r) for r in suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert suffix_dedup(empty).count() == 0


def test_quality_base(spark, docs, empty):
    want = Counter()
    for i, t in rows_of(docs):
        t = t or ""
        w = re.findall(WORD, t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed)] += 1
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    out = quality(docs, trusted)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == want
    assert not out.where("kept and base_failed").count()
    assert quality(docs, trusted.where("false")).where("not base_failed and not kept").count() == 0
    assert quality(empty, trusted).count() == 0


@pytest.mark.parametrize("length", range(6))
def test_quality_of_one_short_text(spark, length):
    docs = spark.createDataFrame([(1, "abcde"[:length])], "doc_id long, text string").coalesce(1)
    row = quality(docs, docs.select("doc_id")).first()
    assert (row["doc_id"], row["word_chars"], row["n_words"], row["kept"]) == (1, length, min(length, 1), False)


def test_quality_ratio(spark):
    clean = [(i, "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun until evening number " + str(i)) for i in range(60)]
    junk = [(100 + i, " ".join(f"x{i}q{k}%%%" for k in range(30))) for i in range(20)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    out = quality(docs, spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long"))
    assert out.where("doc_id < 100 and not kept").count() == 0
    assert out.where("doc_id >= 100 and kept").count() == 0


def test_quality_scores_against_plain_python(spark, docs):
    import math

    from prosemill.llm import quality as module

    rows = rows_of(docs)
    trusted = [r[0] for r in rows if r[0] is not None and r[0] % 3 == 0]
    grams = [[int.from_bytes(b[k : k + 4], "little") * 2654435761 % 2**32 >> 17 for k in range(len(b) - 3)] for b in ((t or "").encode() for _, t in rows)]
    raw, good = Counter(g for x in grams for g in x), Counter(g for (i, _), x in zip(rows, grams, strict=True) if i in trusted for g in x)
    total, target = sum(raw.values()) + module.SMOOTHING * module.BUCKETS, sum(good.values())
    prior = lambda g: (raw[g] + module.SMOOTHING) / total
    ratio = lambda g: math.log((good[g] + module.PRIOR_GRAMS * prior(g)) / (target + module.PRIOR_GRAMS) / prior(g))
    want = sorted((-1 if i is None else i, sum(map(ratio, x)) / max(len(x), 1)) for (i, _), x in zip(rows, grams, strict=True))
    out = quality(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in out)
    assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 1e-6
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= module.THRESHOLD) for r in out)
    # the scores are the same bit for bit however the rows are dealt
    again = quality(docs.repartition(1), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_packing(docs, empty):
    library = Tokenizer.from_file(default_tokenizer())
    library.encode_special_tokens = True
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows_of(docs)]
    out = pack(docs, with_ids=True).collect()
    assert sum(r["length"] for r in out) == sum(map(len, ids))
    assert Counter(r["doc_tokens"] for r in out if r["start"] == 0) == Counter(map(len, ids))
    wanted = Counter(tuple(x) for x in ids)
    single = Counter(tuple(r["ids"]) for r in out if r["doc_tokens"] == r["length"])
    assert single == Counter({k: v for k, v in wanted.items() if len(k) <= WINDOW})
    places = {}
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= WINDOW
    assert pack(empty).count() == 0


def test_tokens_are_the_library_s(texts):
    encode = Encoder(default_tokenizer())
    library = Tokenizer.from_file(default_tokenizer())
    library.encode_special_tokens = True
    assert encode.fast is not None
    for t in texts:
        assert np.frombuffer(encode.encode(t or ""), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_packing_takes_the_ids_of_the_unchanged_library(spark, texts, tmp_path):
    from corpus_pipeline import packing
    from prosemill.llm.queries import op10_packing

    some = [*texts, "a <|endoftext|> b", "<|endoftext|>" * 3, "x" * 50 + "<|endoftext|>", "<|endoftext", "def f():\n    return '<|endoftext|>'\n"]
    table = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(default_tokenizer())
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in some]
    want = Counter((i, at, len(x), zlib.crc32(np.array(x[at : at + WINDOW], "<u4").tobytes())) for i, x in enumerate(ids) for at in range(0, len(x), WINDOW))
    for out in (op10_packing(spark, str(tmp_path)), packing(spark, table, str(tmp_path))):
        assert Counter((r["doc_id"], r["start"], r["doc_tokens"], r["ids_crc32"]) for r in out.collect()) == want


def test_plan_is_best_fit_decreasing():
    import bisect
    import random

    rng = random.Random(2)
    for window in (16, 100):
        counts = {n: rng.randrange(0, 9) for n in range(1, window + 1)}
        free, bins = [], 0
        for length in range(window, 0, -1):
            for _ in range(counts[length]):
                k = bisect.bisect_left(free, length)
                room = free.pop(k) if k < len(free) else window
                bins += room == window
                if room > length:
                    bisect.insort(free, room - length)
        runs = plan(counts, window)
        assert {f + k for _, _, n, f, _ in runs for k in range(n)} == set(range(bins))


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, empty):
    import random

    rng = random.Random(5)
    fuzz = ["".join(rng.choice("ab.@-_+1 4(5)%é\n😀0") for _ in range(rng.randrange(120))) for _ in range(600)]
    fuzz += ["a@b.c_d@e.f.g@h.i 1.2.3.4.5.6.7.8 0001.2.3.255 999.1.1.1 card 4111 1111 1111 1111 +1 (017) 555-7713", "a" * 50_000, "1" * 20_000, "+1" * 2_000, "IBAN DE89 3704 0044 0532 0130 00", None, ""]
    table = spark.createDataFrame(list(enumerate(fuzz, 1000)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    by_text = {}
    for r in pii(table).join(table, "doc_id").where("doc_id >= 1000").collect():
        by_text[r["text"]] = r
        spans = base_spans(r["text"] or "")
        assert r["base_sha256"] == sha(",".join(spans)), r["text"][:80]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in spans) for k in BASE]
        assert set(spans) <= set(r["spans"].split(","))
    assert "iban:5:32" in by_text["IBAN DE89 3704 0044 0532 0130 00"]["spans"]
    assert pii(empty).count() == 0


def test_pii_of_many_spans(spark):
    """The work on a text doesn't grow with the square of its spans."""
    import time

    text = " ".join(f"10.1.{i % 256}.{i % 250} a{i}@b.cd" for i in range(20_000))
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii(table.limit(1).withColumn("text", table["text"].substr(1, 2000))).collect()
    began = time.time()
    row = pii(table).first()
    assert time.time() - began < 20 and (row["n_ip"], row["n_email"]) == (20_000, 20_000)
    assert row["base_sha256"] == sha(",".join(base_spans(text)))
    assert redacted(table).first()["text"] == " ".join(["[IP] [EMAIL]"] * 20_000)


def test_redaction_against_plain_python(spark):
    import random

    rng = random.Random(8)
    parts = ["a@b.cd", "1.2.3.4", "+1 (017) 555-7713", "4111 1111 1111 1111", " plain é😀 words ", "\n", "password: abcdefghij0123456789", "x" * 1500]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii(table).collect()}
    for r in redacted(table).collect():
        text, at, want = texts[r["doc_id"]], 0, ""
        found = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[r["doc_id"]].split(",") if x))
        for a, b, kind in found:
            if a >= at:
                want += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r["text"] == want + text[at:]


def test_mod97(spark):
    rows = spark.createDataFrame([("DE89370400440532013000",), ("GB82WEST12345698765432",), ("DE89370400440532013001",)], "v string")
    assert [r[0] for r in rows.select(mod97(rows["v"])).collect()] == [True, True, False]


def test_redacted(spark):
    clash = spark.createDataFrame([(1, "write a@b.cd or +1 (017) 555-7713 now", "x", "y"), (2, None, "x", "y"), (3, "nothing", "x", "y")], "doc_id long, text string, _found string, _email string")
    out = {r["doc_id"]: r for r in redacted(clash).collect()}
    assert out[1]["text"] == "write [EMAIL] or [PHONE] now" and out[1]["_found"] == "x" and out[1]["_email"] == "y"
    assert out[2]["text"] is None and out[3]["text"] == "nothing"


def test_sharding(docs, empty):
    rows, out = rows_of(docs), shard(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in out}) == len({r["doc_id"] for r in out})
    assert shard(empty).count() == 0


def drawn(key, regions, weights):
    """The descent in plain Python: the child with the earliest clock, level by level."""
    import math
    import struct

    import xxhash

    def uniform(*parts):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        for x in parts:
            seed = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<i", x), seed=seed).intdigest()
        return ((seed >> 12) + 0.5) / (1 << 52)

    def weight(node):
        return weights.get(node, 1.0) if isinstance(node, int) else sum(map(weight, node))

    def take(level, path, children):
        return min((-math.log(uniform(level, *path, n)) / weight(c), n, c) for n, c in children if weight(c) > 0)[1:]

    r, racks = take("region", (), enumerate(regions))
    k, shards = take("rack", (r,), enumerate(racks))
    return take("shard", (r, k), [(x, x) for x in shards])[0]


@pytest.mark.parametrize("shards, weights", [(24, {}), (7, {}), (1, {}), (30, {3: 2.5, 7: 0.0, 12: 0.0, 13: 0.0, 14: 0.0, 15: 0.0})])
def test_sharding_descends(spark, shards, weights):
    keys = [*range(400), 2**63 - 1, -5, None]
    rows = spark.createDataFrame([(k, "x", "r", "k") for k in keys], "doc_id long, text string, _region string, _rack string")
    for r in shard(rows, shards, weights=weights).collect():
        assert r["shard"] == drawn(r["doc_id"], tree(shards), weights)
        assert r["grown_shard"] == drawn(r["doc_id"], grown(tree(shards), shards), weights) and r["grown_shard"] in (r["shard"], shards)
        assert weights.get(r["shard"], 1.0) > 0
    with pytest.raises(ValueError):
        shard(rows, 2, weights={0: 0.0, 1: 0.0})


def test_sharding_weights(spark):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "'' AS text")
    rack = lambda s: s // 4
    plain, heavy, even = ({r["doc_id"]: r["shard"] for r in shard(rows, 24, weights=w).collect()} for w in ({}, {3: 3.0}, {3: 1.5, 2: 0.5}))
    for k, before in plain.items():
        after = heavy[k]
        # rows move into the region, rack and shard that gained weight; what stays in another rack stays in its shard
        assert after == before or (after // 12, rack(after)) == (0, 0) and (before // 12 != 0 or rack(before) != 0 or after == 3) or before // 12 != after // 12 == 0
        if before // 12 == 1 and after // 12 == 1:
            assert after == before
        assert even[k] == before or rack(before) == rack(even[k]) == 0  # the rack's sum is as it was
    assert abs(sum(s == 3 for s in heavy.values()) / 40_000 - 3 / 26) < 0.01
    counts = Counter(plain.values())
    assert max(abs(counts[s] - 40_000 / 24) for s in range(24)) < 6 * (40_000 / 24) ** 0.5


def test_sharding_of_a_hot_row(spark):
    rows = spark.range(9_000).selectExpr("if(id % 3 = 0, -7, id) AS doc_id", "if(id % 3 = 0, repeat('é', 300000), '') AS text").repartition(6)
    out = shard(rows).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == (600_008 if r["doc_id"] == -7 else 8)
    assert len(out) == 9_000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
