"""Operator 3, quality rules: base counts and a hashed n-gram log-likelihood ratio.

A document's byte 4-grams are hashed into BUCKETS. Two multinomials over the buckets are compared: the trusted target
(rows that a curator marked as good, at most TRUSTED_ROWS of them in the order of a hash of their id) and the raw
corpus (every row). A document's score is its mean log ratio per n-gram, so its length cancels; it is kept if it doesn't
fail the base rules and its score is at least THRESHOLD. Both counts and scores cover whole texts. Tasks count in
arrays and send one row per bucket that they met; the driver gets BUCKETS rows.

Log ratios are rounded to multiples of 1 / UNIT, so a document's sum is a whole number and doesn't depend on what else is
read with it.

Nulls and empty texts have no words, so they fail the base rules; texts under four bytes score 0. Rows with equal ids or
texts are scored one by one, a score at the threshold is kept. Very long texts are scored whole. Without trusted rows all
scores are 0 and the base rules decide. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._bytes import IS_SPACE, Rolling, Words, cover, lines, mix, per_doc, pieces, rolling_bytes, with_doc
from prosemill.llm._spark import ship

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
GRAM = 4
TRUSTED_ROWS = 20_000
SMOOTHING = 0.5
PRIOR_GRAMS = 1000
THRESHOLD = -0.4
REPEAT_WINDOW = 5
UNIT = 1 << 24

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether it lies inside its document."""
    n = len(data)
    value = np.zeros(n, np.uint32)
    for k in range(GRAM):
        value[: max(n - k, 0)] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    bucket = (value * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        last = offs[1:] - k
        inside[last[last >= offs[:-1]]] = False
    return bucket, inside


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part, data, offs in pieces(batch, "text"):
            bucket, inside = grams(data, offs)
            total += np.bincount(bucket[inside], minlength=BUCKETS)
            trusted = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(offs))
            if trusted.any():
                good += np.bincount(bucket[inside & trusted], minlength=BUCKETS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met]), pa.array(good[met])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, in units of 1 / UNIT. docs: doc_id, text; trusted: at most TRUSTED_ROWS doc_ids."""
    marked = docs.join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")
    flagged = marked.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    rows = flagged.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    # the target's prior follows the raw corpus, so a bucket that a small target lacks isn't taken as evidence by itself
    prior = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    share = (target + PRIOR_GRAMS * prior) / (target.sum() + PRIOR_GRAMS)
    return np.rint(np.log(share / prior) * UNIT).astype(np.int64)


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offs)
    rolling = rolling_bytes(data)
    n = len(offs) - 1
    start, end, doc = lines(data, offs)
    text = np.append(0, np.cumsum(~IS_SPACE[data]))
    full = text[end] > text[start]
    start, end, doc = start[full], end[full], doc[full]
    _, first = np.unique(with_doc(rolling.hash(start, end), doc), return_index=True)
    again = np.ones(len(start), bool)
    again[first] = False
    at = words.windows(REPEAT_WINDOW)
    sequence = Rolling(mix(rolling.hash(words.start, words.end)))
    _, which, times = np.unique(with_doc(sequence.hash(at, at + REPEAT_WINDOW), words.doc[at]), return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    repeated = cover(len(words.start), at, at + REPEAT_WINDOW)
    return {
        "n_words": words.count,
        "word_chars": per_doc(~IS_SPACE[data] & ((data & 0xC0) != 0x80), offs),
        "n_symbols": per_doc(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(doc[again], minlength=n),
        "n_repeat_words": np.bincount(words.doc[repeated], minlength=n),
    }


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                out = base_counts(data, offs)
                bucket, inside = grams(data, offs)
                sums, n = per_doc(np.where(inside, ratio[bucket], 0), offs), per_doc(inside, offs)
                score = np.round(sums / (np.maximum(n, 1) * float(UNIT)), 9)
                failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
                arrays = [part.column(0), *(pa.array(x.astype(np.int64)) for x in out.values())]
                arrays += [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *out, "base_failed", "kept", "score"])

    return run


def quality(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base_failed, kept and score of every row. trusted: a table of doc_ids of the target, of which TRUSTED_ROWS count."""
    spark = ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    some = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS)
    shared = spark.sparkContext.broadcast(log_ratios(source, some).tobytes())
    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return source.mapInArrow(_score(shared, threshold), kinds)
