"""Operator 8, substring deduplication by difference-cover anchors.

A window is WINDOW consecutive words. Of every residue modulo PERIOD, only those of a difference cover are anchor places:
for any two shifts some place in the next PERIOD ones is a cover place under both. So if a window stands in two
documents, a run of ANCHOR = WINDOW - PERIOD + 1 words in it begins at a cover place of both, and its hash shows up twice.

1. Every document sends the hashes of its anchors (a fifth of its places or less); those that are met twice or more go
   into a filter of bounded size.
2. Anchors that pass are extended to the windows around them. Neighbouring windows travel together as a stretch: those
   whose first SPREAD places have the least hash at the same place, which equal windows agree on. The smallest document
   of equal stretches keeps its windows, the others lose all of them.
3. What is left are stretches that differ but have that place's words in common. The windows of the smallest document of
   each are sent one by one; the smallest document with an equal one decides.
4. The covered words are removed. Only texts that a second filter lets pass travel to meet their spans.

Counts are pre-aggregated per buffer and task; hot stretches are joined with their smallest document, a join whose large
side Spark splits. False positives of the filters only add windows that match nothing.

Nulls and empty texts have no words. Rows that repeat an id don't remove each other's words (no smaller id), and spans
are kept apart by the CRC-32 of the text. A null id is larger than all others. Texts under WINDOW words lose nothing. A text
of any length is one buffer of its own, so nothing is cut at its inside. An empty table gives an empty result; other columns
are left out. Beyond what a filter holds (filter_capacity) more windows are sent, up to all of them, and results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._bytes import Rolling, Words, cover, pieces, place_key, place_keys, signed
from prosemill.llm._spark import HashFilter, drop_staged, hash_filter, held, ship, staged

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo PERIOD: every shift is a difference of two of its members.
COVER = (1, 5, 11, 24, 25, 27)
SPREAD = 16
NO_ID = 2**63 - 1


def anchor_width(window: int = WINDOW) -> int:
    return window - PERIOD + 1


def _hash(sequence: Rolling, at: np.ndarray, width: int) -> np.ndarray:
    return sequence.hash(at, at + width)


def anchors(words: Words, width: int) -> np.ndarray:
    """Words at cover places of their document at which `width` words follow."""
    at = words.windows(width)
    is_cover = np.zeros(PERIOD, bool)
    is_cover[list(COVER)] = True
    return at[is_cover[(at - words.first[words.doc[at]]) % PERIOD]]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_sender(window: int):
    width = anchor_width(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in pieces(batch, "text"):
                words = Words(data, offs)
                found, times = np.unique(_hash(Rolling(words.hashes()), anchors(words, width), width), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(times.astype(np.int32))], ["hash", "n"])

    return run


class Stretches:
    """Runs (first, last) of window starts that pass the filter and share the place of the least hash."""

    def __init__(self, words: Words, shared: HashFilter, window: int):
        self.sequence = Rolling(words.hashes())
        width = anchor_width(window)
        at = anchors(words, width)
        at = at[shared.test(_hash(self.sequence, at, width))]
        # the windows around an anchor start up to PERIOD - 1 words before it
        near = cover(len(words.start), np.maximum(at - (PERIOD - 1), words.first[words.doc[at]]), at + 1)
        starts = words.windows(window)
        if not len(starts):
            self.first = self.last = self.place = np.zeros(0, np.int64)
            return
        three = np.arange(max(len(words.start) - 2, 0))
        draw = (_hash(self.sequence, three, 3) & np.uint64(0xFFFFFFFF00000000)) | three.astype(np.uint64)
        reach = 1
        while reach < SPREAD:
            draw[: len(draw) - reach] = np.minimum(draw[: len(draw) - reach], draw[reach:])
            reach *= 2
        place = (draw[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = words.doc[starts]
        lo = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
        hi = np.append(lo[1:], len(starts)) - 1
        sums = np.append(0, np.cumsum(near))
        some = sums[starts[hi] + 1] > sums[starts[lo]]
        self.first, self.last, self.place = starts[lo][some], starts[hi][some], place[lo][some]
        # the words that all windows of a stretch have in common with any that agree on its place
        self.common = _hash(self.sequence, self.place, window - SPREAD + 1)


RECORD = "common long, hash long, doc_id long, crc long, start int, more int"


def _records(part: pa.RecordBatch, words: Words, s: Stretches, common: np.ndarray, at: np.ndarray, end: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    doc = words.doc[at]
    ids, crcs = _ids(part.column(0))[doc], part.column(1).to_numpy(zero_copy_only=False)[doc]
    arrays = [signed(common), signed(s.sequence.hash(at, end)), ids, crcs, (at - words.first[doc]).astype(np.int32), more.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["common", "hash", "doc_id", "crc", "start", "more"])


def _stretch_sender(shared: HashFilter, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                words = Words(data, offs)
                s = Stretches(words, shared, window)
                if len(s.first):
                    yield _records(part, words, s, s.common, s.first, s.last + window, s.last - s.first)

    return run


def _window_sender(shared: HashFilter, places: HashFilter, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                words = Words(data, offs)
                s = Stretches(words, shared, window)
                if not len(s.first):
                    continue
                doc = words.doc[s.first]
                ids, crcs = _ids(part.column(0))[doc], part.column(1).to_numpy(zero_copy_only=False)[doc]
                some = np.flatnonzero(places.test(place_key(ids, crcs, s.first - words.first[doc])))
                n = s.last[some] - s.first[some] + 1
                which = np.repeat(some, n)
                at = s.first[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield _records(part, words, s, s.common[which], at, at + window, np.zeros(len(at), np.int64))

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, crc, codes, row_key), written: start * SPREAD + extent of runs of windows that a smaller document has. docs: doc_id, crc, text."""
    sent = docs.mapInArrow(_anchor_sender(window), "hash long, n int")
    shared, n_shared = held(sent.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    anchor_filter = hash_filter(shared, "hash", n_shared)
    shared.unpersist()
    key, place = ["common", "hash"], ["doc_id", "crc", "start"]
    rows, _ = held(docs.mapInArrow(_stretch_sender(anchor_filter, window), RECORD))
    # a written table of its own, so that Spark can split the other side of the join where one stretch is frequent; one that is held keeps its partitions, and nothing is split
    least = staged(rows.groupBy(*key).agg(F.min("doc_id").alias("least")), "least")
    stretches = staged(rows.join(least, key), "stretches")
    rows.unpersist()
    drop_staged(least)
    firsts = stretches.where("doc_id = least")
    contested = firsts.groupBy("common").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a < b").select("common")
    places = staged(firsts.join(contested, "common", "left_semi").select(*place).mapInArrow(place_keys, "place long").distinct(), "places")
    place_filter = hash_filter(places, "place", places.count())
    drop_staged(places)
    windows = docs.mapInArrow(_window_sender(anchor_filter, place_filter, window), RECORD)
    smallest = windows.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*key, "least")
    smallest = staged(smallest, "smallest")
    lost = windows.join(smallest, key).where("doc_id > least")
    code = (F.col("start").cast("long") * SPREAD + F.col("more")).alias("code")
    both = stretches.where("doc_id > least").select("doc_id", "crc", code).unionByName(lost.select("doc_id", "crc", code))
    codes = both.groupBy("doc_id", "crc").agg(F.collect_set("code").alias("codes"))
    out = staged(codes.withColumn("row_key", F.xxhash64("doc_id", "crc")), "spans")
    drop_staged(stretches, smallest)
    return out


def _remover(shared: HashFilter):
    """Documents that can't lose words are done; the others go on with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                some = shared.test(part.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
                words = Words(data, offs)
                kept = [None if go else digest for go, digest in zip(some, kept_digests(words, None), strict=True)]
                texts = part.column(part.schema.names.index("text")).take(pa.array(np.arange(part.num_rows), mask=~some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words.count.astype(np.int64)), pa.array(kept, pa.string()), texts], ["doc_id", "crc", "n_words", "kept_sha256", "text"])

    return run


def kept_digests(words: Words, removed: np.ndarray | None) -> list[str]:
    """SHA-256 of each document's kept words, joined by one space."""
    out = []
    raw = words.data
    keep = np.ones(len(words.start), bool) if removed is None else ~removed
    # a byte is kept if it is in a kept word, or is the first space before a kept word that isn't the document's first
    start, end = words.start[keep], words.end[keep]
    doc = words.doc[keep]
    size = end - start
    gap = np.append(False, doc[1:] == doc[:-1]).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    total = size + gap
    stop = np.cumsum(total)
    buffer = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    begin = stop - size
    # copy all words at once: positions in the output minus positions in the input are constant in a word
    where = np.repeat(begin - start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size))
    source = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    buffer[where] = raw[source]
    counts = np.bincount(doc, total, minlength=len(words.offs) - 1).astype(np.int64) if len(doc) else np.zeros(len(words.offs) - 1, np.int64)
    edge = np.append(0, np.cumsum(counts))
    view = memoryview(buffer.tobytes())
    for i in range(len(words.offs) - 1):
        out.append(hashlib.sha256(view[edge[i] : edge[i + 1]]).hexdigest())
    return out


def _finisher(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, data, offs in pieces(batch, "text"):
                get = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                words = Words(data, offs)
                lengths = np.diff(get["codes"].offsets.to_numpy())
                code = get["codes"].flatten().to_numpy(zero_copy_only=False)
                at = code // SPREAD + np.repeat(words.first[:-1], lengths)
                removed = cover(len(words.start), at, at + code % SPREAD + window)
                lost = np.bincount(words.doc[removed], minlength=part.num_rows)
                done = get["kept_sha256"].to_pylist()
                kept = [d or k for d, k in zip(done, kept_digests(words, removed), strict=True)]
                yield pa.RecordBatch.from_arrays([get["doc_id"], get["n_words"], pa.array(lost), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every row. window: 2 * PERIOD words at least are sensible, PERIOD at the very least."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), text.alias("text"))
    found = repeated_spans(source, window)
    span_filter = hash_filter(found, "row_key", found.count())
    known = F.coalesce("doc_id", F.lit(NO_ID))
    keyed = source.select("doc_id", "crc", F.xxhash64(known, "crc").alias("row_key"), "text")
    passed = keyed.mapInArrow(_remover(span_filter), "doc_id long, crc long, n_words long, kept_sha256 string, text string")
    met = passed.withColumn("known", known).join(found.select(F.col("doc_id").alias("known"), "crc", "codes"), ["known", "crc"], "left")
    final = met.select("doc_id", "n_words", "kept_sha256", "text", F.coalesce("codes", F.array().cast("array<long>")).alias("codes"))
    return final.mapInArrow(_finisher(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
