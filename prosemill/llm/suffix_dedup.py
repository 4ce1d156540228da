"""Operator 9, suffix-array deduplication: sorted suffixes that share LENGTH bytes or more.

Sorting every suffix of a corpus is not needed to find the repeated strings of LENGTH bytes: only suffixes that could
begin one are sorted.

1. Each start of a string of LENGTH bytes has an anchor, the place with the least hash of 8 bytes among its first SPREAD
   places, so equal strings have equal anchors. The hashes of the LENGTH - SPREAD + 1 bytes from each anchor are counted;
   those met twice or more go into a filter of bounded size.
2. Suffixes at the starts of one anchor make a stretch. Stretches that pass the filter are suffix records, with their
   leading 32 bytes as four tokens of eight and a hash of all their bytes. Spark's sampled splitters range-partition them by
   the leading tokens, and the hash where they are equal, into buckets of BUCKET_ROWS rows on average. A bucket is sorted by multikey quicksort, vectorised: the
   first token parts it into runs of equal ones, only runs of two or more are sorted by the next token, and so on to the
   hash. Equal neighbours are marked, also across the buckets' boundaries: the first and the last record of each bucket
   are compared with those of the others. A marked stretch is repeated as a whole, so one record serves up to SPREAD suffixes.
3. What is left are the edges of matches. A stretch goes on, cut into blocks of BLOCK suffixes, if other stretches have the
   bytes in common that all its suffixes share; of equal stretches one goes on. Blocks are sorted and compared in the same
   way, and at last the single suffixes of the blocks that are left.
4. Covered bytes are removed. Only texts that a second filter lets pass travel to meet their spans.

A record's place is part of the splitters' order, so a string that a third of the corpus repeats is dealt to many buckets.
Common bytes that many stretches share are looked up in a written table, a join that Spark can split. False positives of
the filters only add records that match nothing. Beyond what a filter holds (filter_capacity), anchors are met in a semi-join
and places travel to their documents as lists, so no level sends more than what goes on; results are the same either way.

Nulls and empty texts have no bytes. Rows that repeat an id and a text are copies of each other like any other equal
texts; spans are kept apart by id and CRC-32. Texts under LENGTH bytes lose nothing. A text of any length is one buffer of
its own, so nothing is cut at its inside. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._bytes import Rolling, cover, pieces, place_key, place_keys, rolling_bytes, signed, spans
from prosemill.llm._spark import HashFilter, drop_staged, filter_capacity, hash_filter, ship, staged

LENGTH = 400
SPREAD = 128
BLOCK = 32
GRAM = 8
TOKENS = 4
BUCKET_ROWS = 300_000
NO_ID = 2**63 - 1


def leading(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number; places near the end get zeros."""
    x = np.zeros(len(data) + GRAM, np.uint64)
    x[: len(data)] = data
    for shift, width in ((1, 8), (2, 16), (4, 32)):
        x = (x[:-shift] << np.uint64(width)) | x[shift:]
    return x[: len(data)]


class Stretches:
    """The stretches of starts (first, last) that share an anchor, and their documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int = LENGTH):
        self.data, self.offs, self.length = data, offs, length
        self.lead = leading(data)
        n = len(data)
        starts = np.maximum(np.diff(offs) - length + 1, 0)
        self.rolling: Rolling | None = None
        if not starts.sum():
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            return
        draw = self.lead * np.uint64(0x9E3779B97F4A7C15)
        draw ^= draw >> np.uint64(29)
        draw = ((draw * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        reach = 1
        while reach < SPREAD:
            draw[: n - reach] = np.minimum(draw[: n - reach], draw[reach:])
            reach *= 2
        doc = np.repeat(np.arange(len(starts)), starts)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + offs[doc]
        anchor = (draw[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at)) - 1
        self.first, self.last, self.anchor, self.doc = at[lo], at[hi], anchor[lo], doc[lo]
        self.rolling = rolling_bytes(data)

    def __len__(self) -> int:
        return len(self.first)

    def anchors(self) -> np.ndarray:
        width = self.length - SPREAD + 1
        return self.rolling.hash(self.anchor, self.anchor + width) if len(self) else np.zeros(0, np.uint64)


def _anchor_sender(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in pieces(batch, "text"):
                # two stretches may have one anchor only in different documents
                found, times = np.unique(Stretches(data, offs, length).anchors(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(times)], ["anchor", "n"])

    return run


KEYS = [f"token{k}" for k in range(TOKENS)] + ["rest"]
PLACE = ["doc_id", "crc", "start"]
COLUMNS = [*KEYS, "common", *PLACE, "more"]
RECORD = ", ".join(f"{c} {'int' if c in ('start', 'more') else 'long'}" for c in COLUMNS)


def _records(part: pa.RecordBatch, s: Stretches, at: np.ndarray, last: np.ndarray, common: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records of the suffixes from `at` to `last`, some thousands at a time."""
    ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    crcs = part.column(1).to_numpy(zero_copy_only=False)
    for lo in range(0, len(at), 20_000):
        few = slice(lo, lo + 20_000)
        # tokens are turned so that signed order is byte order
        tokens = [signed(s.lead[at[few] + GRAM * k] ^ np.uint64(1 << 63)) for k in range(TOKENS)]
        rest = s.rolling.hash(at[few], last[few] + s.length)
        arrays = [*tokens, signed(rest), signed(common[few]), ids[doc[few]], crcs[doc[few]], (at[few] - s.offs[doc[few]]).astype(np.int32), (last[few] - at[few]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], COLUMNS)


def _chosen(part: pa.RecordBatch, s: Stretches, at: np.ndarray, doc: np.ndarray, places: HashFilter | None, column: str) -> np.ndarray:
    """Which of the places go on: by the filter, or by the document's list where there is none."""
    if places is not None:
        ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return places.test(place_key(ids[doc], part.column(1).to_numpy(zero_copy_only=False)[doc], at - s.offs[doc]))
    lists = part.column(part.schema.names.index(column))
    owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    known = s.offs[owner] + lists.flatten().to_numpy(zero_copy_only=False)
    return np.isin(at, known)


def _stretch_sender(anchors: HashFilter, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                s = Stretches(data, offs, length)
                common = s.anchors()
                some = np.flatnonzero(anchors.test(common))
                yield from _records(part, s, s.first[some], s.last[some], common[some], s.doc[some])

    return run


def blocks(s: Stretches, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, stretch and common bytes' hash of the blocks that stretches are cut into, counted from the anchor."""
    anchor = s.anchor[some]
    low, high = (anchor - s.last[some]) // BLOCK, (anchor - s.first[some]) // BLOCK
    n = high - low + 1
    which = np.repeat(np.arange(len(some)), n)
    block = low[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near, far = anchor[which] - block * BLOCK, anchor[which] - block * BLOCK - (BLOCK - 1)
    stretch = some[which]
    common = s.rolling.hash(near, far + s.length) if len(near) else np.zeros(0, np.uint64)
    return np.maximum(s.first[stretch], far), np.minimum(s.last[stretch], near), stretch, common


def _block_sender(anchors: HashFilter, length: int, stretch_places: HashFilter | None, single: bool = False, block_places: HashFilter | None = None):
    """Blocks of the stretches that go on, or (single) the suffixes of the blocks that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                s = Stretches(data, offs, length)
                some = np.flatnonzero(anchors.test(s.anchors()))
                some = some[_chosen(part, s, s.first[some], s.doc[some], stretch_places, "stretch_starts")]
                first, last, stretch, common = blocks(s, some)
                if single:
                    go = np.flatnonzero(_chosen(part, s, first, s.doc[stretch], block_places, "block_starts"))
                    n = last[go] - first[go] + 1
                    which = np.repeat(go, n)
                    first = first[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    last, stretch, common = first, stretch[which], common[which]
                yield from _records(part, s, first, last, common, s.doc[stretch])

    return run


def multikey_sort(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the records by one key after the other, and where in it a record differs from the one before.

    Runs of equal records are sorted by the next key, all at once; those that are alone are done.
    """
    order = np.argsort(keys[0], kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = keys[0][order[1:]] != keys[0][order[:-1]]
    for key in keys[1:]:
        run = np.cumsum(head) - 1
        tied = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else run
        if not len(tied):
            break
        among = order[tied]
        order[tied] = among[np.lexsort((key[among], run[tied]))]
        value = key[order[tied]]
        head[tied[1:]] |= value[1:] != value[:-1]
    return order, head


def _sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket in order, with `repeated` for records that are equal to a neighbour, `leads` for the first of equal ones and `edge` for the first and last of all."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    order, head = multikey_sort([table.column(k).to_numpy() for k in KEYS])
    repeated = ~head
    repeated[:-1] |= ~head[1:]
    edge = np.zeros(len(order), bool)
    edge[[0, -1]] = True
    for lo in range(0, len(order), 20_000):
        few = slice(lo, lo + 20_000)
        rows = table.take(pa.array(order[few])).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x[few]) for x in (repeated, head, edge))], [*COLUMNS, "repeated", "leads", "edge"])


def compared(records: DataFrame, name: str) -> DataFrame:
    """The records with `repeated`, and `leads` for the first of equal ones in a bucket. Range partition, local sort, neighbours."""
    kept = staged(records, f"{name}-records")
    buckets = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // BUCKET_ROWS))
    ranged = kept.repartitionByRange(buckets, *KEYS, *PLACE)  # in the order of the sort, so equal records of two buckets stand at their boundary
    out = staged(ranged.mapInArrow(_sorter, RECORD + ", repeated boolean, leads boolean, edge boolean"), name)
    drop_staged(kept)
    # two records of each bucket at most
    across = out.where("edge").groupBy(*KEYS).count().where("count > 1").select(*KEYS, F.lit(True).alias("across"))
    marked = out.join(F.broadcast(across), KEYS, "left").withColumn("repeated", F.col("repeated") | F.coalesce("across", F.lit(False))).drop("across", "edge")
    marked._staged_path = out._staged_path
    return marked


def going_on(records: DataFrame, name: str) -> DataFrame:
    """The places to look at more closely, written: records that aren't repeated, if others have their common bytes, with those others."""
    candidates = records.where("not repeated or leads")
    shared = candidates.groupBy("common").agg(F.count("*").alias("n"), F.min("repeated").alias("all_repeated")).where("n > 1 and not all_repeated").select("common")
    shared = staged(shared, f"{name}-common")  # a table of its own, so that Spark can split frequent common bytes in the join
    out = staged(candidates.join(shared, "common", "left_semi").select(*PLACE), name)
    drop_staged(shared)
    return out


def narrowed(docs: DataFrame, places: DataFrame, column: str) -> tuple[DataFrame, HashFilter | None]:
    """The documents and a filter of the places; beyond what a filter holds, the documents that have places, with their list in `column`."""
    n = places.count()
    if n <= filter_capacity():
        return docs, hash_filter(places.mapInArrow(place_keys, "place long"), "place", n)
    lists = staged(places.groupBy(F.col("doc_id").alias("known"), "crc").agg(F.collect_set("start").alias(column)), column)
    known = docs.withColumn("known", F.coalesce("doc_id", F.lit(NO_ID)))
    return known.join(lists, ["known", "crc"]).select(*docs.columns, column), None


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, crc, codes, row_key), written: start * SPREAD + extent of stretches whose strings of `length` bytes are all repeated. docs: doc_id, crc, text."""
    sent = docs.mapInArrow(_anchor_sender(length), "anchor long, n long")
    shared = staged(sent.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    n_shared = shared.count()
    anchor_filter = hash_filter(shared, "anchor", n_shared)
    records = docs.mapInArrow(_stretch_sender(anchor_filter, length), RECORD)
    if n_shared > filter_capacity():  # the filter lets too much pass: meet the anchors themselves
        records = records.join(shared.withColumnRenamed("anchor", "common"), "common", "left_semi").select(*COLUMNS)
    stretches = compared(records, "stretches")
    drop_staged(shared)
    stretch_places = going_on(stretches, "stretch-places")
    some, stretch_filter = narrowed(docs, stretch_places, "stretch_starts")
    parts = compared(some.mapInArrow(_block_sender(anchor_filter, length, stretch_filter), RECORD), "blocks")
    block_places = going_on(parts, "block-places")
    some, block_filter = narrowed(some, block_places, "block_starts")
    suffixes = compared(some.mapInArrow(_block_sender(anchor_filter, length, stretch_filter, True, block_filter), RECORD), "suffixes")
    drop_staged(stretch_places, block_places)
    code = (F.col("start").cast("long") * SPREAD + F.col("more")).alias("code")
    marked = [x.where("repeated").select("doc_id", "crc", code) for x in (stretches, parts, suffixes)]
    codes = marked[0].unionByName(marked[1]).unionByName(marked[2]).groupBy("doc_id", "crc").agg(F.collect_set("code").alias("codes"))
    out = staged(codes.withColumn("row_key", F.xxhash64("doc_id", "crc")), "spans")
    drop_staged(stretches, parts, suffixes)
    return out


def _remover(shared: HashFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                some = shared.test(part.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
                view = memoryview(data)
                kept = [None if go else hashlib.sha256(view[offs[i] : offs[i + 1]]).hexdigest() for i, go in enumerate(some)]
                texts = part.column(part.schema.names.index("text")).take(pa.array(np.arange(part.num_rows), mask=~some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offs)), pa.array(kept, pa.string()), texts], ["doc_id", "crc", "n_bytes", "kept_sha256", "text"])

    return run


def _finisher(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, data, offs in pieces(batch, "text"):
                get = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                lengths = np.diff(get["codes"].offsets.to_numpy())
                code = get["codes"].flatten().to_numpy(zero_copy_only=False)
                at = code // SPREAD + np.repeat(offs[:-1], lengths)
                removed = cover(len(data), at, at + code % SPREAD + length)
                run_start, _ = spans(removed, offs)
                runs = np.bincount(np.searchsorted(offs, run_start, "right") - 1, minlength=part.num_rows)
                sums = np.append(0, np.cumsum(removed))
                lost = sums[offs[1:]] - sums[offs[:-1]]
                view = memoryview(data[~removed].tobytes())
                edge = offs - sums[offs]
                done = get["kept_sha256"].to_pylist()
                kept = [d or hashlib.sha256(view[edge[i] : edge[i + 1]]).hexdigest() for i, d in enumerate(done)]
                yield pa.RecordBatch.from_arrays([get["doc_id"], get["n_bytes"], pa.array(lost), pa.array(runs), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every row. length: 2 * SPREAD at least."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), text.alias("text"))
    found = repeated_spans(source, length)
    span_filter = hash_filter(found, "row_key", found.count())
    known = F.coalesce("doc_id", F.lit(NO_ID))
    keyed = source.select("doc_id", "crc", F.xxhash64(known, "crc").alias("row_key"), "text")
    passed = keyed.mapInArrow(_remover(span_filter), "doc_id long, crc long, n_bytes long, kept_sha256 string, text string")
    met = passed.withColumn("known", known).join(found.select(F.col("doc_id").alias("known"), "crc", "codes"), ["known", "crc"], "left")
    final = met.select("doc_id", "n_bytes", "kept_sha256", "text", F.coalesce("codes", F.array().cast("array<long>")).alias("codes"))
    return final.mapInArrow(_finisher(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
