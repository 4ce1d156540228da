"""Operator 6, benchmark decontamination: greedy string tiling.

Texts are compared as lower-case runs of letters and digits. Windows of MIN_TILE tokens (Karp-Rabin hashes) of the test
items are the seeds; a document's windows are looked up among them, seeds on one diagonal that follow each other make
maximal matches, and the longest match whose places are free in both texts is marked again and again, what a marked
place cuts off going back with its rest; of equally long ones the first in the item, then in the document. The tiles may
stand in any order, so reordered passages count. A document is contaminated by an item if its tiles cover COVERAGE of the
item's tokens or more. An item of fewer than MIN_TILE tokens is one tile: it matches documents that hold all its tokens in
a row.

A passage that repeats in a document and in an item makes seed pairs by the product. Where a document would have more than
PAIRS of them, they are counted first, item by item, and a pair of texts with more than PAIRS is tiled without seeds: the
longest free match is searched for by bisection over Karp-Rabin windows, which gives the same tiles in space linear in the texts.

The test set is sent to the tasks in blocks of at most BLOCK_BYTES, checked before each is gathered, with one pass over
the documents per block; documents are never shuffled.

Empty or null items match nothing, as do null or empty documents. Equal documents and equal items each get rows of their
own, as do rows that repeat an id. Very long documents are searched whole. Empty tables give an empty result; other columns
stay in `without_contaminated`, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._bytes import Rolling, letter_runs, lower_case, mix, pieces, rolling_bytes
from prosemill.llm._spark import ship

MIN_TILE = 6
COVERAGE = 0.5
BLOCK_BYTES = 16_000_000
PAIRS = 2_000_000
_BITS = 22


class Tokens:
    """The tokens of the documents of a buffer, and hashes of their windows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        start, end = letter_runs(data, offs)
        self.first = np.searchsorted(start, offs, "left")  # n + 1 entries
        self.hashes = rolling_bytes(lower_case(data)).hash(start, end)
        self.sequence = Rolling(self.hashes)
        self.last = np.repeat(self.first[1:], np.diff(self.first))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens at which a window starts, and the windows' hashes."""
        at = np.arange(len(self.hashes))
        at = at[at + width <= self.last]
        return at, self.sequence.hash(at, at + width)

    def of(self, doc: int) -> np.ndarray:
        return self.hashes[self.first[doc] : self.first[doc + 1]]


class Table:
    """Windows of one width of some test items, sorted by hash, with a bitmap before the search."""

    def __init__(self, tokens: Tokens, items: np.ndarray, width: int):
        at, hashes = tokens.windows(width)
        item = np.searchsorted(tokens.first, at, "right") - 1
        some = items[item] if len(at) else np.zeros(0, bool)
        at, hashes, item = at[some], hashes[some], item[some]
        order = np.argsort(hashes, kind="stable")
        self.width = width
        self.hashes, self.item, self.place = hashes[order], item[order], (at - tokens.first[item])[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self._slot(hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)

    def ranges(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the hashes that are in the table: their index, and where their seeds begin and how many they are."""
        some = np.flatnonzero(self.bitmap[self._slot(hashes)])
        lo, hi = np.searchsorted(self.hashes, hashes[some], "left"), np.searchsorted(self.hashes, hashes[some], "right")
        there = hi > lo
        return some[there], lo[there], (hi - lo)[there]


def expanded(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n places from lo: the range of each place, and the place."""
    which = np.repeat(np.arange(len(lo)), n)
    return which, lo[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Seeds:
    """A block of test items: the windows of those of `width` tokens or more, and the shorter ones whole."""

    def __init__(self, ids: list[int | None], texts: list[str], width: int = MIN_TILE):
        raw = [t.encode() for t in texts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        self.ids, self.width = ids, width
        self.items = Tokens(data, offs)
        self.tokens = np.diff(self.items.first)
        self.long = Table(self.items, self.tokens >= width, width)
        self.short = [Table(self.items, self.tokens == n, n) for n in range(1, width) if (self.tokens == n).any()]


def tile(places: np.ndarray, others: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed pairs (place in the item, place in the document): (place, other, length) of tiles."""
    diagonal = others - places
    order = np.lexsort((places, diagonal))
    places, diagonal = places[order], diagonal[order]
    breaks = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(places) != 1)) + 1
    starts, ends = np.append(0, breaks), np.append(breaks, len(places))
    heap = [(-int(e - s + width - 1), int(places[s]), int(places[s] + diagonal[s])) for s, e in zip(starts, ends, strict=True)]
    heapq.heapify(heap)
    here, there, tiles = set(), set(), []
    while heap:
        size, place, other = heapq.heappop(heap)
        size = -size
        free = [k for k in range(size) if place + k not in here and other + k not in there]
        if len(free) == size:
            tiles.append((place, other, size))
            here.update(range(place, place + size))
            there.update(range(other, other + size))
            continue
        for run in np.split(np.array(free, np.int64), np.flatnonzero(np.diff(free) != 1) + 1) if free else []:
            if len(run) >= width:
                heapq.heappush(heap, (-len(run), place + int(run[0]), other + int(run[0])))
    return tiles


def tile_by_bisection(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The tiles of `tile` from the token hashes of both texts: the longest match of free places, again and again."""
    hashes = [Rolling(item), Rolling(doc)]
    marked = [np.zeros(len(item), bool), np.zeros(len(doc), bool)]

    def match(size: int) -> tuple[int, int] | None:
        """The first place in the item, and the first in the document, of a free match of this size."""
        found = []
        for sequence, taken in zip(hashes, marked, strict=True):
            at = np.arange(len(taken) - size + 1) if len(taken) >= size else np.zeros(0, np.int64)
            sums = np.append(0, np.cumsum(taken))
            at = at[sums[at + size] == sums[at]]
            found.append((at, sequence.hash(at, at + size)))
        (here, mine), (there, others) = found
        common = np.flatnonzero(np.isin(mine, others))
        if not len(common):
            return None
        return int(here[common[0]]), int(there[np.flatnonzero(others == mine[common[0]])[0]])

    tiles, most = [], min(len(item), len(doc))
    while most >= width:
        # a match of a size has matches of all smaller sizes inside, so the largest size is found by bisection
        if (best := match(most)) is None:
            low, high = width - 1, most
            while high - low > 1:
                middle = (low + high) // 2
                if match(middle):
                    low = middle
                else:
                    high = middle
            most = low
            best = match(most) if most >= width else None
        if best is None:
            break
        tiles.append((*best, most))
        for taken, at in zip(marked, best, strict=True):
            taken[at : at + most] = True
    return tiles


def _most(seen: np.ndarray, width: int) -> int:
    """No tiles cover more of an item than the windows at these (sorted, distinct) places."""
    return int(np.minimum(np.diff(seen), width).sum()) + width


def contaminated(seeds: Seeds, data: np.ndarray, offs: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """(document, item, covered tokens, tiles) of the pairs in a buffer that reach the coverage."""
    tokens, out = Tokens(data, offs), []
    for table in seeds.short:
        at, hashes = tokens.windows(table.width)
        index, lo, n = table.ranges(hashes)
        doc = np.searchsorted(tokens.first, at[index], "right") - 1
        _, once = np.unique(np.stack([doc, lo], 1), axis=0, return_index=True)  # a text that repeats in a document counts once
        which, seed = expanded(lo[once], n[once])
        out += [(int(d), int(i), table.width, 1) for d, i in zip(doc[once[which]], table.item[seed], strict=True)]

    table, width = seeds.long, seeds.width
    at, hashes = tokens.windows(width)
    index, lo, n = table.ranges(hashes)
    doc = np.searchsorted(tokens.first, at[index], "right") - 1
    pairs_of = np.bincount(doc, n, minlength=len(offs) - 1)
    few = pairs_of[doc] <= PAIRS
    # in parts, so that no more than PAIRS pairs and those of one document are held
    part = np.cumsum(np.where(pairs_of <= PAIRS, pairs_of, 0)) // PAIRS
    for k in np.unique(part[doc[few]]) if few.any() else ():
        some = np.flatnonzero(few & (part[doc] == k))
        which, seed = expanded(lo[some], n[some])
        owner = doc[some[which]]
        out += _tiled(seeds, owner, table.item[seed], at[index[some[which]]] - tokens.first[owner], table.place[seed], coverage)
    for d in np.unique(doc[~few]):
        mine = np.flatnonzero(doc == d)
        value, where, times = np.unique(hashes[index[mine]], return_index=True, return_counts=True)
        first = mine[where]
        which, seed = expanded(lo[first], n[first])  # a place of an item is met once, so these are no more than the seeds
        for item in np.unique(table.item[seed]):
            own = table.item[seed] == item
            need = coverage * seeds.tokens[item]
            if _most(np.unique(table.place[seed[own]]), width) < need:
                continue
            if times[which[own]].sum() <= PAIRS:
                hit = np.flatnonzero(np.isin(hashes[index[mine]], value[which[own]]))
                there = {}
                for w, p in zip(which[own].tolist(), table.place[seed[own]].tolist(), strict=True):
                    there.setdefault(value[w], []).append(p)
                lists = [there[h] for h in hashes[index[mine[hit]]]]
                sizes = np.array([len(x) for x in lists])
                tiles = tile(np.concatenate(lists), np.repeat(at[index[mine[hit]]] - tokens.first[d], sizes), width)
            else:
                tiles = tile_by_bisection(seeds.items.of(item), tokens.of(d), width)
            covered = sum(t[2] for t in tiles)
            if covered >= need:
                out.append((int(d), int(item), covered, len(tiles)))
    return out


def _tiled(seeds: Seeds, doc: np.ndarray, item: np.ndarray, token: np.ndarray, place: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """contaminated() for seed pairs: places (token) in documents and places in items."""
    order = np.lexsort((item, doc))
    doc, item, token, place = doc[order], item[order], token[order], place[order]
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
    out = []
    for lo, hi in zip(np.append(0, cut), np.append(cut, len(doc)), strict=True):
        need = coverage * seeds.tokens[item[lo]]
        if _most(np.unique(place[lo:hi]), seeds.width) < need:
            continue
        tiles = tile(place[lo:hi], token[lo:hi], seeds.width)
        covered = sum(t[2] for t in tiles)
        if covered >= need:
            out.append((int(doc[lo]), int(item[lo]), covered, len(tiles)))
    return out


def _finder(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                found = contaminated(seeds, data, offs, coverage)
                if found:
                    doc, item, covered, tiles = (np.array(x) for x in zip(*found, strict=True))
                    size = seeds.tokens[item]
                    arrays = [part.column(0).take(pa.array(doc)), pa.array([seeds.ids[i] for i in item], pa.int64()), pa.array(size), pa.array(covered), pa.array(tiles), pa.array(np.round(covered / size, 9))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage"])

    return run


def _cleaner(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            for part, data, offs in pieces(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, *_ in contaminated(seeds, data, offs, coverage)]] = False
                yield part.filter(pa.array(keep))

    return run


def blocks(benchmark: DataFrame) -> Iterator:
    """Broadcast seeds of the test items, BLOCK_BYTES of text at most in each (or one item)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    while n > 1:
        part = items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count("*").alias("items"))
        if not part.where((F.col("size") > BLOCK_BYTES) & (F.col("items") > 1)).head(1) or n > total:
            break
        n *= 2
    for k in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Seeds([r["item_id"] for r in rows], [r["text"] for r in rows]))


def decontamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The contaminated pairs: doc_id, item_id, item_tokens, covered_tokens, n_tiles, coverage."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = None
    for shared in blocks(benchmark):
        found = source.mapInArrow(_finder(shared, coverage), "doc_id long, item_id long, item_tokens long, covered_tokens long, n_tiles long, coverage double")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents, with all their columns, that no item contaminates. docs: a text column, any others."""
    ship(docs.sparkSession)
    for shared in blocks(benchmark):
        docs = docs.mapInArrow(_cleaner(shared, coverage), docs.schema)
    return docs
