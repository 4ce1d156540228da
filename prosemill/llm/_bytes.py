"""Vectorised work on whole Arrow text columns: words, lines and rolling hashes as numpy arrays.

Texts are handled as one UTF-8 buffer with document offsets, so no Python object is made per word.
Hashes are polynomials modulo 2**64 over random byte weights, followed by an avalanche step; prefix sums give
the hash of any span in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 200_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}

#: The space characters of the word pattern: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def power_table(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (or of the inverse base)."""
    table = _powers.get(inverse)
    if table is None or len(table) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        table = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        _powers[inverse] = table
    return table[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche, so that all bits of a hash can be used."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of spans [start, end) of a sequence of weights."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(weights * power_table(n)[:n], out=self.sums[1:])
        self.back = power_table(n, inverse=True)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # the length goes in as well, as a zero weight would be lost
        return mix(self.raw(start, end) + (np.asarray(end - start)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def rolling_bytes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_WEIGHT[data])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `limit` bytes of text each (one document at least), with buffer and offsets."""
    column = batch.column(batch.schema.get_field_index(text))
    data, offs = text_buffers(column)
    n, lo = batch.num_rows, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True, broken at document boundaries."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(keep)
    before[0], before[1:] = False, keep[:-1]
    after = np.empty_like(keep)
    after[-1], after[:-1] = False, keep[1:]
    inner = offs[(offs > 0) & (offs < len(keep))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the documents in a buffer."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        self.start, self.end = spans(~IS_SPACE[data], offs)
        #: word index at which each document begins; n + 1 entries
        self.first = np.searchsorted(self.start, offs, "left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return rolling_bytes(self.data).hash(self.start, self.end)

    def windows(self, width: int) -> np.ndarray:
        """Indices of words at which a window of `width` words of the same document starts."""
        index = np.arange(len(self.start))
        return index[index + width <= self.first[self.doc + 1]]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean array: which of n places lie in one of the spans."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    steps -= np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of whole values (or counts of True) over each document."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:], dtype=np.int64)
    return sums[offs[1:]] - sums[offs[:-1]]


def with_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a document."""
    return mix(hashes + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end and document of the \n-split lines, without an empty last one."""
    after = np.flatnonzero(data == 10) + 1
    begins = offs[:-1][np.diff(offs) > 0]
    start = np.union1d(begins, after[~np.isin(after, offs)])
    doc = np.searchsorted(offs, start, "right") - 1
    doc_end = offs[doc + 1]
    end = doc_end - (data[doc_end - 1] == 10) if len(start) else doc_end
    follows = np.append(doc[1:] == doc[:-1], False) if len(start) else np.zeros(0, bool)
    end = np.where(follows, np.append(start[1:], 0) - 1, end) if len(start) else end
    return start, end, doc


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True


def lower_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters in UTF-8."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    if len(low):
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += np.uint8(32)
    return low


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits; Latin-1 signs and general punctuation aren't letters."""
    keep = _LETTER[data]
    sign = np.flatnonzero(data == 0xC2)
    keep[sign] = False
    keep[sign[sign + 1 < len(data)] + 1] = False
    sign = np.flatnonzero(data == 0xE2)
    sign = sign[sign + 2 < len(data)]
    sign = sign[data[sign + 1] == 0x80]
    for k in range(3):
        keep[sign + k] = False
    return spans(keep, offs)


def place_key(doc_id: np.ndarray, crc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of a place, for the filter of places."""
    x = mix(doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + crc.astype(np.uint64))
    return mix(x + start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def place_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place_key of rows of (doc_id, crc, start)."""
    for batch in batches:
        a, b, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(signed(place_key(a, b, c)))], ["place"])
