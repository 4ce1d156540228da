"""Operator 10, packing: best-fit decreasing into fixed windows.

Documents are tokenised (plus an end id), overlong ones are first cut into full windows, and the pieces are packed by
best-fit decreasing. Pieces of one length are interchangeable, so the packing is decided exactly on the histogram of
lengths (at most `window` rows, whatever the corpus): for each length from the longest down, a segment tree indexed by
remaining capacity finds the tightest open sequences, which are filled run by run. The decisions are a bounded table of
runs; each piece finds its place from its length and its rank among the pieces of that length. Ranks come from counts
per (task, length), so no length is ever gathered in one task.

Nulls: a null text is an empty one, which is a piece holding the end id alone. Rows with equal ids or texts are packed
one by one; of pieces of one length any may take the place of another. A very long text is encoded whole and cut into full
windows. An empty table gives an empty result. Extra columns are ignored, whatever their names.

With added_tokens, a literal added token of the file in a text (such as <|endoftext|>) gets its own id, as the tokenizers
library does by default; without, it is split like other text.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm._spark import ship, staged

WINDOW = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the split pattern of byte-level BPE.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _sample() -> str:
    """Text on which two encoders must agree: contractions, numbers, spaces of all kinds, emoji, combining marks, and words of every script in the first planes."""
    spaces = "".join(f"a{s * n}b{s * n}\n" for s in " \t\n\r\u00a0\u2003\u3000\u200b" for n in (1, 2, 3, 17))
    words = " ".join("".join(map(chr, range(at, at + 9))) for at in (*range(0x21, 0xD7F0, 61), *range(0xE000, 0x20000, 487)))
    signs = "I'm you're it's we'll they'd don't I'VE 'tis 3'd x''s 12 1234567890 1,234.56 ٣٤٥ ²³ Ⅷ ½ a1b2 _x_ __init__ --- ... !?!? <|endoftext|> <|im_start|> http://a.b/c?d=e&f=%20 $x^2$ {\"k\": [1, -2e9]}"
    emoji = "\U0001f600" * 40 + "\U0001f468\u200d\U0001f469\u200d\U0001f467 \U0001f1e9\U0001f1ea e\u0301\u0302 \ufeff\ufffd \x00\x01\x7f\x85"
    return "\n".join((signs, spaces, words, emoji, "ab" * 300, "z" * 1000, "9" * 300, " " * 500, "=" * 400)) + "  "


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of texts as little-endian uint32 bytes, as the tokenizers library gives them for the file.

    For plain byte-level BPE the same vocabulary is run by tiktoken, which is several times faster; a sample is compared
    with the tokenizers library first, and that library does all the work if the two differ. With added_tokens, it also
    encodes the texts that hold an added token.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.added_tokens = path, added_tokens
        self.tokenizer = self._library()
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]] if added_tokens else []
        self.fast, sample = self._fast(spec), _sample()
        for content in self.added:
            sample = sample.replace(content, "")
        if self.fast and self.fast.encode_ordinary(sample) != self.tokenizer.encode(sample, add_special_tokens=False).ids:
            self.fast = None
        if self.fast:
            self.tokenizer = None  # a worker needs one of them, unless it meets an added token

    def _library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = not self.added_tokens
        return tokenizer

    @staticmethod
    def _fast(spec: dict):
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or model["type"] != "BPE":
            return None
        import tiktoken

        special = {t["content"] for t in spec["added_tokens"]}
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and not any(content in text for content in self.added):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        self.tokenizer = self.tokenizer or self._library()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added_tokens: bool) -> Encoder:
    if (path, added_tokens) not in _encoders:
        _encoders[path, added_tokens] = Encoder(path, added_tokens)
    return _encoders[path, added_tokens]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def _cutter(tokenizer: str, window: int, end_id: int, with_ids: bool, added_tokens: bool):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, added_tokens).encode, TaskContext.get().partitionId()
        nth = [0] * (window + 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                rows, held = [], []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + tail
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        size = len(piece) // 4
                        rows.append((doc_id, start, size, zlib.crc32(piece), total, part, nth[size]))
                        held.append(piece)
                        nth[size] += 1
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in held], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0..window: which of them have open sequences."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of `need` or more that is open."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], window: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset): best-fit decreasing on a histogram of lengths."""
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first sequence, sequences)
    tree, opened = CapacityTree(window), 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            free.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in range(window, 0, -1):
        left, rank = counts.get(length, 0), 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                # as many new ones as the rest needs; each is filled before the next one opens
                capacity, first, there = window, opened, -(-left // (window // length))
                opened += there
            else:
                first, there = free[capacity].pop()
                if not free[capacity]:
                    del free[capacity]
                    tree.set(capacity, False)
            each = capacity // length
            full = min(there, left // each)
            for layer in range(each if full else 0):
                runs.append((length, rank, full, first, window - capacity + layer * length))
                rank += full
            put(capacity - each * length, first, full)
            left, first, there = left - each * full, first + full, there - full
            if there and left:  # the last one takes fewer; left < each
                for layer in range(left):
                    runs.append((length, rank, 1, first, window - capacity + layer * length))
                    rank += 1
                put(capacity - left * length, first, 1)
                first, there, left = first + 1, there - 1, 0
            put(capacity, first, there)
    return np.array(runs, np.int64).reshape(-1, 5)


def _placer(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = np.frombuffer(shared.value, np.int64).reshape(-1, 5)
        key = (runs[:, 0] << 48) + runs[:, 1]
        order = np.argsort(key)
        runs, key = runs[order], key[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rank = get["rank"].to_numpy(zero_copy_only=False).astype(np.int64)
            length = get["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            run_of = runs[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            get["sequence_id"] = pa.array(run_of[:, 3] + rank - run_of[:, 1])
            get["offset"] = pa.array(run_of[:, 4])
            yield pa.RecordBatch.from_arrays([get[n] for n in names], names)

    return run


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = 0, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    spark = ship(docs.sparkSession)
    schema = PIECE + (", ids array<int>" if with_ids else "")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = staged(source.mapInArrow(_cutter(tokenizer or default_tokenizer(), window, end_id, with_ids, added_tokens), schema), "pieces")
    per_task = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    shared = spark.sparkContext.broadcast(plan(counts, window).tobytes())
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    names = [x.split()[0] for x in out.split(", ")]
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "base", "nth")
    return ranked.mapInArrow(_placer(shared, names), out)
