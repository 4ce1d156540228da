"""Long texts cut into passages at sentence boundaries, as a native fold over each text's sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.sources.staging import exploded, fresh

MIN_WORDS, MAX_WORDS = 75, 520
TARGET_WORDS, MIN_TAIL = 200, 75


def pieces(text: Column, max_words: int = MAX_WORDS) -> Column:
    """array<struct<text, n>>: sentences with their word counts, each counted once; a longer one is cut into windows of words."""

    def counted(s: Column) -> Column:
        return F.struct(s.alias("text"), T.count_words(s).alias("n"))

    def cut(piece: Column) -> Column:
        return F.when(piece["n"] > max_words, F.transform(T.word_windows(piece["text"], max_words), counted)).otherwise(F.array(piece))

    return F.flatten(F.transform(F.transform(T.sentences(text), counted), cut))


def cuts(counts: Column, goal_of) -> Column:
    """struct<done: array<struct<first, size, n>>, first, size, n>: passages as ranges of pieces, and the open one at the end.

    A passage closes before a piece that would overshoot its goal by more than it falls short. The fold goes over numbers only.
    """
    start = F.struct(F.array().cast("array<struct<first:int,size:int,n:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).alias("n"))

    def step(state: Column, n: Column) -> Column:
        goal = goal_of(F.size(state["done"]))
        closes = (state["size"] > 0) & (state["n"] + n - goal > goal - state["n"])
        passage = F.struct(state["first"].alias("first"), state["size"].alias("size"), state["n"].alias("n"))
        return F.when(closes, F.struct(F.concat(state["done"], F.array(passage)).alias("done"), (state["first"] + state["size"]).alias("first"), F.lit(1).alias("size"), n.alias("n"))).otherwise(
            F.struct(state["done"].alias("done"), state["first"].alias("first"), (state["size"] + 1).alias("size"), (state["n"] + n).alias("n"))
        )

    return F.aggregate(counts, start, step)


def passages(rows: DataFrame, text: Column, goal_of, output: str, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows with output, array<struct<text, n>>: whole sentences until the goal is best met; a tail under min_words is dropped. goal_of: passage number (Column) -> words."""
    found, at = fresh(rows, "_pieces", "_cuts")
    rows = rows.withColumn(found, pieces(text, max_words))
    rows = rows.withColumn(at, cuts(F.col(found)["n"], goal_of))
    state = F.col(at)
    tail = F.struct(state["first"].alias("first"), state["size"].alias("size"), state["n"].alias("n"))
    ranges = F.when((state["size"] > 0) & (state["n"] >= min_words), F.concat(state["done"], F.array(tail))).otherwise(state["done"])
    texts = F.col(found)["text"]
    return rows.withColumn(output, F.transform(ranges, lambda r: F.struct(F.array_join(F.slice(texts, r["first"] + 1, r["size"]), " ").alias("text"), r["n"].alias("n")))).drop(found, at)


def clipped(words: Column, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> Column:
    return F.greatest(F.lit(min_words), F.least(F.lit(max_words), words))


def hashed_goal(targets: list[int], key: Column, seed: int = 42, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS):
    """A goal drawn from the target word counts by a hash of text key and passage number: the same on any cluster."""
    goals = F.array(*(clipped(F.lit(int(t)), min_words, max_words) for t in targets))
    return lambda i: F.element_at(goals, (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(len(targets))) + 1).cast("int"))


def target_quantiles(ai_rows: DataFrame, steps: int = 200) -> list[int]:
    """Word counts of AI texts as a bounded table of quantiles to draw goals from."""
    found = ai_rows.select(T.count_words(F.col("text")).alias("n")).agg(F.percentile_approx("n", [i / steps for i in range(steps + 1)], 10_000)).first()[0]
    return list(found or [])


def chunk_passages(essays: DataFrame, targets: list[int], seed: int = 42, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """id, text, subject, chunk_idx. essays: id, text, subject."""
    goal = hashed_goal(targets, F.col("id"), seed, min_words, max_words)
    cut = passages(essays.select("id", "text", "subject"), F.coalesce("text", F.lit("")), goal, "_passages", min_words, max_words)
    return exploded(cut, F.col("_passages"), "chunk_idx", "p").select("id", F.col("p.text").alias("text"), "subject", "chunk_idx")


def chunk_fixed_goal(essays: DataFrame, goal: int, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """id, chunk_idx, text, words: passages of one goal. essays: id, text."""
    cut = passages(essays.select("id", "text"), F.coalesce("text", F.lit("")), lambda i: F.lit(goal), "_passages", min_words, max_words)
    return exploded(cut, F.col("_passages"), "chunk_idx", "p").select("id", "chunk_idx", F.col("p.text").alias("text"), F.col("p.n").alias("words"))


def split_passages(rows: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """The rows with passages: the whole text up to MAX_WORDS words, else passages of about TARGET_WORDS, a short last one merged."""
    whole, cut, total = fresh(rows, "_whole", "_cut", "_total")
    rows = rows.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn(total, T.count_words(F.col(whole)))
    # a text that stays whole has no pieces to count
    rows = passages(rows, F.when(F.col(total) > MAX_WORDS, F.col(whole)), lambda i: F.lit(TARGET_WORDS), cut, 1)
    n = F.size(cut)
    last, before = F.element_at(cut, -1), F.when(n > 1, F.element_at(cut, -2))
    merged = F.concat(F.slice(cut, 1, n - 2), F.array(F.struct(F.concat_ws(" ", before["text"], last["text"]).alias("text"), (before["n"] + last["n"]).alias("n"))))
    parts = F.when((n > 1) & (last["n"] < MIN_TAIL), merged).otherwise(F.col(cut))
    alone = F.array(F.struct(F.col(whole).alias("text"), F.col(total).alias("n")))
    return rows.withColumn("passages", F.when(F.col(total) <= MAX_WORDS, alone).otherwise(parts)).drop(whole, cut, total)
