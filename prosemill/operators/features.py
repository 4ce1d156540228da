"""Stylometric, embedding, fused and TF-IDF features.

Providers stand for models that aren't here: an annotator gives tokens with heads and parts of speech, an encoder gives
vectors. Without an annotator the syntactic columns are null, never made up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from prosemill.functions import text as T
from prosemill.sources.staging import fresh, staged

LEXICAL = ("ttr", "hapax_legomena_ratio", "avg_word_length", "function_word_ratio")
SYNTACTIC = ("pos_noun_ratio", "pos_adj_ratio", "pos_verb_ratio", "pos_adv_ratio", "avg_dependency_length", "mean_parse_tree_depth")
MAX_DEPTH = 10_000


def syntactic_features(tokens: Column) -> dict[str, Column]:
    """From array<struct<i, head, pos, dep>> in order of i; a root is its own head."""
    content = F.filter(tokens, lambda t: t["pos"].isin("NOUN", "VERB", "ADJ", "ADV"))

    def pos(tag: str) -> Column:
        return F.size(F.filter(content, lambda t: t["pos"] == tag)) / F.greatest(F.size(content), F.lit(1))

    bound = F.filter(tokens, lambda t: (t["dep"] != "ROOT") & (t["head"] != t["i"]))
    length = F.aggregate(bound, F.lit(0), lambda s, t: s + F.abs(t["i"] - t["head"])) / F.greatest(F.size(bound), F.lit(1))
    words = F.filter(tokens, lambda t: t["pos"] != "SPACE")
    heads = F.transform(tokens, lambda t: t["head"])
    # depths by doubling: jump[i] is the ancestor 2^k steps up and far[i] the steps to it; 14 doublings pass MAX_DEPTH
    state = F.struct(heads.alias("jump"), F.transform(tokens, lambda t: (t["head"] != t["i"]).cast("int")).alias("far"))
    rounds = F.sequence(F.lit(1), F.least(F.lit(14), F.ceil(F.log2(F.greatest(F.size(tokens), F.lit(2)))).cast("int") + 1))

    def double(s: Column, _: Column) -> Column:
        far = F.transform(s["far"], lambda d, i: d + F.get(s["far"], F.get(s["jump"], i)))
        return F.struct(F.transform(s["jump"], lambda j: F.get(s["jump"], j)).alias("jump"), far.alias("far"))

    depth = F.aggregate(rounds, state, double, lambda s: s["far"])
    summed = T.let(depth, lambda d: F.aggregate(words, F.lit(0), lambda s, t: s + F.least(F.get(d, t["i"]), F.lit(MAX_DEPTH))))
    return {
        "pos_noun_ratio": pos("NOUN"),
        "pos_adj_ratio": pos("ADJ"),
        "pos_verb_ratio": pos("VERB"),
        "pos_adv_ratio": pos("ADV"),
        "avg_dependency_length": F.coalesce(length, F.lit(0.0)),
        "mean_parse_tree_depth": F.coalesce(summed / F.greatest(F.size(words), F.lit(1)), F.lit(0.0)),
    }


def style_features(rows: DataFrame, text: str = "text", annotator: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows with LEXICAL and SYNTACTIC columns; all 0 for a text without alphabetic tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = rows.withColumn("_lexical", T.lexical_struct(t))
    out = found.withColumns({k: F.col("_lexical")[k].cast("float") for k in LEXICAL}).drop("_lexical")
    if annotator is None:
        return out.withColumns({k: F.lit(None).cast("float") for k in SYNTACTIC})
    tagged = out.withColumn("_tokens", annotator(t))
    has_words = t.rlike(r"\p{L}")
    return tagged.withColumns({k: F.when(has_words, v).otherwise(F.lit(0.0)).cast("float") for k, v in syntactic_features(F.col("_tokens")).items()}).drop("_tokens")


def joined_embeddings(rows: DataFrame, vectors: DataFrame, size: int, missing: str = "error") -> DataFrame:
    """The default encoder: vectors computed elsewhere, by row_id. Blank texts get zeros; other rows without a vector are an error, or zeros if missing="zeros"."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    blank = F.length(T.strip(F.coalesce("text", F.lit("")))) == 0 if "text" in rows.columns else F.lit(False)
    (found,) = fresh(rows, "_found")
    joined = rows.drop("embedding").join(vectors.select("row_id", F.col("embedding").alias(found)), "row_id", "left")
    lost = F.raise_error(F.concat(F.lit("no vector for row "), F.col("row_id").cast("string"))).cast("array<float>")
    absent = F.when(blank, zeros).otherwise(zeros if missing == "zeros" else lost)
    return joined.withColumn("embedding", F.when(F.col(found).isNotNull(), F.col(found)).otherwise(absent)).drop(found)


def encoder_udf(make_predict: Callable, size: int, batch_size: int = 16) -> Callable[[Column], Column]:
    """An encoder loaded once per Python worker; make_predict returns a function from a batch of texts to an array (n, size)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)


def fused(style: DataFrame, vectors: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    """row_id and the style columns followed by the embedding as one vector; an error where one of the two lacks a row, when it is met. One join."""
    in_style, in_vectors = fresh(style, "_style", "_vectors")
    left, right = style.withColumn(in_style, F.lit(True)), vectors.select("row_id", "embedding", F.lit(True).alias(in_vectors))
    both = left.join(right, "row_id", "full_outer")
    gap = F.raise_error(F.concat(F.lit("the feature tables have different rows: "), F.col("row_id").cast("string")))
    checked = both.withColumn("embedding", F.when(F.col(in_style) & F.col(in_vectors), F.col("embedding")).otherwise(gap.cast(vectors.schema["embedding"].dataType)))
    ready = checked.withColumn("_vector", array_to_vector("embedding")).fillna(0.0, subset=names).drop(in_style, in_vectors)
    return VectorAssembler(inputCols=[*names, "_vector"], outputCol=output).transform(ready).drop("_vector", "embedding")


class TfidfModel:
    """A fitted TF-IDF: vocabulary and inverse document frequencies of the training texts, applied to any rows."""

    def __init__(self, counter, idf):
        self.counter, self.idf = counter, idf

    @property
    def vocabulary(self) -> list[str]:
        return self.counter.vocabulary

    @staticmethod
    def fit(train: DataFrame, max_terms: int = 10_000, min_df: int = 2) -> TfidfModel:
        """Words and pairs of the train rows only. train: text."""
        from pyspark.ml.feature import IDF, CountVectorizer

        counted = _counted(train)
        counter = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_terms, minDF=float(min_df)).fit(counted)
        return TfidfModel(counter, IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(counted)))

    def transform(self, rows: DataFrame, output: str = "tfidf") -> DataFrame:
        """The rows, written, with a sparse vector: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length. Only terms that a row holds are touched."""
        from pyspark.ml.linalg import VectorUDT

        counts = self.idf.transform(self.counter.transform(_counted(rows)))
        tf, scaled = F.unwrap_udt("_tf"), F.unwrap_udt("_idf")  # scaled: tf * ln((1 + n) / (1 + df)), at the same places
        weights = F.transform(tf["values"], lambda c, i: (1 + F.log(c)) * (F.get(scaled["values"], i) / c + 1))

        def unit(w: Column) -> Column:
            norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
            return F.transform(w, lambda x: x / norm)

        vector = F.struct(F.lit(0).cast("byte").alias("type"), tf["size"].alias("size"), tf["indices"].alias("indices"), T.let(weights, unit).alias("values"))
        plain = counts.withColumn(output, vector).drop("_terms", "_tf", "_idf")
        held = staged(plain, "tfidf")
        # a vector is stored as this struct, so it is read as one
        schema = StructType([StructField(f.name, VectorUDT() if f.name == output else f.dataType, True) for f in held.schema])
        return rows.sparkSession.read.schema(schema).parquet(held._staged_path)

    def save(self, path: str) -> None:
        self.counter.write().overwrite().save(f"{path}/counter")
        self.idf.write().overwrite().save(f"{path}/idf")

    @staticmethod
    def load(path: str) -> TfidfModel:
        from pyspark.ml.feature import CountVectorizerModel, IDFModel

        return TfidfModel(CountVectorizerModel.load(f"{path}/counter"), IDFModel.load(f"{path}/idf"))


def _counted(rows: DataFrame) -> DataFrame:
    from prosemill.operators.linking import terms, untagged

    return rows.withColumn("_terms", terms(untagged(F.col("text")), None, True))
