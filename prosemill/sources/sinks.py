"""Writers of tables, split assignments and models."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import strip_surrogate_characters
from prosemill.operators.splitting import label_proportions
from prosemill.sources.staging import drop_staged, staged  # noqa: F401


def _clean(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: strip_surrogate_characters(F.col(c)) for c, kind in rows.dtypes if kind == "string"})


def output_path(folder: str, name: str, sample_size: int | None = None) -> str:
    """A sample's file says so in its name."""
    return f"{folder}/{name}_sample_{sample_size}" if sample_size else f"{folder}/{name}"


def write_csv(rows: DataFrame, path: str) -> None:
    """UTF-8 without surrogates, replacing what is there. White space stays at the ends of texts, and an empty text is quoted, a null isn't."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""', "nullValue": ""}
    _clean(rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').options(**kept).csv(path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = _clean(rows).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_split(assigned: DataFrame, path: str) -> None:
    """The assignment partitioned by split, and the shares of labels in each split."""
    write_table(assigned, f"{path}/assignments", ["split"])
    write_table(label_proportions(assigned), f"{path}/summary")


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The assignment, or one split of it, from its partition; an error if nothing was written."""
    rows = spark.read.parquet(f"{path}/assignments")
    return rows.where(F.col("split") == split) if split else rows


def write_features(rows: DataFrame, names: list[str], path: str) -> None:
    """Feature rows, with the features' names beside them."""
    write_table(rows, f"{path}/rows")
    spark = rows.sparkSession
    write_table(spark.createDataFrame(list(enumerate(names)), "idx int, feature string"), f"{path}/names")


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The rows and the features' names in order."""
    names = spark.read.parquet(f"{path}/names").orderBy("idx").collect()  # a row per feature
    return spark.read.parquet(f"{path}/rows"), [r["feature"] for r in names]


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def save_search(search, path: str) -> None:
    """The kept model, and a table of all settings with their scores, best first."""
    save_model(search.model, f"{path}/model")
    rows = [(k, json.dumps(r["params"], sort_keys=True), float(r["score"]), float(r["val_score"]) if "val_score" in r else None, r["params"] == search.chosen["params"]) for k, r in enumerate(search.rows)]
    write_table(search_table(rows), f"{path}/settings")


def search_table(rows: list[tuple]) -> DataFrame:
    return SparkSession.active().createDataFrame(rows, "rank int, params string, score double, val_score double, selected boolean")


def load_search(spark: SparkSession, path: str):
    """The kept model and the table of settings."""
    from pyspark.ml.classification import GBTClassificationModel

    return GBTClassificationModel.load(f"{path}/model"), spark.read.parquet(f"{path}/settings")


def embed(rows: DataFrame, encoder: Callable[[Column], Column], path: str, parts: int = 16) -> DataFrame:
    """Embeddings of the rows as a table at path, written part by part: a run that was stopped goes on with the rows that aren't there yet.

    rows: row_id (unique), text. A part is one write, so a row is there once or not at all. Blank texts get the encoder's vector of an empty text.
    """
    spark = rows.sparkSession
    wanted = rows.select("row_id", F.coalesce("text", F.lit("")).alias("text"))
    for part in range(parts):
        folder = f"{path}/part={part}"
        if exists(spark, f"{folder}/_SUCCESS"):
            continue
        mine = wanted.where(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == part)
        mine.select("row_id", encoder(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*(f"{path}/part={part}" for part in range(parts)))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_reports(reports: dict[str, DataFrame], path: str) -> list[str]:
    """One CSV folder for each report table, replacing what is there; their names."""
    for name, rows in reports.items():
        write_csv(rows, f"{path}/{name}")
    return sorted(reports)
