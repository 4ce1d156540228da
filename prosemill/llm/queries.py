"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.decontamination import decontamination
from prosemill.llm.near_dedup import near_duplicates
from prosemill.llm.packing import pack
from prosemill.llm.pii import pii
from prosemill.llm.quality import quality
from prosemill.llm.sharding import shard
from prosemill.llm.substring_dedup import substring_dedup
from prosemill.llm.suffix_dedup import suffix_dedup
from prosemill.llm.toxicity import toxicity
from prosemill.llm.warc import warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality(table(spark, sf_dir, "documents"), trusted)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added_tokens=True)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_toxicity, op3_quality, op4_warc, op5_pii, op6_decontamination, op7_sharding, op8_substring_dedup, op9_suffix_dedup, op10_packing)}
ORACLES = {
    "op8_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        low AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
        gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM (SELECT doc_id, i FROM win JOIN low USING (h) WHERE least < doc_id), range(0, 50) AS r(k) GROUP BY doc_id),
        kept AS (SELECT d.doc_id, len(w) AS n, CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS v FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n AS n_words, n - len(v) AS n_removed, sha256(array_to_string(v, ' ')) AS kept_sha256 FROM kept
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        f AS (SELECT html, min(page_id) AS first_page FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html)
        SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN f.first_page < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_page < p.page_id THEN f.first_page END AS refers_to, p.url AS target_uri
        FROM p LEFT JOIN f ON p.html = f.html
    """,
}
