"""Queries against their SQL on documents of odd texts: empty ones, nulls, white space at the ends, quotes and line breaks."""

import pytest
from test_queries import ordered

import __spark_entry__ as entry

TEXTS = [None, "", " ", "\n", "a ", " a\t", "\r\n", "a\r\nb\r", 'say "so", then\n', '"', "\\", "null", "NaN", "Zoë saw it ", "plain text"]


def agrees(spark, folder, name, texts):
    """Whether a query gives the rows of its SQL on documents of these texts."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, text, ("en", "de")[i % 2], f"src{i % 3}", len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    want = duckdb.connect().execute(entry.oracle_sql()[name].replace("FROM documents", f"FROM read_parquet('{folder}/documents.parquet/*.parquet')"))
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(folder))
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.select(*(f"`{c}`" for c in columns)).collect()) == ordered(want.fetchall())


def test_csv_keeps_odd_texts(spark, tmp_path):
    agrees(spark, tmp_path, "csv_scan", TEXTS)


def test_xml_counts_files_without_text(spark, tmp_path):
    agrees(spark, tmp_path, "xml_ingest", TEXTS)


def test_xml_summary_counts_files_without_text(spark, tmp_path):
    agrees(spark, tmp_path, "xml_summary", TEXTS)


def test_tfidf_weights_take_all_terms(spark, tmp_path):
    many = " ".join(f"w{i}" for i in range(60_010))
    agrees(spark, tmp_path, "tfidf_weights", [many, "few words", f"{many} w1 w2", "few other words", "few " * 3, "w5 words"])


def test_link_sends_human_rows_in_rounds(spark, tmp_path, monkeypatch):
    """With pieces and tiles of a few rows the link is that of the SQL, and no vector is written more than once."""
    from prosemill.operators import linking

    for name, value in {"TILE": 4, "ENTRIES": 40, "PRODUCTS": 3, "TERMS": 2}.items():
        monkeypatch.setattr(linking, name, value)
    written = []
    monkeypatch.setattr(linking, "staged", lambda df, name, plain=linking.staged: (out := plain(df, name), written.append((name, out.count(), out.select(linking.F.countDistinct("row_id")).first()[0])))[0])
    words = [f"word{i}" for i in range(12)]
    texts = [" ".join(words[(i * k) % 12] for k in range(3 + i % 4)) for i in range(60)] + ["", "nothing shared", None]
    agrees(spark, tmp_path, "link_originals", texts)
    assert [w[0] for w in written] == ["terms", "vectors"] and all(n == ids for _, n, ids in written)


def test_lexical_features_by_the_token(spark, tmp_path):
    """ASCII texts are taken in lower case as a whole, others token by token; the features are those of the SQL."""
    agrees(spark, tmp_path, "lexical_features", ["", " ", "12 !", "One one TWO two three", "a a b", "Zoë zoë ZOË the x", "the The THE", "it's it is", "x", "é"])
    from prosemill.functions import text as T

    plan = spark.createDataFrame([("a b a",)], "t string").select(T.lexical_struct(T.F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan  # a fold over every token was most of the time of detection
