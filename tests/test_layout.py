"""The rest of the repository works without the training-data subpackage, and row numbers hold on larger tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from prosemill.operators import combine

ROOT = Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and not [n for n in q if n.startswith('op') or n == 'pipeline'], sorted(q); assert set(o) <= set(q); print('fine')"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "prosemill" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


@pytest.mark.parametrize("partitions", [6, 40])
def test_row_numbers_are_gapless(spark, partitions):
    rows = spark.range(1_500_000).selectExpr("id * 7919 % 1500000 as k", "id % 3 as tie").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = combine.numbered(rows, ["k"])
        got = out.selectExpr("count(*) n", "count(distinct row_id) d", "min(row_id) lo", "max(row_id) hi", "count_if(row_id <> k) wrong").first()
        assert got[:] == (1_500_000, 1_500_000, 0, 1_499_999, 0)
        tied = combine.numbered(rows.select("tie"), ["tie"])  # a third of the rows are equal in the order
        assert tied.selectExpr("count(distinct row_id) d", "max(row_id) hi", "count_if(row_id div 500000 <> tie) wrong").first()[:] == (1_500_000, 1_499_999, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_public_names():
    import prosemill

    assert len(prosemill.__all__) > 80 and all(callable(getattr(prosemill, name)) for name in prosemill.__all__)
    with pytest.raises(AttributeError):
        prosemill.nothing
