"""Every query with SQL against DuckDB on the smallest tables, where they exist."""

import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from amalgam import queries

SF = os.environ.get("AMALGAM_TEST_DATA", "/root/testdata/sf0.001")


def rows(columns, data):
    def say(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(say(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["normalize_claims", "extract_foreign_json", "extract_note_files", "normalize_hints", "extract_resume_files"])
def test_rows_of_one_row_group_go_to_all_cores(spark, name):
    # the table has one row group, so it is read by one task; what is made of it is not
    made = queries.QUERIES[name](spark, SF)
    column = "source" if name == "normalize_claims" else "path"
    if name == "normalize_claims":
        # its records are a table, written by the tasks that made them
        assert len(made.inputFiles()) >= spark.sparkContext.defaultParallelism
    else:
        assert made.groupBy(F.spark_partition_id().alias("task")).agg(F.count(column)).count() >= spark.sparkContext.defaultParallelism


def test_entry_survives_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True).stdout.split()
    assert out == [str(len(queries.QUERIES)), "0", "True"]
