"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from prose_spark.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_and_sql_agree(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == canonical(want.columns, want.fetchall())


def test_the_rest_imports_without_the_optional_folders():
    import subprocess
    import sys

    code = "import sys; sys.modules['prose_spark.llm'] = None; import __spark_entry__ as e; assert 'document_metrics' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
