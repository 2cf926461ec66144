"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from lexspark import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sql, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(map(tuple, frame.select(columns).collect()), key=repr)
    assert found
    if name in queries.ORACLES:
        relation = sql.sql(queries.ORACLES[name])
        assert sorted(relation.columns) == columns
        assert found == sorted(relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["e4_truncate_left", "e4_truncate_right", "n1_sequence", "n7_prepend"])
def test_queries_over_texts_without_characters(spark, tmp_path, name):
    texts = ["", None, "a", "x" * 16, "x" * 17, " ", "the land of the sea, " * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    relation = connection.sql(queries.ORACLES[name]).select(*[duckdb.ColumnExpression(c) for c in frame.columns])
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(relation.fetchall(), key=repr)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "lexspark.llm", "corpus_pipeline", "xxhash"])
def test_entry_works_without_the_optional_parts(missing):
    """In a fresh interpreter where one module cannot be imported, the engine's queries are all there."""
    import subprocess
    import sys

    code = f"""
import sys, warnings
warnings.simplefilter('ignore')
sys.modules[{missing!r}] = None
import __spark_entry__ as e
from lexspark import queries
assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
assert 'pipeline' not in e.queries()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
