"""Every registered query with SQL against DuckDB."""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, tables
from songsift.registry import load

# Full-size fits, which compare.py runs.
SLOW = {"forest_cv", "forest_best_params", "forest_accuracy", "model_comparison", "playlist_kmeans"}


@pytest.fixture(scope="module")
def db(sf_dir):
    return tables(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    ours = queries()[name](spark, sf_dir).toPandas()
    assert difference(ours, db.execute(oracle_sql()[name]).df()) is None


def test_every_query_of_the_catalogue_has_sql():
    assert set(load()) == {name for name, item in load().items() if item.sql}


def test_entry(spark, sf_dir):
    assert entry(spark).count() > 0


def test_the_rest_works_without_the_text_operators():
    code = (
        "import sys; sys.modules['songsift.llm'] = None; import __spark_entry__ as e;"
        "print(len(e.queries()), len(e.oracle_sql()))"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(load()))] * 2, done.stderr
