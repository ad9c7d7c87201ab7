"""Every registered query that has SQL gives the same rows as DuckDB."""

import check
import pytest

from raresift import queries

# Whole experiments; covered by test_models.py and test_protocol.py on a small table.
HEAVY = ("j3", "j7")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_matches_sql(spark, duck, sf, name):
    rows, error = check.compare(spark, duck, sf, queries.QUERIES[name], queries.ORACLES[name])
    assert error is None, error


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and not n.startswith(HEAVY)])
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports, and offers the other queries, where raresift/llm is deleted, with or without the pipeline's file."""
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(os.path.join(repo, "raresift"), copy / "raresift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(repo, "__spark_entry__.py"), copy)
        if pipeline and os.path.exists(os.path.join(repo, "corpus_pipeline.py")):
            shutil.copy(os.path.join(repo, "corpus_pipeline.py"), copy)
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
        assert out.stdout.split() == [str(len(queries.QUERIES)), "False", "False"], out.stderr[-1000:]
