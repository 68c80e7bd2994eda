"""Every query with SQL gives DuckDB's rows; every other query gives rows; all run with the operators of llm absent too."""

import os
import shutil
import subprocess
import sys

import pytest

from krigora import registry

from .compare import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    """A whole copy less krigora/llm and tests/llm, with and without corpus_pipeline.py."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=env, check=True, timeout=120)
