import os
import shutil
import subprocess
import sys

from tests.conftest import HERE


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_everything_else_works_without_the_corpus_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(HERE, tmp_path / "r", ignore=skip)
    for empty in (False, True):
        if empty:
            os.makedirs(tmp_path / "r/tidemark/llm")
        code = "import __spark_entry__ as e; assert 'k1_bars' in e.queries() and not any(k.startswith('op') for k in e.queries())"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=env, check=True)


def test_the_flagship_query(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.columns == ["symbol", "label", "n", "mean_return"] and got.count() > 0
