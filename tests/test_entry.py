"""The driver contract, with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_training_data_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "lodestack"), tmp_path / "lodestack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=120, check=False).returncode == 0
