"""The driver's entry module without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import logging; logging.disable()
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert "cq02_top_interactions" in names and set(sql) <= set(names) and len(names) > 100
assert "pipeline" not in names and not any(n[2:3].isdigit() and n.startswith("op") for n in names)
"""


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for path in gone:
        target = copy / path
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, env=env, check=True, timeout=120)
