"""The library without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as entry
from sluicegate.plans import catalog
assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
import pkgutil, importlib, sluicegate
for m in pkgutil.walk_packages(sluicegate.__path__, "sluicegate."):
    importlib.import_module(m.name)
print("whole")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_alone(tmp_path, pipeline):
    tree = shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    if not pipeline:
        (tree / "corpus_pipeline.py").unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(tree)}
    got = subprocess.run([sys.executable, "-c", PROBE], cwd=tree, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip() == "whole", got.stderr
