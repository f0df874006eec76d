"""The library without the training-data operators: the rest imports and answers."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys, types
import __spark_entry__ as entry
assert not any(m.startswith("sparkwell.llm") or m == "corpus_pipeline" for m in sys.modules)
assert not any(k == "pipeline" or (k.startswith("op") and k[2].isdigit()) for k in entry.queries())
assert len(entry.queries()) >= 30
import pkgutil, importlib, sparkwell
for m in pkgutil.walk_packages(sparkwell.__path__, "sparkwell."):
    importlib.import_module(m.name)
"""


@pytest.mark.parametrize("gone", [("sparkwell/llm", "tests/llm"), ("sparkwell/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_imports(tmp_path, gone):
    copy = str(tmp_path / "repo")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = os.path.join(copy, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)
    env = os.environ | {"PYTHONPATH": copy, "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
