"""The library works where the training-data operators have been removed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import re
import __spark_entry__ as e
assert len(e.queries()) == len(e.oracle_sql()) > 50, len(e.queries())
assert not any(re.match(r"op\\d+_|pipeline", n) for n in e.queries())
"""


def test_entry_without_the_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.txt"))
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, check=True)
    (copy / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, check=True)


def test_nothing_else_imports_them():
    for file in (ROOT / "xylem").rglob("*.py"):
        if "llm" not in file.parts:
            assert "xylem.llm" not in file.read_text(), file
