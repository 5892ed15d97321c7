"""Without the folders of the corpus operators everything else still loads."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from foliospark import catalogue

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("foliospark/llm", "tests/llm"), ("foliospark/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in gone:
        at = tmp_path / "repo" / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False"], out.stderr


def test_nothing_in_the_library_imports_the_corpus_operators():
    for path in (ROOT / "foliospark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "foliospark.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
