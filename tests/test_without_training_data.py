"""The core works where the training-data operators are not installed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LOAD = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_core_alone(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for gone in (copy / "quarry" / "llm", copy / "tests" / "llm"):
        shutil.rmtree(gone, ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    for args in (["-c", LOAD], ["-m", "pytest", "--collect-only", "-q", "tests"]):
        done = subprocess.run([sys.executable, *args], cwd=copy, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stdout + done.stderr
