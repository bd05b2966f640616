"""The rest imports and answers where the folders quillon/llm and tests/llm are gone, with corpus_pipeline.py there or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e, quillon.catalogue as c
assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.SQL), sorted(e.queries())
"""


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("left", [True, False])
def test_rest_stands_alone(tmp_path, pipeline, left):
    """left: a folder with compiled files alone stays behind."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    if left:
        (tmp_path / "repo/quillon/llm/__pycache__").mkdir(parents=True)
    if not pipeline:
        (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr
