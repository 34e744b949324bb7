"""The library and its entry points work without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LEFT_OUT = ("linkloom/llm", "tests/llm", "corpus_pipeline.py", ".git")


@pytest.mark.parametrize("kept", ["", "corpus_pipeline.py"])
def test_the_rest_imports_alone(tmp_path, kept):
    def ignore(folder, names):
        inside = os.path.relpath(folder, ROOT)
        return [n for n in names if n == "__pycache__" or (p := os.path.normpath(f"{inside}/{n}")) in LEFT_OUT and p != kept]

    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    code = (
        "import __spark_entry__ as e, bench, checks.compare, linkloom.plans.refresh, linkloom.streaming.feeds, linkloom.sources.pagestore;"
        "q = e.queries(); assert q and not [n for n in q if n == 'pipeline' or n.startswith('op') and n[2].isdigit()];"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
